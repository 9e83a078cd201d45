from __future__ import annotations

import hashlib
import json
import os

import pytest
import sources
from pyspark.sql import functions as F

from lodestone import commands, contracts, policy
from lodestone.cli import main
from lodestone.errors import PolicyRefusal, SourceChanged, Unsupported, VerificationFailure
from lodestone.functions import values as v
from lodestone.operators import lowering, store
from lodestone.operators.detect import detect, detect_tree, version_parts
from lodestone.sources import documents, sqlite_ro
from lodestone.sources.filetree import listing, scan

# Digests that the two rows and the audit lines of the documented store must have.
ROWS = {
    "pred-old-pls-val": "sha256:112438ce3dae9807dd717d768096e787419977c22e8dc5f1dd615bd8e2fd19d0",
    "pred-old-svm-test": "sha256:b61c6a80f92c43fb43322ca71ef0a0dcba8b4e30e8e33c7b34f49e1f0cd38cd3",
}
LINES = "sha256:2fd39c42493dd6583ff5458217dcae877c3cb0522f7719aa1e66019c90fef8b1"


def run(spark, source, output, **options):
    code = commands.migrate(spark, str(source), str(output), **options)
    return code, json.loads((output / contracts.NAMES["manifest"]).read_text())


def test_legacy_store_gives_the_documented_digests(spark, tmp_path):
    src = sources.legacy_store(tmp_path / "in")
    before = listing(str(src))
    code, doc = run(spark, src, tmp_path / "out", verify_after=True)
    assert code == 0 and listing(str(src)) == before
    assert {k[7:]: d for k, d in doc["checksums"].items() if k.startswith("arrays:")} == ROWS
    assert doc["checksums"]["preserved/prediction_arrays.jsonl"] == LINES
    assert sorted(os.listdir(tmp_path / "out" / "arrays")) == ["corn-lot-2024.parquet", "field_block_7.parquet"]
    svm = spark.read.parquet(str(tmp_path / "out" / "arrays" / "field_block_7.parquet")).first()
    assert svm.y_proba_shape == [4, 2] and len(svm.y_proba) == 8
    tables = store.load(spark, str(tmp_path / "out"))
    assert {t: df.count() for t, df in tables.items()} == {"projects": 1, "runs": 1, "pipelines": 2, "chains": 2, "predictions": 2, "artifacts": 0, "logs": 0}
    assert tables["chains"].where("chain_id = 'cl'").first().preprocessings is None  # an explicit null stays
    assert tables["chains"].first().fold_strategy == "per_fold"
    assert spark.sql("select count(*) from v_chain_summary").first()[0] == 2 and len(store.chain_summary(tables).columns) == 28


@pytest.mark.parametrize("cell", ["[32.0,31.4]", "[32.0,NaN,31.0]", "{}", "[[1,2],[3"])
def test_broken_arrays_are_kept_as_lines_or_refused(spark, tmp_path, cell):
    src = sources.legacy_store(tmp_path / "in", cell)
    code, doc = run(spark, src, tmp_path / "out", verify_after=True)
    assert code == 10 and not [k for k in doc["checksums"] if k.startswith("arrays:")]
    with pytest.raises(Unsupported):
        run(spark, src, tmp_path / "strict", strict=True)
    assert not (tmp_path / "strict").exists()


def test_loose_record(spark, tmp_path):
    code, doc = run(spark, sources.loose(tmp_path / "in"), tmp_path / "out", verify_after=True)
    tables = store.load(spark, str(tmp_path / "out"))
    chain = tables["chains"].first()
    parts = json.dumps(["run-a1", "pipe-b2", "Ridge", "Ridge"], separators=(",", ":"))
    assert code == 0 and chain.chain_id == "chain-" + hashlib.sha256(parts.encode()).hexdigest()[:24]
    assert chain.steps == '["detrend","Ridge"]' and chain.model_step_idx == 1
    prediction = tables["predictions"].first()
    assert prediction.scores == '{"a":{"é":2},"b":1.0}' and prediction.n_samples == 3
    assert tables["runs"].first().config == '{"prediction_file":"run_predictions.json","source_kind":"loose-predictions"}'


@pytest.mark.parametrize(
    "change",
    [{"run_id": 3}, {"run_id": ""}, {"dataset": ...}, {"y_pred": [1.0]}, {"y_true": []}, {"weights": [1.0]}, {"y_true": [[1.0], [2.0], [3.0]]}, {"val_score": "x"}, {"sample_indices": [0, 1, 2**40]}, {"y_true": [1, None, 2]}],
)
def test_broken_loose_records_are_kept(spark, tmp_path, change):
    code, doc = run(spark, sources.loose(tmp_path / "in", **change), tmp_path / "out", verify_after=True)
    assert code == 10 and doc["unsupported"][0]["disposition"] == "preserved"
    assert store.load(spark, str(tmp_path / "out"))["runs"].count() == 0


def test_nonfinite_loose_record_is_refused(spark, tmp_path):
    with pytest.raises(Unsupported):
        run(spark, sources.loose(tmp_path / "in", y_pred=[1.0, float("nan"), 2.0]), tmp_path / "out")
    assert not (tmp_path / "out").exists()


def test_many_loose_records_at_once(spark):
    texts = [(f"{i}_predictions.json", json.dumps(sources.LOOSE | {"prediction_id": f"p{i}", "fold_id": f"f{i % 3}"})) for i in range(20)] + [("bad", "[1]"), ("worse", "{")]
    rows = lowering.loose_rows(spark.createDataFrame(texts, "prediction_file string, text string"))
    out = lowering.lower_loose(rows, "now")
    assert rows.where("violation is not null").count() == 2
    assert {t: df.count() for t, df in out.tables.items()} == {"runs": 1, "pipelines": 1, "chains": 1, "predictions": 20}


def test_legacy_run(spark, tmp_path):
    code, doc = run(spark, sources.legacy_run(tmp_path / "in"), tmp_path / "out", verify_after=True)
    assert len(doc["preserved_opaque"]) == 2
    assert store.load(spark, str(tmp_path / "out"))["predictions"].count() == 1
    other = sources.legacy_run(tmp_path / "other", "Another")
    with pytest.raises(Unsupported, match="model_name"):
        run(spark, other, tmp_path / "strict", strict=True)
    code, doc = run(spark, other, tmp_path / "kept", verify_after=True)
    assert code == 10 and len(doc["preserved_opaque"]) == 2


def test_native(spark, tmp_path):
    code, doc = run(spark, sources.native(tmp_path / "in"), tmp_path / "out", verify_after=True)
    t = {k: df.collect() for k, df in store.load(spark, str(tmp_path / "out")).items()}
    assert code == 0 and [len(t[k]) for k in ("runs", "pipelines", "chains", "predictions", "artifacts")] == [1, 2, 2, 3, 2]
    first = next(p for p in t["pipelines"] if p.name == "c1")
    assert first.best_val == 0.5 and first.metric == "rmse"  # of the first row, not the best
    parts = json.dumps(["run-n", 0, "d", "c1", "m", "val", "0", ""], separators=(",", ":"))
    assert "prediction-" + hashlib.sha256(parts.encode()).hexdigest()[:24] in {p.prediction_id for p in t["predictions"]}
    assert sum(k.startswith("arrays:") for k in doc["checksums"]) == 2
    assert {a.content_hash for a in t["artifacts"] if a.artifact_id == "a"} == {"sha256:ff"}


@pytest.mark.parametrize("change", [{"shape": [2, 1]}, {"engine": "x"}, {"num_predictions": 9}, {"score_set_hash": "0"}, {"run_id": ""}])
def test_broken_native_results_are_kept(spark, tmp_path, change):
    code, doc = run(spark, sources.native(tmp_path / "in", **change), tmp_path / "out", verify_after=True)
    assert code == 10 and len(doc["preserved_opaque"]) == 1
    with pytest.raises(Unsupported):
        run(spark, tmp_path / "in", tmp_path / "strict", strict=True)


def test_detection(spark, tmp_path):
    src = sources.legacy_store(sources.loose(sources.legacy_run(tmp_path / "in")))
    (src / "store.duckdb").write_text("x")
    sources.bundle(src / "model.n4a")
    (src / "model.n4a.py").write_text("x")
    sources.native(src / "nat")
    kinds = [a.kind for a in detect(str(src))]
    assert kinds == ["duckdb-workspace", "sqlite-workspace-legacy-arrays", "fs-runs-legacy", "loose-predictions", "n4a-bundle", "n4a-py-bundle", "native-results-v1"]
    tree = spark.createDataFrame([("a", e[0]) for e in listing(str(src))], "root string, rel_path string")
    assert {r.source_kind for r in detect_tree(tree).collect()} == set(kinds) - {"sqlite-workspace-legacy-arrays"} | {"sqlite-workspace-v2"}
    assert version_parts("1.0.x.2") == [1, 0] and [a.forward for a in detect(str(sources.bundle(tmp_path / "b.n4a", "1.0.1")))] == [True]
    assert detect(str(tmp_path / "none"))[0].kind == "unknown"


def test_forward_versions_and_paths_are_refused(spark, tmp_path):
    src = tmp_path / "b" / "m.n4a"
    sources.bundle(src, "2.0")
    with pytest.raises(Unsupported):
        run(spark, src, tmp_path / "out")
    good = sources.loose(tmp_path / "in")
    for output in (good, good / "sub", tmp_path):
        with pytest.raises(PolicyRefusal):
            run(spark, good, output)
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "x").write_text("x")
    with pytest.raises(PolicyRefusal):
        run(spark, good, tmp_path / "full")
    policy.require_disjoint(str(tmp_path / "ab"), str(tmp_path / "abc"))


def test_guard_sees_an_edit_of_equal_size_and_time(spark, tmp_path):
    f = tmp_path / "in" / "x"
    f.parent.mkdir()
    f.write_text("aa")
    stat = f.stat()
    with pytest.raises(SourceChanged):
        with policy.guarded(spark, str(f.parent)):
            f.write_text("bb")
            os.utime(f, ns=(stat.st_atime_ns, stat.st_mtime_ns))


def test_copy_only_and_dry_run(spark, tmp_path, capsys):
    src = sources.legacy_run(tmp_path / "in")
    code, doc = run(spark, src, tmp_path / "out", copy_only=True, verify_after=True)
    assert code == 0 and len(doc["checksums"]) == 2
    assert commands.migrate(spark, str(src), str(tmp_path / "dry"), dry_run=True) == 0 and not (tmp_path / "dry").exists()
    assert json.loads(capsys.readouterr().out)["unsupported_counts"]["preserved"] == 0


def _edit(doc_path, change):
    doc = json.loads(doc_path.read_text())
    change(doc)
    doc_path.write_text(json.dumps(doc))


MUTATIONS = {
    "files": lambda out: (out / "preserved/prediction_arrays.jsonl").write_text("x"),
    "orphans": lambda out: (out / "extra").write_text("x"),
    "arrays": lambda out: _edit(out / contracts.NAMES["manifest"], lambda d: d["checksums"].__setitem__("arrays:pred-old-pls-val", "sha256:0")),
    "preserved": lambda out: _edit(out / contracts.NAMES["manifest"], lambda d: d["preserved_opaque"].__setitem__(0, d["preserved_opaque"][0] | {"checksum": "sha256:0"})),
    "preserved_twice": lambda out: _edit(out / contracts.NAMES["manifest"], lambda d: d["preserved_opaque"].append(d["preserved_opaque"][0])),
    "preserved_outside": lambda out: _edit(out / contracts.NAMES["manifest"], lambda d: d["preserved_opaque"].append({"path": "../x", "checksum": "y"})),
    "preserved_list": lambda out: _edit(out / contracts.NAMES["manifest"], lambda d: d.__setitem__("preserved_opaque", 3)),
    "arrays_missing": lambda out: _edit(out / contracts.NAMES["manifest"], lambda d: d["checksums"].__setitem__("arrays:none", "sha256:0")),
    "arrays_unlisted": lambda out: _edit(out / contracts.NAMES["manifest"], lambda d: d["checksums"].pop("arrays:pred-old-svm-test")),
}


@pytest.mark.parametrize("name", MUTATIONS)
def test_one_change_fails_one_check(spark, tmp_path, name, capsys):
    src = sources.legacy_store(tmp_path / "in")
    sources.native(src / "nat")
    out = tmp_path / "out"
    assert run(spark, src, out)[0] == 10
    manifest = str(out / contracts.NAMES["manifest"])
    assert commands.verify(spark, str(out), manifest) == 0
    MUTATIONS[name](out)
    with pytest.raises(VerificationFailure):
        commands.verify(spark, str(out), manifest, str(out / contracts.NAMES["report"]))
    found = json.loads((out / contracts.NAMES["report"]).read_text())["verification_summary"]["checks"]
    assert [k for k, c in found.items() if c["failure_count"]] == [name.split("_")[0]]


def test_cli_exit_codes(spark, tmp_path, capsys):
    src = sources.loose(tmp_path / "in")
    assert main(["inspect", str(src)], spark) == 0 and main(["inspect", str(tmp_path / "no"), "--format", "text"], spark) == 20
    assert main(["migrate", str(src), "--output", str(tmp_path / "out"), "--verify"], spark) == 0
    assert main(["verify", str(tmp_path / "out"), "--manifest", str(tmp_path / "out" / contracts.NAMES["manifest"])], spark) == 0
    assert main(["verify", str(tmp_path / "out"), "--manifest", str(tmp_path / "none")], spark) == 20
    assert main(["migrate", str(src), "--output", str(src)], spark) == 40 and main(["migrate"], spark) == 2
    assert "cause" in capsys.readouterr().err


def test_sources(spark, tmp_path):
    src = sources.legacy_store(tmp_path / "in")
    path = str(src / "store.sqlite")
    assert sqlite_ro.load(spark, path, mode="probe").first().user_version == 2
    assert sqlite_ro.load(spark, path, mode="catalog").where("table = 'runs'").count() == 6
    assert sqlite_ro.load(spark, path, "predictions", ["prediction_id", "val_score"]).columns == ["prediction_id", "val_score", "_ordinal"]
    assert not list(src.glob("*-wal")) and sqlite_ro.probe(str(src / "none")) == (None, [])
    with pytest.raises(Unsupported):
        documents.run_manifest("a:\n   b: c")
    tree = scan(spark, str(src)).collect()
    assert tree[0].sha256 == "sha256:" + hashlib.sha256((src / "store.sqlite").read_bytes()).hexdigest() and scan(spark, str(tmp_path / "no")).count() == 0


def test_canonical_json_is_as_python_writes_it(spark):
    import random

    r = random.Random(3)
    rows = [([r.choice([1e-5, 1e16, 0.1, 3.0, -0.0, 1e300, r.random()]) for _ in range(r.randint(0, 4))], r.choice(["é\u2028", '"\t\\', "x", ""]), r.choice([None, 7])) for _ in range(50)]
    df = spark.createDataFrame(rows, "b array<double>, a string, c long")
    for ascii_only in (True, False):
        for got, (b, a, c) in zip(df.select(v.canonical_json("b", "a", "c", ascii_only=ascii_only)).collect(), rows):
            assert got[0] == json.dumps({"a": a, "b": b, "c": c}, separators=(",", ":"), ensure_ascii=ascii_only)


def test_array_cells(spark):
    cells = [None, " ", "null", "[]", "[1, 2.5]", "[[1,2],[3,4]]", "x", "[1,null]"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    d = v.decode_array(F.col("c"))
    got = [tuple(r) for r in df.select(d, v.array_shape(F.col("c")), v.decode_failed(F.col("c"), d)).collect()]
    assert got[:3] == [(None, None, False)] * 3 and got[3] == ([], [0], False) and got[4] == ([1.0, 2.5], [2], False) and got[5] == ([1.0, 2.0, 3.0, 4.0], [2, 2], False)
    assert got[6][2] and got[7][2]
    deep = spark.createDataFrame([("[[[1,2],[3,4]],[[5,6],[7,8]]]",), ('["1.5",true]',), ("[[1,2],[3]]",)], "c string")
    assert [tuple(r) for r in deep.select(v.decode_array(F.col("c")), v.array_shape(F.col("c")), v.ragged(F.col("c"))).collect()] == [([float(i) for i in range(1, 9)], [2, 2, 2], False), ([1.5, 1.0], [2], False), ([1.0, 2.0, 3.0], [2, 2], True)]


def test_a_folder_beside_the_output_is_left_alone(spark, tmp_path):
    src = sources.loose(tmp_path / "out.partial")
    code, _ = run(spark, src, tmp_path / "out")
    assert code == 0 and listing(str(src)) and sorted(os.listdir(tmp_path)) == ["out", "out.partial"]


def test_resuming_removes_only_what_the_manifest_lists(spark, tmp_path):
    src = sources.legacy_store(tmp_path / "in")
    run(spark, src, tmp_path / "out")
    (tmp_path / "out" / "store" / "notes.txt").write_text("mine")
    code, doc = run(spark, src, tmp_path / "out", resume=True)
    assert code == 0 and (tmp_path / "out" / "store" / "notes.txt").read_text() == "mine"
    on_disk = {os.path.relpath(p, tmp_path / "out") for top, _, fs in os.walk(tmp_path / "out") for p in (os.path.join(top, f) for f in fs)}
    assert on_disk == {k for k in doc["checksums"] if not k.startswith("arrays:")} | set(contracts.NAMES.values()) | {"store/notes.txt"}


def test_sidecars_of_names_that_spark_escapes(spark, tmp_path):
    names = ["lot#3", "50%", "corn=a", "it's", "a[1]", "ü b", "x{y}"]
    rows = [(f"p{i}-{k}", n, "[1.0]", "[1.0]") for i, n in enumerate(names) for k in range(3)]
    records = lowering.array_records(spark.createDataFrame(rows, "prediction_id string, dataset_name string, y_true string, y_pred string").repartition(5))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 1)
    try:
        digests, listed = store.write_arrays(records, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(listed) == len(names) and sum(k.startswith("arrays:") for k in digests) == len(rows)
    for n in names:
        assert spark.read.parquet(str(tmp_path / "arrays" / f"{n.replace(' ', '_')}.parquet").replace("[", "\\[").replace("{", "\\{").replace("}", "\\}")).count() == 3


def test_versions_with_large_parts(spark):
    rows = [tuple(r) for r in spark.createDataFrame([("3000000000.1.2",), ("1.x.2",), ("9" * 45,)], "c string").select(v.version(F.col("c"))).collect()]
    assert [[int(p) for p in r[0]] for r in rows] == [[3000000000, 1, 2], [1], [10**38 - 1]]


def test_far_rowids_make_few_partitions(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "x.sqlite")
    con = sqlite3.connect(path)
    con.execute("create table t (a integer)")
    con.executemany("insert into t (rowid, a) values (?, ?)", [(1, 1), (2**60, 2)])
    con.commit()
    con.close()
    df = sqlite_ro.load(spark, path, "t")
    assert sorted(r.a for r in df.collect()) == [1, 2] and df.rdd.getNumPartitions() == 1


def test_repeated_loose_prediction_is_a_violation(spark):
    texts = [(f"{c}_predictions.json", json.dumps(sources.LOOSE)) for c in "ab"]
    out = lowering.lower_loose(lowering.loose_rows(spark.createDataFrame(texts, "prediction_file string, text string")), "now")
    assert lowering.violations_of(out.records) == {"prediction_id_repeated": 1} and out.tables["predictions"].count() == 1


@pytest.mark.parametrize("change", [{"y_true": ["32.5", True, 1]}, {"weights": ["1", 2, 0.5]}])
def test_castable_items_of_loose_records(spark, tmp_path, change):
    code, _ = run(spark, sources.loose(tmp_path / "in", **change), tmp_path / "out", verify_after=True)
    assert code == 0


def test_contract_documents(spark, tmp_path, capsys):
    ids = contracts.id_map()
    assert ids["$id"].endswith("legacy_id_map.v1.json") and set(ids["entities"]) == set(contracts.ENTITIES) and not any(ids["entities"].values())
    with pytest.raises(KeyError):
        contracts.new("report", no_such_field=1)
    src = sources.legacy_store(tmp_path / "in")
    sources.bundle(src / "model.n4a")
    run(spark, src, tmp_path / "out")
    doc, rep, unsupported, written = (json.loads((tmp_path / "out" / contracts.NAMES[k]).read_text()) for k in ("manifest", "report", "unsupported", "id_map"))
    assert written == ids and doc["tool"]["name"] == "lodestone" and doc["tool"]["completed_at"] and doc["environment"]["pyspark"]
    assert doc["output_inventory"][0]["row_counts"]["predictions"] == 2 and doc["output_inventory"][0]["generated_manifests"] == sorted(contracts.NAMES.values())
    assert rep["preserved_counts"]["n4a"] == 1 and rep["source_summary"]["bundles"] == 1 and rep["recommended_next_command"].startswith("lodestone verify ")
    assert unsupported["counts"] == {"unsupported": 1, "preserved": 1, "refused": 0, "opaque_payloads": 1} and unsupported["source"] == doc["source"] and unsupported["target"]["path"] == str(tmp_path / "out")
    assert main(["--version"], spark) == 0 and "lodestone" in capsys.readouterr().out


def test_copy_only_has_an_inventory(spark, tmp_path):
    _, doc = run(spark, sources.loose(tmp_path / "in"), tmp_path / "out", copy_only=True)
    assert doc["output_inventory"] == [contracts.output_entry("payload", {"files": 1})]


def test_core_queries_match_their_sql(same_as_sql):
    from lodestone import registry

    sql = registry.oracle_sql()
    for name, query in registry.queries().items():
        same_as_sql(query, sql[name])
