"""Plans, run manifests, ordered digests and arrays of any depth, for many sources or groups at once."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.errors import Unsupported
from lodestone.functions import values as v
from lodestone.operators import dispatch, folding, run_manifests
from lodestone.schemas import KINDS, PRESERVABLE
from lodestone.sources import documents


def _plain_plan(found):
    """(plan, refusal, main, dispositions) of one source's (seq, kind, newer)."""
    kinds = [k for _, k, _ in found]
    refusal = "nothing_known" if set(kinds) == {"unknown"} else "newer_version" if any(f for *_, f in found) else None
    if refusal:
        return "refuse", refusal, [False] * len(found), ["refused"] * len(found)
    if dispatch.STORE in kinds:
        how, main = "store", [i == kinds.index(dispatch.STORE) for i in range(len(kinds))]
    elif kinds in ([dispatch.NATIVE], [dispatch.LOOSE]):
        how, main = {dispatch.NATIVE: "native", dispatch.LOOSE: "loose"}[kinds[0]], [True]
    elif kinds.count(dispatch.RUN) == 1 and set(kinds) <= {dispatch.RUN, dispatch.LOOSE}:
        how, main = "run", [k == dispatch.RUN for k in kinds]
    else:
        how, main = "keep", [False] * len(kinds)
    return how, None, main, ["lowered" if m or how == "run" else "preserved" if k in PRESERVABLE else "ignored" for m, k in zip(main, kinds)]


def test_plans_of_many_roots_equal_a_plain_version(spark):
    r = random.Random(2)
    few = [dispatch.STORE, dispatch.NATIVE, dispatch.RUN, dispatch.LOOSE, "unknown", "n4a-bundle"]
    roots = {f"r{i}" if i else None: [(s, r.choice(few if i % 2 else KINDS), r.random() < 0.07) for s in range(r.choice([1, 1, 2, 3, 5]))] for i in range(300)}
    rows = [(root, s, k, f) for root, found in roots.items() for s, k, f in found]
    r.shuffle(rows)
    got = dispatch.plans(spark.createDataFrame(rows, "root string, seq int, source_kind string, forward_version boolean").repartition(5)).collect()
    assert len(got) == len(rows)
    for root, found in roots.items():
        plan, refusal, main, said = _plain_plan(found)
        own = sorted((x for x in got if x.root == root), key=lambda x: x.seq)
        assert [(x.plan, x.refusal) for x in own] == [(plan, refusal)] * len(found) and [x.main for x in own] == main and [x.disposition for x in own] == said
        assert {x.strict_refused for x in own} == {bool({"preserved", "refused"} & set(said))}


def test_run_manifests_as_tables_equal_the_parser(spark):
    r = random.Random(7)
    lines = ["run_id: a", "run_id: 'b c'", 'dataset: "x"', "model:", "  class: M", "  name: 'N'", "  name: O ", "preprocessing:", "  - snv", "  - 'de trend'", "  -", "predictions:", "  file: ../f.json", "# no", "  # no", "", "   ", "status: ok"]
    rare = ["engine:", "   deep: 1", "model: plain", "- item", "  - stray", "9: x", "a b: c", "\tkey: x", "  class:", "x:  y ", "k:v", "'"]
    texts = [("\r\n" if i % 3 == 0 else "\x0b" if i % 7 == 0 else "\n").join(r.choice(rare if r.random() < 0.06 else lines) for _ in range(r.randint(0, 12))) for i in range(400)] + [None]
    found = {x.name: x for x in run_manifests.manifests(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "name string, text string").repartition(4)).collect()}
    refused = 0
    for i, text in enumerate(texts):
        x = found.get(str(i))
        try:
            want = documents.run_manifest(text or "")
        except Unsupported as e:
            refused += 1
            assert x.bad_line == int(str(e).split()[1]), text
            continue
        if x is None:
            assert want == {}
            continue
        got = dict(x.fields) | {k: x[k] if isinstance(x[k], list) else dict(x[k]) for k in documents.SECTIONS if x[k] is not None}
        assert x.bad_line is None and got == want, text
    assert 50 < refused < 350


def test_digests_of_groups_are_folded_in_order(spark):
    r = random.Random(3)
    rows = [(r.choice([None, "a", "b"]), i * 7919 % 3001, r.choice([None, "", "é", "x" * 50])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, n int, t string").repartition(7)
    got = {x.g: x.digest for x in folding.folded_digest(df, ["g"], ["n"], F.col("t"), "<", "|", ">").collect()}
    want = {g: v.digest_of("<" + "|".join(t for k, _, t in sorted(rows, key=lambda x: x[1]) if k == g and t is not None) + ">") for g in (None, "a", "b")}
    assert got == want
    whole = folding.folded_digest(df, [], ["n"], F.col("t"), prefix="").collect()
    assert [x.digest for x in whole] == [hashlib.sha256("".join(t or "" for _, _, t in sorted(rows, key=lambda x: x[1])).encode()).hexdigest()]
    assert folding.folded_digest(df.limit(0), ["g"], ["n"], F.col("t")).collect() == folding.folded_digest(df.limit(0), [], ["n"], F.col("t")).collect() == []


def test_a_large_group_streams_in_batches(spark):
    df = spark.range(300_000).select("id", F.concat(F.col("id").cast("string"), F.repeat(F.lit("-"), 200)).alias("t"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        got = folding.folded_digest(df.repartition(8), [], ["id"], F.col("t"), prefix="").first().digest
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state = hashlib.sha256()
    for i in range(300_000):
        state.update(f"{i}{'-' * 200}".encode())
    assert got == state.hexdigest()


def _flat(x):
    return [z for y in x for z in _flat(y)] if isinstance(x, list) else [x]


def _shape(x):
    return [len(x), *(_shape(x[0]) if x else [])] if isinstance(x, list) else []


def test_arrays_of_any_depth_equal_a_plain_version(spark):
    r = random.Random(5)

    def make(depth):
        return [make(depth - 1) if depth and r.random() < 0.6 else r.choice([1, 2.5, -3e4, True, "7"]) for _ in range(r.randint(0, 4))]

    cells = [make(r.randint(0, 14)) for _ in range(300)] + [[1, [2, 3]], [[], [1]], [[[[[[[[[[[[1]]]]]]]]]]]], [[]], []]
    texts = [json.dumps(c, separators=r.choice([(",", ":"), (" , ", ": "), (",\n ", ":")])) for c in cells]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    for x in df.select("i", v.decode_array(F.col("c")).alias("d"), v.array_shape(F.col("c")).alias("s")).collect():
        assert x.d == [float(y) for y in _flat(cells[x.i])] and x.s == _shape(cells[x.i]), texts[x.i]


@pytest.mark.parametrize("cell", ["[[1,2],[3", "[1,,2]", '[[{"a":1}]]', '["x",[1]]', "[[1],null]", '[["[1]"]]', "7", "{}", "[1]]", "[1] [2]", "[1],[2]", "[1]],[[2]", "[1]},[2]", '[1],"b":[2]', "[[1]] x"])
def test_cells_that_are_no_arrays_of_numbers_fail(spark, cell):
    df = spark.createDataFrame([(cell,)], "c string")
    assert df.select(v.decode_failed(F.col("c"), v.decode_array(F.col("c")))).first()[0]


def test_booleans_are_told_as_words(spark):
    df = spark.createDataFrame([(True, None), (None, 2)], "b boolean, n int")
    assert [x[0] for x in df.select(v.first_filled(F.col("b"), F.col("n"))).collect()] == ["True", "2"]


def _plain_nodes(files):
    """Digest of each node of a tree {path: digest}, by (path, kind)."""
    out, dirs = {(p, "file"): d for p, d in files.items()}, {}
    for p in files:
        parts = p.split("/")
        for i in range(len(parts)):
            dirs.setdefault("/".join(parts[:i]), {})[(parts[i], "file" if i == len(parts) - 1 else "dir")] = "/".join(parts[: i + 1])
    for d in sorted(dirs, key=lambda d: (-d.count("/") if d else 1, d)):
        lines = [f"{k}:{n}:{out[(path, k)]}" for (n, k), path in sorted(dirs[d].items())]
        out[(d, "dir")] = v.digest_of("\n".join(lines))
    return out


def test_trees_are_compared_from_the_root(spark):
    from lodestone.operators.trees import tree_changes, tree_nodes

    r = random.Random(8)
    before = {"/".join(r.choice("abc") for _ in range(r.randint(1, 5))) + f"/{i}": f"d{i}" for i in range(120)} | {"top": "x", "swap": "y"}
    after = {p: d for p, d in before.items() if p != "swap"} | {"swap/in": "z", "new/dir/f": "n"}
    gone, edited = r.sample(sorted(after), 2)
    after.pop(gone)
    after[edited] = "edited"
    frame = lambda files: spark.createDataFrame([*files.items(), (None, "x"), ("null", None)], "path string, digest string").repartition(3)
    a, b = tree_nodes(frame(before)), tree_nodes(frame(after))
    for found, files in ((a, before), (b, after)):
        assert {(x.path, x.kind): x.digest for x in found.collect()} == _plain_nodes(files)
    old, new = _plain_nodes(before), _plain_nodes(after)
    want = {(p, k, "added" if (p, k) not in old else "removed" if (p, k) not in new else "changed") for p, k in {*old, *new} if old.get((p, k)) != new.get((p, k))}
    rows = tree_changes(a, b).collect()
    assert {(x.path, x.kind, x.change) for x in rows} == want and len(rows) == len(want)
    assert 0 < sum({x.depth: x.compared for x in rows}.values()) < len(old)
    assert tree_changes(a, a).collect() == [] and tree_changes(tree_nodes(frame({})), tree_nodes(frame({}))).collect() == []
    assert {(x.path, x.change) for x in tree_changes(tree_nodes(frame({})), tree_nodes(frame({"a/b": "1"}))).collect()} == {("", "added"), ("a", "added"), ("a/b", "added")}


def test_a_tree_listed_by_tasks_equals_the_listing(spark, tmp_path, monkeypatch):
    from lodestone.sources import filetree

    r = random.Random(1)
    for i in range(400):
        folder = tmp_path / "t" / "/".join(r.choice(["a", "b", "ü x"]) for _ in range(r.randint(0, 4)))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.txt").write_text("x" * (i % 7))
    (tmp_path / "t" / "empty").mkdir()
    (tmp_path / "t" / "loop").symlink_to(tmp_path / "t")
    (tmp_path / "t" / "gone").symlink_to(tmp_path / "nothing")
    monkeypatch.setattr(filetree, "ENTRIES", 3)
    root = str(tmp_path / "t")
    assert sorted(tuple(x) for x in filetree.walked(spark, root).collect()) == filetree.listing(root)
    assert sorted(filetree.scan(spark, root, by_tasks=True).collect()) == sorted(filetree.scan(spark, root).collect())
    for other in (root + "/0.txt", str(tmp_path / "nothing")):
        assert [tuple(x) for x in filetree.walked(spark, other).collect()] == filetree.listing(other)
