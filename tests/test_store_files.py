"""Footers as a table, the sink that commits all or nothing, and a store's integrity by its files."""

from __future__ import annotations

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sources
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone import commands, contracts
from lodestone.errors import Unsupported, VerificationFailure
from lodestone.operators import store
from lodestone.schemas import TABLES
from lodestone.sources.parquet_store import footers, write_checked


def _files(folder):
    return sorted(os.path.relpath(os.path.join(top, f), folder) for top, dirs, fs in os.walk(folder) for f in [*fs, *dirs])


def test_footers_say_what_the_data_hold(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("t"), F.array(F.col("id").cast("double")).alias("a.b"), F.struct("id").alias("s"))
    df.repartition(3).write.parquet(str(tmp_path / "x"))
    got = footers(spark, str(tmp_path / "x"), str(tmp_path / "none")).groupBy("column", "type").agg(F.sum("rows").alias("n"), F.sum("nulls").alias("nulls"), F.countDistinct("file").alias("files")).collect()
    assert {tuple(r) for r in got} == {("id", "bigint", 100, 0, 3), ("t", "string", 100, 25, 3), ("a.b", "array<double>", 100, None, 3), ("s", "struct<id:bigint>", 100, None, 3)}
    (tmp_path / "bad.parquet").write_bytes(b"PAR1")
    assert footers(spark, str(tmp_path / "bad.parquet")).select(F.col("error").isNotNull(), "column").collect() == [(True, None)]


def test_sink_writes_all_or_nothing(spark, tmp_path):
    target = str(tmp_path / "t.parquet")
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("v")).repartition(8)
    write_checked(df, target, ["id"], ["id"])
    assert spark.read.parquet(target).count() == 1000 and all(f.startswith("part-") for f in os.listdir(target))
    before = _files(tmp_path)
    late = df.withColumn("v", F.when(F.col("id") == 977, F.lit(None)).otherwise(F.col("v")))
    for rows, rule in ((late, "null in v"), (df.union(df.where("id = 5")), "repeated id"), (df.withColumn("v", F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).otherwise(F.col("v"))), "boom")):
        for path in (target, str(tmp_path / "new.parquet")):
            with pytest.raises(PySparkException, match=rule):
                write_checked(rows, path, ["id", "v"], ["id"])
        assert _files(tmp_path) == before  # neither files nor folders are left
    nulls = spark.createDataFrame([(None, 1), (None, 2)], "k string, x int")
    write_checked(nulls, str(tmp_path / "nulls.parquet"), [], ["k"])
    write_checked(nulls.limit(0), str(tmp_path / "none.parquet"), ["k"], ["k"])
    assert spark.read.parquet(str(tmp_path / "nulls.parquet")).count() == 2 and spark.read.parquet(str(tmp_path / "none.parquet")).schema == nulls.schema


def test_a_store_with_a_null_or_a_repeated_key_is_refused(spark, tmp_path):
    runs = spark.createDataFrame([("a", None)], "run_id string, name string")
    full = lambda df: df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES["runs"]))
    for rows, rule in ((runs, "runs: null in name"), (runs.fillna("x").union(runs.fillna("y")), "runs: repeated run_id")):
        with pytest.raises(Unsupported, match=rule):
            store.create(spark, str(tmp_path / "out"), {"runs": full(rows)})
        assert not (tmp_path / "out" / "store" / "runs.parquet").exists()
    assert store.create(spark, str(tmp_path / "good"), {"runs": full(runs.fillna("x"))})["runs"] == 1


def _replace(folder, change):
    (name,) = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    table = pq.read_table(folder / name)
    pq.write_table(change(table), folder / name)


FAULTS = {
    "other_type: predictions: val_score": lambda s: _replace(s / "predictions.parquet", lambda t: t.set_column(t.column_names.index("val_score"), "val_score", t["val_score"].cast(pa.string()))),
    "missing_column: chains: steps": lambda s: _replace(s / "chains.parquet", lambda t: t.drop_columns(["steps"])),
    "unknown_column: runs: more": lambda s: _replace(s / "runs.parquet", lambda t: t.append_column("more", pa.nulls(t.num_rows, pa.int64()))),
    "null_in_required: pipelines: name": lambda s: _replace(s / "pipelines.parquet", lambda t: t.set_column(t.column_names.index("name"), "name", pa.nulls(t.num_rows, pa.string()))),
    "unreadable_file: logs": lambda s: [(s / "logs.parquet" / f).write_bytes((s / "logs.parquet" / f).read_bytes()[:-9]) for f in os.listdir(s / "logs.parquet")],
    "missing_table: artifacts": lambda s: [os.remove(s / "artifacts.parquet" / f) for f in os.listdir(s / "artifacts.parquet")],
    "other_version": lambda s: (s / "version.json").write_text('{"user_version": 1}'),
    "other_version ": lambda s: os.remove(s / "version.json"),
}


@pytest.fixture(scope="module")
def migrated(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("store")
    commands.migrate(spark, str(sources.legacy_store(top / "in")), str(top / "out"))
    return top / "out"


@pytest.mark.parametrize("fault", FAULTS)
def test_each_fault_of_a_store_is_one_finding(spark, tmp_path, migrated, fault):
    import shutil

    out = tmp_path / "out"
    shutil.copytree(migrated, out)
    assert store.integrity(spark, str(out)).count() == 0
    FAULTS[fault](out / "store")
    (found,) = store.integrity(spark, str(out)).collect()
    assert ": ".join(x for x in (found.finding, found.table, found.column) if x) == fault.strip()
    with pytest.raises(VerificationFailure, match="store"):
        commands.verify(spark, str(out), str(out / contracts.NAMES["manifest"]), str(tmp_path / "report.json"))
    told = json.loads((tmp_path / "report.json").read_text())["verification_summary"]["checks"]["store"]
    assert told["failure_count"] == 1 and told["files"][0].startswith(found.finding)
