"""Writing a store: Parquet tables, array sidecars by dataset, audit lines; and checks over what was written."""

from __future__ import annotations

import glob
import hashlib
import json
import os
import re
import shutil
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SHAPE, Unsupported
from ..functions import values as v
from ..schemas import FOREIGN_KEYS, NATURAL_KEY, REQUIRED, SIDECAR, SUMMARY, TABLES, USER_VERSION
from ..sources.filetree import hash_file
from ..sources.parquet_store import BROKEN, footers, write_checked
from .relational import TASK_ROWS, key_violations, orphan_references, with_children

STORE, ARRAYS, PRESERVED = "store", "arrays", "preserved"


_ZSTD = {"compression": "zstd", "parquet.compression.codec.zstd.level": "3"}


def write_text(lines: DataFrame, target: str) -> None:
    """The one text column of lines as the single file target, in order of the partitions, which are written by tasks."""
    temp = f"{target}._parts"
    lines.write.text(temp)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "wb") as out:
        for part in sorted(glob.glob(f"{glob.escape(temp)}/part-*")):
            with open(part, "rb") as f:
                shutil.copyfileobj(f, out)
    shutil.rmtree(temp)


def create(spark: SparkSession, output: str, tables: dict[str, DataFrame] | None = None) -> dict[str, int]:
    """Writes all tables of the store, empty where none is given, with its version; returns the row counts.

    A null in a required column or a repeated key is refused before any file of the table is there.
    """
    for name, schema in TABLES.items():
        df = (tables or {}).get(name)
        if df is None:
            df = spark.createDataFrame([], schema)
        try:
            write_checked(df, os.path.join(output, STORE, f"{name}.parquet"), REQUIRED[name], [schema.names[0]])
        except PySparkException as e:
            if (rule := re.search(re.escape(BROKEN) + r"([^\n\"']+)", str(e))) is None:
                raise
            raise Unsupported(f"{name}: {rule[1]}", SHAPE) from e
    with open(os.path.join(output, STORE, "version.json"), "w", encoding="utf-8") as f:
        json.dump({"user_version": USER_VERSION}, f)
    return counts(load(spark, output))


def expected_columns(spark: SparkSession) -> DataFrame:
    """(table, column, type, required) of the store."""
    rows = [(t, f.name, f.dataType.simpleString(), f.name in REQUIRED[t]) for t, schema in TABLES.items() for f in schema.fields]
    return spark.createDataFrame(rows, "table string, column string, type string, required boolean")


def file_findings(said: DataFrame, versions: DataFrame, expected: DataFrame, version: int = USER_VERSION) -> DataFrame:
    """(finding, table, file, column): what the footers of a store's files, (table, footers' columns), show to be wrong.

    versions: (user_version), the store's markers; expected: (table, column, type, required). No row of data is read: types, lacking
    and unknown columns come from schemas, nulls in required columns from statistics.
    """
    good = said.where("error is null").groupBy("table", "file", "column", "type").agg(F.sum("nulls").alias("nulls"))
    files = good.select("table", "file").distinct()
    wanted = expected.select(F.col("table"), F.col("column"), F.col("type").alias("wanted"), "required")
    both = good.join(wanted, ["table", "column"])
    none = F.lit(None).cast("string")
    found = {
        "unreadable_file": said.where("error is not null").select("table", "file", none.alias("column")),
        "missing_table": wanted.join(said.select("table"), "table", "left_anti").select("table", none.alias("file"), none.alias("column")).distinct(),
        "missing_column": files.join(wanted, "table").join(good.select("file", "column"), ["file", "column"], "left_anti").select("table", "file", "column"),
        "unknown_column": good.join(wanted, ["table", "column"], "left_anti").select("table", "file", "column"),
        "other_type": both.where("type <> wanted").select("table", "file", "column"),
        "null_in_required": both.where("required and nulls > 0").select("table", "file", "column"),
        "other_version": versions.agg(F.count("*").alias("n"), F.count(F.when(F.col("user_version") == version, 1)).alias("right")).where("n = 0 or n <> right").select(none.alias("table"), none.alias("file"), none.alias("column")),
    }
    return reduce(DataFrame.union, (df.select(F.lit(k).alias("finding"), "table", "file", "column") for k, df in found.items()))


def integrity(spark: SparkSession, output: str) -> DataFrame:
    """file_findings() of the store below output."""
    base = os.path.join(output, STORE)
    said = footers(spark, *(os.path.join(base, f"{t}.parquet") for t in TABLES))
    table = F.regexp_extract("file", r"([^/]+)\.parquet/[^/]*$", 1)
    marker = os.path.join(base, "version.json")
    versions = spark.read.schema("user_version long").json(marker, multiLine=True) if os.path.isfile(marker) else spark.createDataFrame([], "user_version long")
    return file_findings(said.withColumn("table", table), versions, expected_columns(spark))


def load(spark: SparkSession, output: str) -> dict[str, DataFrame]:
    """The store's tables, also as temporary views, with the view v_chain_summary."""
    found = {name: spark.read.schema(schema).parquet(os.path.join(output, STORE, f"{name}.parquet")) for name, schema in TABLES.items()}
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    chain_summary(found).createOrReplaceTempView("v_chain_summary")
    return found


def count_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table, counted in one job."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t, df in tables.items()))


def counts(tables: dict[str, DataFrame]) -> dict[str, int]:
    return {r.name: r.n for r in count_rows(tables).collect()}


def chain_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Chains that have predictions, with their pipeline's run and status."""
    pipelines = tables["pipelines"].select("pipeline_id", "run_id", F.col("status").alias("pipeline_status"))
    return with_children(tables["chains"], pipelines, "pipeline_id", tables["predictions"], "chain_id", "chain_id").select(*SUMMARY, "run_id", "pipeline_status")


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, n): rows that break a null, key or reference rule of the store.

    Rows are counted first, so the tables are such as are cheap to read; those of more than TASK_ROWS are dealt out by their keys to more
    tasks the more rows there are, so what a task sorts or groups does not grow.
    """
    tasks = {t: n // TASK_ROWS + 1 for t, n in counts(tables).items()}
    dealt = lambda t, most, *by: tables[t].select(*by).repartition(most, *by) if most > 1 else tables[t]
    rules = []
    for t, df in tables.items():
        key = df.columns[0]
        rules.append((f"{t}: null in {', '.join(REQUIRED[t])}", df.where(" or ".join(f"`{c}` is null" for c in REQUIRED[t]))))
        rules.append((f"{t}: repeated {key}", key_violations(dealt(t, tasks[t], key), [key])))
    rules.append(("predictions: repeated natural key", key_violations(dealt("predictions", tasks["predictions"], *NATURAL_KEY), NATURAL_KEY)))
    for child, c, parent in FOREIGN_KEYS:
        most, key = max(tasks[child], tasks[parent]), tables[parent].columns[0]
        # references are counted before they meet the parents: those to one parent are one row
        named = dealt(child, most, c).groupBy(c).agg(F.count("*").alias("n"))
        rules.append((f"{child}: no {parent} of its {c}", orphan_references(named, c, dealt(parent, most, key), key)))
    of = {r: F.coalesce(F.sum("n"), F.lit(0)) if ": no " in r else F.count("*") for r, _ in rules}
    return reduce(DataFrame.union, (df.agg(of[r].alias("n")).select(F.lit(r).alias("rule"), "n") for r, df in rules)).where("n > 0")


def record_digests(records: DataFrame) -> DataFrame:
    """(prediction_id, digest): each sidecar record's canonical JSON, hashed."""
    return records.select("prediction_id", v.digest(v.canonical_json(*(F.col(c) for c in SIDECAR.names))).alias("digest"))


def write_arrays(records: DataFrame, output: str) -> tuple[dict[str, str], list[dict]]:
    """Sidecars, one file for each file name that datasets come to; returns digests by file and by record, and an inventory.

    Files are grouped by a digest of the name, as Spark would escape names in its folders.
    """
    bad = records.where("violation is not null").select("violation").limit(1).collect()
    if bad:
        raise Unsupported(f"array records break a rule: {bad[0][0]}", SHAPE)
    rows = records.select(*SIDECAR.names, v.file_name(F.col("dataset_name")).alias("dataset_file")).persist()
    temp = os.path.join(output, "._arrays")
    dealt = rows.withColumn("file_key", F.sha2("dataset_file", 256)).drop("dataset_file").repartition("file_key").sortWithinPartitions("file_key", "prediction_id")
    dealt.write.options(**_ZSTD).option("maxRecordsPerFile", 0).partitionBy("file_key").parquet(temp)
    digests, inventory = {}, []
    for name, n in sorted((r[0], r[1]) for r in rows.groupBy("dataset_file").count().collect()):
        rel = f"{ARRAYS}/{name}.parquet"
        os.makedirs(os.path.join(output, ARRAYS), exist_ok=True)
        (part,) = glob.glob(os.path.join(glob.escape(temp), f"file_key={hashlib.sha256(name.encode()).hexdigest()}", "part-*"))
        os.replace(part, os.path.join(output, rel))
        digests[rel] = hash_file(os.path.join(output, rel))
        inventory.append({"path": rel, "tables": {"arrays": SIDECAR.names}, "row_counts": {"arrays": n}, "generated_manifests": []})
    shutil.rmtree(temp, ignore_errors=True)
    digests |= {f"arrays:{r[0]}": r[1] for r in record_digests(rows).toLocalIterator()}
    rows.unpersist()
    return digests, inventory


def write_lines(lines: DataFrame, output: str, rel: str) -> dict[str, str]:
    """The audit lines in order of prediction_id as one file; returns its digest."""
    write_text(lines.orderBy("prediction_id").select("value"), os.path.join(output, rel))
    return {rel: hash_file(os.path.join(output, rel))}
