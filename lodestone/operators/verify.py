"""Checks of an output against its ledger, as joins of three small tables: ledger, files, sidecar records."""

from __future__ import annotations

import os
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import VERIFICATION, VerificationFailure
from ..functions import values as v
from ..schemas import SIDECAR
from ..sources.filetree import scan, unsafe
from . import store
from .folding import folded_digest
from .relational import mismatched, missing

ROWS = "arrays:"


def _list(df: DataFrame, column: str) -> list[str]:
    return sorted(r[0] for r in df.select(column).collect())


def ledger(spark: SparkSession, checksums: dict[str, str]) -> DataFrame:
    """(key, digest, is_row) of a ledger's entries."""
    return spark.createDataFrame([(k, str(d), k.startswith(ROWS)) for k, d in checksums.items()], "key string, digest string, is_row boolean")


def folder_digests(rows: DataFrame) -> DataFrame:
    """(path, digest): of each folder the digest of its files' digests, as a canonical JSON map of rows (path, key, digest)."""
    one = v.canonical_map(F.create_map("key", "digest"))
    return folded_digest(rows, ["path"], ["key"], F.substring(one, F.lit(2), F.char_length(one) - 2), "{", ",", "}")


def preserved_findings(preserved: DataFrame, files: DataFrame) -> DataFrame:
    """(finding, path, seq): what is wrong with preserved (seq, path, checksum), held against files (key, digest).

    A path is a file's, or a folder's whose files' digests, as a canonical JSON map, have that checksum. Folders are matched
    through each file's ancestors, by equality.
    """
    bad = preserved.where("path is null or path = '' or checksum is null or checksum = ''")
    good = preserved.join(bad.select("seq"), "seq", "left_anti").withColumn("n", F.row_number().over(_by_path()))
    again, once = good.where("n > 1"), good.where("n = 1")
    outside = once.where(unsafe(F.col("path")) | ~F.col("path").startswith(f"{store.PRESERVED}/"))
    once = once.join(outside.select("seq"), "seq", "left_anti")
    above = files.select("key", "digest", F.explode(v.ancestors(F.col("key"))).alias("path")).where("path <> key")
    folders = folder_digests(above.join(once.select("path"), "path", "left_semi")).withColumnRenamed("digest", "actual")
    actual = files.select(F.col("key").alias("path"), F.col("digest").alias("of_file")).join(folders, "path", "full_outer").select("path", F.coalesce("of_file", "actual").alias("actual"))
    held = once.join(actual, "path", "left")
    found = {"missing_checksums": held.where("actual is null"), "mismatched_payloads": held.where("actual <> checksum"), "duplicate_paths": again, "invalid_entries": bad, "outside_preserved": outside}
    return reduce(DataFrame.union, (df.select(F.lit(k).alias("finding"), "path", "seq") for k, df in found.items()))


def preserved_coverage(preserved: DataFrame, files: DataFrame, expected: int) -> dict[str, Any]:
    """preserved_findings() by kind, and how many of the expected payloads are not listed."""
    out: dict[str, Any] = {"missing_opaque_payloads": max(0, expected - preserved.count())}
    out |= {k: [] for k in ("missing_checksums", "mismatched_payloads", "duplicate_paths", "invalid_entries", "outside_preserved")}
    for r in preserved_findings(preserved, files).orderBy("path", "seq").collect():
        out[r.finding].append(f"[{r.seq}]" if r.finding == "invalid_entries" else r.path)
    return _rated(out)


def _by_path():
    from pyspark.sql import Window

    return Window.partitionBy("path").orderBy("seq")


def _rated(check: dict[str, Any]) -> dict[str, Any]:
    n = sum(x if isinstance(x, int) else len(x) for x in check.values())
    return {"status": "failed" if n else "passed", "failure_count": n, **check}


def array_findings(expected: DataFrame, actual: DataFrame, stored: DataFrame | None) -> DataFrame:
    """(finding, prediction_id): record digests (prediction_id, digest) held against the expected ones and the store's ids."""
    on = ["prediction_id"]
    once = actual.where("prediction_id is not null").dropDuplicates(on)
    found = {
        "missing_rows": missing(expected, once, on),
        "missing_row_checksums": missing(once, expected, on),
        "mismatched_rows": mismatched(expected, once, on, "digest"),
        "duplicate_rows": actual.groupBy(*on).count().where("prediction_id is not null and count > 1"),
    }
    if stored is not None:
        found["orphan_rows"] = missing(once, stored, on)
    return reduce(DataFrame.union, (df.select(F.lit(k).alias("finding"), *on) for k, df in found.items()))


def array_coverage(spark: SparkSession, output: str, book: DataFrame, stored: DataFrame | None) -> dict[str, Any]:
    """Checks the sidecars' records against the ledger's row digests and the store's prediction ids."""
    expected = book.where("is_row").select(F.expr(f"substring(key, {len(ROWS) + 1})").alias("prediction_id"), "digest")
    paths = [r[0] for r in book.where(f"not is_row and key like '{store.ARRAYS}/%.parquet'").select("key").collect()]
    there = [os.path.join(output, p) for p in paths if os.path.isfile(os.path.join(output, p))]
    if not there and expected.isEmpty():
        return {"status": "not_applicable", "failure_count": 0}
    records = spark.read.schema(SIDECAR).parquet(*there) if there else spark.createDataFrame([], SIDECAR)
    actual = store.record_digests(records).persist()
    out: dict[str, Any] = {k: [] for k in ("missing_rows", "missing_row_checksums", "mismatched_rows", "orphan_rows", "duplicate_rows")}
    for r in array_findings(expected, actual, stored).orderBy("prediction_id").collect():
        out[r.finding].append(r.prediction_id)
    out["rows_without_id"] = actual.where("prediction_id is null").count()
    actual.unpersist()
    return _rated(out)


def summary(spark: SparkSession, output: str, manifest: dict[str, Any], exclude: list[str]) -> dict[str, Any]:
    """All checks of an output against its manifest. exclude: relative paths of ledger documents in the output."""
    book = ledger(spark, manifest.get("checksums") or {}).persist()
    files = scan(spark, output).where("kind = 'file'").select(F.col("rel_path").alias("key"), F.col("sha256").alias("digest")).persist()
    want = book.where("not is_row")
    listed = _rated({"missing": _list(missing(want, files, ["key"]), "key"), "mismatched": _list(mismatched(want, files, ["key"], "digest"), "key")})
    orphans = _rated({"orphans": _list(missing(files.where(~F.col("key").isin(exclude)), want, ["key"]), "key")})
    has_store = os.path.isdir(os.path.join(output, store.STORE))
    wrong = [": ".join(x for x in (r.finding, r.table, r.file and os.path.basename(r.file), r.column) if x) for r in store.integrity(spark, output).orderBy("finding", "table", "file", "column").collect()] if has_store else []
    # tables whose files are not as they should be are not read
    tables = store.load(spark, output) if has_store and not wrong else None
    rules = [f"{r.rule} ({r.n})" for r in store.violations(tables).collect()] if tables else []
    integrity = _rated({"files": wrong, "violations": rules}) if has_store else {"status": "not_applicable", "failure_count": 0}
    items = manifest.get("preserved_opaque")
    expected = sum(1 for u in manifest.get("unsupported") or [] if isinstance(u, dict) and u.get("disposition") == "preserved")
    if not isinstance(items, list):
        payloads = _rated({"invalid_entries": ["preserved_opaque"]})
    elif not items:
        payloads = _rated({"missing_opaque_payloads": expected}) if expected else {"status": "not_applicable", "failure_count": 0}
    else:
        text = lambda i, k: i[k] if isinstance(i, dict) and isinstance(i.get(k), str) else None
        rows = spark.createDataFrame([(n, text(i, "path"), text(i, "checksum")) for n, i in enumerate(items)], "seq int, path string, checksum string")
        payloads = preserved_coverage(rows, want.select("key", "digest"), expected)
    checks = {"files": listed, "orphans": orphans, "store": integrity, "preserved": payloads}
    checks["arrays"] = array_coverage(spark, output, book, tables["predictions"].select("prediction_id") if tables else None)
    book.unpersist()
    files.unpersist()
    n = sum(c["failure_count"] for c in checks.values())
    return {"ran": True, "passed": n == 0, "checks": checks, "mismatches": n}


def require(found: dict[str, Any]) -> None:
    if not found["passed"]:
        failed = ", ".join(k for k, c in found["checks"].items() if c["failure_count"])
        raise VerificationFailure(f"{found['mismatches']} check(s) failed: {failed}", VERIFICATION)
