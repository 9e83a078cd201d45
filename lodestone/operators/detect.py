"""What a source holds: rules over the listing of its tree, in a fixed order of kinds."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BUNDLE_VERSION, NATIVE_VERSION, USER_VERSION
from ..sources.documents import json_or_none, zip_manifest
from ..sources.filetree import listing
from ..sources.sqlite_ro import probe

NATIVE_FILES = ("manifest.json", "score_set.json", "predictions.parquet")


@dataclass
class Artifact:
    path: str
    kind: str
    version: Any = None
    forward: bool = False
    note: str | None = None
    details: dict[str, Any] = field(default_factory=dict)


def version_parts(text: str) -> list[int]:
    """The leading numeric parts of a dotted version."""
    out = []
    for part in text.split("."):
        if not part.isdigit():
            break
        out.append(int(part))
    return out


def kind_of_path(path: Column) -> Column:
    """The kind that a file's relative path alone shows, null for none; by directory rules in their order."""
    rules = [
        (r"^store\.duckdb$", "duckdb-workspace"),
        (r"^store\.sqlite$", "sqlite-workspace-v2"),
        (r"^runs/[^/]+/run_manifest\.yaml$", "fs-runs-v2"),
        (r"^runs/[^/]+/[^/]+/manifest\.yaml$", "fs-runs-legacy"),
        (r"^[^/]+(\.meta\.parquet|_predictions\.json)$", "loose-predictions"),
        (r"^[^/]+\.n4a\.py$", "n4a-py-bundle"),
        (r"^[^/]+\.n4a$", "n4a-bundle"),
        (r"^([^/]+/)?(manifest\.json|score_set\.json|predictions\.parquet)$", "native-results-v1"),
    ]
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(rules):
        out = F.when(path.rlike(pattern), kind).otherwise(out)
    return out


def detect_tree(tree: DataFrame) -> DataFrame:
    """(path, source_kind, files): artifacts of many trees' listings (root, rel_path) at once, by paths alone."""
    files = tree.withColumn("source_kind", kind_of_path(F.col("rel_path"))).where("source_kind is not null")
    folder = F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1)
    path = (
        F.when(F.col("source_kind").startswith("fs-runs"), "runs")
        .when(F.col("source_kind") == "loose-predictions", ".")
        .when(F.col("source_kind") == "native-results-v1", F.when(folder == "", ".").otherwise(folder))
        .otherwise(F.col("rel_path"))
    )
    found = files.groupBy("root", path.alias("path"), "source_kind").agg(F.array_sort(F.collect_set("rel_path")).alias("files"))
    return found.where((F.col("source_kind") != "native-results-v1") | (F.size("files") == len(NATIVE_FILES)))


def _bundle(path: str, rel: str) -> Artifact:
    version = (zip_manifest(path) or {}).get("bundle_format_version")
    forward = bool(version) and version_parts(str(version)) > BUNDLE_VERSION
    return Artifact(rel, "n4a-bundle", version, forward, "newer bundle format" if forward else "kept as it is, never run")


def _native(folder: str, rel: str) -> Artifact | None:
    if not all(os.path.exists(os.path.join(folder, f)) for f in NATIVE_FILES):
        return None
    version = (json_or_none(os.path.join(folder, "manifest.json")) or {}).get("schema_version")
    forward = isinstance(version, int) and version > NATIVE_VERSION
    return Artifact(rel, "native-results-v1", version, forward, "newer native schema" if forward else None)


def _store(path: str) -> Artifact:
    version, tables = probe(path)
    arrays = "prediction_arrays" in tables
    forward = version is not None and version > USER_VERSION
    note = "newer store version" if forward else "not a readable database" if version is None else None
    return Artifact("store.sqlite", f"sqlite-workspace-{'legacy-arrays' if arrays else 'v2'}", version, forward, note, {"has_prediction_arrays": arrays, "table_count": len(tables)})


def detect(source: str) -> list[Artifact]:
    """The artifacts of one source; a single unknown one if there are none."""
    if not os.path.lexists(source):
        return [Artifact(".", "unknown", note="there is nothing at this path")]
    if not os.path.isdir(source):
        if source.endswith(".n4a.py"):
            return [Artifact(".", "n4a-py-bundle", note="kept as it is, never run")]
        return [_bundle(source, ".")] if source.endswith(".n4a") else [Artifact(".", "unknown", note="not a kind of file that is known")]
    at = lambda *p: os.path.join(source, *p)
    entries = listing(source)
    names = [e[0] for e in entries]
    top = [n for n in names if "/" not in n]
    out = []
    if "store.duckdb" in top:
        out.append(Artifact("store.duckdb", "duckdb-workspace", note="kept as it is; not read"))
    if "store.sqlite" in top:
        out.append(_store(at("store.sqlite")))
    parts = [n.split("/") for n in names if n.startswith("runs/")]
    if any(len(p) == 3 and p[2] == "run_manifest.yaml" for p in parts):
        out.append(Artifact("runs", "fs-runs-v2"))
    if any(len(p) == 4 and p[3] == "manifest.yaml" for p in parts):
        out.append(Artifact("runs", "fs-runs-legacy"))
    loose = sorted(n for n in top if n.endswith((".meta.parquet", "_predictions.json")))
    if loose:
        out.append(Artifact(".", "loose-predictions", details={"files": loose}))
    out += [_bundle(at(n), n) for n in top if n.endswith(".n4a")]
    out += [Artifact(n, "n4a-py-bundle", note="kept as it is, never run") for n in top if n.endswith(".n4a.py")]
    out += [a for rel, kind, *_ in [(".", "dir"), *entries] if kind == "dir" and "/" not in rel and (a := _native(at(rel) if rel != "." else source, rel))]
    return out or [Artifact(".", "unknown", note="nothing known was found")]


def as_table(spark: SparkSession, artifacts: list[Artifact]) -> DataFrame:
    rows = [(i, a.path, a.kind, None if a.version is None else str(a.version), a.forward, a.note) for i, a in enumerate(artifacts)]
    return spark.createDataFrame(rows, "seq int, path string, source_kind string, detected_version string, forward_version boolean, note string")


def kinds(detected: DataFrame) -> DataFrame:
    """(source_kind, seq, detected_version): distinct kinds as first seen, each with its last version."""
    return detected.groupBy("source_kind").agg(F.min("seq").alias("seq"), F.max_by("detected_version", "seq").alias("detected_version")).orderBy("seq")
