"""Rules about paths, and the guard that a source is as it was."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import IN_PLACE, NON_EMPTY, RUNTIME, PolicyRefusal, SourceChanged
from .functions import values as v
from .operators.folding import folded_digest
from .operators.relational import snapshot_diff
from .sources.filetree import scan


def _inside(child: str, parent: str) -> bool:
    return os.path.commonpath([child, parent]) == parent


def require_disjoint(source: str, output: str) -> None:
    a, b = os.path.realpath(source), os.path.realpath(output)
    if _inside(a, b) or _inside(b, a):
        raise PolicyRefusal("source and output must be apart from each other", IN_PLACE)


def require_outside(source: str, path: str | None) -> None:
    if path is not None and _inside(os.path.realpath(path), os.path.realpath(source)):
        raise PolicyRefusal(f"{path} would be written into the source", IN_PLACE)


def require_available(output: str, resume: bool) -> None:
    if os.path.isdir(output):
        if os.listdir(output) and not resume:
            raise PolicyRefusal("the output folder is not empty", NON_EMPTY)
    elif os.path.lexists(output):
        raise PolicyRefusal("the output is a file", NON_EMPTY)


def fingerprint(tree: DataFrame) -> str:
    """Digest of a tree's entries in order of their paths, without times, as a canonical JSON list."""
    kind = F.when(F.col("size") == -1, "directory").when(F.col("size") == -2, "unreadable").otherwise("file")
    rows = tree.select("rel_path", "size", "sha256", kind.alias("kind"), F.col("rel_path").alias("path"))
    entry = F.when(F.col("size") < 0, v.canonical_json("kind", "path")).otherwise(v.canonical_json("kind", "path", "sha256", "size"))
    found = folded_digest(rows, [], ["rel_path"], entry, "[", ",", "]").first()
    return found.digest if found else v.digest_of("[]")


@contextmanager
def guarded(spark: SparkSession, source: str) -> Iterator[DataFrame]:
    """Gives the source's tree, hashed once; on leaving, whatever happened, compares it with the source as it is then."""
    before = spark.createDataFrame(scan(spark, source).collect(), "rel_path string, kind string, size long, mtime_ns long, sha256 string")
    try:
        yield before
    finally:
        changed = snapshot_diff(before, scan(spark, source), "rel_path", "size", "mtime_ns", "sha256").orderBy("rel_path").limit(5).collect()
        if changed:
            raise SourceChanged("the source changed: " + ", ".join(r.rel_path for r in changed), RUNTIME)
