"""File trees as tables: a listing on the driver, hashing and copying in tasks."""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed

BLOCK = 1 << 20
LISTED = "rel_path string, kind string, size long, mtime_ns long"
SCHEMA = f"{LISTED}, sha256 string"
#: Entries that a task hands on at once while it lists a directory.
ENTRIES = 10_000


def hash_file(path: str) -> str:
    """Prefixed SHA-256 of a file, read in blocks."""
    state = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(BLOCK):
            state.update(block)
    return f"sha256:{state.hexdigest()}"


def listing(root: str) -> list[tuple[str, str, int, int]]:
    """(path, kind, size, time) of all entries below root, in order; directories have size -1, unreadable entries -2.

    Links to directories are entries and are not followed; a file as root has the path '.'; a missing root has no entries.
    """
    if not os.path.lexists(root):
        return []
    if not os.path.isdir(root):
        s = os.stat(root)
        return [(".", "file", s.st_size, s.st_mtime_ns)]
    found = []
    for top, dirs, files in os.walk(root):
        for name in [*dirs, *files]:
            path = os.path.join(top, name)
            rel = os.path.relpath(path, root).replace(os.sep, "/")
            try:
                s = os.stat(path)
                is_dir = os.path.isdir(path)
                found.append((rel, "dir" if is_dir else "file", -1 if is_dir else s.st_size, s.st_mtime_ns))
            except OSError:
                found.append((rel, "file", -2, 0))
    return sorted(found)


def walked(spark: SparkSession, root: str) -> DataFrame:
    """listing() as a table that tasks make: directories are opened a level at a time, and no list of files is in the driver.

    A task lists whole directories and hands their entries on in batches. The levels are checkpointed.
    """
    if not os.path.isdir(root):
        return spark.createDataFrame(listing(root), LISTED)

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for folder in pdf.rel_path:
                rows = []
                try:
                    entries = os.scandir(os.path.join(root, folder))
                except OSError:
                    continue
                with entries:
                    for e in entries:
                        rel = f"{folder}/{e.name}" if folder else e.name
                        try:
                            s, is_dir = e.stat(), e.is_dir()
                            rows.append((rel, "dir" if is_dir else "file", -1 if is_dir else s.st_size, s.st_mtime_ns, is_dir and not e.is_symlink()))
                        except OSError:
                            rows.append((rel, "file", -2, 0, False))
                        if len(rows) == ENTRIES:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                yield pd.DataFrame(rows, columns=columns)

    columns = ["rel_path", "kind", "size", "mtime_ns", "open"]
    levels, frontier = [], spark.createDataFrame([("",)], "rel_path string")
    while True:
        level = checkpointed(frontier.mapInPandas(opened, f"{LISTED}, open boolean"))
        levels.append(level.drop("open"))
        frontier = level.where("open").select("rel_path")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        frontier = frontier.repartition(spark.sparkContext.defaultParallelism * 4, "rel_path")


def scan(spark: SparkSession, root: str, by_tasks: bool = False) -> DataFrame:
    """The tree below root with a digest of each readable file. Files must be visible to all tasks by this path.

    by_tasks: the tree is listed by tasks too, for trees whose listing the driver should not hold; the rows are the same.
    """
    if by_tasks:
        paths = walked(spark, root).repartition(spark.sparkContext.defaultParallelism * 4, "rel_path")
    else:
        rows = listing(root)
        paths = spark.createDataFrame(rows, LISTED)
        if len(rows) > 64:
            paths = paths.repartition(min(len(rows) // 16, spark.sparkContext.defaultParallelism * 4), "rel_path")

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            digests, sizes = [], []
            for rel, kind, size in zip(pdf.rel_path, pdf.kind, pdf["size"]):
                digest = None
                if kind == "file" and size >= 0:
                    try:
                        digest = hash_file(root if rel == "." else os.path.join(root, rel))
                    except OSError:
                        size = -2
                digests.append(digest)
                sizes.append(size)
            yield pdf.assign(size=sizes, sha256=digests)

    return paths.mapInPandas(hashed, SCHEMA)


def copy(tree: DataFrame, root: str, output: str, prefix: str) -> DataFrame:
    """(rel_path, sha256) of the files of a tree after they were copied below output/prefix; directories, unreadable entries
    and unsafe names are left out."""
    files = tree.where((F.col("kind") == "file") & (F.col("size") >= 0) & ~unsafe(F.col("rel_path")))

    def copied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            names, digests = [], []
            for rel in pdf.rel_path:
                name = os.path.basename(root) if rel == "." else rel
                target = os.path.join(output, prefix, name)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                shutil.copyfile(root if rel == "." else os.path.join(root, rel), target)
                names.append(f"{prefix}/{name}" if prefix else name)
                digests.append(hash_file(target))
            yield pd.DataFrame({"rel_path": names, "sha256": digests})

    return files.select("rel_path").mapInPandas(copied, "rel_path string, sha256 string")


def unsafe(path: F.Column) -> F.Column:
    """Whether a relative name is absolute or climbs out of its folder."""
    return path.rlike(r"^/|(^|/)\.\.(/|$)")
