"""Digests of directories from those of their children, and two trees compared from the root down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from .folding import folded_digest

DIR, FILE = "dir", "file"


def tree_nodes(files: DataFrame) -> DataFrame:
    """(path, parent, depth, kind, digest): all files (path, digest) and the directories above them, the root's path being ''.

    A directory's digest is the hash of its children's lines "kind:name:digest" in order of names: two directories of equal
    digests hold the same tree. Levels are folded from the deepest up, each from the one below it, which is
    checkpointed; a null path or digest leaves its file out, and of a path that occurs twice the least digest counts.
    """
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    kept = files.where("path is not null and digest is not null").groupBy("path").agg(F.min("digest").alias("digest"))
    leaves = checkpointed(kept.select("path", parent.alias("parent"), F.size(F.split("path", "/")).alias("depth"), F.lit(FILE).alias("kind"), "digest"))
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    levels, below = [leaves], None
    for depth in range(deepest, 0, -1):
        here = leaves.where(F.col("depth") == depth)
        here = here if below is None else here.unionByName(below)
        line = F.concat_ws(":", "kind", name, "digest")
        above = folded_digest(here.withColumn("name", name), ["parent"], ["name", "kind"], line, between="\n").select(F.col("parent").alias("path"), "digest")
        place = F.when(F.col("path") == "", F.lit(None).cast("string")).otherwise(parent)
        below = checkpointed(above.select("path", place.alias("parent"), F.lit(depth - 1).alias("depth"), F.lit(DIR).alias("kind"), "digest"))
        levels.append(below)
    return reduce(DataFrame.unionByName, levels)


def tree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, depth, kind, change, compared): nodes of two trees, as tree_nodes() gives them, that differ.

    Only children of directories that differ are looked at: a level at a time, the paths that differ are joined with the next level
    by parent. compared is the number of nodes that were compared on the level. A path that was a file and is a directory is removed
    as one and added as the other. Equal trees give no rows after one comparison.
    """
    a = before.select("path", "parent", "depth", "kind", F.col("digest").alias("old"))
    b = after.select("path", "parent", "depth", "kind", F.col("digest").alias("new"))
    deepest = max(df.agg(F.max("depth")).first()[0] or 0 for df in (a, b))
    found, open_ = [], None
    for depth in range(deepest + 1):
        old, new = (df.where(F.col("depth") == depth) for df in (a, b))
        if open_ is not None:
            old, new = (df.join(open_, "parent", "left_semi") for df in (old, new))
        both = checkpointed(old.select("path", "kind", "old").join(new.select("path", "kind", "new"), ["path", "kind"], "full_outer"))
        change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
        apart = both.where(~F.col("old").eqNullSafe(F.col("new")))
        compared = both.agg(F.count("*")).first()[0]
        found.append(apart.select("path", F.lit(depth).alias("depth"), "kind", change.alias("change"), F.lit(compared).cast("long").alias("compared")))
        open_ = apart.where(F.col("kind") == DIR).select(F.col("path").alias("parent"))
        if not compared or open_.isEmpty():
            break
    return reduce(DataFrame.union, found)
