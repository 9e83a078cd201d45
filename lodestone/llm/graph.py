"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable by edges, for every node that has an edge to another.

    Alternates large-star and small-star steps, which need O(log^2 n) rounds and never gather a node's neighbours in
    one row: each step aggregates a minimum and joins it back. Rows with a null end or equal ends are ignored.
    """
    cur = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        # large star: larger neighbours of a node move to its minimum
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: a node and its smaller neighbours move to the least of them
        near = large.join(low, "u")
        after = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(after, "edges")
        n, same, inner = _state(after, cur)
        if same or inner == 0 and n == after.select("u").distinct().count():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                after.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        cur = after


def _state(after: DataFrame, before: DataFrame) -> tuple[int, bool, int]:
    """Number of edges, whether nothing changed, and how many edges end in a node that has a smaller neighbour."""
    n = after.count()
    inner = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").count()
    same = inner > 0 and n == before.count() and before.join(after, ["u", "v"], "left_anti").isEmpty()
    return n, same, inner
