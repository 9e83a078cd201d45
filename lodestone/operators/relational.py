"""Comparisons of tables by key, groups that keep first or last rows, and checks of keys; all as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import kept

#: Rows that a task sorts or groups at a time, where their number is known before.
TASK_ROWS = 250_000
#: Up to so many runs of rows are broadcast.
BROADCAST_RUNS = 1 << 16


def missing(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """Rows of expected without a partner."""
    return expected.join(actual.select(*on), on, "left_anti")


def mismatched(expected: DataFrame, actual: DataFrame, on: list[str], value: str) -> DataFrame:
    """Keys that both sides have with other values."""
    a, b = expected.select(*on, F.col(value).alias("__a")), actual.select(*on, F.col(value).alias("__b"))
    return a.join(b, on).where(~F.col("__a").eqNullSafe(F.col("__b"))).select(*on)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, *values: str) -> DataFrame:
    """(key, change): keys that were added or removed or whose values changed."""
    a = before.select(F.col(key), F.struct(*values).alias("__a"))
    b = after.select(F.col(key), F.struct(*values).alias("__b"))
    both = a.join(b, key, "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b")))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("changed")
    return both.select(key, change.alias("change"))


def lookup_last(rows: DataFrame, details: DataFrame, on: str, order: str, columns: list[str]) -> DataFrame:
    """rows with columns of details, of which the last by order counts for each key; unmatched rows have nulls."""
    last = details.groupBy(on).agg(F.max_by(F.struct(*columns), order).alias("__d")).select(on, "__d.*")
    return rows.join(last, on, "left")


def first_by(rows: DataFrame, by: list[str], order: Column | str, columns: list[str]) -> DataFrame:
    """For each group the columns of its first row."""
    return rows.groupBy(*by).agg(F.min_by(F.struct(*columns), order).alias("__d")).select(*by, "__d.*")


def distinct_first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, seq): distinct values with the place they were first seen at."""
    return rows.groupBy(value).agg(F.min(order).alias("seq"))


def extra_occurrences(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, extra): keys that occur more than once, with how often after the first."""
    return rows.groupBy(*by).agg((F.count("*") - 1).alias("extra")).where("extra > 0")


def key_violations(rows: DataFrame, by: list[str]) -> DataFrame:
    """Natural keys that occur more than once; keys with a null part never collide."""
    full = rows.where(" and ".join(f"`{c}` is not null" for c in by))
    return full.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def orphan_references(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose reference is set and has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("__k")), F.col(column) == F.col("__k"), "left_anti")


def with_children(parents: DataFrame, details: DataFrame, on: str, children: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """parents joined with details, of which only those with at least one child are kept."""
    kept = parents.join(children.select(F.col(child_key).alias("__c")), F.col(parent_key) == F.col("__c"), "left_semi")
    return kept.join(details, on)


def occurrence(by: list[str], order: list) -> Column:
    """A row's number, from 1, among those with its key."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their number, from 1, in their group: occurrence() for groups of any size.

    Rows are dealt out by ranges of (by, order), some TASK_ROWS to a task, and numbered there; what each group has in the ranges before
    is added. No columns may begin with two underscores.
    """
    keys = [*by, *order]
    dealt = rows.repartitionByRange(rows.count() // TASK_ROWS + 1, *keys).sortWithinPartitions(*keys)
    placed = kept(dealt.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    runs = placed.groupBy(*(F.col(c).alias(f"__{i}") for i, c in enumerate(by)), F.col("__part").alias("__run")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    groups = [f"__{i}" for i in range(len(by))]
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*groups).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = kept(runs.select(*groups, "__run", (F.col("__first") - before).alias("__off")))
    same = F.col("__part") == F.col("__run")
    for g, c in zip(groups, by):
        same &= F.col(c).eqNullSafe(F.col(g))
    found = placed.join(F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs, same)
    return found.select(*rows.columns, (F.col("__at") - F.col("__off") + 1).alias(name))


def project_onto(source: DataFrame, schema: object, defaults: dict[str, Column]) -> DataFrame:
    """source in the columns of a schema: those it has, nulls included, and defaults or nulls for the rest."""
    have = set(source.columns)
    return source.select(*((F.col(f.name).cast(f.dataType) if f.name in have else defaults.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in schema.fields))
