"""Operator 10, mixing sources to target weights by Pfair scheduling.

Each source's documents are shuffled by a hash of their ids and cut into blocks of BLOCK documents. With integer weights
c of sum D, block i (from 0) of a source is released at slot floor(i * D / c) and due at ceil((i + 1) * D / c). The
earliest-deadline-first schedule of these windows meets all deadlines, so after any number of slots each source is
less than one block from its target. The schedule repeats after D slots: it is simulated for one period, and a block's
slot is then arithmetic on its number, done by a join. When a source ends, a new phase begins with the weights of
those that remain. No document is dropped or repeated: the result is an order.

The schedule is made on the driver. What it holds grows with the number of sources (phases x sources), not with documents;
more than MAX_SOURCES sources are refused: mix by a coarser column then, such as a group of hosts.

Results for special rows: null sources are a source of their own; null doc_ids are ordinary ids; repeated rows each
have a place; an empty table has no slots. Weights that are missing or not positive count as the least weight.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import partitions, read, small, written

BLOCK = 64
#: Target weights are proportional to a source's size to this power, unless they are given.
TEMPER = 0.5
#: Weights are rounded to this many parts, or ten for each source if that is more.
PARTS = 1000
BROADCAST_SOURCES = 1000
MAX_SOURCES = 500

_PHASES = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first", "end", "slot", "period")] + [T.StructField("offsets", T.ArrayType(T.LongType()))]))


def whole_weights(weights: dict, parts: int = PARTS) -> dict:
    """Integer weights by largest remainder, each at least 1, without a common factor."""
    if not weights:
        return {}
    parts = max(parts, 10 * len(weights))
    good = {k: float(w) if w is not None and math.isfinite(w) and w > 0 else 0.0 for k, w in weights.items()}
    total = sum(good.values()) or 1.0
    exact = {k: w / total * (parts - len(weights)) for k, w in good.items()}
    out = {k: 1 + math.floor(x) for k, x in exact.items()}
    order = sorted(exact, key=lambda k: (math.floor(exact[k]) - exact[k], str(k)))
    for k in order[: max(0, parts - sum(out.values()))]:
        out[k] += 1
    g = math.gcd(*out.values())
    return {k: c // g for k, c in out.items()}


def period(c: dict) -> dict:
    """Slots of each source's c blocks in one period of sum(c) slots, by earliest deadline first."""
    d = sum(c.values())
    names = sorted(c, key=lambda k: (k is None, str(k)))
    slots: dict = {k: [] for k in names}
    waiting = [(0, n) for n in range(len(names))]  # (release, source)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    for slot in range(d):
        while waiting and waiting[0][0] <= slot:
            _, n = heapq.heappop(waiting)
            k = names[n]
            heapq.heappush(ready, (-(-(len(slots[k]) + 1) * d // c[k]), n))
        due, n = heapq.heappop(ready)
        k = names[n]
        if due <= slot:
            raise AssertionError("a deadline was missed")
        slots[k].append(slot)
        if len(slots[k]) < c[k]:
            heapq.heappush(waiting, (len(slots[k]) * d // c[k], n))
    return slots


def plan(blocks: dict, weights: dict) -> dict:
    """For each source its phases (first block, end block, first slot, period, offsets), given its number of blocks."""
    c = whole_weights({k: weights.get(k) for k in blocks})
    done, start, out = dict.fromkeys(blocks, 0), 0, {k: [] for k in blocks}
    live = [k for k in blocks if blocks[k] > 0]
    while live:
        now = {k: c[k] for k in live}
        slots, d = period(now), sum(now.values())

        def at(k: object, i: int, slots: dict = slots, now: dict = now, d: int = d) -> int:
            return i // now[k] * d + slots[k][i % now[k]]

        length = min(at(k, blocks[k] - done[k] - 1) for k in live) + 1
        for k in live:
            n = length // d * now[k] + sum(s < length % d for s in slots[k])
            if n:
                out[k].append((done[k], done[k] + n, start, d, slots[k]))
            done[k] += n
        start += length
        live = [k for k in live if done[k] < blocks[k]]
    return out


def _ranked(docs: DataFrame, source: str, doc_id: str, ties: list[F.Column]) -> DataFrame:
    """docs with __s_i, a row's number within its source in order of the hash of its id.

    Ranks are made by parts: 4096 ranges of the hash for each source are counted, and numbered within, so a source of
    any size is spread.
    """
    keyed = docs.withColumn("__s_h", F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    keyed = keyed.withColumn("__s_p", F.substring("__s_h", 1, 3))
    counts = keyed.groupBy(F.col(source).alias("__s_s"), F.col("__s_p").alias("__s_q")).agg(F.count("*").alias("__s_n"))
    before = Window.partitionBy("__s_s").orderBy("__s_q").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__s_b", F.coalesce(F.sum("__s_n").over(before), F.lit(0)))
    within = Window.partitionBy(source, "__s_p").orderBy("__s_h", doc_id, *ties)
    ranked = keyed.withColumn("__s_r", F.row_number().over(within) - 1)
    joined = ranked.join(small(written(counts, "ranges"), 200_000), F.col(source).eqNullSafe(F.col("__s_s")) & (F.col("__s_p") == F.col("__s_q")))
    return joined.withColumn("__s_i", F.col("__s_b") + F.col("__s_r")).drop("__s_h", "__s_p", "__s_s", "__s_q", "__s_n", "__s_b", "__s_r")


def slots(docs: DataFrame, weights: dict | None = None, source: str = "source", doc_id: str = "doc_id", block: int = BLOCK, ties: list[F.Column] | None = None) -> tuple[DataFrame, int]:
    """(docs with block, slot and position, number of slots). Sorting by position gives the mixed order.

    weights: by source; by default a source's number of blocks to the power TEMPER. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("block", "slot", "position")
    sizes = docs.groupBy(source).count().limit(MAX_SOURCES + 1).collect()  # a row for each source
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mix by a coarser column")
    blocks = {r[0]: -(-r[1] // block) for r in sizes}
    weights = {k: n**TEMPER for k, n in blocks.items()} if weights is None else weights
    made = plan(blocks, weights)
    schema = T.StructType([T.StructField("__p_s", docs.schema[source].dataType), T.StructField("__p_phases", _PHASES)])
    table = spark.createDataFrame([(k, v) for k, v in made.items()], schema)
    if len(made) <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    ranked = _ranked(docs, source, doc_id, ties or []).withColumn("block", F.expr(f"__s_i div {block}"))
    joined = ranked.join(table, F.col(source).eqNullSafe(F.col("__p_s")))
    phase = joined.withColumn("__p_p", F.expr("element_at(filter(__p_phases, p -> block >= p.first and block < p.end), 1)"))
    k = F.expr("block - __p_p.first")
    c = F.expr("size(__p_p.offsets)")
    slot = F.expr("__p_p.slot") + F.call_function("div", k, c) * F.expr("__p_p.period") + F.get("__p_p.offsets", k % c)
    out = phase.withColumn("slot", slot).withColumn("position", F.col("slot") * block + F.expr(f"__s_i % {block}"))
    return out.drop("__s_i", "__p_s", "__p_phases", "__p_p"), sum(blocks.values())


def interleave(docs: DataFrame, weights: dict | None = None, source: str = "source", doc_id: str = "doc_id", block: int = BLOCK, position: str | None = None) -> DataFrame:
    """All rows and columns of docs in mixed order: partition by partition, and sorted by position within each.

    position: a column for it, which is replaced if docs has one. Readers of files need not keep the order of rows.
    """
    docs = docs.drop(position) if position else docs
    kept = docs.select(*(F.col(c).alias(f"__c_{c}") for c in docs.columns), F.col(source).alias("source"), F.col(doc_id).alias("doc_id"))
    kept = kept.withColumn("__c_tie", F.xxhash64(*[F.col(f"__c_{c}") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]))
    out, n = slots(kept, weights, block=block, ties=[F.col("__c_tie")])
    p = partitions(docs.sparkSession)
    part = F.expr(f"cast(position div {-(-max(n, 1) * block // p)} as int)")
    return out.repartitionById(p, part).sortWithinPartitions("position").select(*(F.col(f"__c_{c}").alias(c) for c in docs.columns), *([F.col("position").alias(position)] if position else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block, slot and position of every document."""
    docs = written(read(spark, sf_dir, "documents").select("doc_id", "source"), "ids")
    return slots(docs)[0].select("doc_id", "source", "block", "slot", "position")
