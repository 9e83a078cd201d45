"""Operator 13, filter interaction audit: how five filters share their removals, in each order in which they may be applied.

A to D are rules over a document's own text, as bits of one scan. E, "identical to the text of any smaller doc_id", is an existential
self-join: the rows that share a hash with another row are joined, left-semi, with (hash, text, smallest doc_id) on hash,
exact text and a smaller doc_id; there is one such row for each text, so a group of any number of copies costs no pairs, and its rows
are salted by their number. The ids of E are united with those of the other failures and their bits gathered by
document; counts of bit combinations by part, at most 32 for each kind of label, are all that the orders are computed from.

Of k filters that a document fails, each comes first in 1/k of the 120 orders; so shapley needs no sum over orders.

Special rows: a null text is empty and equals other empty ones; a null doc_id is not smaller than any and no other is smaller than
it, so it never fails E; rows of the same doc_id are documents of their own and no reason for E to each other; labels of one doc_id
count if any of its rows has them; null labels are none; a null source is the part "". An empty table has no parts.
Only doc_id, text and source are read, and doc_id, quality and toxic of labels, whatever other columns there are.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read, small, written

FILTERS = "ABCDE"
#: So many hashes of 32 bytes are broadcast at most.
BROADCAST_HASHES = 1 << 18
#: Rows of one text that are compared with its first one in a task.
SALTED = 512
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
_SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """The bits of A, B, C and D for a text that is not null."""
    words = F.filter(F.split(text, _SPACE, -1), lambda w: w != "")
    return F.transform(F.array(words), _bits(text))[0]


def _bits(text: Column):
    # a lambda's argument: the words are split once, and every rule reads them
    def of(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        rules = {
            "A": n < 50,
            "B": distinct.cast("long") * 100 < n.cast("long") * 65,
            "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text).cast("long") * 5,
            "D": text.rlike(r"[#$%&*|]"),
        }
        bits = [F.when(c, F.lit(_BIT[k])).otherwise(F.lit(0)) for k, c in rules.items()]
        return bits[0] + bits[1] + bits[2] + bits[3]

    return of


def repeated(rows: DataFrame, base: DataFrame) -> DataFrame:
    """The rows (doc_id, source, hash, text) whose exact text a row with a smaller doc_id has; base: (doc_id, hash) of all rows.

    The rows of a hash are dealt out over one salt for each SALTED of them, and the row of the text's first id is there for each salt.
    """
    several = base.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high")
    several = small(written(several.select("hash", F.ceil(F.col("n") / SALTED).alias("salts")), "hashes"), BROADCAST_HASHES)
    own = rows.join(several, "hash").withColumn("salt", F.pmod(F.xxhash64("doc_id"), "salts"))
    first = own.groupBy("hash", "text", "salts").agg(F.min("doc_id").alias("first")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    first = first.select(*(F.col(c).alias(f"of_{c}") for c in ("hash", "text", "salt")), "first")
    same = [F.col(c) == F.col(f"of_{c}") for c in ("hash", "text", "salt")]
    return own.join(first, [*same, F.col("first") < F.col("doc_id")], "left_semi")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, good, toxic, n): documents by part, failed filters and labels."""
    rows = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.unhex(F.sha2("text", 256)))
    base = written(rows.select("doc_id", "source", "hash", failures(F.col("text")).alias("bits")), "failures")
    key = ["doc_id", "source", "hash"]
    ids = base.select(*key, "bits", F.lit(1).cast("long").alias("n")).union(repeated(rows, base).select(*key, F.lit(_BIT["E"]), F.lit(0).cast("long")))
    by_doc = ids.groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    told = labels.groupBy("doc_id").agg(F.max(F.col("quality").eqNullSafe(F.lit(1))).alias("good"), F.max(F.col("toxic").eqNullSafe(F.lit(1))).alias("toxic"))
    labelled = by_doc.join(told, "doc_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return labelled.groupBy(F.coalesce("source", F.lit("")).alias("part"), "bits", flag("good"), flag("toxic")).agg(F.sum("n").alias("n"))


def audit(counts: DataFrame) -> DataFrame:
    """One row for each part, order and step, from combinations()."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "good", "toxic", "n")).alias("all"))
    steps = [(order, i + 1, _BIT[f], sum(_BIT[x] for x in order[:i])) for order in ORDERS for i, f in enumerate(order)]
    plan = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(f).alias("own"), F.lit(b).alias("before")) for o, s, f, b in steps))
    rows = parts.select("part", "all", F.explode(plan).alias("s")).select("part", "all", "s.*")
    own, before = F.col("own"), F.col("before")
    total = lambda of: F.aggregate(F.filter("all", of), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    fails = lambda x: x["bits"].bitwiseAND(own) != 0
    passed = lambda x: x["bits"].bitwiseAND(before) == 0

    share = F.aggregate(F.filter("all", fails), F.lit(0).cast("long"), lambda a, x: a + (x["n"] * len(ORDERS) / F.bit_count(x["bits"])).cast("long"))
    return rows.select(
        "part", "filter_order", "step", total(lambda x: passed(x) & ~fails(x)).alias("kept"), total(lambda x: passed(x) & fails(x)).alias("removed"),
        total(lambda x: ~passed(x) & fails(x)).alias("redundant"), total(lambda x: x["bits"] == own).alias("unique_fails"),
        total(lambda x: passed(x) & fails(x) & x["good"]).alias("good_lost"), total(lambda x: passed(x) & fails(x) & x["toxic"]).alias("toxic_lost"), share.alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(combinations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


_FACTS = """t as (select doc_id, coalesce(source, '') part, coalesce(text, '') x from documents),
  w as (select *, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '') words, min(doc_id) over (partition by x) low from t),
  l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by 1),
  f as (select w.part, coalesce(good, false) good, coalesce(toxic, false) toxic,
    (case when len(words) < 50 then 1 else 0 end) + (case when 100 * len(list_distinct(words)) < 65 * len(words) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) then 4 else 0 end) + (case when regexp_matches(x, '[#$%&*|]') then 8 else 0 end)
    + (case when low < w.doc_id then 16 else 0 end) bits from w left join l using (doc_id)),
  c as (select part, bits, count(*) n, count(*) filter (where good) g, count(*) filter (where toxic) b from f group by 1, 2)"""
_ORDERS = ", ".join(f"('{o}', {i + 1}, {_BIT[f]}, {sum(_BIT[x] for x in o[:i])})" for o in ORDERS for i, f in enumerate(o))
SQL = f"""with {_FACTS}, s(filter_order, step, own, done) as (values {_ORDERS}),
  r as (select part, filter_order, step, own, coalesce(sum(n) filter (where bits & done = 0 and bits & own = 0), 0)::bigint kept, coalesce(sum(n) filter (where bits & done = 0 and bits & own <> 0), 0)::bigint removed,
    coalesce(sum(n) filter (where bits & done <> 0 and bits & own <> 0), 0)::bigint redundant, coalesce(sum(n) filter (where bits = own), 0)::bigint unique_fails,
    coalesce(sum(g) filter (where bits & done = 0 and bits & own <> 0), 0)::bigint good_lost, coalesce(sum(b) filter (where bits & done = 0 and bits & own <> 0), 0)::bigint toxic_lost
    from c cross join s group by part, filter_order, step, own)
  select * exclude (own), (sum(removed) over (partition by part, own))::bigint shapley from r"""
