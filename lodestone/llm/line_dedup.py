"""Operator 5, line dedup by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct words (runs of anything but space, \\t, \\v, \\f and \\r); lines without words take no part.
Lines are ordered by (document, line number); a line is removed if an earlier line has a token set
with 100 * intersection >= PERCENT * union, whether that one is itself removed or not. Steps:

1. Rarity. Words are counted over all texts in 2**RARITY_BITS hash ranges (a sketch whose size is fixed); a token's key is the
   class of its range's count, then its hash, so keys in ascending order go from rare to common.
2. Equal sets. Of lines with one set only the first goes on; all others are removed. Sets are told apart by two hash
   functions of different kind over the sorted keys, 96 bits, and their size.
3. Near sets. Rows (token, line) are made for each set's prefix. A pair is found on a common prefix token, if the sizes,
   the positions of the token and the sets' parity signatures (which differ in no more bits than the sets in tokens) allow it.
   First, lines are held against the earliest line that shares one of a few tokens of their prefixes; what is removed by that
   needs no further partner, so that a group of m near copies costs O(m). Then the rest is joined with all.
4. Candidates are verified on the words of the lines themselves.

Results for special rows: null text has no lines and stays null; empty and blank lines stay; lines of rows that agree in
doc_id and text have the same place and do not remove each other; a null doc_id comes before others. If doc_ids repeat
with other texts, their lines are ordered by a hash of the text after doc_id.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import forget, read, small, written

PERCENT = 80
RARITY_BITS = 16
#: Tokens of a prefix, those of least hash, by which a line is first held against an earlier one.
FIRST = 3
#: Sets of more tokens than this have signatures of 128 bits.
LONG = 40
#: Rows, or lines named in them, up to which a table is broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _words(line: Column) -> Column:
    """The words of a line; lines whose words are parted by single spaces, the most, are split without a pattern."""
    odd = F.lit(False)
    for c in ("\t", "\x0b", "\f", "\r", "  "):
        odd |= F.contains(line, F.lit(c))
    odd |= F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | (line == "")
    return F.when(odd, F.array_remove(F.split(line, "[ \\t\\x0B\\f\\r]+"), "")).otherwise(F.split(line, " "))


def _lines(docs: DataFrame, key: list[str]) -> DataFrame:
    return docs.select(*key, F.posexplode(F.split("text", "\n")).alias("line", "s"))


def _rarity(docs: DataFrame) -> Column:
    """An array with the class of each hash range's count. It is a literal, as a lambda function can hold no subquery."""
    size = 1 << RARITY_BITS
    word = _lines(docs, []).select(F.explode(_words(F.col("s"))).alias("w"))
    counts = word.groupBy(F.pmod(F.xxhash64("w"), F.lit(size)).cast("int").alias("range")).agg(F.count("*").alias("n"))
    classes = [0] * size
    # two classes for each doubling of the count
    for r, c in counts.select("range", F.expr("2 * length(bin(n)) + (shiftright(n, greatest(length(bin(n)) - 2, 0)) & 1)")).collect():  # at most size rows
        classes[r] = c
    return F.from_json(F.lit(json.dumps(classes, separators=(",", ":"))), "array<tinyint>")


def _sets(docs: DataFrame, key: list[str]) -> DataFrame:
    """(key, line, n, k1, k2, s0, s1, prefix) of each line with words; docs has the key's columns and text."""
    classes = _rarity(docs)
    low = F.lit((1 << 56) - 1)

    def token(h: Column) -> Column:
        # never null, which lets the arrays be sorted as primitive ones
        rarity = F.coalesce(F.get(classes, h.bitwiseAND(F.lit((1 << RARITY_BITS) - 1)).cast("int")), F.lit(0).cast("tinyint"))
        return F.shiftleft(rarity.cast("long"), 56).bitwiseOR(h.bitwiseAND(low))

    def parities(keys: Column, bit: int | None = None) -> Column:
        """64 parities of the tokens by six bits of their hashes; bit: one that must be set for a token to count."""

        def step(acc: Column, k: Column) -> Column:
            one = F.lit(1).cast("long") if bit is None else F.call_function("shiftright", k, F.lit(bit)).bitwiseAND(F.lit(1).cast("long"))
            return acc.bitwiseXOR(F.call_function("shiftleft", one, k.bitwiseAND(F.lit(63)).cast("int")))

        return F.aggregate(keys, F.lit(0).cast("long"), step)

    # a generator between the two steps: otherwise the planner would make the keys anew for each use
    # words are hashed once, a hash is used twice
    keys = F.sort_array(F.array_distinct(F.transform(F.transform(_words(F.col("s")), lambda w: F.xxhash64(w)), token)))
    lines = _lines(docs, key).select(*key, "line", F.explode(F.array(keys)).alias("keys"))
    n = F.size("keys")
    # of a prefix token half the hash goes on: few tokens then are taken for others, and verification tells
    prefix = F.transform(F.slice("keys", 1, n - F.ceil(n * PERCENT / F.lit(100)).cast("int") + 1), lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    signature = [parities(F.col("keys")).alias("s0"), F.when(n > LONG, parities(F.col("keys"), 6)).otherwise(F.lit(0).cast("long")).alias("s1")]
    return lines.where(n > 0).select(*key, "line", n.alias("n"), F.xxhash64("keys").alias("k1"), F.hash("keys").alias("k2"), *signature, prefix.alias("prefix"))


def _pack(n: str, at: str, flag: str = "0") -> Column:
    """Size, position and a flag in one long, as a row of many small columns takes eight bytes for each."""
    return F.expr(f"shiftleft(cast({n} as bigint), 32) | shiftleft(cast({at} as bigint), 1) | {flag}")


def _fits(a: str, b: str) -> Column:
    """Whether sizes and positions (p, see _pack) and signatures of two rows allow a link."""
    n, m = (f"shiftright({x}.p, 32)" for x in (a, b))
    i, j = (f"(shiftright({x}.p, 1) & 2147483647)" for x in (a, b))
    need = f"((({n} + {m}) * {PERCENT} + {99 + PERCENT}) div {100 + PERCENT})"
    x, y = (f"({a}.s{k} ^ {b}.s{k})" for k in (0, 1))
    apart = f"if({n} > {LONG} and {m} > {LONG}, bit_count({y}) + bit_count({x} ^ {y}), bit_count({x}))"
    sizes = f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})"
    return F.expr(f"{sizes} and least({i}, {j}) + least({n} - {i}, {m} - {j}) >= {need} and {apart} <= {n} + {m} - 2 * {need}")


def _verified(pairs: DataFrame, docs: DataFrame, key: list[str]) -> DataFrame:
    """The places of the later lines of pairs (x, y), two places, that truly link; docs has no row twice."""
    pairs = written(pairs.select(F.least("x", "y").alias("early"), F.greatest("x", "y").alias("late")).distinct(), "pairs")
    ids = written(pairs.select(F.explode(F.array("early", "late")).alias("id")).distinct().select("id.*"), "ids")
    whose = written(ids.select(*key).distinct(), "ids")
    texts = docs.join(small(whose, BROADCAST_ROWS), key, "left_semi")
    lines = written(_lines(texts, key).join(small(ids, BROADCAST_ROWS), [*key, "line"], "left_semi").select(F.struct(*key, "line").alias("id"), "s"), "lines")
    # whole lines travel, as arrays of words would take three times the room
    both = pairs.join(lines.select(F.col("id").alias("early"), F.col("s").alias("a")), "early").join(lines.select(F.col("id").alias("late"), F.col("s").alias("b")), "late")
    both = both.select("late", F.explode(F.array(F.struct(F.array_distinct(_words(F.col("a"))).alias("a"), F.array_distinct(_words(F.col("b"))).alias("b")))).alias("w"))
    both = both.select("late", F.size("w.a").alias("n"), F.size("w.b").alias("m"), F.size(F.array_intersect("w.a", "w.b")).alias("o"))
    found = written(both.where(100 * F.col("o") >= PERCENT * (F.col("n") + F.col("m") - F.col("o"))).select("late.*").distinct(), "matched")
    forget(pairs, ids, whose, lines)
    return found


class Keys:
    """The columns of a document's key and place: its id, with a hash of the text where ids repeat with other texts."""

    def __init__(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> None:
        d = F.col(doc_id).alias("d")
        self.repeated = not docs.groupBy(d).count().where("count > 1").isEmpty()
        other = self.repeated and not docs.groupBy(d).agg(F.min(F.xxhash64(text)).alias("a"), F.max(F.xxhash64(text)).alias("b")).where("a <> b").isEmpty()
        self.columns = {"d": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)).cast("long"))}
        if other:
            self.columns["h"] = F.xxhash64(text)
        self.names = list(self.columns)


def removed(docs: DataFrame, keys: Keys, text: str = "text") -> DataFrame:
    """(key columns, lines): for each document with removed lines, their numbers from 0 in order. A written table."""
    key = keys.names
    docs = docs.select(*(c.alias(n) for n, c in keys.columns.items()), F.col(text).alias("text"))
    if keys.repeated:
        docs = docs.dropDuplicates(key)
    lines = written(_sets(docs, key), "lines")
    place = F.struct(*key, "line")
    again = lines.groupBy("k1", "k2", "n").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    marked = lines.join(again, ["k1", "k2", "n"], "left").withColumn("again", F.col("first").isNotNull() & (place > F.col("first")))
    marked = written(marked.select(*key, "line", "again", "n", "s0", "s1", F.when(~F.col("again"), F.col("prefix")).alias("prefix")), "sets")
    forget(lines)
    sets = marked.where("not again").drop("again")

    # tokens of least hash: near copies have most of these in common, whatever rare words each has of its own
    some = F.explode(F.slice(F.sort_array("prefix"), 1, FIRST))
    rare = sets.select(*key, "line", "n", "s0", "s1", "prefix", some.alias("token"))
    rare = rare.select("token", *key, "line", _pack("n", "array_position(prefix, token) - 1").alias("p"), "s0", "s1")
    earliest = rare.groupBy("token").agg(F.min(F.struct(*key, "line", "p", "s0", "s1")).alias("e"), F.count("*").alias("c")).where("c > 1").select("token", "e.*")
    places = [F.struct(*(f"{side}.{k}" for k in (*key, "line"))).alias(side) for side in ("x", "y")]
    hit = rare.alias("x").join(earliest.alias("y"), "token").where(_fits("x", "y")).select(*places).where("x <> y")
    one = _verified(hit, docs, key)

    # the longer line's whole prefix against the part of the shorter one's that a line at least as long must share; pairs of
    # which both lines are removed already need no look
    state = sets.join(small(one, BROADCAST_ROWS).withColumn("done", F.lit(1)), [*key, "line"], "left")
    state = written(state.select(*key, "line", "n", "s0", "s1", "prefix", F.coalesce("done", F.lit(0)).alias("done")), "state")
    equal = written(marked.where("again").select(*key, "line"), "equal")
    forget(marked)

    def rows(until: str) -> DataFrame:
        """A row for each token of the prefixes, up to a number of them: the token and the one before it in one long."""
        tokens = F.posexplode(F.slice("prefix", F.lit(1), F.least(F.size("prefix"), F.expr(until))))
        out = state.select(*key, "line", "n", "done", "s0", "s1", "prefix", tokens.alias("at", "token"))
        pair = F.expr("shiftleft(cast(token as bigint), 32) | coalesce(get(prefix, at - 1), -1) & 4294967295")
        return out.select(pair.alias("t"), *key, "line", _pack("n", "at", "done").alias("p"), "s0", "s1")

    part = f"n - ((2 * n * {PERCENT} + {99 + PERCENT}) div {100 + PERCENT}) + 1"
    hit = rows("n").alias("x").join(rows(part).alias("y"), F.expr("shiftright(x.t, 32) = shiftright(y.t, 32)"))
    # of a run of common tokens the first alone makes the pair: sizes and positions allow all of a run or none
    hit = hit.where("(x.t <> y.t or x.t & 4294967295 = 4294967295) and shiftright(x.p, 32) >= shiftright(y.p, 32) and x.p & y.p & 1 = 0")
    two = _verified(hit.where(_fits("x", "y")).select(*places).where("x <> y"), docs, key)
    gone = written(equal.union(one).union(two).groupBy(*key).agg(F.array_sort(F.collect_set("line")).alias("lines")), "removed")
    forget(state, equal, one, two)
    return gone


def _joined(docs: DataFrame, keys: Keys, gone: DataFrame) -> DataFrame:
    """docs with __l_lines, the numbers of its removed lines or null."""
    gone = small(gone, BROADCAST_ROWS, F.size("lines")).select(*(F.col(k).alias(f"__l_{k}") for k in keys.names), F.col("lines").alias("__l_lines"))
    same = F.lit(True)
    for k, c in keys.columns.items():
        same &= c == F.col(f"__l_{k}")
    return docs.join(gone, same, "left").drop(*(f"__l_{k}" for k in keys.names))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: str | None = None) -> DataFrame:
    """docs with the removed lines cut out of their texts; a text of which no line is left is empty.

    length: a column that is set to the number of characters of texts that changed.
    """
    keys = Keys(docs, text, doc_id)
    out = _joined(docs, keys, removed(docs, keys, text))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda s, i: ~F.array_contains(F.col("__l_lines"), i)), "\n")
    changed = F.col("__l_lines").isNotNull()
    out = out.withColumn(text, F.when(changed, kept).otherwise(F.col(text)))
    if length is not None:
        out = out.withColumn(length, F.when(changed, F.char_length(text)).otherwise(F.col(length)).cast(docs.schema[length].dataType))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the numbers of the removed lines, comma-joined, of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    keys = Keys(docs)
    gone = removed(docs, keys)
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(breaks + 1).cast("long").alias("n_lines")
    counted = docs.select("doc_id", n_lines, *([F.col("text")] if "h" in keys.names else []))
    out = _joined(counted, keys, gone)
    return out.select("doc_id", "n_lines", F.coalesce(F.size("__l_lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("__l_lines", ","), F.lit("")).alias("removed"))


SQL = f"""
with l as (select doc_id, i - 1 as line, list_distinct(regexp_extract_all(ls[i], '[^\\x20\\x09-\\x0D]+')) as ws
  from (select doc_id, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null)),
s as (select doc_id, line, ws, len(ws) as n, md5(array_to_string(list_sort(ws), ' ')) as k from l where len(ws) > 0),
m as (select *, min((doc_id, line)) over (partition by k) as f from s),
d as (select row_number() over (order by doc_id, line) as id, * from m where (doc_id, line) = f),
w as (select id, n, unnest(ws) as w from d),
c as (select w, count(*) as c from w group by w),
p as (select id, n, w from (select id, n, w, row_number() over (partition by id order by c, w) as i from w join c using (w)) where i <= n - ({PERCENT} * n + 99) // 100 + 1),
q as (select distinct a.id as x, b.id as y from p a join p b on a.w = b.w and a.id < b.id and 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)),
v as (select y, len(list_intersect(a.ws, b.ws)) as o, a.n + b.n as t from q join d a on a.id = x join d b on b.id = y),
g as (select doc_id, line from m where (doc_id, line) <> f union select doc_id, line from d where id in (select y from v where 100 * o >= {PERCENT} * (t - o)))
select documents.doc_id, coalesce(len(string_split(text, chr(10))), 0)::bigint as n_lines, coalesce(r.n, 0)::bigint as n_removed, coalesce(r.s, '') as removed
from documents left join (select doc_id, count(*) as n, string_agg(line::varchar, ',' order by line) as s from g group by doc_id) r on r.doc_id = documents.doc_id
"""
