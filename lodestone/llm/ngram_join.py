"""Operator 7, n-gram Jaccard join: a grouped prefix join on sets of word shingles, and its connected components.

Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set holds the 64-bit hashes of its
distinct k-word shingles (with fewer words, of the whole sequence). Two documents link when 100 * intersection >=
percent * union. Steps:

1. Survivors. A document that links has at most n - ceil(percent * n / 100) shingles that no other document has. Of a
   third of the hash space, chosen by the hash itself, all shingles are counted over all documents; a document with
   more than that many unshared ones in the sample can have no link and is left alone. This loses nothing.
2. Equal sets become one representative with members.
3. Prefixes. All shingles of the representatives are counted; each set is ordered from rare to common, and its prefix is
   what two linked sets must share a shingle of. Shingles of a single set lead the order and need no join.
4. Grouping. Representatives with equal prefixes and size become one group. Only components are asked for, so pairs that are
   connected already need no look: first every member is held against its group's leader, and a leader against the leader
   of the group that it shares most prefix shingles with. A group's members are then classed by component. So a large
   group of near copies costs work in proportion to its size.
5. Groups are joined on the prefix shingles whose groups still fall into several components: first, in ROUNDS rounds, each class
   is held against one other, by one member each; then all pairs of groups with classes of different components that sizes and
   positions allow are expanded to the members of these classes, and those pairs of members that their 256-bit parity
   signatures do not rule out are verified on the whole sets. A pair that shares many prefix shingles is met at few of them:
   each shingle carries up to BEFORE shingles that stand before it in its prefix, and where two such windows share one, the
   pair is left to that earlier shingle. The first shared shingle has none before it, so no link between components is missed.

Results for special rows: null, empty and blank texts have an empty set, link with nothing and are their own component;
a null doc_id belongs to a component but never names it (its component_id is null if it is alone); repeated rows link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as bl
from . import text as tx
from .graph import components
from .tables import forget, partitions, read, small, written

SAMPLE = 3
#: Rounds in which groups of one shingle are held against one of them before all pairs across components are looked at.
ROUNDS = 1
#: Shingles before one in its prefix that tell where else a pair meets. Any number gives the same links.
BEFORE = 8
#: Up to so many survivors are broadcast for the join with documents; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sizes, sorted distinct hashes of all) of runs of texts."""
    for row, offsets, data in tx.slices(column):
        starts, ends, doc = tx.words(data, offsets)
        h, owner = tx.shingles(tx.word_hashes(data, starts, ends, lower=True), doc, k)
        edge = np.searchsorted(owner, np.arange(len(offsets)))
        sets = [np.unique(h[a:b]) for a, b in zip(edge[:-1], edge[1:])]
        yield row, np.array([len(s) for s in sets], np.int64), np.concatenate(sets) if sets else h


def _spare(n: np.ndarray, percent: int) -> np.ndarray:
    """Most shingles that a set of n may have apart from a linked one."""
    return n - (percent * n + 99) // 100


def _sampled(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)) % np.uint64(SAMPLE) == 0


def _keys(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 128-bit key of each set, as bytes."""
    edge = np.concatenate([[0], np.cumsum(sizes)])
    return np.array([hashlib.md5(h[a:b].tobytes(), usedforsecurity=False).digest() for a, b in zip(edge[:-1], edge[1:])], "S16")


def _fixed(keys: np.ndarray) -> pa.Array:
    """A binary column of 16-byte keys (numpy's S type would drop trailing zeros)."""
    raw = keys.tobytes()
    return pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())


def _shared(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(uid): the first 64 bits of the set keys of documents whose sampled shingles may nearly all be shared."""
    n_buckets = partitions(texts.sparkSession)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for _, sizes, h in _sets(got.column(0), k):
                keys = _keys(h, sizes)
                uid = np.frombuffer(keys.tobytes(), np.int64).reshape(-1, 2)[:, 0]
                owner = np.repeat(np.arange(len(sizes)), sizes)
                mine = _sampled(h)
                h, owner = h[mine], owner[mine]
                need = np.bincount(owner, minlength=len(sizes)) - _spare(sizes, percent)
                mine = need[owner] > 0
                h, owner = h[mine], owner[mine]
                yield bl.batch([(b, _compact(x, o, uid, need)) for b, (x, o) in bl.spread(h % np.uint64(n_buckets), n_buckets, h, owner)])

    def count(bucket: int, held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0, *(len(x[2]) for x in held)])
        owner = np.concatenate([x[1].astype(np.int64) + b for x, b in zip(held, base)])
        h, uid, need = (np.concatenate([x[i] for x in held]) for i in (0, 2, 3))
        order = np.argsort(h)
        h = h[order]
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        n = np.bincount(owner[order[same[1:] | same[:-1]]], minlength=len(uid))
        at = np.flatnonzero(n)
        to = (uid[at].view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
        parts = list(bl.spread(to, n_buckets, uid[at], need[at], n[at]))
        for i in range(0, len(parts), 256):
            yield bl.batch([(b, bl.pack(*x)) for b, x in parts[i : i + 256]])

    def total(bucket: int, held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        # equal sets have one uid: their counts add up, and any of them needs what one does
        uid, need, n = bl.joined(held)
        uid, first, where = np.unique(uid, return_index=True, return_inverse=True)
        uid = uid[np.bincount(where, n) >= need[first]]
        for i in range(0, len(uid), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(uid[i : i + 50_000])], names=["uid"])

    counts = bl.by_bucket(texts.mapInArrow(sample, bl.SCHEMA), n_buckets, count, bl.SCHEMA)
    return bl.by_bucket(counts, n_buckets, total, "uid long")


def _compact(h: np.ndarray, owner: np.ndarray, uid: np.ndarray, need: np.ndarray) -> bytes:
    """A packed bucket that names only the documents it has shingles of."""
    used, where = np.unique(owner, return_inverse=True)
    return bl.pack(h, where.astype(np.uint32), uid[used], need[used].astype(np.int32))


def _members(docs: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """docs without text, with __j_n, __j_key and, for those that may have links, __j_set (hashes as bytes); written."""
    others = [c for c in docs.columns if c != text]
    at = docs.columns.index(text)
    texts = docs.select(F.col(text).alias("text"))
    found = written(_shared(texts, k, percent), "survivors")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row, sizes, h in _sets(whole.column(at), k):
                got = whole.slice(row, len(sizes))
                keys, raw = _keys(h, sizes), h.tobytes()
                edge = np.concatenate([[0], np.cumsum(sizes)]) * 8
                mine = np.concatenate([[0], np.cumsum(_sampled(h))])
                free = mine[edge[1:] // 8] - mine[edge[:-1] // 8] <= _spare(sizes, percent)
                uid = np.frombuffer(keys.tobytes(), np.int64).reshape(-1, 2)[:, 0]
                new = [
                    pa.array(sizes), _fixed(keys), pa.array(uid), pa.array(free),
                    pa.array([raw[a:b] for a, b in zip(edge[:-1], edge[1:])], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([got.column(got.schema.get_field_index(c)) for c in others] + new, names=[*others, "__j_n", "__j_key", "__j_uid", "__j_free", "__j_set"])

    schema = T.StructType([docs.schema[c] for c in others])
    for name, kind in (("__j_n", T.LongType()), ("__j_key", T.BinaryType()), ("__j_uid", T.LongType()), ("__j_free", T.BooleanType()), ("__j_set", T.BinaryType())):
        schema = schema.add(name, kind)
    found = small(found, BROADCAST_IDS).select(F.col("uid").alias("__j_s"))
    out = docs.mapInArrow(sets, schema).join(found, F.col("__j_uid") == F.col("__j_s"), "left")
    may = (F.col("__j_n") > 0) & (F.col("__j_free") | F.col("__j_s").isNotNull())
    return written(out.withColumn("__j_set", F.when(may, F.col("__j_set"))).drop("__j_uid", "__j_free", "__j_s"), "sets")


def _prefixes(reps: DataFrame, percent: int) -> DataFrame:
    """(key, n, gid, lead, prefix): the shared shingles in each prefix; lead is how many unshared ones stand before."""
    n_buckets = partitions(reps.sparkSession)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for begin in range(0, got.num_rows, 500):
                part = got.slice(begin, 500)
                raw = part.column("set").to_pylist()
                sizes = np.array([len(x) // 8 for x in raw])
                h = np.frombuffer(b"".join(raw), np.uint64)
                keys = np.frombuffer(b"".join(part.column("key").to_pylist()), np.int64).reshape(-1, 2)
                owner = np.repeat(np.arange(len(raw)), sizes)
                rows = []
                for b, (x, o) in bl.spread(h % np.uint64(n_buckets), n_buckets, h, owner):
                    used, where = np.unique(o, return_inverse=True)
                    rows.append((b, bl.pack(x, where.astype(np.uint32), keys[used, 0], keys[used, 1], sizes[used])))
                yield bl.batch(rows)

    def count(bucket: int, held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0, *(len(x[2]) for x in held)])
        owner = np.concatenate([x[1].astype(np.int64) + b for x, b in zip(held, base)])
        h, k1, k2, sizes = (np.concatenate([x[i] for x in held]) for i in (0, 2, 3, 4))
        order = np.argsort(h)
        h, owner = h[order], owner[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        df = np.repeat(np.diff(np.r_[first, len(h)]), np.diff(np.r_[first, len(h)]))
        mine = df > 1
        h, owner, df = h[mine], owner[mine], df[mine]
        to = (k1[owner].astype(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
        parts = list(bl.spread(to, n_buckets, h, owner, df))
        for i in range(0, len(parts), 64):
            yield bl.batch([(b, bl.pack(x, d.astype(np.int64), k1[o], k2[o], sizes[o])) for b, (x, o, d) in parts[i : i + 64]])

    def cut(bucket: int, held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, df, k1, k2, sizes = bl.joined(held)
        order = np.lexsort((h, df, k2, k1))
        h, k1, k2, sizes = h[order], k1[order], k2[order], sizes[order]
        first = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        rows: list[list] = [[], [], [], [], []]
        for a, b in zip(first, np.r_[first[1:], len(h)]):
            n = int(sizes[a])
            lead = n - int(b - a)
            take = int(_spare(np.int64(n), percent)) + 1 - lead
            if take <= 0:
                continue
            prefix = h[a : min(b, a + take)].view(np.int64)
            gid = hashlib.md5(np.array([n, lead]).tobytes() + prefix.tobytes(), usedforsecurity=False).digest()
            for column, value in zip(rows, (k1[a : a + 1].tobytes() + k2[a : a + 1].tobytes(), n, gid, lead, prefix)):
                column.append(value)
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        for i in range(0, len(rows[0]), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(r[i : i + 2000], t) for r, t in zip(rows, kinds)], names=["key", "n", "gid", "lead", "prefix"])

    counted = bl.by_bucket(reps.select("key", "set").mapInArrow(spread, bl.SCHEMA), n_buckets, count, bl.SCHEMA)
    return bl.by_bucket(counted, n_buckets, cut, "key binary, n long, gid binary, lead long, prefix array<long>")


def _verified(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of pairs whose whole sets link."""
    a = reps.select(F.col("key").alias("x"), F.col("set").alias("a"))
    b = reps.select(F.col("key").alias("y"), F.col("set").alias("b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            keep = []
            for a, b in zip(got.column("a"), got.column("b")):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                inter = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield got.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    # The set of x is fetched first, so that the side with many pairs for one y can be split.
    return pairs.join(a, "x").join(b, "y").select("x", "y", "a", "b").mapInArrow(check, "x binary, y binary")


def _signatures(reps: DataFrame) -> DataFrame:
    """(key, s0 .. s3): 256 parities of each set's shingles by hash; two sets differ in as many shingles as bits, or more."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            bits = np.zeros((got.num_rows, 256), np.uint8)
            for i, s in enumerate(got.column("set")):
                h = np.frombuffer(s.as_buffer(), np.uint64)
                bits[i] = np.bincount((h >> np.uint64(20)).astype(np.int64) & 255, minlength=256) & 1
            words = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([got.column("key"), *(pa.array(words[:, i]) for i in range(4))], names=["key", "s0", "s1", "s2", "s3"])

    return reps.select("key", "set").mapInArrow(sign, "key binary, s0 long, s1 long, s2 long, s3 long")


def links(reps: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the representatives (key, n, set) that link with others, by least key."""
    found = written(_prefixes(reps, percent), "prefixes")
    groups = found.groupBy("gid").agg(F.min("key").alias("leader"), F.first("n").alias("n"), F.first("lead").alias("lead"), F.first("prefix").alias("prefix"))
    groups = written(groups, "groups")
    rows = groups.select("gid", "leader", "n", "lead", F.posexplode("prefix").alias("at", "token"))
    before = F.slice("prefix", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, F.least("at", F.lit(BEFORE)))
    windows = groups.select("gid", "n", "lead", "prefix", F.posexplode("prefix").alias("at", "token")).withColumn("before", before).drop("prefix")
    # stars: of a group of near copies, the one with fewest shingles of its own is the likeliest original
    anchor = rows.groupBy("token").agg(F.min(F.struct("lead", "n", "gid", "leader")).alias("to"), F.count("*").alias("groups")).where("groups > 1")
    near = rows.join(anchor, "token").where(f"gid <> to.gid and 100 * least(n, to.n) >= {percent} * greatest(n, to.n)")
    best = near.groupBy("gid", "leader", F.col("to.leader").alias("y")).agg(F.count("*").alias("shared"))
    best = best.groupBy("gid", "leader").agg(F.max_by("y", F.struct("shared", "y")).alias("y")).select(F.col("leader").alias("x"), "y")
    own = found.join(groups.select("gid", "leader"), "gid").where("key <> leader").select(F.col("key").alias("x"), F.col("leader").alias("y"))
    edges = written(_verified(best.union(own), reps, percent), "links")

    members = written(found.select("key", "gid").join(_signatures(reps), "key"), "members")
    # overlap <= the shared shingles before this one in the shorter prefix, and this one with what follows in the shorter
    # rest; a set's leading shingles are in no other set
    bound = F.expr("least(at1, at2) + least(n1 - lead1 - at1, n2 - lead2 - at2)")
    fits = F.expr(f"comp1 <> comp2 and 100 * least(n1, n2) >= {percent} * greatest(n1, n2)") & ((100 + percent) * bound >= percent * F.expr("n1 + n2"))
    apart = F.expr(f"({' + '.join(f'bit_count(s{i}1 ^ s{i}2)' for i in range(4))}) * {100 + percent} <= {100 - percent} * (n1 + n2)")
    marks = ["s0", "s1", "s2", "s3"]
    columns = ["gid", "comp", "n", "lead", "at", "key", *marks]
    side = lambda df, i, names: df.select(*([] if "token" not in df.columns else ["token"]), *(F.col(c).alias(f"{c}{i}") for c in names))
    pair = F.struct(F.least("key1", "key2").alias("x"), F.greatest("key1", "key2").alias("y")).alias("p")

    comp = components(edges, "x", "y")
    for attempt in range(ROUNDS + 1):
        # the classes of a group: its members by component; most groups have one
        placed = written(members.join(comp, F.col("key") == F.col("node"), "left").select("key", "gid", F.coalesce("component", "key").alias("comp"), *marks), "placed")
        classes = placed.groupBy("gid", "comp").agg(F.min(F.struct("key", *marks)).alias("r"), F.count("*").alias("m")).select("gid", "comp", "m", "r.*")
        tokens = written((rows.drop("leader") if attempt < ROUNDS else windows).join(classes, "gid"), "tokens")
        mixed = tokens.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("token")
        rest = written(tokens.join(mixed, "token", "left_semi"), "open")
        if rest.isEmpty():
            break
        one = side(rest, 1, columns)
        if attempt < ROUNDS:  # each shingle's classes against one of them, by one member each
            some = rest.groupBy("token").agg(F.min_by(F.struct(*columns), F.xxhash64("token", "key", F.lit(attempt))).alias("r")).select("token", "r.*")
            cross = one.join(side(some, 2, columns), "token").where(fits & apart).select(pair)
        else:  # pairs of groups, expanded to their members of different components
            order = F.struct("gid1", "comp1") < F.struct("gid2", "comp2")
            alone = F.expr("m1 > 1 or m2 > 1") | apart  # a class of one member needs no expanding to be ruled out
            earlier = F.arrays_overlap("before1", "before2")
            last = [*columns, "m", "before"]
            paired = side(rest, 1, last).join(side(rest, 2, last), "token").where(fits & order & alone & ~earlier).select("gid1", "comp1", "n1", "gid2", "comp2", "n2").distinct()
            for i in (1, 2):
                paired = paired.join(side(placed, i, ["gid", "comp", "key", *marks]), [f"gid{i}", f"comp{i}"])
            cross = paired.where(apart).select(pair)
        cross = written(cross.select("p.*").distinct(), "cross")
        more = written(_verified(cross, reps, percent), "links")
        forget(placed, tokens, rest, cross)
        if not more.isEmpty():
            edges = written(edges.union(more), "links")
            comp = components(edges, "x", "y")
    forget(found, groups, members)
    return comp


def join(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without text, with n_shingles and component_id; columns of these names are replaced."""
    docs = docs.drop("n_shingles", "component_id")
    members = _members(docs, text, k, percent)
    reps = members.where("__j_set is not null").groupBy("__j_key").agg(F.first("__j_set").alias("set"), F.first("__j_n").alias("n"))
    reps = written(reps.select(F.col("__j_key").alias("key"), "n", "set"), "representatives")
    comp = links(reps, percent).select(F.col("node").alias("__j_node"), F.col("component").alias("__j_comp"))
    tied = members.drop("__j_set").join(comp, F.col("__j_key") == F.col("__j_node"), "left").withColumn("__j_comp", F.coalesce("__j_comp", "__j_key")).drop("__j_node", "__j_key")
    tied = written(tied, "members")
    forget(members)
    # a row for each component of several documents
    least = tied.where("__j_n > 0").groupBy(F.col("__j_comp").alias("__j_c")).agg(F.min(doc_id).alias("__j_least"), F.count("*").alias("__j_m")).where("__j_m > 1").drop("__j_m")
    least = small(written(least, "least"), BROADCAST_IDS)
    named = tied.join(least, (F.col("__j_comp") == F.col("__j_c")) & (F.col("__j_n") > 0), "left")
    named = named.withColumn("n_shingles", F.col("__j_n")).withColumn("component_id", F.coalesce("__j_least", doc_id))
    return named.drop("__j_n", "__j_comp", "__j_c", "__j_least")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each component, the one of the least doc_id; of rows with that id, any one.

    Rows with a null doc_id stay: nothing names them.
    """
    ids = written(join(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), k, percent), "components")
    gone = small(written(ids.where("doc_id <> component_id").select(F.col("doc_id").alias("__k_id")).distinct(), "gone"), BROADCAST_IDS)
    out = docs.join(gone, F.col(doc_id) == F.col("__k_id"), "left_anti")
    again = ids.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("__k_id")).count().where("count > 1").select("__k_id")
    if again.isEmpty():
        return out
    again = small(written(again, "again"), BROADCAST_IDS)
    once = out.join(again, F.col(doc_id) == F.col("__k_id"), "left_semi").dropDuplicates([doc_id])
    return out.join(again, F.col(doc_id) == F.col("__k_id"), "left_anti").union(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85)


def sql(k: int, percent: int, docs: str = "documents") -> str:
    return f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from {docs}),
s as (select distinct doc_id, md5(array_to_string(ws[i:i+{k - 1}], ' ')) as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - {k - 2}, 2))) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select x, y from o join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= {percent} * (p.n + q.n - c)),
b as (select x, y from e union select y, x from e),
r as (select doc_id as x, doc_id as m from d union select b.y, r.m from r join b on b.x = r.x where r.m < b.y)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, (select min(m) from r where r.x = d.doc_id)) as component_id
from d left join n using (doc_id)
"""


SQL = sql(4, 85)
