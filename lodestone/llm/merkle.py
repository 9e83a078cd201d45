"""Operator 12, Merkle dataset manifest: a tree of digests over all rows, and each leaf's proof by pointer jumping.

H is the lowercase hexadecimal SHA-256 of its inputs joined, digests among them as hexadecimal text. A leaf is H of a row's fields,
each "-" if null, else its UTF-8 byte count, ":" and the value. In each group (source) leaves ascend by key; while several nodes
remain, every RUN consecutive ones become their H, the last run with what is left. What remains is the group's subroot. Subroots in
order of their groups give the root in the same way.

Proofs: a node holds its siblings on the way to an ancestor, first its parent. A self-join on the ancestor appends what that
one holds and takes over its ancestor, so distances double until all leaves hold their way to the root: log2(height) rounds.
Each round only needs nodes that lie as high as its distance, a share that shrinks by RUN to the power of it; they are broadcast where
their rows and segments were counted to be at most BROADCAST, and else joined by ancestor, which has at most RUN^distance leaves below it.

Rows are numbered in their groups by ranges of (group, key, leaf) and counts by range, so a group of any size is spread
over tasks. Every table that is read again is written to the shared folder first; intermediate ones are deleted.

Special rows: null keys come first, and so does the group of null; rows of equal keys are ordered by leaf; repeated rows are
leaves of their own; a null text is "-" and an empty one "0:"; a group of one leaf has it as subroot; an empty table
has no rows and no root. Columns that are neither key, group nor fields are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import forget, partitions, read, small, written

RUN = 3
BROADCAST = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SIBLINGS = "array<struct<left:binary,right:binary>>"


def leaf(*fields: Column) -> Column:
    """H of fields, which are texts or integers."""
    told = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*(told(c.cast("string")) for c in fields)), 256)


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(proof, start, lambda a, s: F.sha2(F.concat(_text(s["left"]), a, _text(s["right"])), 256))


def proof_digest(proof: Column) -> Column:
    """H of all siblings, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(_text(s["left"]), _text(s["right"]))), ""), 256)


def ranked(rows: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """rows with rank, their number from 0 in their group (or in all), and size, the group's count; rows is a written table."""
    keys = [*([group] if group else []), *order]
    placed = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()), "placed").withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy((F.col(group) if group else F.lit(0)).alias("run_group"), F.col("part").alias("run_part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    by_group = Window.partitionBy("run_group")
    before = F.coalesce(F.sum("n").over(by_group.orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select("run_group", "run_part", (F.col("first") - before).alias("off"), F.sum("n").over(by_group).alias("size")), "runs")
    size = F.octet_length(F.col("run_group").cast("string")) / 64
    same = (F.col("run_part") == F.col("part")) & (F.col(group).eqNullSafe(F.col("run_group")) if group else F.lit(True))
    found = placed.join(small(runs, BROADCAST, size), same).select(*rows.columns, (F.col("at") - F.col("off")).alias("rank"), "size")
    out = written(found, "ranked")
    forget(placed, runs)
    return out


def _height(size: Column) -> Column:
    """How often runs are taken until one node remains."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(40)), lambda k: F.pow(F.lit(float(RUN)), k) < size))


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """For each level below the top the runs of its nodes: (g, h, idx, kids, digest); nodes: (g, h, idx, digest, *more), which kids keep."""
    out = []
    more = [c for c in nodes.columns if c not in ("g", "h")]
    for level in range(most):
        kid = F.struct(*(more if level == 0 else ["idx", "digest"]))
        runs = nodes.where(F.col("h") > level).groupBy("g", "h", F.expr(f"idx div {RUN}").alias("up")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        digest = F.unhex(F.sha2(F.array_join(F.transform("kids", lambda k: _text(k["digest"])), ""), 256))
        out.append(written(runs.select("g", "h", F.col("up").alias("idx"), "kids", digest.alias("digest")), "runs"))
        nodes = out[-1].select("g", "h", "idx", "digest")
    return out


def _links(levels: list[DataFrame], top: dict[str, Column]) -> list[DataFrame]:
    """Each level's nodes with their parent and the siblings beside them; top: (g, level, idx) by which a tree's top is known."""
    out = []
    for level, runs in enumerate(levels):
        last = F.col("h") == level + 1
        inside = {"g": F.col("g"), "level": F.lit(level + 1), "idx": F.col("up")}
        up = [F.when(last, top[x]).otherwise(inside[x]).alias(f"up_{x}") for x in top]
        rows = runs.select("g", "h", F.col("idx").alias("up"), "kids", F.explode("kids").alias("kid"))
        beside = lambda keep: F.aggregate(F.filter("kids", keep), F.lit(b""), lambda a, k: F.concat(a, k["digest"]))
        seg = F.array(F.struct(beside(lambda k: k["idx"] < F.col("kid.idx")).alias("left"), beside(lambda k: k["idx"] > F.col("kid.idx")).alias("right")))
        out.append(rows.select("g", F.lit(level).alias("level"), F.col("kid.idx").alias("idx"), *up, seg.cast(_SIBLINGS).alias("seg"), "h", "kid"))
    return out


def manifest(leaves: DataFrame, key: str, group: str, digest: str = "leaf", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, group, leaf, *carry, subroot, root, proof) of each row of leaves (key, group, digest, *carry).

    proof is an array of (left, right): the digests beside the node on each level, joined as bytes.
    """
    rows = written(leaves.select(F.col(key).alias("key"), F.col(group).alias("group"), F.col(digest).alias("leaf"), F.struct(F.lit(0).alias("_"), *carry).alias("carry")), "leaves")
    names = written(rows.select("group").distinct(), "groups")
    groups = ranked(names, None, ["group"]).withColumnsRenamed({"group": "of", "rank": "g"})
    wide = F.octet_length(F.col("of").cast("string")) / 64
    base = ranked(rows, "group", ["key", "leaf"]).join(small(groups.select("of", "g"), BROADCAST, wide), F.col("group").eqNullSafe(F.col("of")))
    base = base.select("g", _height(F.col("size")).alias("h"), F.col("rank").alias("idx"), F.unhex("leaf").alias("digest"), "key", "group", "carry")
    base = written(base, "base")
    forget(rows, names)
    high = base.agg(F.max("h")).first()[0] or 0
    n = groups.count()
    above = next(k for k in range(64) if RUN**k >= max(n, 1))
    # the groups' trees, then the tree of their subroots, whose group is -1
    levels = _levels(base, high)
    tops = [base.where("h = 0").select("g", "digest"), *(runs.where(F.col("h") == k + 1).select("g", "digest") for k, runs in enumerate(levels))]
    tops = written(reduce(DataFrame.union, tops), "tops")
    roots = _levels(tops.select(F.lit(-1).cast("long").alias("g"), F.lit(above).alias("h"), F.col("g").alias("idx"), "digest"), above)
    found = (roots[-1] if roots else tops).select(_text(F.col("digest"))).first()
    root = F.lit(found[0] if found else None).cast("string")
    place = ["g", "level", "idx", "up_g", "up_level", "up_idx", "seg"]
    own = F.struct("key", "group", "carry", "h", "digest")
    none = F.lit(None).cast(base.select(own.alias("row")).schema["row"].dataType).alias("row")
    to_root = {"g": F.lit(-1).cast("long"), "level": F.lit(0), "idx": F.col("g")}
    lone = base.where("h = 0").select("g", F.lit(0).alias("level"), "idx", *(c.alias(f"up_{x}") for x, c in to_root.items()), F.array().cast(_SIBLINGS).alias("seg"), own.alias("row"))
    low, top = _links(levels, to_root), _links(roots, to_root | {"level": F.lit(above), "idx": F.lit(0).cast("long")})
    leaves_ = [df.select(*place, F.struct("kid.key", "kid.group", "kid.carry", "h", "kid.digest").alias("row")) for df in low[:1]]
    state = written(reduce(DataFrame.union, [lone, *leaves_, *(df.select(*place, none) for df in low[1:] + top)]), "links")
    forget(*levels, *roots, base)
    rounds = (max(high, 1) + above - 1).bit_length()
    for k in range(rounds):
        state = _doubled(state, 1 << k, leaves_only=k == rounds - 1)
    subroots = small(tops.select(F.col("g").alias("top"), _text(F.col("digest")).alias("subroot")), BROADCAST)
    done = state.where("row is not null").join(subroots, F.col("g") == F.col("top"))
    return done.select(F.col("row.key").alias(key), F.col("row.group").alias(group), _text(F.col("row.digest")).alias("leaf"), *(F.col(f"row.carry.{c}").alias(c) for c in carry), "subroot", root.alias("root"), F.col("seg").alias("proof"))


def _doubled(state: DataFrame, distance: int, leaves_only: bool) -> DataFrame:
    """state with each node's ancestor replaced by that one's ancestor, and its siblings appended."""
    over = state.where((F.col("level") >= distance) | (F.col("g") < 0)).select(*(F.col(c).alias(f"o_{c}") for c in ("g", "level", "idx", "up_g", "up_level", "up_idx", "seg")))
    below = state.where("row is not null") if leaves_only else state
    same = (F.col("up_g") == F.col("o_g")) & (F.col("up_level") == F.col("o_level")) & (F.col("up_idx") == F.col("o_idx"))
    joined = below.join(small(over, BROADCAST, F.size("o_seg")), same, "left")
    up = [F.coalesce(f"o_{c}", c).alias(c) for c in ("up_g", "up_level", "up_idx")]
    seg = F.when(F.col("o_seg").isNull(), F.col("seg")).otherwise(F.concat("seg", "o_seg"))
    joined = joined.select("g", "level", "idx", *up, seg.alias("seg"), "row")
    if leaves_only:
        return joined
    out = written(joined, "links")
    forget(state)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    changed = F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n")), leaf(*(F.col(c) for c in FIELDS[:-1]), F.replace("text", F.lit("\n"), F.lit(""))))
    rows = docs.select("doc_id", "source", leaf(*map(F.col, FIELDS)).alias("leaf"), changed.alias("changed"))
    found = manifest(rows, "doc_id", "source", carry=("changed",))
    again = folded(F.coalesce("changed", "leaf"), F.col("proof"))
    out = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_LEAF = " || ".join("coalesce(strlen({0}::varchar)::varchar || ':' || {0}, '-')".format(c) for c in FIELDS[:-1])
_SHUT = "coalesce(strlen({0})::varchar || ':' || {0}, '-')"
_STEP = "coalesce(string_agg(n.digest, '' order by n.idx) filter (where n.idx {0} p.idx), '')"


def _way(name: str, start: str, nodes: str, keys: str, same: str) -> str:
    """The recursion from a leaf's place up one tree: its digest again and the siblings' text."""
    left, right = _STEP.format("<"), _STEP.format(">")
    return f"""{name} as ({start} union all select p.rid, {keys} p.level + 1, p.idx // 3, (p.size + 2) // 3, sha256({left} || p.f || {right}), p.proof || {left} || {right}
    from {name} p left join {nodes} n on {same} n.level = p.level and n.idx // 3 = p.idx // 3 and n.idx <> p.idx where p.size > 1 group by p.rid, {keys} p.level, p.idx, p.size, p.f, p.proof)"""


#: The CRC's table comes from its rule; trees are built level by level, and each leaf goes up level by level.
SQL = f"""with recursive crc as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) tab),
  d as (select doc_id, source, sha256({_LEAF} || {_SHUT.format("text")}) leaf, sha256({_LEAF} || {_SHUT.format("replace(text, chr(10), '')")}) less,
    xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 2 = 0 odd from documents, crc),
  l as (select *, row_number() over () rid, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 idx, count(*) over (partition by source) size from d),
  t as (select source, 0 as level, idx, leaf digest, size from l union all
    select source, level + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), (size + 2) // 3 from t where size > 1 group by source, level, idx // 3, size),
  s as (select source, digest, row_number() over (order by source nulls first) - 1 idx, count(*) over () size from t where size = 1),
  u as (select 0 as level, idx, digest, size from s union all select level + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), (size + 2) // 3 from u where size > 1 group by level, idx // 3, size),
  {_way("p1", "select rid, source, 0 as level, idx, size, case when odd then less else leaf end f, '' proof from l", "t", "p.source,", "n.source is not distinct from p.source and")},
  {_way("p2", "select p1.rid, 0 as level, s.idx, s.size, p1.f, p1.proof from p1 join s on s.source is not distinct from p1.source where p1.size = 1", "u", "", "")}
  select doc_id, leaf, s.digest subroot, u.digest root, sha256(p2.proof) proof_sha256, p2.f folded_root, p2.f = u.digest verified
    from l join s on s.source is not distinct from l.source join p2 on p2.rid = l.rid and p2.size = 1 join u on u.size = 1"""
