"""Operator 1, quality rules: adaptive thresholds from mergeable quantile sketches by language and source.

Pass 1 turns each text into a few integer measures. A sketch of a measure is a table of counts by *edge*: a value
with all but its five leading bits cleared (relative error 1/16). Sketches merge by adding counts, so partial
aggregation, a language's sketch from its sources' and the corpus's from all languages' are the same operation, and
the result depends on neither partitioning nor order. From the sketch of texts that pass the base rules come the
three quartiles, and from these a band: the upper quartile plus SPREADS times its distance to the median (at
least a floor per measure), and likewise below. A (language, source) with fewer than MIN_TEXTS such texts uses its
language's band, a language with fewer the corpus's. Pass 2 joins each text with its group's band and filters.

Results for special rows: null text counts as no words and fails the base rules; null lang or source are groups of
their own; repeated rows are judged alike and count each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .tables import read, small, written

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_upper"]
SPREADS = 8
MIN_TEXTS = 200
#: measure -> (numerator, factor, denominator, least spread, whether values below the band fail too)
MEASURES = {
    "symbol_rate": ("n_symbols", 1000, "word_chars", 8, False),
    "upper_rate": ("n_upper", 1000, "word_chars", 40, False),
    "word_length": ("word_chars", 100, "n_words", 50, True),
    "dup_line_rate": ("n_dup_lines", 1000, "n_words", 5, False),
    "repeat_rate": ("n_repeat_words", 1000, "n_words", 20, False),
}
#: Groups up to this number are joined by broadcast, more by a shuffle.
BROADCAST_GROUPS = 50_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(windows: np.ndarray) -> int:
    """Words in 5-word windows that occur twice or more."""
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    if len(counts) == len(windows):
        return 0
    edge = np.zeros(len(windows) + 5, np.int64)
    at = np.flatnonzero(counts[inverse] > 1)
    edge[at] += 1
    np.subtract.at(edge, at + 5, 1)
    return int((np.cumsum(edge) > 0).sum())


def _measure(column: pa.Array) -> dict[str, list[int]]:
    out: dict[str, list[np.ndarray]] = {k: [] for k in COUNTS}
    for _, offsets, data in tx.slices(column):
        n = len(offsets) - 1
        starts, ends, doc = tx.words(data, offsets)
        h, owner = tx.shingles(tx.word_hashes(data, starts, ends), doc, 5)
        n_words = np.bincount(doc, minlength=n)
        bound = np.searchsorted(owner, np.arange(n + 1))
        out["n_words"].append(n_words)
        out["word_chars"].append(_sums(~tx._SPACE[data] & ((data & 0xC0) != 0x80), offsets))
        out["n_symbols"].append(_sums(_SYMBOL[data], offsets))
        out["n_upper"].append(_sums((data >= 65) & (data <= 90), offsets))
        out["n_repeat_words"].append(np.array([_repeated(h[a:b]) if w > 5 else 0 for a, b, w in zip(bound[:-1], bound[1:], n_words)], np.int64))
        raw, dups = data.tobytes(), []
        for a, b in zip(offsets[:-1], offsets[1:]):
            lines = [x for x in raw[a:b].split(b"\n") if x.strip(b" \t\n\v\f\r")]
            dups.append(len(lines) - len(set(lines)))
        out["n_dup_lines"].append(np.array(dups, np.int64))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the counts of COUNTS as longs, named with a prefix; columns of these names are replaced."""
    docs = docs.drop(*[prefix + k for k in COUNTS])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + k, T.LongType()) for k in COUNTS)])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                found = _measure(batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[k], pa.int64()) for k in COUNTS)], names=schema.names)

    return docs.mapInArrow(run, schema)


def base_failed(prefix: str = "") -> F.Column:
    n = F.col(prefix + "n_words")
    return (n < 10) | (100 * F.col(prefix + "n_repeat_words") > 20 * n)


def measures(prefix: str = "") -> dict[str, F.Column]:
    return {m: F.expr(f"{factor} * `{prefix}{num}` div greatest(`{prefix}{den}`, 1)") for m, (num, factor, den, _, _) in MEASURES.items()}


def _edge(v: F.Column) -> F.Column:
    shift = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def bands(counts: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "") -> DataFrame:
    """One row for each (lang, source) of counts: <measure>_lo and <measure>_hi of its band."""
    values = counts.where(~base_failed(prefix)).select(
        F.col(lang).alias("lang"),
        F.col(source).alias("source"),
        F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), _edge(v).alias("edge")) for m, v in measures(prefix).items()))).alias("x"),
    )
    sketch = values.groupBy("lang", "source", "x.measure", "x.edge").agg(F.count("*").alias("n"))
    sketch = written(sketch, "sketch")
    of_lang = sketch.groupBy("lang", "measure", "edge").agg(F.sum("n").alias("n"))
    of_all = of_lang.groupBy("measure", "edge").agg(F.sum("n").alias("n"))
    groups = counts.select(F.col(lang).alias("lang"), F.col(source).alias("source")).distinct()

    own = _band(sketch, ["lang", "source"], 0)
    langs = _band(of_lang, ["lang"], 1)
    corpus = _band(of_all, [], 2)
    g = groups.alias("g")
    out = g.join(own.alias("o"), F.expr("g.lang <=> o.lang and g.source <=> o.source"), "left")
    out = out.join(langs.alias("l"), F.expr("g.lang <=> l.lang"), "left").join(F.broadcast(corpus).alias("c"), F.lit(True), "left")
    picked = []
    for m in MEASURES:
        for side in ("lo", "hi"):
            picked.append(F.expr(f"case when o.total0 >= {MIN_TEXTS} then o.{m}_{side}0 when l.total1 >= {MIN_TEXTS} then l.{m}_{side}1 else c.{m}_{side}2 end").alias(f"{m}_{side}"))
    return out.select("g.lang", "g.source", *picked)


def _band(sketch: DataFrame, by: list[str], level: int) -> DataFrame:
    """From counts by edge: total and each measure's band of a group (measures bounded, so a group's rows are few)."""
    w = Window.partitionBy(*by, "measure")
    cum = sketch.withColumn("cum", F.sum("n").over(w.orderBy("edge"))).withColumn("total", F.sum("n").over(w))
    q = cum.groupBy(*by, "measure").agg(
        F.max("total").alias("total"),
        *(F.min(F.when(F.col("cum") * 4 >= F.col("total") * d, F.col("edge"))).alias(f"q{d}") for d in (1, 2, 3)),
    )
    spread = F.create_map(*(F.lit(x) for m, v in MEASURES.items() for x in (m, v[3])))[F.col("measure")]
    two_sided = F.col("measure").isin([m for m, v in MEASURES.items() if v[4]])
    q = q.withColumn("hi", F.col("q3") + SPREADS * F.greatest(F.col("q3") - F.col("q2"), spread))
    q = q.withColumn("lo", F.when(two_sided, F.col("q1") - SPREADS * F.greatest(F.col("q2") - F.col("q1"), spread)).otherwise(F.lit(-1)))
    return q.groupBy(*by).agg(
        F.max("total").alias(f"total{level}"),
        *(F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}{level}") for m in MEASURES for side in ("lo", "hi")),
    )


def _judged(counts: DataFrame, table: DataFrame, lang: str, source: str, prefix: str = "") -> DataFrame:
    """counts with columns <prefix>base_failed and <prefix>kept."""
    table = small(written(table, "bands"), BROADCAST_GROUPS).select(*(F.col(c).alias(f"__b_{c}") for c in table.columns))
    joined = counts.join(table, F.col(lang).eqNullSafe(F.col("__b_lang")) & F.col(source).eqNullSafe(F.col("__b_source")), "left")
    inside = F.lit(True)
    for m, v in measures(prefix).items():
        inside &= F.coalesce(v.between(F.col(f"__b_{m}_lo"), F.col(f"__b_{m}_hi")), F.lit(True))
    joined = joined.withColumn(f"{prefix}base_failed", base_failed(prefix))
    return joined.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & inside).drop(*table.columns)


def verdicts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs without its text, with COUNTS, base_failed and kept; columns of these names are replaced."""
    docs = docs.drop("base_failed", "kept")
    counts = written(with_counts(docs, text).drop(text), "counts")
    return _judged(counts, bands(counts, lang, source), lang, source)


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with their columns. Measures twice, so that no text is shuffled or stored."""
    p = "__q_"
    narrow = with_counts(docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source")), "text", p).drop("text")
    table = bands(narrow, prefix=p)
    return _judged(with_counts(docs, text, p), table, lang, source, p).where(f"{p}kept").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return verdicts(docs).select("doc_id", *BASE, "base_failed", "kept", "n_upper", "lang", "source")


def _sql() -> str:
    values = ", ".join(f"{factor} * {num} // greatest({den}, 1) as {m}" for m, (num, factor, den, _, _) in MEASURES.items())
    names = ", ".join(MEASURES)
    spread = " ".join(f"when '{m}' then {v[3]}" for m, v in MEASURES.items())
    two = ", ".join(f"'{m}'" for m, v in MEASURES.items() if v[4])

    def band(source: str, by: str) -> str:
        keys = f"{by}, " if by else ""
        return f"""select {keys}measure, max(total) total,
    min(edge) filter (cum * 4 >= total * 1) q1, min(edge) filter (cum * 4 >= total * 2) q2, min(edge) filter (cum * 4 >= total * 3) q3
  from (select {keys}measure, edge, sum(n) over (partition by {keys}measure order by edge) cum, sum(n) over (partition by {keys}measure) total from {source})
  group by {keys}measure"""

    return f"""
with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws from d),
p as (select rid, unnest(range(1, len(ws) - 3)) as i, ws from w where len(ws) > 4),
g as (select rid, i, array_to_string(ws[i:i+4], ' ') as win from p),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, win) as c from g) where c > 1),
rep as (select rid, count(distinct j) as n from (select rid, unnest(range(i, i + 5)) as j from r) group by rid),
l as (select rid, unnest(string_split(t, chr(10))) as line from d),
dup as (select rid, count(*) - count(distinct line) as n from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by rid),
c as (select d.rid, doc_id, lang, source, len(ws)::bigint as n_words,
    coalesce(length(array_to_string(ws, '')), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as n_upper,
    coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
  from d join w using (rid) left join rep using (rid) left join dup using (rid)),
f as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed, {values} from c),
u as (unpivot (select rid, coalesce(lang, '~') as lang, coalesce(source, '~') as source, {names} from f where not base_failed) on {names} into name measure value v),
e as (select lang, source, measure, (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) as edge from u),
s0 as (select lang, source, measure, edge, count(*) n from e group by all),
s1 as (select lang, measure, edge, sum(n) n from s0 group by all),
s2 as (select measure, edge, sum(n) n from s0 group by all),
b0 as ({band("s0", "lang, source")}),
b1 as ({band("s1", "lang")}),
b2 as ({band("s2", "")}),
picked as (select g.lang, g.source, b2.measure,
    case when b0.total >= {MIN_TEXTS} then b0.q1 when b1.total >= {MIN_TEXTS} then b1.q1 else b2.q1 end q1,
    case when b0.total >= {MIN_TEXTS} then b0.q2 when b1.total >= {MIN_TEXTS} then b1.q2 else b2.q2 end q2,
    case when b0.total >= {MIN_TEXTS} then b0.q3 when b1.total >= {MIN_TEXTS} then b1.q3 else b2.q3 end q3
  from (select distinct lang, source from u) g cross join b2
  left join b0 on b0.lang = g.lang and b0.source = g.source and b0.measure = b2.measure
  left join b1 on b1.lang = g.lang and b1.measure = b2.measure),
band as (select *, q3 + {SPREADS} * greatest(q3 - q2, case measure {spread} end) as hi,
    case when measure in ({two}) then q1 - {SPREADS} * greatest(q2 - q1, case measure {spread} end) else -1 end as lo from picked),
bad as (select distinct rid from u join band using (lang, source, measure) where v < lo or v > hi)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and bad.rid is null) as kept, n_upper, lang, source
from f left join bad using (rid)
"""


SQL = _sql()
