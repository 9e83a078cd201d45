"""Column functions over names, defaults, versions, digests and JSON arrays; built-in expressions but for two UDFs."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = "sha256:"


def digest(text: Column) -> Column:
    """Prefixed SHA-256 of a text or binary column."""
    return F.concat(F.lit(PREFIX), F.sha2(text, 256))


def digest_of(text: str) -> str:
    """digest() of a text that the driver has."""
    return PREFIX + hashlib.sha256(text.encode()).hexdigest()


def prefixed(text: Column) -> Column:
    """A digest with its prefix, added where it is missing."""
    return F.when(text.startswith(PREFIX), text).otherwise(F.concat(F.lit(PREFIX), text))


def or_default(text: Column, default: str) -> Column:
    """text, or default where it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def first_filled(*columns: Column, default: str = "") -> Column:
    """The first of columns that is neither null nor empty, as text; Booleans are True and False. Of a list see first_of_list()."""
    text = lambda c: F.when(F.typeof(c) == "boolean", F.initcap(c.cast("string"))).otherwise(c.cast("string"))
    return F.coalesce(*(F.nullif(text(c), F.lit("")) for c in columns), F.lit(default))


def first_of_list(items: Column) -> Column:
    """The first item of an array that is neither null nor empty."""
    return F.get(F.filter(F.transform(items, lambda x: x.cast("string")), lambda x: x != ""), 0)


def file_name(text: Column) -> Column:
    """A name that is safe for a file: runs of separators and white space become one underscore."""
    return or_default(F.btrim(F.regexp_replace(text, r'(?U)[/\\:*?"<>|\s.]+', "_"), F.lit("_")), "unnamed")


def version(text: Column) -> Column:
    """The leading numeric parts of a dotted version as an array, which compares part by part; parts beyond 38 digits count as the largest."""
    parts = F.split(text, r"\.")
    bad = F.array_position(F.transform(parts, lambda p: ~p.rlike("^[0-9]+$")), F.lit(True))
    return F.transform(F.slice(parts, 1, F.when(bad == 0, F.size(parts)).otherwise(bad - 1).cast("int")), lambda p: F.coalesce(p.try_cast("decimal(38,0)"), F.lit("9" * 38).cast("decimal(38,0)")))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and 24 hex digits of the digest of the parts' JSON list; parts are texts without control characters."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, 24))


def _plain(x: object) -> object:
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return {k: _plain(v) for k, v in x.asDict().items()}
    if hasattr(x, "tolist"):
        return _plain(x.tolist())
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def canonical(value: object, ascii_only: bool) -> str:
    """JSON with sorted keys and no spaces; NaN and infinities raise ValueError."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False)


def canonical_json(*columns: Column, ascii_only: bool = True) -> Column:
    """Canonical JSON of a struct of columns, with numbers as Python writes them.

    A UDF over Arrow batches: to_json writes doubles in another form, and the text is hashed.
    """

    @F.arrow_udf("string")
    def write(rows: pa.Array) -> pa.Array:
        encode = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False).encode
        return pa.array([encode(r) for r in rows.to_pylist()], pa.string())

    return write(F.struct(*columns))


@F.pandas_udf(T.StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    """Canonical raw-UTF-8 form of texts that hold JSON; null where they do not."""

    def one(t: object) -> str | None:
        try:
            return canonical(json.loads(t), False)
        except (TypeError, ValueError):
            return None

    return texts.map(one)


# ---- arrays ---------------------------------------------------------------------------------------------------------


def blank_cell(cell: Column) -> Column:
    return cell.isNull() | F.trim(cell).isin("", "null")


def quoted_nonfinite(text: Column) -> Column:
    """JSON text whose bare NaN and infinities are texts, so that they can be read as such."""
    return F.regexp_replace(text, r'(?<![\w"-])(-?(?:NaN|Infinity))(?![\w"])', '"$1"')


def _flat_items(cell: Column) -> Column:
    """The scalars of a JSON array cell of any depth, mixed depths too, as texts; null where it is not JSON or no array."""
    cell = quoted_nonfinite(cell)
    # within an object and within a list, as the parser leaves what follows a whole value unread
    outer = F.from_json(F.concat(F.lit('{"a":'), cell, F.lit("}")), "struct<a:array<string>>")["a"]
    alone = F.size(F.from_json(F.concat(F.lit("["), cell, F.lit("]")), "array<string>")) == 1
    # brackets outside of strings fall away, and what is left is a flat list
    bare = F.regexp_replace(cell, r'("(?:[^"\\]++|\\.)*+")|[\[\]\s]', "$1")
    bare = F.btrim(F.regexp_replace(bare, ",+", ","), F.lit(","))
    items = F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<string>")
    nested = F.exists(outer, lambda x: x.startswith("["))
    return F.when(outer.isNotNull() & alone, F.when(nested, items).otherwise(outer))


def number(x: Column, kind: str = "double") -> Column:
    """A scalar's text as a number: digits in strings and Booleans count too; null for anything else, null items included."""
    t = F.trim(x)
    word = F.when(F.lower(t).isin("nan", "+nan", "-nan"), "NaN").when(F.lower(t).isin("inf", "+inf", "infinity", "+infinity"), "Infinity").when(F.lower(t).isin("-inf", "-infinity"), "-Infinity")
    value = F.when(t.isin("true", "false"), t.isin("true").cast("int").cast("double")).otherwise(F.coalesce(word, F.when(t.rlike("[0-9][dDfF]$"), None).otherwise(t)).try_cast("double"))
    return value if kind == "double" else value.cast(kind)


def decode_array(cell: Column, kind: str = "double") -> Column:
    """A JSON array cell of any depth, flattened; null for blank cells and for cells that are no arrays."""
    return F.when(~blank_cell(cell), F.transform(_flat_items(cell), lambda x: number(x, kind)))


def decode_failed(cell: Column, decoded: Column) -> Column:
    """Whether a cell holds something that decode_array could not take, or a null number."""
    return ~blank_cell(cell) & (decoded.isNull() | F.exists(decoded, lambda x: x.isNull()))


def array_shape(cell: Column) -> Column:
    """Sizes along the first elements of a JSON array cell, of any depth; null for blank cells."""
    depth = F.length(F.regexp_extract(F.regexp_replace(cell, r"\s", ""), r"^\[+", 0))

    # as many steps as brackets at the start: each takes the size of what is left and goes on with its first element
    def step(a: Column, _: Column) -> Column:
        level = F.from_json(a["at"], "array<string>")
        return F.struct(F.get(level, F.lit(0)).alias("at"), F.when(level.isNull(), a["sizes"]).otherwise(F.concat(a["sizes"], F.array(F.size(level)))).alias("sizes"))

    start = F.struct(cell.alias("at"), F.array().cast("array<int>").alias("sizes"))
    sizes = F.aggregate(F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")), start, step, lambda a: a["sizes"])
    return F.when(~blank_cell(cell), sizes)


def ragged(cell: Column) -> Column:
    """Whether a cell's items are not as many as its shape says."""
    product = F.aggregate(array_shape(cell), F.lit(1).cast("long"), lambda a, n: a * n)
    return F.coalesce(product != F.size(_flat_items(cell)), F.lit(False))


def null_if_empty(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def lengths_agree(*arrays: Column) -> Column:
    """Whether those of the arrays that are not null have one size."""
    sizes = F.filter(F.array(*(F.when(a.isNotNull(), F.size(a)) for a in arrays)), lambda n: n.isNotNull())
    return F.size(F.array_distinct(sizes)) <= 1


def finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def nonfinite_field(**arrays: Column) -> Column:
    """The name of the first array, or number, that holds NaN or an infinity; null if none does."""
    return F.coalesce(*(F.when(F.exists(a, lambda x: ~finite(x)), F.lit(name)) for name, a in arrays.items()))


def sample_count(indices: Column, shape: Column) -> Column:
    """The number of indices if there are any, else the first size of a shape."""
    return F.coalesce(F.when(F.size(indices) > 0, F.size(indices)), F.try_element_at(shape, F.lit(1)))


def rmse(pairs: Column) -> Column:
    """Root mean square of an array of differences."""
    return F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda a, d: a + d * d) / F.size(pairs))


def ancestors(path: Column) -> Column:
    """All leading parts of a path of names separated by '/', itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def canonical_map(entries: Column) -> Column:
    """Canonical JSON of a map of texts."""

    @F.arrow_udf("string")
    def write(maps: pa.Array) -> pa.Array:
        return pa.array([canonical(dict(m), True) for m in maps.to_pylist()], pa.string())

    return write(entries)
