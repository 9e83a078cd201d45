"""Run manifests as tables: the lines of many texts at once, section headers filled forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.documents import SECTIONS

_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_PAIR = r"^([A-Za-z_][A-Za-z0-9_]*):(?:\s+(.*))?$"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _unquoted(text: Column) -> Column:
    t = _stripped(text)
    first = F.left(t, F.lit(1))
    return F.when((F.char_length(t) > 1) & (first == F.right(t, F.lit(1))) & first.isin("'", '"'), F.substring(t, F.lit(2), F.char_length(t) - 2)).otherwise(t)


def manifest_lines(texts: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """(name, line, section, section_line, key, value, bad): the lines that are neither blank nor comments.

    A scalar at the top has no section; an item of a list section no key. section_line is the header's. bad marks lines of forms that
    are not supported. Texts of one name are read apart.
    """
    return _numbered_lines(texts, name, text).drop("text_no")


def _numbered_lines(texts: DataFrame, name: str, text: str) -> DataFrame:
    """manifest_lines() with text_no, which tells texts apart whatever their names are."""
    rows = texts.select(F.monotonically_increasing_id().alias("text_no"), F.col(name).alias("name"), F.col(text).alias("text"))
    rows = rows.select("text_no", "name", F.posexplode(F.split(F.col("text"), _LINE_ENDS, -1)).alias("line", "raw"))
    body = _stripped(F.col("raw"))
    rows = rows.select("text_no", "name", (F.col("line") + 1).alias("line"), body.alias("body"), F.length(F.regexp_extract("raw", "^ *", 0)).alias("indent")).where((body != "") & ~body.startswith("#"))
    pair = F.col("body").rlike(_PAIR)
    key = F.when(pair, F.regexp_extract("body", _PAIR, 1))
    said = F.when(pair & F.col("body").rlike(r"^[A-Za-z0-9_]+:\s"), _unquoted(F.regexp_extract("body", _PAIR, 2)))
    rows = rows.withColumn("key", key).withColumn("said", said).withColumn("top", (F.col("indent") == 0) & pair)
    is_header = F.col("top") & F.col("said").isNull() & F.col("key").isin(list(SECTIONS))
    # what a line at the top says holds for those below it: the section it opens, or none
    opened = F.when(F.col("top"), F.struct(F.when(is_header, F.col("key")).alias("section"), F.col("line").alias("line")))
    so_far = Window.partitionBy("text_no").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("header", is_header).withColumn("open", F.last(opened, ignorenulls=True).over(so_far))
    lists = [s for s, kind in SECTIONS.items() if kind is list]
    inside = (F.col("indent") == 2) & F.col("open.section").isNotNull()
    item = inside & F.col("open.section").isin(lists) & F.col("body").startswith("- ")
    entry = inside & ~F.col("open.section").isin(lists) & F.col("said").isNotNull()
    scalar = F.col("top") & F.col("said").isNotNull()
    value = F.when(item, _unquoted(F.substring("body", F.lit(3), F.char_length("body")))).when(entry | scalar, F.col("said"))
    bad = ~F.coalesce(scalar | F.col("header") | item | entry, F.lit(False))
    section = F.when(F.col("header"), F.col("key")).when(item | entry, F.col("open.section"))
    return rows.select("text_no", "name", "line", section.alias("section"), F.when(F.col("header") | item | entry, F.col("open.line")).alias("section_line"), F.when(scalar | entry, F.col("key")).alias("key"), value.alias("value"), bad.alias("bad"))


def manifests(texts: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """(name, fields, model, predictions, preprocessing, bad_line), a row for each text that has a line.

    fields are the scalars at the top; sections are maps or a list, null where they are not opened; bad_line is the first line of a form that
    is not supported, null if there is none. What is said twice counts as said last, and a section opened again begins anew.
    """
    lines = _numbered_lines(texts, name, text)
    head = F.coalesce("section", "key")
    last = F.max(F.coalesce("section_line", "line")).over(Window.partitionBy("text_no", head))
    again = F.max("line").over(Window.partitionBy("text_no", head, F.when(F.col("section").isNotNull() & F.col("key").isNotNull(), F.col("key")).otherwise(F.col("line").cast("string"))))
    rows = lines.withColumn("kept", (F.coalesce("section_line", "line") == last) & (F.col("line") == again) & ~F.col("bad"))
    pairs = lambda where: F.map_from_entries(F.collect_list(F.when(F.col("kept") & where, F.struct("key", "value"))))
    out = [pairs(F.col("section").isNull() & F.col("key").isNotNull()).alias("fields")]
    for s, kind in SECTIONS.items():
        own = F.col("section") == s
        opened = F.max(F.when(own & F.col("kept"), 1)).isNotNull()
        if kind is dict:
            made = pairs(own & F.col("key").isNotNull())
        else:
            items = F.array_sort(F.collect_list(F.when(F.col("kept") & own & F.col("value").isNotNull(), F.struct("line", "value"))))
            made = F.transform(items, lambda x: x["value"])
        out.append(F.when(opened, made).alias(s))
    return rows.groupBy("text_no", "name").agg(*out, F.min(F.when(F.col("bad"), F.col("line"))).alias("bad_line")).drop("text_no")
