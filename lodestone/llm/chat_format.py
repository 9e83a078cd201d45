"""Operator 11, chat formatting: conversations as training texts of a token budget, in DataFrame functions only.

Prefix sums of the turns' tokens choose windows that begin and end at turns: a window takes turns as long as the system turn,
the repeated history and the new turns stay within the budget. Each window but the first repeats the conversation's system
turn and as many of the turns before it as fit into the history's budget; what is repeated is masked, so that each assistant
turn is a target once. A turn is never cut: one that is beyond the budget by itself is a window of its own, with the system turn and without history.

The template writes a turn as "<turn ROLE>\\n", its text and "</turn>\\n". A backslash goes behind each backslash of a text, and
behind "<" or "</" where "turn" follows, so no text holds a mark; in roles ">" gets one before it. Taking the first backslash of each
pair away gives the text again.

Turns are dealt out by conversation and 2^SEGMENT_BITS turn numbers, so that a conversation of any length is no single task; up to CARRY turns
before a segment and the system turn are copied into it, and windows end where a segment does. BLOCK bounds the rows that
are looked at together where turn numbers repeat: further rows of the same segment form blocks without system turn and history.

Special rows: rows are ordered by turn, role and text, nulls first; a null role or text is empty; rows with a null
conv_id are one conversation; repeated rows are turns of their own; an empty table has no windows. Only the four
columns named are read, whatever others there are. The system turn is the first turn if its role is "system" (also the first of
a segment that nothing was carried into).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read

BUDGET, HISTORY = 2048, 512
SEGMENT_BITS, CARRY, BLOCK = 10, 16, 2048
#: Tokens of a turn besides its text: the marks and the role.
MARKS = 4
#: Up to eight letters, up to three digits or any other mark that is no space count as a token.
TOKEN = r"\p{L}{1,8}|\p{N}{1,3}|[^\x20\x09-\x0D\p{L}\p{N}]"
CLOSE = "</turn>\n"
SYSTEM, TARGET = "system", "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|</?(?=turn)", r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def header(role: Column) -> Column:
    return F.concat(F.lit("<turn "), F.regexp_replace(escaped(role), ">", r"\\>"), F.lit(">\n"))


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long") + MARKS


def _dealt(turns: DataFrame) -> DataFrame:
    """Turns with their segment, and copies of what later segments need: kind 0 a system turn, 1 history, 2 the turn itself."""
    segment = F.shiftright("turn", SEGMENT_BITS)
    carried = F.col("turn") - F.shiftleft("segment", SEGMENT_BITS) >= (1 << SEGMENT_BITS) - CARRY
    own = F.struct("segment", F.lit(2).alias("kind"))
    places = F.when(carried, F.array(own, F.struct((F.col("segment") + 1).alias("segment"), F.lit(1).alias("kind")))).otherwise(F.array(own))
    rows = turns.withColumn("segment", segment).withColumn("place", F.explode(places)).select("conv_id", "turn", "role", "text", "place.*")
    # the later segments of conversations that have several, from two narrow columns
    there = turns.groupBy("conv_id", segment.alias("segment")).agg(F.min("turn").alias("first"))
    there = there.withColumn("first", F.min("first").over(Window.partitionBy("conv_id"))).where(F.col("segment") > F.shiftright("first", SEGMENT_BITS))
    there = there.select(F.col("conv_id").alias("long_id"), "segment", "first")
    heads = turns.where(F.col("role") == SYSTEM).groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    copies = heads.join(there, F.col("conv_id").eqNullSafe(F.col("long_id")) & (F.col("turn") == F.col("first")))
    return rows.union(copies.select("conv_id", "turn", F.lit(SYSTEM), "text", "segment", F.lit(0)))


def _greedy(items: Column, budget: int) -> Column:
    """The windows' first turns as (p, hist), from turns in order as (p, upto, hist, over)."""
    spans = "array<struct<p:bigint,hist:bigint>>"
    zero = F.struct(F.lit(None).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("room"), F.array().cast(spans).alias("starts"))

    def step(a: Column, x: Column) -> Column:
        opens = a["start"].isNull() | (x["upto"] - a["start"] > a["room"])
        begun = F.struct(x["p"].alias("start"), (F.lit(budget) - x["hist"] - x["over"]).alias("room"), F.concat(a["starts"], F.array(F.struct(x["p"].alias("p"), x["hist"].alias("hist")))).alias("starts"))
        return F.when(opens, begun).otherwise(a)

    return F.aggregate(items, zero, step, lambda a: a["starts"])


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each window: (conv_id, segment, block, window, text, loss, n_turns, n_context, n_tokens).

    text is the formatted window; loss its target spans (start, end) in code points, end exclusive; the first n_context of its
    n_turns turns are repeated ones.
    """
    empty = F.lit("")
    turns = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text"))
    rows = _dealt(turns).withColumn("tokens", tokens(F.col("text")))
    in_order = Window.partitionBy("conv_id", "segment").orderBy("kind", "turn", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(in_order)).withColumn("upto", F.sum("tokens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("p", F.col("upto") - F.col("tokens")).withColumn("block", F.floor((F.col("n") - 1) / BLOCK).cast("long"))
    rows = rows.withColumn("system", (F.col("kind") == 0) | (F.col("n") == 1) & (F.col("kind") == 2) & (F.col("role") == SYSTEM))
    by_place = Window.partitionBy("conv_id", "segment", "block").orderBy("p")
    whole = by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lowest = F.min(F.when(~F.col("system"), F.col("p"))).over(by_place.rangeBetween(-history, 0))
    rows = rows.withColumn("hist", F.coalesce(F.col("p") - lowest, F.lit(0))).withColumn("over", F.coalesce(F.sum(F.when(F.col("system"), F.col("tokens"))).over(whole), F.lit(0)))
    rows = rows.withColumn("over", F.when(F.col("system"), 0).otherwise(F.col("over")))
    rows = rows.withColumn("hist", F.when(F.col("hist") + F.col("over") + F.col("tokens") <= budget, F.col("hist")).otherwise(0))
    rows = rows.withColumn("items", F.collect_list(F.when(F.col("kind") == 2, F.struct("p", "upto", "hist", "over"))).over(whole)).withColumn("at", F.row_number().over(by_place))
    # the greedy choice is made once for each block and then handed to all its rows
    rows = rows.withColumn("starts", F.when(F.col("at") == 1, _greedy(F.col("items"), budget))).drop("items")
    rows = rows.withColumn("starts", F.first("starts", ignorenulls=True).over(whole))
    p = F.col("p")
    own = F.size(F.filter("starts", lambda s: s["p"] <= p)) - 1
    place = F.transform("starts", lambda s, i: F.struct(i.alias("window"), s["p"].alias("p"), s["hist"].alias("hist")))
    later = F.filter(place, lambda s: (s["p"] > p) & (F.col("system") | (p >= s["p"] - s["hist"])) | (F.col("kind") == 0))
    later = F.transform(later, lambda s: F.struct(s["window"].alias("window"), F.lit(False).alias("fresh")))
    here = F.when(F.col("kind") == 2, F.array(F.struct(own.alias("window"), F.lit(True).alias("fresh")))).otherwise(F.array().cast("array<struct<window:int,fresh:boolean>>"))
    head, body = header(F.col("role")), escaped(F.col("text"))
    rows = rows.withColumn("w", F.explode(F.concat(here, later))).withColumn("head", head).withColumn("body", body)
    turn_ = F.struct("p", F.concat("head", "body", F.lit(CLOSE)).alias("text"), F.char_length("head").cast("long").alias("lead"), F.char_length("body").cast("long").alias("size"), (F.col("w.fresh") & (F.col("role") == TARGET)).alias("target"))
    grouped = rows.groupBy("conv_id", "segment", "block", F.col("w.window").alias("window")).agg(
        F.array_sort(F.collect_list(turn_)).alias("turns"), F.count(F.when(~F.col("w.fresh"), 1)).alias("n_context"), F.sum("tokens").alias("n_tokens")
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def place_loss(a: Column, t: Column) -> Column:
        start = a["at"] + t["lead"]
        span = F.array(F.struct(start.alias("start"), (start + t["size"]).alias("end")))
        return F.struct((start + t["size"] + len(CLOSE)).alias("at"), F.when(t["target"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    loss = F.aggregate("turns", zero, place_loss, lambda a: a["spans"])
    formatted = F.array_join(F.transform("turns", lambda t: t["text"]), "")
    return grouped.select("conv_id", "segment", "block", "window", formatted.alias("text"), loss.alias("loss"), F.size("turns").cast("long").alias("n_turns"), "n_context", "n_tokens")


def turns_of(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    parts = F.filter(F.split(text, CLOSE, -1), lambda x: x != "")
    head = r"(?s)^<turn ((?:[^\\>]++|\\.)*+)>\n"

    def parsed(x: Column) -> Column:
        role = F.regexp_extract(x, head, 1)
        # what follows the header, which is the role with seven more characters and the line feed
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(x, F.char_length(role) + 9, F.char_length(x))).alias("text"))

    return F.transform(parts, parsed)


def loss_texts(text: Column, loss: Column) -> Column:
    """The texts under the spans of a loss mask."""
    return F.transform(loss, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def read_back(found: DataFrame) -> DataFrame:
    """Conversations from their windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation's digest needs its text as one value, as SHA-256 has no form that goes on; windows() has no such bound.
    """
    fresh = F.slice(turns_of(F.col("text")), F.col("n_context").cast("int") + 1, F.lit(1 << 30))
    said = F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    target = F.array_join(loss_texts(F.col("text"), F.col("loss")), "")
    parts = found.select("conv_id", F.struct("segment", "block", "window", said.alias("said"), target.alias("target")).alias("x"), F.size(fresh).cast("long").alias("n"), F.char_length("text").cast("long").alias("chars"))
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("x")).alias("all"), F.sum("chars").alias("formatted_chars"))
    joined = lambda name: F.array_join(F.transform("all", lambda x: x[name]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.char_length(joined("target")).cast("long").alias("loss_chars"), F.sha2(joined("target"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), said.alias("text"))
    return read_back(windows(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)))


_TOKENS = "len(regexp_extract_all(x, '\\p{L}{1,8}|\\p{N}{1,3}|[^\\x20\\x09-\\x0D\\p{L}\\p{N}]')) + " + str(MARKS)
_ESCAPES = "len(regexp_extract_all({0}, '\\\\|</?turn'))"
#: For conversations within 2^SEGMENT_BITS turn numbers, in which a segment ends nothing.
SQL = f"""with recursive c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') x from conversations
    union all select -7, i, case i when 0 then 'user' else '{TARGET}' end, '\\### Assistant: </turn> ok' from range(2) r(i)),
  r as (select *, row_number() over (partition by conv_id order by turn nulls first, role, x) n, {_TOKENS} tokens,
    length(role) + {_ESCAPES.format("role")} + len(regexp_extract_all(role, '>')) + length(x) + {_ESCAPES.format("x")} + {len("<turn >" + CLOSE) + 1} chars from c),
  p as (select *, sum(tokens) over (partition by conv_id order by n) upto, upto - tokens p, n = 1 and role = '{SYSTEM}' head from r),
  o as (select a.*, case when a.head then 0 else coalesce((select tokens from p b where b.conv_id = a.conv_id and b.head), 0) end over_,
    a.p - coalesce((select min(b.p) from p b where b.conv_id = a.conv_id and not b.head and b.p between a.p - {HISTORY} and a.p), a.p) back from p a),
  h as (select * replace (case when back + over_ + tokens <= {BUDGET} then back else 0 end as back) from o),
  g as (select conv_id, n, p as start, {BUDGET} - back - over_ room, true opens from h where n = 1 union all
    select h.conv_id, h.n, case when h.upto - g.start > g.room then h.p else g.start end, case when h.upto - g.start > g.room then {BUDGET} - h.back - h.over_ else g.room end, h.upto - g.start > g.room
    from g join h on h.conv_id = g.conv_id and h.n = g.n + 1),
  w as (select h.conv_id, sum(b.chars) chars from g join h using (conv_id, n) join h b on b.conv_id = h.conv_id and b.p < h.p and (b.head or b.p >= h.p - h.back) where g.opens group by 1)
  select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || x || chr(10), '' order by n)) turns_sha256, coalesce(length(string_agg(x, '' order by n) filter (where role = '{TARGET}')), 0) loss_chars,
    sha256(coalesce(string_agg(x, '' order by n) filter (where role = '{TARGET}'), '')) loss_sha256, (sum(chars) + coalesce((select w.chars from w where w.conv_id = h.conv_id), 0))::bigint formatted_chars from h group by conv_id"""
