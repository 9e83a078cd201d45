"""Operator 8, personal data by candidate gradient boosting, in DataFrame functions only.

Base spans are the valid matches of four formats. Besides, high-recall generators propose spans that overlap: long tokens, what
is said to be a password, loosely written addresses, colon-separated hexadecimal groups, and of each run of digit groups the whole
and all parts of up to GROUPS whole groups and MOST_DIGITS digits, so that a number is found beside others. Boosted trees score each
proposal from its format and from what stands beside it; a threshold for each generator, calibrated on held-out samples for a
precision of PRECISION, selects redactions. The trees are trained on SAMPLES made-up candidates from a fixed seed and
are applied as one SQL expression, so texts never leave the JVM.

Positions come from splitting a text by a pattern: a match starts after the pieces and matches before it, summed by a
window over the matches of one text. Patterns are written so that they match as given but look at each run of
characters once and without nested repetition, so that long texts cost time in proportion. Texts are read once;
what goes on are candidates with 24 characters to either side.

Accepted spans that overlap each other are merged under the kind of the best score; of what a base span covers, only the
parts beside it are added, without spaces and marks at their ends. Null text is empty; a text without spans has counts 0 and the hash of nothing; repeated rows each have a row.
"""

from __future__ import annotations

import functools
import random
import re
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .boosting import Boosted
from .tables import read, written

SAMPLES = 6000
PRECISION = 0.98
BASE = ["email", "ip", "card", "phone"]
ADDED = ["secret", "number", "address", "ipv6", "password"]
KINDS = [*BASE, *ADDED]
CONTEXT = 24
#: Parts of a run of digit groups that are proposed: groups, least and most digits.
GROUPS, LEAST_DIGITS, MOST_DIGITS = 8, 7, 19

# In the texts matched, \x02 stands for a dot between label characters (email) or a single separator between digits (card).
_LOCAL = r"[A-Za-z0-9._%+\x02-]"
_PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++\x02[A-Za-z0-9\x02-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x02]*+(?<=[0-9][0-9]|[0-9]\x02[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+",
    "number": r"(?<![0-9A-Za-z])[0-9][0-9 ()./-]{5,}[0-9]",
    "address": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?: at [A-Za-z0-9-]+ dot [A-Za-z]{2,6}|(?:@| ?[\[({<-]at[\])}>-] ?)[A-Za-z0-9-]+(?: ?[\[({<-]?(?:dot|\.)[\])}>-]? ?[A-Za-z]{2,6})?)",
    "ipv6": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]{5,}",
    "password": r"(?<=[:=\x20\"'])(?<=(?i:passwor[dt]|passwd|passphrase|pwd|pin code)[\"']?(?: is)?\x20{0,2}[:=]?\x20{0,2}[\"']?)[^\x00-\x20\"',;:=]{5,64}+",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _subject(kind: str) -> Column:
    clean = F.translate("text", "\x02", "\x01")
    if kind == "email":
        return F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "\x02")
    if kind == "card":
        return F.regexp_replace(clean, r"(?<=[0-9])[ -](?=[0-9])", "\x02")
    return F.col("text")


_MAY = {"email": "contains(text, '@')", "address": "(contains(text, '@') or contains(text, 'at'))", "secret": "true", "ipv6": "contains(text, ':')", "password": "rlike(text, '(?i)pass|pwd|pin code')", "phone": "contains(text, '+')"}


def _found(kind: str) -> Column:
    """An array of (kind, number, characters since the last match, match, text before, text after)."""
    subject, pattern = _subject(kind), F.lit(_PATTERNS[kind])
    pieces = F.split(subject, _PATTERNS[kind], -1)
    hits = F.regexp_extract_all(subject, pattern, F.lit(0))
    one = F.transform(
        F.arrays_zip(pieces.alias("p"), F.slice(pieces, 2, 1 << 30).alias("q"), hits.alias("h")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.char_length(x["p"]).cast("long").alias("gap"), x["h"].alias("hit"),
            F.right(x["p"], F.lit(CONTEXT)).alias("before"), F.left(x["q"], F.lit(CONTEXT)).alias("after"),
        ),
    )
    may = F.expr(_MAY.get(kind, "rlike(text, '[0-9]')"))
    return F.when(may, F.filter(one, lambda x: x["hit"].isNotNull()))


def found() -> Column:
    """All matches and proposals of a text."""
    return F.flatten(F.filter(F.array(*map(_found, KINDS)), lambda a: a.isNotNull()))


def _placed(every: DataFrame) -> DataFrame:
    """(row, kind, start, end, hit, before, after) of found candidates, one a row."""
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("hit")
    end = F.sum(F.col("gap") + size).over(before)
    return every.withColumn("end", end).withColumn("start", F.col("end") - size).drop("i", "gap")


def _with_parts(found: DataFrame) -> DataFrame:
    """found, of number candidates, with the parts of each run: whole digit groups in a row, with what stands beside them.

    A run is cut into its groups, a row each, and windows over a few groups put parts together, so that a run of any
    length costs time in proportion.
    """
    groups = found.select("row", "kind", F.col("start").alias("run"), F.col("end").alias("run_end"), "before", "after", F.posexplode(F.arrays_zip(F.split("hit", "[0-9]+").alias("mark"), F.regexp_extract_all("hit", F.lit("[0-9]+"), F.lit(0)).alias("digits"))).alias("at", "g"))
    groups = groups.select("*", "g.*").drop("g").where("digits is not null")
    order = Window.partitionBy("row", "run").orderBy("at")
    text = F.concat("mark", "digits")
    joined = lambda first, last: F.array_join(F.collect_list(text).over(order.rowsBetween(first, last)), "")
    groups = groups.withColumn("end", F.col("run") + F.sum(F.char_length(text)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    groups = groups.withColumn("left", F.right(F.concat("before", joined(-CONTEXT, -1), "mark"), F.lit(CONTEXT))).withColumn("right", F.left(F.concat(joined(1, CONTEXT), "after"), F.lit(CONTEXT)))
    groups = groups.withColumn("start", F.col("end") - F.char_length("digits")).withColumn("next", F.collect_list(F.struct("mark", "digits", "end", "right")).over(order.rowsBetween(0, GROUPS - 1)))
    parts = groups.select("row", "kind", "run", "run_end", "start", "left", "next", "digits", F.explode(F.sequence(F.lit(1), F.size("next"))).alias("n"))
    hit = F.concat("digits", F.array_join(F.transform(F.expr("slice(next, 2, n - 1)"), lambda g: F.concat(g["mark"], g["digits"])), ""))
    last = F.element_at("next", F.col("n"))
    parts = parts.where((F.col("start") != F.col("run")) | (last["end"] != F.col("run_end")))  # the whole is there already
    parts = parts.select("row", "kind", "start", last["end"].alias("end"), hit.alias("hit"), F.col("left").alias("before"), last["right"].alias("after"))
    whole = found.select("row", "kind", "start", "end", "hit", "before", "after")
    return whole.union(parts.where(F.length(_digits(F.col("hit"))).between(LEAST_DIGITS, MOST_DIGITS)).select(*whole.columns))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's sum is divisible by ten; for at most 40 digits."""
    at = F.sequence(F.lit(1), F.least(F.length(digits), F.lit(40)))
    value = F.transform(at, lambda i: F.expr("0") + F.call_function("substring", F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(F.transform(value, lambda v: v - F.when(v > 9, 9).otherwise(0)), F.lit(0), lambda a, v: a + v) % 10 == 0


def valid() -> Column:
    """Whether a base match holds."""
    digits = _digits(F.col("hit"))
    n = F.length(digits)
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", F.col("hit").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(F.col("kind") == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
        .when(F.col("kind") == "phone", n.between(9, 15))
        .otherwise(False)
    )


def _count(pattern: str) -> Column:
    return F.length(F.regexp_replace("hit", f"[^{pattern}]", ""))


def features() -> dict[str, Column]:
    hit, digits = F.col("hit"), _digits(F.col("hit"))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    near = lambda words: flag(F.col("before").rlike(f"(?i)(?:{words})"))
    return {
        "f_kind": F.array_position(F.array(*map(F.lit, ADDED)), F.col("kind")).cast("int"),
        "f_length": F.length("hit"),
        "f_digits": _count("0-9"),
        "f_upper": _count("A-Z"),
        "f_lower": _count("a-z"),
        "f_marks": _count("+/_=-"),
        "f_spaces": _count(" ()."),
        "f_distinct": F.size(F.array_distinct(F.split("hit", ""))),
        "f_hex": flag(hit.rlike("^[0-9a-fA-F]+$")),
        "f_plain": flag(hit.rlike("^[0-9]+$")),
        "f_ssn": flag(hit.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "f_local": flag(hit.rlike(r"^\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$")),
        "f_date": flag(hit.rlike(r"^(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})")),
        "f_decimal": flag(hit.rlike(r"^[0-9]+\.[0-9]+$")),
        "f_iban": flag(hit.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")),
        "f_luhn": flag(F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)),
        "f_word": flag(hit.rlike("^[A-Z]?[a-z-]+$")),
        "f_groups": F.size(F.split("hit", "[^0-9A-Za-z]+")),
        "f_colons": _count(":"),
        "f_at": flag(hit.rlike("@|at[])}>-]")),
        "f_dot": flag(hit.rlike(r"(?:dot|\.)[])}>-]? ?[A-Za-z]{2,6}$")),
        "f_odd": _count("!?#$%^&*~|"),
        "f_area": flag(hit.rlike(r"^\(?0[0-9]{1,4}\)?[ /-]{1,2}[0-9]{2,8}(?:[ -][0-9]{2,5}){0,3}$")),
        "f_fours": flag(hit.rlike("^[0-9]{4}(?:[ -][0-9]{4}){3}$")),
        "f_inner": flag(F.col("before").rlike("[0-9][ ()./-]{0,3}$") | F.col("after").rlike("^[ ()./-]{0,3}[0-9]")),
        "f_secret": near("token|secret|key|passw|pwd|auth|bearer|credential"),
        "f_contact": near("tel|phone|call|fax|mobile|contact|mail|reach|write"),
        "f_id": near("ssn|social|iban|account|passport|card|tax|insurance|number"),
        "f_not": near("order|invoice|version|isbn|page|fig|price|date|year|total|sku|part|release"),
        "f_quote": flag(F.col("before").rlike("[\"'=:] ?[\"']?$")),
    }


# ---- made-up candidates -------------------------------------------------------------------------------------------


def _samples() -> list[tuple[str, str, str, str, int]]:
    """(kind, hit, before, after, label) from a fixed seed."""
    r = random.Random(20)
    hexa, alnum = string.hexdigits[:16], string.ascii_letters + string.digits
    text = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    num = lambda n: text(string.digits, n)
    word = lambda n: text(string.ascii_lowercase, n)

    def beside(words: list[str], chance: float) -> str:
        lead = f"{word(r.randint(3, 9))} {word(r.randint(2, 7))} "
        return (lead + r.choice(words) + r.choice([" ", ": ", " = ", "=", ' = "', " is "]))[-CONTEXT:] if r.random() < chance else lead[-CONTEXT:]

    secret, contact = ["token", "secret", "api key", "password", "auth", "bearer"], ["tel", "phone", "call", "fax", "mobile", "contact", "Tel.", "Phone"]
    said = ["password", "Password", "passwd", "pwd", "passphrase"]
    ident, other = ["ssn", "iban", "account", "passport", "card", "tax"], ["order", "invoice", "version", "isbn", "page", "price", "date", "total", "part"]
    yes = [
        ("secret", lambda: text(hexa, r.choice([32, 40, 40, 64])), secret),
        ("secret", lambda: text(alnum, r.randint(20, 48)), secret),
        ("secret", lambda: r.choice(["sk_", "ghp_", "AKIA", "xoxb-"]) + text(alnum, r.randint(16, 36)), secret),
        ("secret", lambda: text(string.ascii_uppercase, 2) + num(2) + text(string.ascii_uppercase, 4) + num(14), ident),
        ("number", lambda: f"{num(3)}-{num(2)}-{num(4)}", ident),
        ("number", lambda: f"{num(3)}{r.choice('-. ')}{num(3)}{r.choice('-. ')}{num(4)}", contact),
        ("number", lambda: f"0{num(r.randint(2, 4))}{r.choice(['/', ' ', '-', ' / '])}{num(r.randint(5, 8))}", contact),
        ("number", lambda: f"0{num(r.randint(1, 3))}{r.choice(' -')}{num(r.choice([3, 4]))}{r.choice(' -')}{num(r.choice([3, 4]))}", contact),
        ("number", lambda: num(r.randint(13, 19)), ident),
        ("number", lambda: r.choice(" -").join(num(4) for _ in range(4)), ident),
        ("password", lambda: text(alnum + "!?#$%&*_-", r.randint(8, 24)), said),
        ("password", lambda: word(r.randint(3, 8)) + r.choice(["", "!", "_", "#"]) + num(r.randint(2, 4)) + r.choice(["", "!", "$"]), said),
        ("address", lambda: f"{word(r.randint(1, 8))}{r.choice([' -at- ', ' {at} ', ' <at> '])}{word(r.randint(1, 9))}{r.choice([' -dot- ', ' {dot} ', ' <dot> '])}{r.choice(['com', 'org', 'net', 'de'])}", contact),
        ("address", lambda: f"{word(r.randint(3, 8))}{r.choice([' [at] ', ' (at) ', '[at]'])}{word(r.randint(4, 9))}{r.choice([' [dot] ', ' dot ', '.'])}{r.choice(['com', 'org', 'net', 'de'])}", contact),
        ("address", lambda: f"{word(r.randint(3, 8))} at {word(r.randint(4, 9))} dot {r.choice(['com', 'org', 'net', 'de'])}", contact),
        ("ipv6", lambda: ":".join(text(hexa, r.randint(1, 4)) for _ in range(8)), contact),
        ("ipv6", lambda: f"{text(hexa, 4)}:{text(hexa, 4)}::{text(hexa, 4)}:{text(hexa, 4)}", contact),
    ]
    no = [
        ("secret", lambda: word(r.randint(16, 40)), other),
        ("secret", lambda: word(r.randint(16, 28)).capitalize(), secret),
        ("secret", lambda: text(string.ascii_uppercase, r.randint(16, 30)), other),
        ("secret", lambda: "-".join(word(r.randint(2, 9)) for _ in range(r.randint(3, 6))), other),
        ("secret", lambda: "/".join(word(r.randint(2, 9)) for _ in range(r.randint(3, 6))), other),
        ("secret", lambda: r.choice("-_=+/") * r.randint(16, 60), other),
        ("secret", lambda: "_".join(word(r.randint(3, 9)) for _ in range(3)), secret),
        ("number", lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", other),
        ("number", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", other),
        ("number", lambda: f"{num(r.randint(4, 7))}.{num(r.randint(2, 4))}", other),
        ("number", lambda: f"{num(r.randint(1, 4))}.{num(2)}.{num(3)}", other),
        ("number", lambda: num(r.randint(7, 9)), other),
        ("number", lambda: " ".join(num(r.randint(1, 3)) for _ in range(r.randint(4, 9))), other),
        ("number", lambda: f"{r.randint(1900, 2030)} - {r.randint(1900, 2030)}", other),
        ("number", lambda: f"{num(4)}{r.choice('-/ ')}{num(r.randint(3, 6))}", other),
        ("password", lambda: word(r.randint(5, 14)), said),
        ("password", lambda: word(r.randint(5, 9)).capitalize() + r.choice([".", ")", ""]), said),
        ("password", lambda: r.choice("*.-_x") * r.randint(5, 16), said),
        ("address", lambda: f"{word(r.randint(2, 9))} at {word(r.randint(2, 9))} dot {word(r.randint(4, 6))}", other),
        ("address", lambda: f"{word(r.randint(2, 9))} (at) {word(r.randint(2, 9))}", other),
        ("address", lambda: f"{word(r.randint(2, 9))}@{word(r.randint(2, 9))}", other),
        ("ipv6", lambda: f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}", other),
        ("ipv6", lambda: f"{r.randint(1, 9)}:{r.randint(10, 99)}:{r.randint(10, 99)}:{r.randint(10, 99)}", other),
        ("ipv6", lambda: r.choice(["add", "bad", "cafe", "face"]) + ":::::" + ":" * r.randint(0, 9), other),
    ]
    out = []
    for k in range(SAMPLES):
        kind, make, words = r.choice(yes if k % 2 else no)
        after = r.choice([" ", ". ", ", ", '" ']) + word(r.randint(2, 9)) + " "
        out.append((kind, make(), beside(words if k % 2 or r.random() < 0.8 else contact, 1.0 if kind == "password" else 0.6), after, k % 2))
    # numbers in a row: those that are personal, and parts that begin or end within one or hold several
    things = [(make, k) for k, rows in ((1, yes), (0, no)) for kind, make, _ in rows if kind == "number"]
    while len(out) < SAMPLES * 3 // 2:
        line, owned = beside(contact + other, 0.5), set()
        for make, k in r.choices(things, k=r.randint(2, 4)):
            one = make()
            if k:
                owned.add((len(line), len(line) + len(one)))
            line += one + r.choice([" ", "  ", " - ", " ("])
        line += word(5)
        groups = [m.span() for m in re.finditer("[0-9]+", line)]
        a = r.randrange(len(groups))
        start, end = r.choice(sorted(owned)) if owned and r.random() < 0.5 else (groups[a][0], groups[min(len(groups) - 1, a + r.randint(0, 4))][1])
        if LEAST_DIGITS <= len(re.sub("[^0-9]", "", line[start:end])) <= MOST_DIGITS:
            out.append(("number", line[start:end], line[:start][-CONTEXT:], line[end:][:CONTEXT], int((start, end) in owned)))
    return out


@functools.lru_cache(maxsize=1)
def _model(app: str) -> tuple[str, dict[str, float]]:
    """The trees' expression and each kind's threshold on it; app is only the key of what is remembered."""
    spark = SparkSession.active()
    rows = spark.createDataFrame(_samples(), "kind string, hit string, before string, after string, label int")
    got = np.array([tuple(r) for r in rows.select("label", *(c.cast("double").alias(n) for n, c in features().items())).collect()])
    y, x = got[:, 0], got[:, 1:]
    held = np.arange(len(y)) % 10 >= 7
    trees = Boosted(x[~held], y[~held])
    margin, thresholds = trees.margin(x[held]), {}
    for k, kind in enumerate(ADDED, 1):
        own = x[held, 0] == k
        m, truth = margin[own], y[held][own]
        order = np.argsort(-m)
        precise = np.cumsum(truth[order]) / np.arange(1, len(order) + 1) >= PRECISION
        last = np.flatnonzero(precise)
        thresholds[kind] = max(0.0, float(m[order][last[-1]])) if len(last) else float("inf")
    return trees.sql(list(features())), thresholds


def spans(candidates: DataFrame) -> DataFrame:
    """(row, kind, start, end, base) of the base spans and of the redactions added, for candidates (row, found)."""
    expression, thresholds = _model(candidates.sparkSession.sparkContext.applicationId)
    every = _placed(candidates.select("row", F.explode("found").alias("x")).select("row", "x.*"))
    base = written(every.where(F.col("kind").isin(BASE) & valid()).select("row", "kind", "start", "end", F.lit(True).alias("base")), "base")
    proposed = every.where(F.col("kind").isin(ADDED))
    several = (F.col("kind") == "number") & F.col("hit").rlike("[0-9][^0-9]+[0-9]")
    place = ["row", "kind", "start", "end", "hit", "before", "after"]
    proposed = proposed.where(~several).select(*place).union(_with_parts(proposed.where(several)))
    scored = proposed.select("row", "kind", "start", "end", "hit", *(c.alias(n) for n, c in features().items()))
    # stored, as the planner would otherwise copy each feature's expression into every node of the trees
    scored = written(scored, "features").withColumn("score", F.expr(expression))
    least = F.coalesce(*(F.when(F.col("kind") == k, F.lit(t)) for k, t in thresholds.items()))
    added = scored.where(F.col("score") >= least).select("row", "kind", "start", "end", "hit", "score")
    return base.union(_beside(base, added).select("row", "kind", "start", "end", F.lit(False)))


def _beside(base: DataFrame, added: DataFrame) -> DataFrame:
    """(row, kind, start, end): what added spans (row, kind, start, end, hit, score) cover and base spans do not."""
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    spans = added.withColumn("reach", reach)
    spans = spans.withColumn("group", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(order))
    # of each span the text that those before it do not have; together they are the group's text
    spans = spans.withColumn("new", F.expr("substring(hit, cast(greatest(reach - start, 0) + 1 as int))"))
    parts = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("e"), F.struct("kind", "new").alias("x"))))
    groups = spans.groupBy("row", "group").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("kind", F.struct("score", "start", "kind")).alias("kind"),
        F.array_join(F.transform(parts, lambda p: p["x"]["new"]), "").alias("text"),
    )
    # a sweep over the ends of all spans: how many base spans and groups are open behind each place
    group = F.struct("start", "end", "kind", "text")
    none = F.lit(None)
    edge = lambda df, at, b, g, x: df.select("row", F.col(at).alias("at"), F.lit(b).alias("b"), F.lit(g).alias("g"), x.alias("x"))
    edges = edge(groups, "start", 0, 1, group).union(edge(groups, "end", 0, -1, F.when(F.lit(False), group)))
    own = base.join(groups.select("row").distinct(), "row", "left_semi")
    edges = edges.union(edge(own, "start", 1, 0, none)).union(edge(own, "end", -1, 0, none))
    places = edges.groupBy("row", "at").agg(F.sum("b").alias("b"), F.sum("g").alias("g"), F.max("x").alias("x"))
    so_far = Window.partitionBy("row").orderBy("at")
    open_ = places.select("row", "at", F.lead("at").over(so_far).alias("to"), F.sum("b").over(so_far).alias("b"), F.sum("g").over(so_far).alias("g"), F.last("x", ignorenulls=True).over(so_far).alias("x"))
    left = open_.where("g > 0 and b = 0 and to is not null").withColumn("whole", (F.col("at") == F.col("x.start")) & (F.col("to") == F.col("x.end")))
    text = F.expr("substring(x.text, cast(at - x.start + 1 as int), cast(to - at as int))")
    left = left.withColumn("text", text)
    trim = lambda pattern: F.when(F.col("whole"), 0).otherwise(F.length(F.regexp_extract("text", pattern, 0)))
    left = left.select("row", "x.kind", (F.col("at") + trim(r"^[^\p{L}\p{N}]*")).alias("start"), (F.col("to") - trim(r"[^\p{L}\p{N}]*+$")).alias("end"))
    return left.where("start < end")


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with n_email ... n_phone, base_sha256 and spans; columns of these names are replaced."""
    new = [*(f"n_{k}" for k in BASE), "base_sha256", "spans"]
    rest = [c for c in docs.columns if c not in new and c != text]
    kept = docs.select(*(F.col(c).alias(f"__p_{c}") for c in rest), F.coalesce(text, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    every = written(kept.select("row", *(f"__p_{c}" for c in rest), found().alias("found")), "candidates")
    got = spans(every)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    told = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    by_row = got.groupBy("row").agg(
        *(F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE),
        F.array_sort(F.collect_list(F.struct(rank.alias("r"), "start", told.alias("told"), "base"))).alias("all"),
    )
    joined = every.drop("found").join(by_row, "row", "left")
    name = lambda a: F.concat_ws(",", F.transform(a, lambda x: x["told"]))
    base = F.when(F.col("all").isNull(), F.lit("")).otherwise(name(F.filter("all", lambda x: x["base"])))
    return joined.select(
        *(F.col(f"__p_{c}").alias(c) for c in rest), *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(base, 256).alias("base_sha256"), F.when(F.col("all").isNull(), F.lit("")).otherwise(name(F.col("all"))).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents").select("doc_id", "text"))
