"""Operator 9, language identification: script ranges narrow the candidates, Viterbi over words labels spans.

Training takes text and lang of the documents outside the held-out fold. Words are runs of letters, lower-cased. For
each language, the counts of a word's character n-grams (of ORDERS characters, with word ends marked) give smoothed
log-probabilities; a word's score for a language is the mean of its n-grams' log-probabilities times its length. A
language is a candidate for a word only if at least SCRIPT_SHARE of its training letters are of the word's script.
Over the words of a text, Viterbi finds the labels of the best total score less SWITCH for each change of language, so
that mixed texts get spans. A text's language is the one with most letters in its spans.

n-gram counts are taken from all training rows: they are pre-aggregated before the shuffle. The tables that are
broadcast hold all n-grams counted at least MIN_COUNT times, so no language loses its table to the size of another. Their
number grows with the languages and alphabets of the corpus, and the driver collects them.

Results for special rows: null text or text without letters gives lang_pred 'und', score 0 and no spans; words of scripts that
no language was trained on say nothing, and a text of only such words gets the language with most training letters,
score 0 and no spans; ties go to the lesser name; with no training rows all texts are 'und'. Null langs are not learned from.
"""

from __future__ import annotations

import itertools
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import read, written

ORDERS = (1, 2, 3)
MIN_COUNT = 3
SWITCH = 12.0
SCRIPT_SHARE = 0.01
#: Least score of a word for a language; words that a worker remembers.
OUT = -60.0
REMEMBERED = 200_000
FOLDS = 5

# First and last code point of letter ranges by script.
SCRIPTS = [
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F),
    ("thai", 0x0E00, 0x0E7F),
    ("latin", 0x1E00, 0x1EFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
# characters that count as alphanumeric but are neither letters nor decimal digits, such as fractions and Roman numerals
_NUMERIC = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_RUN = re.compile(r"[^\W\d_]+")
# slow, as it looks for each character among all of those: only for runs that hold one
_LETTERS = re.compile(rf"[^\W\d_{re.escape(_NUMERIC)}]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in order."""
    runs = _RUN.findall(text)
    if text.isascii() or all(map(str.isalpha, runs)):
        return runs
    return [w for run in runs for w in ([run] if run.isalpha() else _LETTERS.findall(run))]


def spans_of(text: str) -> Iterator[tuple[int, int]]:
    """Where words_of() are, as (start, end)."""
    for m in _RUN.finditer(text):
        if m[0].isalpha():
            yield m.span()
        else:
            yield from ((m.start() + w.start(), m.start() + w.end()) for w in _LETTERS.finditer(m[0]))


def script(c: str) -> str:
    n = ord(c)
    return next((name for name, a, b in SCRIPTS if a <= n <= b), "other")


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in ORDERS for i in range(n == 1, len(w) - n + (n > 1))]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n): sums of n-grams ('g') and script letters ('s') of this partition, emitted when large."""
    words: dict[str, Counter[str]] = {}
    total: dict[tuple[str, str], dict[str, int]] = {}

    def fold() -> None:
        for lang, seen in words.items():
            own, letters = total.setdefault((lang, "g"), {}), total.setdefault((lang, "s"), {})
            for word, n in seen.items():
                for g in grams(word):
                    own[g] = own.get(g, 0) + n
                k = script(word[0])
                letters[k] = letters.get(k, 0) + n * len(word)
        words.clear()

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, kind), own in total.items():
            same = [pa.array([x] * len(own), pa.string()) for x in (lang, kind)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "kind", "key", "n"])
        total.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            text, lang = text.as_py(), lang.as_py()
            if text is not None and lang is not None:
                words.setdefault(lang, Counter()).update(words_of(text.lower()))
                if sum(map(len, words.values())) > REMEMBERED:
                    fold()
                    if sum(map(len, total.values())) > REMEMBERED:
                        yield from out()
    fold()
    yield from out()


class Model:
    """Scores of words by language, learned from n-gram counts."""

    def __init__(self, rows: list[tuple[str, str, str, int]]) -> None:
        self.langs = sorted({r[0] for r in rows})
        at = {k: i for i, k in enumerate(self.langs)}
        n = len(self.langs)
        counts: dict[str, np.ndarray] = {}
        letters: dict[str, np.ndarray] = {}
        for lang, kind, key, c in rows:
            table = counts if kind == "g" else letters
            table.setdefault(key, np.zeros(n))[at[lang]] += c
        total = sum(letters.values()) if letters else np.zeros(n)
        self.prior = int(np.argmax(total)) if n else -1
        self.allowed = {s: x >= SCRIPT_SHARE * np.maximum(total, 1) for s, x in letters.items()}
        self.allowed = {s: x for s, x in self.allowed.items() if x.any()}
        self.allowed_of = np.array([self.allowed.get(name, np.zeros(n, bool)) for name, *_ in [*SCRIPTS, ("other",)]]).reshape(len(SCRIPTS) + 1, n)
        # each order has a distribution of its own, with half a count for n-grams not seen, in row 0 of its table
        self.alphabet = np.array(sorted({ord(c) for g in counts for c in g}), np.int64)
        self.keys, self.tables = {}, {}
        for order in ORDERS:
            own = sorted(g for g in counts if len(g) == order)
            mass = sum((counts[g] for g in own), np.zeros(n)) + 0.5 * (len(own) + 1)
            keys = self._key([self._letters("".join(g[i] for g in own)) for i in range(order)]) if own else np.zeros(0, np.int64)
            by = np.argsort(keys)
            self.keys[order] = keys[by]
            self.tables[order] = np.log(np.concatenate([np.full((1, n), 0.5), np.array([counts[g] for g in own]).reshape(len(own), n)[by] + 0.5]) / mass)

    def _letters(self, text: str) -> np.ndarray:
        """Numbers of the characters in the alphabet, from 1; 0 for others."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(self.alphabet):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0)

    def _key(self, letters: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(letters[0]), np.int64)
        for x in letters:
            out = out * (len(self.alphabet) + 1) + x
        return out

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of lower-cased words by language, against the word's best one and at least OUT, which is also the
        score of languages that its script rules out; and which words have a language at all."""
        text = f" {' '.join(words)} "
        letters = self._letters(text)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size + 1) - size - 1  # of the space before each word
        total = np.zeros((len(letters), len(self.langs)))
        for order in ORDERS:
            windows = len(letters) - order + 1
            key = self._key([letters[i : i + windows] for i in range(order)])
            keys = self.keys[order]
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            found = self.tables[order][np.where(keys[at] == key, at + 1, 0) if len(keys) else np.zeros(windows, np.int64)]
            if order == 1:
                found[begin] = found[-1] = 0  # spaces
            else:
                for k in range(1, order - 1):  # windows across the space between two words
                    found[begin[1:] - k] = 0
            total[:windows] += found
        out = np.add.reduceat(total, begin, axis=0)
        n_grams = sum(size if order == 1 else np.maximum(size + 3 - order, 0) for order in ORDERS)
        out *= ((size + 1) / n_grams)[:, None]
        first = np.array([ord(w[0]) for w in words])
        starts = np.array([a for _, a, _ in SCRIPTS])
        at = np.searchsorted(starts, first, "right") - 1
        inside = (at >= 0) & (first <= np.array([b for *_, b in SCRIPTS])[at])
        allowed = self.allowed_of[np.where(inside, at, len(SCRIPTS))]
        known = allowed.any(1)
        out[~allowed] = -np.inf
        with np.errstate(invalid="ignore"):
            return np.where(known[:, None], np.maximum(out - out.max(1, keepdims=True), OUT), 0.0), known


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best labels of each of several score tables (words x languages), found for all of them step by step."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    size = np.array([len(scores[i]) for i in order], np.int64)
    out = [np.zeros(len(s), np.int64) for s in scores]
    if not len(size) or not size[0]:
        return out
    n = scores[0].shape[1]
    live = np.searchsorted(-size, -np.arange(size[0]), "left")  # texts with more than t words
    base = np.concatenate([[0], np.cumsum(live)])  # word t of the j-th longest text is row base[t] + j
    table = np.empty((base[-1], n))
    for j, i in enumerate(order):
        table[base[: size[j]] + j] = scores[i]
    back = np.zeros((base[-1], n), np.int16)
    best = table[: live[0]].copy()
    same = np.arange(n)
    for t in range(1, size[0]):
        k = live[t]
        now = best[:k]
        top = now.argmax(1)
        jump = now[np.arange(k), top] - switch
        stay = now >= jump[:, None]
        back[base[t] : base[t + 1]] = np.where(stay, same, top[:, None])
        best[:k] = np.where(stay, now, jump[:, None]) + table[base[t] : base[t + 1]]
    label = best.argmax(1)
    path = np.zeros(base[-1], np.int64)
    for t in range(size[0] - 1, -1, -1):
        k = live[t]
        path[base[t] : base[t + 1]] = label[:k]
        if t:
            label[:k] = back[base[t] + np.arange(k), label[:k]]
    for j, i in enumerate(order):
        out[i] = path[base[: size[j]] + j]
    return out


def settled(scores: np.ndarray, switch: float = SWITCH) -> int | None:
    """The one label that is best for all words, if no run of words gains a switch by any other labels; else None."""
    lead = int(scores.sum(0).argmax())
    gain = np.delete(scores, lead, 1).max(1, initial=-np.inf) - scores[:, lead]
    total = np.concatenate([[0.0], np.cumsum(gain)])
    return lead if (total - np.minimum.accumulate(total)).max() < switch else None


class Labeller:
    """Labels texts with a model, remembering the scores of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs)))

    def _rows(self, words: list[str]) -> np.ndarray:
        """Rows of the words' scores in the table, -1 for words of scripts that nothing was learned of."""
        if len(self.at) > REMEMBERED:
            self.at, self.table = {}, self.table[:0]
        new = {w: None for w in words if w not in self.at}
        if new:
            scores, known = self.model.score([w.lower() for w in new])
            rows = np.where(known, np.arange(len(self.table), len(self.table) + len(new)), -1)
            self.at |= zip(new, rows.tolist(), strict=True)
            self.table = np.concatenate([self.table, scores])
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[dict]]]:
        """(language, score, spans) of each text."""
        out: list[tuple[str, float, list[dict]]] = [("und", 0.0, [])] * len(texts)
        if not self.model.langs:
            return out
        found = [(i, words_of(t)) for i, t in enumerate(texts) if t]
        rows = self._rows(list(itertools.chain.from_iterable(ws for _, ws in found)))
        langs, at, mixed = self.model.langs, 0, []
        for i, ws in found:
            r = rows[at : at + len(ws)]
            at += len(ws)
            if (r < 0).all():
                if ws:
                    out[i] = (langs[self.model.prior], 0.0, [])
                continue
            known = r >= 0
            s = self.table[r[known]]
            lead = settled(s)
            if lead is None:
                mixed.append((i, known, s))
                continue
            text = texts[i]
            if known.all():
                start, end = text.find(ws[0]), text.rfind(ws[-1]) + len(ws[-1])
            else:
                ms = list(itertools.compress(spans_of(text), known))
                start, end = ms[0][0], ms[-1][1]
            out[i] = (langs[lead], 1.0, [{"start": start, "end": end, "lang": langs[lead]}])
        for (i, known, _), labels in zip(mixed, viterbi([s for *_, s in mixed]), strict=True):
            ms = list(itertools.compress(spans_of(texts[i]), known))
            size = np.array([end - start for start, end in ms])
            share = np.bincount(labels, weights=size, minlength=len(langs))
            lead = int(share.argmax())
            cut = [0, *(np.flatnonzero(np.diff(labels)) + 1), len(labels)]
            spans = [{"start": ms[a][0], "end": ms[b - 1][1], "lang": langs[labels[a]]} for a, b in zip(cut, cut[1:])]
            out[i] = (langs[lead], float(share[lead] / share.sum()), spans)
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from all rows of docs with a language; the counts are aggregated in Spark."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    schema = "lang string, kind string, key string, n long"
    counts = written(rows.mapInArrow(_counted, schema).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "grams")
    known = counts.where(f"kind = 'g' and n >= {MIN_COUNT}")
    return Model([tuple(r) for r in known.union(counts.where("kind = 's'")).collect()])


def label(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and spans (start and end in characters, lang); columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "spans")
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(held.value)
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                found = labeller.label(batch.column(at).to_pylist())
                new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], kind)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    model = train(docs.where(~F.coalesce(held_out, F.lit(False))))
    found = label(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "spans")
