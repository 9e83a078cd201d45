from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import boosting, cover_tree, language_id, line_dedup, lm_scoring, mixing, ngram_join, pii, quality_rules, registry, sentencepiece_codec, substring_dedup
from lodestone.llm import text as tx
from lodestone.llm.graph import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def odd_rows(spark):
    """Nulls in all columns, empty and blank texts, a very long one, ties, repeated rows, and a column more."""
    long = " ".join(f"w{i * 7919 % 4001}" for i in range(60_000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, base, "en", "a", 1, "x"), (1, base, "en", "a", 1, "x"), (2, None, None, None, None, None), (None, base, "en", None, 3, ""), (3, "", "en", "a", 0, ""), (4, " \n\t\x0b ", None, "a", 5, ""),
            (5, long, "de", "b", 9, ""), (6, base + " seventeen", "en", "b", 9, ""), (6, "other text of the same id, not long", "en", "b", 9, ""), (7, "x" * 50_000, "xx", "c", 1, ""), (8, "\x00 é 漢字 🙂", "zh", "c", 1, "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", [k for k in registry.oracle_sql()])
def test_query_matches_sql(same_as_sql, name):
    same_as_sql(registry.queries()[name], registry.oracle_sql()[name], SF)


OPERATORS = {
    "quality": lambda d: quality_rules.verdicts(d),
    "quality_keep": lambda d: quality_rules.keep(d),
    "codec": lambda d: sentencepiece_codec.encode(d, sentencepiece_codec.model_path()),
    "lm": lambda d: lm_scoring.score(d, lm_scoring.train(d.withColumn("t", F.col("doc_id") == 1), "t")),
    "lines": lambda d: line_dedup.dedup(d, length="n_chars"),
    "passages": lambda d: substring_dedup.passages(d),
    "join": lambda d: ngram_join.join(d),
    "keep_one": lambda d: ngram_join.keep_one(d),
    "pii": lambda d: pii.digest(d),
    "lang": lambda d: language_id.label(d, language_id.train(d)),
    "mixing": lambda d: mixing.interleave(d),
    "slots": lambda d: mixing.slots(d)[0],
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    d = odd_rows(spark)
    rows = OPERATORS[name](d).collect()
    if name in ("quality", "codec", "lm", "lines", "join", "pii", "lang", "mixing", "slots"):
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in d.collect())
    assert OPERATORS[name](d.limit(0)).collect() == []
    # columns whose names clash with those that are added
    clash = d.withColumns({c: F.lit("?") for c in ("n_words", "kept", "ids", "n_ids", "round_trip", "ce_diff", "n_shingles", "component_id", "spans", "score", "lang_pred", "block", "slot", "position", "n_email", "row", "at", "token")})
    if name != "passages":
        assert len(OPERATORS[name](clash).collect()) == len(rows)


def test_words_and_shingles_of_slices():
    import pyarrow as pa

    texts = ["a b  c", None, "", "é x y", " q\tw e r t y ", "b c"]
    seen = {}
    for _, offsets, data in tx.slices(pa.array(texts)):
        s, e, d = tx.words(data, offsets)
        got = [data[i:j].tobytes().decode() for i, j in zip(s, e)]
        assert got == [w for t in texts for w in WORD.findall(t or "")]
        h = tx.word_hashes(data, s, e)
        for w, x in zip(got, h):
            assert seen.setdefault(w, x) == x
        k, o = tx.shingles(h, d, 3)
        assert np.bincount(o, minlength=6).tolist() == [1, 0, 0, 1, 4, 1]
    assert len(set(seen.values())) == len(seen)


def test_quality_rules_are_mergeable_and_keep_clean_texts(spark):
    r = random.Random(1)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    clean = [(i, " ".join(r.choices(vocab, k=r.randint(60, 200))), "en", f"s{i % 3}") for i in range(400)]
    junk = [(1000 + i, " ".join(w + "###" for w in r.choices(vocab, k=80)), "en", "s0") for i in range(10)] + [(2000 + i, " ".join(r.choices(vocab, k=80)).upper(), "en", "s1") for i in range(10)]
    d = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    kept = {x.doc_id for x in quality_rules.keep(d.repartition(7)).collect()}
    assert kept == set(range(400)) == {x.doc_id for x in quality_rules.verdicts(d.coalesce(1)).where("kept").collect()}


def test_codec_equals_the_library_and_streams():
    import sentencepiece

    path = sentencepiece_codec.model_path()
    library, vocabulary = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Vocabulary(path)
    encoder, r = sentencepiece_codec.Encoder(vocabulary), random.Random(0)
    texts = ["  a\n\tb x", "    ", "\n\n", "x" * 900, "▁a ▁▁ b", "漢字 🙂🙂 é", " " * 37 + "the", "supercalifragilistic" * 90, "日本" * 300]
    texts += ["".join(r.choice("the  in er at▁\n\taeion.--==,12é漢") for _ in range(r.randint(0, 80))) for _ in range(500)]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == library.encode(t)
        assert vocabulary.decode(ids) == t.replace("▁", " ") == library.decode(ids) or "▁" in t
    for t in ["🙂" * 5000, "。、" * 3000, "*·" * 4000, "x" + "!?" * 50_000, "日本。" * 20_000]:  # long runs of marks
        assert encoder.encode(t) == library.encode(t)
    # whole texts through the stream, in blocks: what is committed early is what the library gives
    for t in [*texts[-60:], "the quick brown fox " * 300, "ab\n\ncd  e" * 100]:
        whole = "▁" + t.replace(" ", "▁")
        n, got = 0, []
        for part, path in encoder.stream(whole[i : i + 64] for i in range(0, len(whole), 64)):
            n += 1
            for piece, end in path:
                got += [piece] if piece != sentencepiece_codec.OTHER else [vocabulary.byte[b] for b in part[end - 1].encode()]
        assert not t or got == library.encode(t)
        assert n > 1 or len(t) < 400
    # pieces of a long text come out before its end
    blocks = iter(["abcdefgh" * 8] * 50)
    stream = encoder.stream(blocks)
    next(stream)
    assert sum(1 for _ in blocks) > 40


def test_codec_decodes_tables(spark):
    path = sentencepiece_codec.model_path()
    d = odd_rows(spark).where("doc_id <> 5")
    ids = sentencepiece_codec.encode(d, path)
    assert ids.where("not round_trip").count() == 0
    back = sentencepiece_codec.decode(ids.withColumnRenamed("text", "was"), path)
    assert back.where("not (text <=> was)").count() == 0 and back.count() == d.count()


def test_lm_scores_equal_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FREQUENT", 6)
    monkeypatch.setattr(lm_scoring, "BLOCK", 40)
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the", "of", "é", *"abcdefghijkl"]) if r.random() < 0.6 else "the" for _ in range(r.randint(1, 30))), i % 3 == 0) for i in range(60)]
    rows += [(100, None, True), (101, " \t", None), (102, "unmarked of the", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, t boolean").repartition(3)
    more = spark.createDataFrame([(200, "the never seen of", None)], "doc_id long, text string, t boolean")

    def plain(frequent, texts, factor, vocabulary):
        of = lambda w: w if w in frequent else ""
        pair, own, word = Counter(), Counter(), Counter()
        for t in texts:
            w = WORD.findall(t or "")
            for before, x in zip([None, *map(of, w)], w):
                pair[before, of(x)] += factor
                own[of(x)] += factor
                word[x] += factor
        before = Counter()
        for (c, _), n in pair.items():
            before[c] += n
        rare = sum(n for x, n in word.items() if x not in frequent)

        def log_p(c, x):
            p = (own[of(x)] + lm_scoring.ADD) / (sum(own.values()) + lm_scoring.ADD * (len(frequent) + 1))
            p = (pair[c, of(x)] + lm_scoring.CONTEXT * p) / (before[c] + lm_scoring.CONTEXT)
            return math.log(p) + (0 if x in frequent else math.log((word[x] + lm_scoring.ADD) / (rare + lm_scoring.ADD * (len(vocabulary - frequent) + 1))))

        return of, log_p

    n = Counter(w for _, t, _ in rows for w in WORD.findall(t or ""))
    frequent = {w for w, k in n.items() if k * 6 >= sum(n.values())}
    target, other = [t for _, t, ok in rows if ok], [t for _, t, ok in rows if not ok]
    size = [sum(len(WORD.findall(t or "")) for t in x) for x in (target, other)]
    of, log_t = plain(frequent, target, 1.0, set(n))
    _, log_b = plain(frequent, other, size[0] / size[1], set(n))
    assert frequent and len(frequent) < len(n)
    seen = 0
    for x in lm_scoring.score(d.union(more), lm_scoring.train(d, "t")).collect():
        w = WORD.findall(x.text or "")
        want = [log_b(c, v) - log_t(c, v) for c, v in zip([None, *map(of, w)], w)]
        assert x.n_tokens == len(w) and (x.ce_diff == pytest.approx(sum(want) / len(want), abs=1e-9) if w else x.ce_diff is None)
        seen += 1
    assert seen == len(rows) + 1


def test_lm_without_one_side_scores_zero(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, "c"), (3, None)], "doc_id long, text string")
    for mark in (True, False, None):
        got = lm_scoring.score(d, lm_scoring.train(d.withColumn("t", F.lit(mark).cast("boolean")), "t")).collect()
        assert {r.doc_id: r.ce_diff for r in got} == {1: 0.0, 2: 0.0, 3: None}


def test_lm_target_of_repeated_and_null_labels(spark):
    d = spark.createDataFrame([(1,), (2,), (3,), (None,), (1,)], "doc_id long")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted((str(r.doc_id), r.is_target) for r in lm_scoring.with_target(d, labels).collect()) == [("1", True), ("1", True), ("2", False), ("3", False), ("None", False)]


def test_lm_separates_labels_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = lm_scoring.train(lm_scoring.with_target(docs, labels.where("doc_id % 2 = 0")), "is_target")
    rows = lm_scoring.score(docs, model).join(labels, "doc_id").where("doc_id % 2 = 1 and ce_diff is not null").select("ce_diff", "quality", "toxic").collect()
    good, bad = ([r.ce_diff for r in rows if (r.quality == 1 and r.toxic == 0) == k] for k in (True, False))
    wins = sum((b > g) + 0.5 * (b == g) for g in good for b in bad) / (len(good) * len(bad))
    print("held-out area under the curve", wins, len(good), len(bad))
    assert wins > 0.6


def test_cover_tree_finds_exactly_the_pairs(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 16))
    x = np.concatenate([centres[r.integers(0, 40, 900)] + 0.17 * r.normal(size=(900, 16)), r.normal(size=(300, 16)), centres[:30], centres[:30]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = unit @ unit.T >= 0.9
    np.fill_diagonal(want, False)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    old = cover_tree.BLOCK, cover_tree.FAN, cover_tree.PART
    try:
        cover_tree.BLOCK, cover_tree.FAN, cover_tree.PART = 100, 5, 150
        got = {g.vec_id: g for g in cover_tree.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()}
    finally:
        cover_tree.BLOCK, cover_tree.FAN, cover_tree.PART = old
    assert [got[i].n_links for i in range(len(x))] == want.sum(1).tolist()
    label = np.arange(len(x))
    cover_tree._unite(label, *np.nonzero(want))
    least = {c: min(np.flatnonzero(label == c)) for c in set(label)}
    assert [got[i].component_id for i in range(len(x))] == [least[c] for c in label]
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_cover_tree_prunes_pairs_of_cells_and_keeps_widths_apart(spark):
    r = np.random.default_rng(6)
    centres = r.normal(size=(12, 8))
    x = [(i, (centres[i % 12] + 0.05 * r.normal(size=8)).tolist()) for i in range(1200)]
    x += [(5000 + i, (centres[0][:3] + 0.05 * r.normal(size=3)).tolist()) for i in range(300)] + [(9000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(250)]
    d = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    old = cover_tree.BLOCK
    try:
        cover_tree.BLOCK = 60
        placed = spark.createDataFrame([(str(i), str(len(v)), (np.array(v) / np.linalg.norm(v)).tobytes()) for i, v in x], "row string, cell string, x binary")
        cells, levels = cover_tree._tree(placed, 0.447)
        leaves = sum(n.where("leaf").count() for n in levels)
        assert cells.count() == len(x) and leaves > 20
        assert cover_tree._cell_pairs(levels, 0.447).count() < 0.4 * leaves * (leaves + 1) / 2
        got = {g.vec_id: g for g in cover_tree.link(d).collect()}
    finally:
        cover_tree.BLOCK = old
    for width in {len(v) for _, v in x}:
        own = [i for i, v in x if len(v) == width]
        u = np.array([v for _, v in x if len(v) == width])
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        want = (u @ u.T >= 0.9).sum(1) - 1
        assert [got[i].n_links for i in own] == want.tolist() and {got[i].component_id for i in own} <= set(own)


def test_cover_tree_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [2.0, 0.0]), (None, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [1e308, 1e308]), (10, [1e-300, 1e-300]), (11, [0.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("kept", F.lit(1))
    got = sorted((x.vec_id or 0, x.n_links, x.component_id) for x in cover_tree.link(d).collect())
    assert got == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 1, 9), (10, 1, 9), (11, 0, 11)]
    assert cover_tree.link(d.limit(0)).collect() == []


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [len(s) for s in sets], label


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 50)])
def test_ngram_join_equals_brute_force(spark, k, percent):
    r = random.Random(k)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = r.choices(vocab, k=r.choice([1, 2, 3, 8, 40, 120]))
        for _ in range(r.choice([1, 2, 12])):
            t = [w if r.random() > r.choice([0, 0.01, 0.05]) else r.choice(vocab) for w in base]
            texts.append(" ".join(t).upper() if r.random() < 0.2 else " ".join(t))
    texts += ["", None, "  ", texts[0], texts[1]]
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k, percent).collect())
    n, label = brute_components(texts, k, percent)
    assert got == list(zip(range(len(texts)), n, label))


@pytest.mark.parametrize("before", [0, 1, 8])
def test_ngram_join_loses_no_link_of_pairs_left_to_earlier_shingles(spark, monkeypatch, before):
    """Copies of one text with up to eight words changed: most pairs share shingles of their prefixes, few of them link."""
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "BEFORE", before)
    r = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(120):
        t = list(base)
        for at in r.sample(range(150), r.choice([2, 4, 8])):
            t[at] = f"x{r.randrange(6)}"
        texts.append(" ".join(t))
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85).collect())
    n, label = brute_components(texts, 4, 85)
    assert got == list(zip(range(len(texts)), n, label)) and 5 < len(set(label)) < 115


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(4)
    vocab = [f"v{i}" for i in range(200)]
    lines = [r.choices(vocab, k=r.choice([1, 3, 5, 6, 15, 40, 130])) for _ in range(60)]
    docs = []
    for i in range(60):
        some = [[w if r.random() > 0.04 else r.choice(vocab) for w in r.choice(lines)] for _ in range(r.randint(0, 6))]
        docs.append((i, "\n".join(r.choice([" ", " ", "  ", "\t"]).join(s) for s in some)))
    got = {x.doc_id: x.text for x in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    earlier, want = [], {}
    for i, t in docs:
        kept = []
        for line in t.split("\n"):
            s = set(WORD.findall(line))
            if not s or not any(100 * len(s & e) >= 80 * len(s | e) for e in earlier):
                kept.append(line)
            if s:
                earlier.append(s)
        want[i] = "\n".join(kept)
    assert got == want


def test_substring_dedup_finds_repeats_and_fuzzy_passages(spark):
    r = random.Random(6)
    vocab = [f"u{i}" for i in range(5000)]
    passage = r.choices(vocab, k=80)
    fuzzy = [w if i % 19 else "changed" for i, w in enumerate(passage)]
    moved = passage[:40] + ["put", "in"] + passage[40:]
    fill = lambda n: r.choices(vocab, k=n)
    docs = [fill(100), fill(30) + passage + fill(30), fill(10) + passage + fill(90), fill(50) + fuzzy, moved + fill(20), fill(200), fill(40) + passage[:30] + fill(40)]
    docs += [docs[1], docs[0]]
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    rows = substring_dedup.passages(d).collect()
    assert {x.doc_id for x in rows} == {2, 3, 4, 7, 8}
    exact = next(x for x in rows if x.doc_id == 2)
    assert (exact.start, exact.end, exact.source_id, exact.source_start, exact.matched) == (10, 90, 1, 30, 80)
    assert all(x.matched >= 70 for x in rows) and {(x.doc_id, x.source_id) for x in rows} >= {(7, 1), (8, 0)}


def test_substring_dedup_splits_chains_at_gaps(spark):
    r = random.Random(61)
    vocab = [f"u{i}" for i in range(5000)]
    fill = lambda n: r.choices(vocab, k=n)
    docs, want = [], []
    for gap in (10, 50, 120, 250, 400):
        one, two = fill(60), fill(60)
        docs += [fill(20) + one + fill(gap) + two + fill(20), fill(30) + one + fill(gap) + two + fill(10)]
        want += [{(30, 90), (90 + gap, 150 + gap)} if gap > 30 else {(30, 150 + gap)}]
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    rows = substring_dedup.passages(d).collect()
    for i, spans in enumerate(want):
        assert {(x.start, x.end) for x in rows if x.doc_id == 2 * i + 1} == spans
    assert {(x.doc_id, x.source_id) for x in rows} == {(2 * i + 1, 2 * i) for i in range(len(want))}


def test_alignment_equals_brute_force_over_parts():
    r = random.Random(62)
    for _ in range(30):
        x, y, spans = [], [], []
        for _ in range(r.randint(1, 4)):
            n, gap = r.randint(20, 90), r.randint(0, 120)
            both = [r.randrange(10**6) for _ in range(n)]
            spans.append((len(x), len(x) + n))
            x, y = x + both + [r.randrange(10**6) for _ in range(gap)], y + both + [r.randrange(10**6) for _ in range(gap)]
        b = np.concatenate([np.arange(s, e - substring_dedup.K + 1, 5) for s, e in spans])
        got = substring_dedup.align(np.array(x, np.uint64), np.array(y, np.uint64), b, b)
        parts = [(sum(e - s for s, e in spans[i : j + 1]), spans[i][0], spans[j][1]) for i in range(len(spans)) for j in range(i, len(spans))]
        parts = [p for p in parts if p[2] - p[1] >= substring_dedup.MIN_WORDS and 100 * p[0] >= substring_dedup.IDENTITY * (p[2] - p[1])]
        assert max(parts, default=(0,))[0] == max((g[4] for g in got), default=0)
        assert all(any(g[0] < e and s < g[1] for g in got) for _, s, e in parts)


def test_substring_dedup_finds_passages_whose_parts_other_documents_have(spark):
    r = random.Random(63)
    vocab = [f"u{i}" for i in range(5000)]
    fill = lambda n: r.choices(vocab, k=n)
    docs, want = [], set()
    for _ in range(12):
        parts = [fill(20) for _ in range(3)]
        whole = parts[0] + parts[1] + parts[2]
        alone = lambda parts=parts: [fill(15) + p + fill(15) for p in parts]
        first = len(docs) + 3
        docs += [*alone(), fill(25) + whole + fill(25), *alone(), fill(30) + whole + fill(10)]
        want.add((len(docs) - 1, 30, 90, first, 25, 85))
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    assert {tuple(x)[:6] for x in substring_dedup.passages(d).collect()} == want


def test_substring_dedup_covers_all_exact_repeats(spark):
    r = random.Random(64)
    pool = [r.choices([f"u{i}" for i in range(3000)], k=9) for _ in range(40)]
    sources = [sum(r.choices(pool, k=60), []) for _ in range(4)]
    docs = []
    for _ in range(120):
        words = []
        for _ in range(r.randint(1, 4)):
            source, n = r.choice(sources), r.randint(40, 70)
            at = r.randrange(len(source) - n)
            words += r.choices([f"v{i}" for i in range(3000)], k=r.randint(0, 30)) + source[at : at + n]
        docs.append(words)
    n, seen, missed, repeats = substring_dedup.MIN_WORDS, set(), [], 0
    rows = substring_dedup.passages(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")).collect()
    for d, words in enumerate(docs):
        runs = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        covered = {w for x in rows if x.doc_id == d for w in range(x.start, x.end)}
        for i, run in enumerate(runs):
            if run in seen:
                repeats += 1
                missed += [] if covered.issuperset(range(i, i + n)) else [(d, i)]
        seen |= set(runs)
    assert repeats > 500 and missed == []


@pytest.mark.parametrize("changed", [0.05, 0.10, 0.15])
def test_substring_dedup_recall_of_fuzzy_passages(spark, changed):
    r = random.Random(65)
    vocab = [f"u{i}" for i in range(5000)]
    fill = lambda n: r.choices(vocab, k=n)
    docs, want = [], set()
    for i in range(100):
        passage = fill(r.randint(60, 150))
        fuzzy = [w if r.random() > changed else r.choice(vocab) for w in passage]
        if i % 3 == 0:  # a word put in and one left out
            fuzzy = fuzzy[:20] + ["extra"] + fuzzy[20:40] + fuzzy[41:]
        docs += [fill(r.randint(0, 60)) + passage + fill(r.randint(0, 60)), fill(r.randint(0, 60)) + fuzzy + fill(r.randint(0, 60))]
        want.add((2 * i + 1, 2 * i))
    rows = substring_dedup.passages(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")).collect()
    found = {(x.doc_id, x.source_id) for x in rows}
    assert found <= want and len(found) >= 0.9 * len(want)


def test_substring_dedup_within_one_text_and_without_ids(spark):
    r = random.Random(66)
    vocab = [f"u{i}" for i in range(5000)]
    one, two = r.choices(vocab, k=70), r.choices(vocab, k=90)
    fill = lambda n: r.choices(vocab, k=n)
    docs = [(3, one + fill(40) + one + fill(9)), (None, two + fill(30)), (7, fill(20) + two), (8, ["a", "b"] * 300)]
    rows = {tuple(x) for x in substring_dedup.passages(spark.createDataFrame([(i, " ".join(x)) for i, x in docs], "doc_id long, text string")).collect()}
    assert {x for x in rows if x[0] != 8} == {(3, 110, 180, 3, 0, 70, 70), (7, 20, 110, None, 0, 90, 90)}


def test_substring_dedup_repeats_within_a_text_against_any_earlier_place(spark):
    """Parts that stand apart first, then in a row, twice; and brute force over texts made of few phrases."""
    r = random.Random(71)
    vocab = [f"u{i}" for i in range(5000)]
    fill = lambda n: r.choices(vocab, k=n)
    a, b, c = fill(20), fill(20), fill(20)
    texts = [a + fill(15) + b + fill(15) + c + fill(15) + a + b + c + fill(15) + a + b + c, ["a", "b"] * 300, fill(50) * 2, fill(49) * 2, []]
    for _ in range(90):
        phrases = [fill(r.choice([7, 20, 30])) for _ in range(6)]
        texts.append([w for _ in range(r.randint(5, 25)) for w in r.choice(phrases)])
    found = substring_dedup.passages(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")).where("doc_id = source_id").collect()
    covered = {i: set() for i in range(len(texts))}
    for x in found:
        assert x.source_end <= x.start and x.end <= len(texts[x.doc_id])
        covered[x.doc_id].update(range(x.start, x.end))
    assert any((x.start, x.end) == (180, 240) for x in found if x.doc_id == 0)
    n = 0
    for i, t in enumerate(texts):
        first = {}
        for p in range(len(t) - 49):
            if p - first.setdefault(tuple(t[p : p + 50]), p) >= 50:
                assert covered[i].issuperset(range(p, p + 50)), (i, p)
                n += 1
    assert n > 1000 and not covered[3]


def test_substring_dedup_pairs_of_frequent_seeds(spark):
    """Passages of seeds that more than RARE documents have, each with another first document."""
    r = random.Random(67)
    vocab = [f"u{i}" for i in range(5000)]
    fill = lambda n: r.choices(vocab, k=n)
    parts = [fill(30) for _ in range(3)]
    docs = [fill(5) + parts[i % 3] + fill(5) for i in range(3 * (substring_dedup.RARE + 5))]
    whole = sum(parts, [])
    docs += [fill(12) + whole + fill(7) for _ in range(substring_dedup.RARE + 5)]
    rows = substring_dedup.passages(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")).collect()
    first = 3 * (substring_dedup.RARE + 5)
    assert {(x.doc_id, x.source_id, x.start, x.end) for x in rows} == {(i, first, 12, 102) for i in range(first + 1, len(docs))}


def test_language_keeps_its_table_beside_large_ones(spark):
    r = random.Random(90)
    hot = [" ".join("".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(3)) for _ in range(600)) for _ in range(100)]
    rows = [(t, "zh") for t in hot for _ in range(7)] + [("bani deko lumi", "aa"), ("ruxo wepy quzi", "bb")] * 3
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    got = language_id.label(spark.createDataFrame([(1, "deko lumi bani"), (2, "wepy quzi ruxo")], "doc_id long, text string"), model).collect()
    assert {x.doc_id: x.lang_pred for x in got} == {1: "aa", 2: "bb"}


def test_fenwick_chain_equals_brute_force():
    r = np.random.default_rng(2)
    for _ in range(40):
        n = int(r.integers(1, 14))
        b, a = np.sort(r.integers(0, 60, n)), r.integers(0, 60, n)
        best = np.zeros(n)
        order = sorted(range(n), key=lambda i: (b[i], a[i]))
        for i in order:
            best[i] = substring_dedup.SEED
            for j in order:
                if b[j] < b[i] and a[j] < a[i]:
                    best[i] = max(best[i], substring_dedup.SEED + best[j] - substring_dedup.GAP * float(b[i] - b[j] + a[i] - a[j]))
        chains = substring_dedup.fenwick_chain(b, a)
        assert sorted(i for c in chains for i in c) == list(range(n))
        first = chains[0]
        score = len(first) * substring_dedup.SEED - substring_dedup.GAP * float(b[first[-1]] - b[first[0]] + a[first[-1]] - a[first[0]])
        assert all(b[i] < b[j] and a[i] < a[j] for i, j in zip(first, first[1:])) and score == pytest.approx(best.max())


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(d))) % 10 == 0
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans_equal_plain_patterns(spark):
    r = random.Random(9)
    texts = ["a@b.c@d.e.f x@y..z .a.b@c-d.e_ a@b.co_x@y.z", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.0003.4", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111", "+1 (234) 567-8901 +12 +1+22 333 4444 555", "\x02a.b@c.d", "🙂 x@y.com 🙂 1.1.1.1"]
    texts += [None, "", "1" * 5000, "a." * 5000 + "@b" + ".c" * 5000, "+1" + " " * 20000 + "2 3 4 5 6 7 8 9"] + ["".join(r.choice("ab1.@- +()9_4%\n\x02") for _ in range(60)) for _ in range(400)]
    got = {x.doc_id: x for x in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t or "")[:80]
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s.startswith(k + ":") for s in want) for k in BASE]
        assert set(want) <= set(got[i].spans.split(",")) | {""} or not want


def test_pii_adds_secrets_and_leaves_clean_text(spark):
    secret, number = "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e", "123-45-6789"
    texts = [f'the token = "{secret}" here', f"his ssn: {number}, so", "write to jane [at] mail [dot] org now", "it was at home on 2024-05-01 at 10:20:30, version 1.22.333", "interdisciplinarywise and well-known-in-the-world", "they met at noon"]
    got = {x.doc_id: x.spans for x in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == f"secret:{texts[0].index(secret)}:{texts[0].index(secret) + 40}" and got[1].startswith("number:9:20") and got[2].startswith("address:")
    assert [got[i] for i in (3, 4, 5)] == ["", "", ""]


def test_pii_keeps_what_stands_beside_base_spans(spark):
    text = "call 4111 1111 1111 1111 (555) 123-4567 now"
    got = pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.spans == "card:5:24,number:26:39" and got.n_card == 1
    base = spark.createDataFrame([(1, "ip", 10, 20, True), (1, "phone", 18, 24, True), (2, "ip", 0, 5, True)], "row long, kind string, start long, end long, base boolean")
    added = [(1, "number", 5, 30, "a" * 25, 1.0), (1, "secret", 28, 33, "b" * 5, 2.0), (1, "secret", 40, 44, "cccc", 1.0), (2, "number", 1, 4, "123", 1.0)]
    got = pii._beside(base, spark.createDataFrame(added, "row long, kind string, start long, end long, hit string, score double")).collect()
    assert sorted(tuple(x) for x in got) == [(1, "secret", 5, 10), (1, "secret", 24, 33), (1, "secret", 40, 44)]


def test_pii_finds_numbers_beside_others_and_forms_not_trained_on(spark):
    """What has to be covered in each text; the templates are not those of the training samples."""
    r = random.Random(5)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    mixed = lambda n: "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(n))
    forms = {
        "beside_card": lambda: ("call 4111 1111 1111 1111 ({}", [f"555) {num(3)}-{num(4)}"]),
        "in_failed_card": lambda: ("my tel {} {}", ["4111 1111 1111 1111", f"555-{num(3)}-{num(4)}"]),
        "area_slash": lambda: ("Tel.: {}", [f"030/{num(7)}"]),
        "dashed_at": lambda: ("send it to {} soon", [f"{mixed(1)} -at- {mixed(5).lower()} -dot- com"]),
        "password": lambda: ("password: {}", [mixed(8) + num(4)]),
        "before_date": lambda: ("ring me on {} 2024-05-01", [f"{num(3)}-{num(3)}-{num(4)}"]),
        "two_phones": lambda: ("{} or {}", [f"{num(3)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}"]),
        "london": lambda: ("dial {} please", [f"020 {num(4)} {num(4)}"]),
        "two_ids": lambda: ("numbers {} {}", [f"{num(3)}-{num(2)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}"]),
    }
    rows, want = [], {}
    for name, make in forms.items():
        for _ in range(20):
            form, parts = make()
            text = "some words before " + form.format(*parts) + " and words after"
            want[len(rows)] = (name, [(text.index(p), text.index(p) + len(p)) for p in parts])
            rows.append((len(rows), text))
    hit, total = Counter(), Counter()
    for x in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        name, parts = want[x.doc_id]
        spans = [tuple(map(int, s.split(":")[1:])) for s in x.spans.split(",") if s]
        covered = {i for a, b in spans for i in range(a, b)}
        text = rows[x.doc_id][1]
        hit[name] += all(i in covered or not text[i].isalnum() for a, b in parts for i in range(a, b))
        total[name] += 1
    print(dict(hit))
    assert sum(hit.values()) >= 0.9 * sum(total.values()) and all(hit[k] >= 0.75 * total[k] for k in forms)


def test_pii_long_runs_of_numbers_take_linear_time(spark):
    text = " ".join(str(i % 97) for i in range(60_000))
    got = pii.digest(spark.createDataFrame([(1, text), (2, "x 12 " + "3" * 30_000)], "doc_id long, text string")).collect()
    assert len(got) == 2


def test_pii_recall_and_precision_in_texts_like_the_documents(spark):
    """Spans of each added kind are put into clean documents; what is found elsewhere is wrong."""
    from lodestone.llm.tables import read

    r = random.Random(81)
    hexa, letters = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    word = lambda: pick("abcdefghijklmnop", r.randint(4, 8))
    make = {
        "secret": [lambda: f'token = "{pick(hexa, 40)}"', lambda: f"api key: {pick(letters, 32)}", lambda: f"secret {pick(hexa, 32)}"],
        "number": [lambda: f"ssn: {pick('0123456789', 3)}-{pick('0123456789', 2)}-{pick('0123456789', 4)}", lambda: f"phone: {pick('23456789', 3)}-{pick('0123456789', 3)}-{pick('0123456789', 4)}"],
        "address": [lambda: f"mail {word()} [at] {word()} [dot] org", lambda: f"write to {word()} (at) {word()} dot com"],
        "ipv6": [lambda: "host " + ":".join(pick(hexa, 4) for _ in range(8))],
    }
    clean = [x.text for x in read(spark, "/root/testdata/sf0.01", "documents").where("text is not null and not rlike(text, '[0-9@+#*|]') and length(text) between 200 and 6000").orderBy("doc_id").collect()]
    rows, want = [], {}
    for i, t in enumerate(clean[:320]):
        kind = [*make, None][i % 5]
        if kind:
            cut, said = t.index(" ", len(t) // 2), r.choice(make[kind])()
            t = f"{t[:cut]} {said}{t[cut:]}"
            want[i] = (kind, cut + 1, cut + 1 + len(said))
        rows.append((i, t))
    got = {x.doc_id: [s.split(":") for s in x.spans.split(",") if s] for x in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit, total, wrong = Counter(), Counter(), 0
    for i, _ in rows:
        kind, a, b = want.get(i, (None, 0, 0))
        total[kind] += 1
        inside = [s for s in got[i] if a <= int(s[1]) and int(s[2]) <= b and kind]
        hit[kind] += bool(inside)
        wrong += len(got[i]) - len(inside)
    print({k: (hit[k], total[k]) for k in make}, "wrong", wrong)
    assert all(hit[k] >= 0.9 * total[k] for k in make) and wrong <= 0.02 * len(rows)


def test_boosted_trees_learn_and_agree_with_their_sql(spark):
    r = np.random.default_rng(1)
    x = r.integers(0, 10, (800, 3)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 6)).astype(float)
    trees = boosting.Boosted(x, y)
    assert ((trees.margin(x) > 0) == y).mean() > 0.97
    d = spark.createDataFrame([tuple(map(float, row)) for row in x[:50]], "a double, b double, c double")
    assert [q[0] for q in d.select(F.expr(trees.sql(["a", "b", "c"]))).collect()] == pytest.approx(trees.margin(x[:50]).tolist())


def test_words_are_runs_of_letters_and_found_in_linear_time():
    import time

    r, letter = random.Random(1), lambda c: c.isalpha()
    for _ in range(500):
        t = "".join(r.choice("ab é½Ⅳ²漢_9字一٣\n") for _ in range(30))
        want = [(i, j) for i in range(len(t)) for j in range(i + 1, len(t) + 1) if all(map(letter, t[i:j])) and not (i and letter(t[i - 1])) and not (j < len(t) and letter(t[j]))]
        assert list(language_id.spans_of(t)) == want and language_id.words_of(t) == [t[i:j] for i, j in want]
    began = time.process_time()
    assert len(language_id.words_of("the quick brown fox " * 500_000)) == 2_000_000 and time.process_time() - began < 6


def test_language_id_on_the_held_out_fold(spark):
    from lodestone.llm.tables import read

    d = read(spark, "/root/testdata/sf0.01", "documents")
    rows = language_id.query(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in rows if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in rows)
    assert sum(x.lang == x.lang_pred for x in held) / len(held) > 0.97 and all(0 <= x.score <= 1 for x in rows)


def test_viterbi_equals_brute_force_and_its_shortcut_holds():
    r = np.random.default_rng(3)
    tables = [r.normal(size=(int(n), 3)) * 5 for n in r.integers(1, 7, 30)]
    import itertools

    for s, got in zip(tables, language_id.viterbi(tables, 4.0)):
        value = lambda p: sum(s[i, q] for i, q in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=len(s)), key=value)
        assert value(got) == pytest.approx(value(best))
        lead = language_id.settled(s, 4.0)
        assert lead is None or (got == lead).all()


def test_mixed_text_gets_spans(spark):
    en = "the river was wide and the old bridge stood there for a hundred years of quiet water"
    ru = "река была широкой и старый мост стоял там сто лет над тихой водой"
    d = spark.createDataFrame([(1, en, "en"), (2, ru, "ru"), (3, en + " " + ru, None), (4, "漢字", None), (5, "12 .", None)], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_id.label(d, language_id.train(d.union(d).union(d))).collect()}
    assert [s.lang for s in got[3].spans] == ["en", "ru"] and got[3].spans[1].start == len(en) + 1 and got[3].lang_pred == "en"
    assert (got[4].lang_pred, got[4].score) == ("en", 0.0) and (got[5].lang_pred, got[5].spans) == ("und", [])
    signs = language_id.label(spark.createDataFrame([(1, "½ ² Ⅷ 12")], "doc_id long, text string"), language_id.train(d))
    assert signs.first().lang_pred == "und"  # numbers that are no letters


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 0, "c": float("nan")}])
def test_mixing_deviates_by_less_than_a_block(spark, weights):
    rows = [(i, s) for n, s in ((700, "a"), (300, "b"), (90, "c"), (5, None)) for i in range(n)]
    d = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.slots(d, weights, block=10)[0].collect()
    assert len({x.position for x in got}) == len(rows)
    blocks = Counter((x.source, x.block) for x in got)
    assert len({x.slot for x in got}) == len(blocks) == max(x.slot for x in got) + 1
    order = [s for _, s in sorted({(x.slot, x.source) for x in got}, key=lambda p: p[0])]
    c = mixing.whole_weights({k: (weights or {s: n**0.5 for s, n in Counter(s for s, _ in blocks).items()}).get(k) for k in ("a", "b", "c", None)})
    live, done, since, start = set(c), Counter(), Counter(), 0
    total = Counter(s for s, _ in blocks)
    for t, s in enumerate(order):
        done[s] += 1
        since[s] += 1
        whole = sum(c[k] for k in live)
        assert all(abs(since[k] - (t + 1 - start) * c[k] / whole) < 1 for k in live)
        if done[s] == total[s]:
            live.discard(s)
            since, start = Counter(), t + 1


def test_mixing_refuses_too_many_sources(spark):
    d = spark.range(mixing.MAX_SOURCES + 1).selectExpr("id as doc_id", "cast(id as string) as source")
    with pytest.raises(ValueError):
        mixing.slots(d)


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(60), r.randrange(60)) for _ in range(25)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = label.setdefault(a, a), label.setdefault(b, b)
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    assert got == label


def _plain_mix(rows, block, weights):
    """(doc_id, source, block, slot, position) by going through the slots one after the other, on rows of (doc_id, source)."""
    key = lambda k: (k is None, str(k))
    names = sorted({s for _, s in rows}, key=key)
    queues = {k: sorted((d for d, s in rows if s == k), key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d)) for k in names}
    left = {k: -(-len(q) // block) for k, q in queues.items()}
    c = mixing.whole_weights({k: weights(n) for k, n in left.items()})
    out, taken, slot = [], dict.fromkeys(names, 0), 0
    while any(left.values()):
        live = [k for k in names if left[k]]
        total, given, start = sum(c[k] for k in live), dict.fromkeys(live, 0), slot
        while all(left[k] for k in live):
            free = [k for k in live if given[k] * total // c[k] <= slot - start]
            k = min(free, key=lambda k: (-(-(given[k] + 1) * total // c[k]), key(k)))
            for i, d in enumerate(queues[k][taken[k] * block : (taken[k] + 1) * block]):
                out.append((d, k, taken[k], slot, slot * block + i))
            given[k], taken[k], left[k], slot = given[k] + 1, taken[k] + 1, left[k] - 1, slot + 1
    return sorted(out, key=str)


def test_mixing_query_equals_slot_by_slot_scheduling(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = [(r.doc_id, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()]
        got = sorted(((r.doc_id, r.source, r.block, r.slot, r.position) for r in mixing.query(spark, sf).collect()), key=str)
        assert got == _plain_mix(rows, mixing.BLOCK, lambda n: n**mixing.TEMPER)
    # blocks of two, so that periods repeat and phases change within each source, with a null source
    r = random.Random(8)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"a": 0.2, "b": 0.5, "c": 0.25, None: 0.05}
    got = sorted(((x.doc_id, x.source, x.block, x.slot, x.position) for x in mixing.slots(d, weights, block=2)[0].collect()), key=str)
    at = iter([weights[k] for k in sorted({s for _, s in rows}, key=lambda k: (k is None, str(k)))])
    assert got == _plain_mix(rows, 2, lambda n: next(at))
