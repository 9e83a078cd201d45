"""Chat formatting, Merkle manifest and filter audit against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat_format, filter_audit, merkle

CHATS = "conv_id long, turn long, role string, text string, extra string"
TOKEN = re.compile(r"[^\W\d_]{1,8}|\d{1,3}|[^\x20\x09-\x0D]")
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


# ---- chat formatting --------------------------------------------------------------------------------------------------


def _escaped(text):
    return re.sub(r"\\|</?(?=turn)", lambda m: m[0] + "\\", text)


def _formatted(role, text):
    head = "<turn " + _escaped(role).replace(">", "\\>") + ">\n"
    return head, _escaped(text), "</turn>\n"


def _plain_windows(turns, budget, history):
    """(text, loss spans, repeated turns) of one conversation's turns (role, text), in order."""
    size = [len(TOKEN.findall(x)) + chat_format.MARKS for _, x in turns]
    system = turns[0][0] == "system"
    out, i = [], 0
    while i < len(turns):
        over = size[0] if system and i else 0
        back = i
        while back > system and sum(size[back - 1 : i]) <= history:
            back -= 1
        if sum(size[back:i]) + over + size[i] > budget:
            back = i
        end = i + 1
        while end < len(turns) and sum(size[back : end + 1]) + over <= budget:
            end += 1
        text, loss = "", []
        for k in [*([0] if system and i else []), *range(back, end)]:
            head, body, close = _formatted(*turns[k])
            if k >= i and turns[k][0] == "assistant":
                loss.append((len(text) + len(head), len(text) + len(head) + len(body)))
            text += head + body + close
        out.append((text, loss, (system and i > 0) + i - back))
        i = end
    return out


@pytest.mark.parametrize("budget, history", [(40, 15), (25, 40), (5, 0), (2048, 512)])
def test_windows_equal_a_plain_version(spark, budget, history):
    r = random.Random(budget)
    marks = ["</turn>", "<turn user>", "\\", "\\\\n", "a<b", "</", "\n", "### User:", "word", "é🙂漢", "1234", "", "assistant>\n"]
    chats = {c: [(r.choice(["system", "user"]) if t == 0 else r.choice(["user", "assistant", "system", "a>\nb\\"]), " ".join(r.choices(marks, k=r.randint(0, 9)))) for t in range(r.randint(1, 12))] for c in range(40)}
    rows = [(c, t, role, text, "?") for c, turns in chats.items() for t, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    found = chat_format.windows(spark.createDataFrame(rows, CHATS).repartition(3), budget, history).orderBy("conv_id", "segment", "block", "window").collect()
    got = {c: [(w.text, [tuple(s) for s in w.loss], w.n_context) for w in found if w.conv_id == c] for c in chats}
    assert got == {c: _plain_windows(turns, budget, history) for c, turns in chats.items()}


def _check_digests(df, turns_by_conv, **options):
    rows = {x.conv_id: x for x in chat_format.read_back(chat_format.windows(df, **options)).collect()}
    assert set(rows) == set(turns_by_conv)
    for c, turns in turns_by_conv.items():
        said = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        x = rows[c]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_long_conversations_are_cut_into_segments(spark):
    turns = [("system", "be brief")] + [(("user", "assistant")[i % 2], f"t{i} word word") for i in range(2500)]
    df = spark.createDataFrame([(1, t, a, b, "") for t, (a, b) in enumerate(turns)], CHATS)
    _check_digests(df, {1: turns}, budget=100, history=30)
    found = chat_format.windows(df, 100, 30).orderBy("segment", "window").collect()
    assert {w.segment for w in found} == {0, 1, 2} and max(w.n_tokens for w in found) <= 100
    for w in found[1:]:  # the system turn and history are in each window, at the start of a segment too
        assert w.text.startswith("<turn system>\nbe brief</turn>\n") and 1 < w.n_context < 6


def test_odd_turns(spark):
    rows = [(1, 0, None, None, ""), (1, 0, None, None, ""), (1, None, "assistant", "first", ""), (None, 3, "user", "x", ""), (None, 3, "assistant", "y" * 50_000, ""), (2, -5, "system", "", ""), (2, 10**15, "assistant", "\\", ""), (2, 2048, "user", "q", "")]
    df = spark.createDataFrame(rows, CHATS)
    want = {1: [("assistant", "first"), ("", ""), ("", "")], None: [("assistant", "y" * 50_000), ("user", "x")], 2: [("system", ""), ("user", "q"), ("assistant", "\\")]}
    _check_digests(df, want, budget=50, history=10)
    _check_digests(df.withColumns({c: F.lit("?") for c in ("segment", "kind", "p", "w", "starts", "n", "window", "loss", "block")}), want)
    assert chat_format.read_back(chat_format.windows(df.limit(0))).collect() == []


def test_many_rows_of_one_turn_number_are_cut_into_blocks(spark):
    df = spark.range(9000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(7).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit("same text").alias("text"), F.lit("").alias("extra"))
    _check_digests(df, {1: [("assistant", "same text")] * 9000})


def test_escaping_comes_back(spark):
    r = random.Random(4)
    parts = ["<", "/", "turn", ">", "\\", "\n", "</turn>\n", "<turn ", "t", "é"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, texts[-i]) for i, t in enumerate(texts)], "i int, t string, role string")
    whole = F.concat(chat_format.header(F.col("role")), chat_format.escaped(F.col("t")), F.lit(chat_format.CLOSE))
    for x in df.select("t", "role", chat_format.turns_of(F.concat(whole, whole)).alias("back")).collect():
        assert [tuple(p) for p in x.back] == [(x.role, x.t)] * 2


# ---- Merkle manifest --------------------------------------------------------------------------------------------------


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def _tree(digests):
    """(root, the siblings of each leaf as (left, right) by level)."""
    proofs, nodes = [[] for _ in digests], [(d, [i]) for i, d in enumerate(digests)]
    while len(nodes) > 1:
        above = []
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            for j, (_, below) in enumerate(run):
                for i in below:
                    proofs[i].append(([x[0] for x in run[:j]], [x[0] for x in run[j + 1 :]]))
            above.append((_h(*(x[0] for x in run)), [i for x in run for i in x[1]]))
        nodes = above
    return (nodes[0][0] if nodes else None), proofs


def _plain_manifest(rows):
    groups = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    by = {g: sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))) for g in groups}
    trees = {g: _tree([_leaf(r) for r in by[g]]) for g in groups}
    root, ways = _tree([trees[g][0] for g in groups])
    out = []
    for g, way in zip(groups, ways):
        for r, proof in zip(by[g], trees[g][1]):
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            again = _leaf((*r[:4], r[4].replace("\n", ""))) if odd else _leaf(r)
            for left, right in proof + way:
                again = _h(*left, again, *right)
            out.append((r[0], _leaf(r), trees[g][0], root, _h(*(x for a, b in proof + way for x in a + b)), again, again == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n, sources", [(0, ["a"]), (1, ["a"]), (3, [None, "b"]), (4, ["a"]), (90, [None, "", "a", "b", "é", "z", "\U0001f642"]), (60, [f"s{i}" for i in range(40)])])
def test_manifest_equals_a_plain_version(spark, tmp_path, n, sources):
    r = random.Random(n)
    rows = [(r.choice([None, *range(60)]), r.choice(sources), r.choice([None, "en"]), r.choice([None, 5]), r.choice([None, "", "a\nb", "long " * 3000, "x"])) for _ in range(n)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("?") for c in ("g", "h", "idx", "key", "group", "rank", "leaf", "root", "carry")})
    df.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((tuple(x) for x in merkle.query(spark, str(tmp_path)).collect()), key=str) == _plain_manifest(rows)


def test_manifest_without_broadcasts(spark, tmp_path, monkeypatch):
    rows = [(i, f"s{i % 5 if i % 3 else 0}", "en", 1, f"t\n{i}") for i in range(300)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(merkle, "BROADCAST", 0)
    assert sorted((tuple(x) for x in merkle.query(spark, str(tmp_path)).collect()), key=str) == _plain_manifest(rows)


# ---- filter audit -------------------------------------------------------------------------------------------------------


def _plain_audit(docs, labels):
    first = {}
    for i, _, text in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({d for d, *q in labels if d is not None and q[k] == 1} for k in (0, 1))
    facts = []
    for i, source, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i is not None and first[text] < i}
        facts.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, taken = [], {}
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            gone = set()
            for step, name in enumerate(order, 1):
                here = [k for k, f in enumerate(own) if name in f[1] and k not in gone]
                again = sum(name in f[1] for f in own) - len(here)
                gone |= set(here)
                taken[part, name] = taken.get((part, name), 0) + len(here)
                out.append([part, order, step, len(own) - len(gone), len(here), again, sum(f[1] == {name} for f in own), sum(own[k][2] for k in here), sum(own[k][3] for k in here)])
    return sorted((*x, taken[x[0], x[1][x[2] - 1]]) for x in out)


def test_audit_equals_a_plain_version(spark):
    r = random.Random(9)
    texts = [None, "", " \n", "short one", "Many " * 60, " ".join(f"w{i}" for i in range(70)), " ".join(f"w{i}" for i in range(55)) + " #", "ABC " * 80, " ".join(f"W{i}" for i in range(60)), "x" * 30_000]
    docs = [(r.choice([None, *range(40)]), r.choice([None, "", "a", "b"]), r.choice(texts)) for _ in range(150)] + [(7, "a", texts[5])] * 3
    labels = [(r.choice([None, *range(40)]), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({c: F.lit("?") for c in ("hash", "bits", "part", "good", "n", "of_text", "toxic")})
    q = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(filter_audit.combinations(d.repartition(3), q)).collect()
    assert sorted(tuple(x) for x in found) == _plain_audit(docs, labels)
    assert filter_audit.audit(filter_audit.combinations(d.limit(0), q)).collect() == []
    assert [x.kept for x in filter_audit.audit(filter_audit.combinations(d.where("doc_id = 7"), q.limit(0))).collect()]


def test_audit_without_broadcasts_and_with_salts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BROADCAST_HASHES", 0)
    monkeypatch.setattr(filter_audit, "SALTED", 3)
    docs = [(i, "a", f"text {i % 7}") for i in range(50)]
    found = filter_audit.audit(filter_audit.combinations(spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect()
    assert sorted(tuple(x) for x in found) == _plain_audit(docs, [])
