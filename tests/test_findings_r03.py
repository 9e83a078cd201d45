"""What the review of round 3 found: odd rows, numbering over tasks, checks of keys, words' bigrams, links of frequent seeds."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lodestone.llm import line_dedup, substring_dedup
from lodestone.llm import text as tx
from lodestone.operators import relational as rel
from lodestone.operators import run_manifests, store
from lodestone.plans import queries as plans


def _folder(path, **tables):
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), path / f"{name}.parquet")
    return str(path)


def test_manifests_of_odd_documents_equal_sql(tmp_path, same_as_sql):
    ids = pa.array([None, 0, 4, 7, 7, -13, -8, 9, 117, 63, 3, 5, None, 2**53 + 1], pa.int64())
    n = len(ids)
    texts = ["ab cd", None, "", "12", "12", "é жизнь", None, None, "x y", "", "null", None, "z", "w"]
    langs = [None, "en", "", " a b ", " a b ", "# x", "'q'", '"', "en", None, "en", "en", "fr", "de"]
    sources = ["s1", None, "", " s ", " s ", "s2", "s3", None, "s", "s", "s", None, "s4", "s5"]
    docs = {"doc_id": ids, "text": texts, "lang": langs, "source": sources, "n_chars": pa.array([1] * n, pa.int64())}
    same_as_sql(plans.QUERIES["manifest_tables"], plans.SQL["manifest_tables"], _folder(tmp_path, documents=docs))


def test_texts_of_one_name_are_read_apart(spark):
    df = spark.createDataFrame([("a", "x: 1\nmodel:"), ("a", "x: 2\n  name: n"), (None, "x: 3"), (None, "x: 3")], "name string, text string")
    got = sorted(((x.name, x.fields["x"], x.bad_line) for x in run_manifests.manifests(df).collect()), key=str)
    assert got == sorted([("a", "1", None), ("a", "2", 2), (None, "3", None), (None, "3", None)], key=str)


def test_scalars_of_odd_events_equal_sql(tmp_path, same_as_sql):
    ids = [None, -7, -6, -5, -4, -3, -2, -1, 0, 1, 2, 2, 3, 4, 5, 6, 12, 18, 2**53 + 1, 10**18 + 3, 24, 30]
    values = [1.0, None, 2.5, 1e300, 0.0, 1.0, 1.0, 1.0, float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, None, 5e-324, 0.1 + 0.2, 1.0, 1.0, float("inf"), -1e22]
    events = {"event_id": pa.array(ids, pa.int64()), "value": pa.array(values, pa.float64())}
    same_as_sql(plans.QUERIES["scalar_casts"], plans.SQL["scalar_casts"], _folder(tmp_path, events=events))


def test_numbers_over_ranges_equal_a_window(spark, monkeypatch):
    monkeypatch.setattr(rel, "TASK_ROWS", 40)
    r = random.Random(4)
    rows = [(r.choice([None, 1, 2, 3]), r.choice([None, *range(300)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, a int, i int").repartition(5)
    got = rel.numbered(df, ["g"], ["a", "i"], "n")
    assert got.columns == ["g", "a", "i", "n"]
    want = df.withColumn("n", rel.occurrence(["g"], ["a", "i"]).cast("long"))
    assert sorted(map(tuple, got.collect()), key=lambda x: x[2]) == sorted(map(tuple, want.collect()), key=lambda x: x[2])
    assert rel.numbered(df.limit(0), ["g"], ["a"], "n").collect() == []


def test_first_rows_are_sought_by_number_alone(spark):
    found = plans._native(plans.Tables(spark, "/root/testdata/sf0.001")).tables["pipelines"]
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()


def test_store_rules_dealt_out_to_tasks_equal_sql(spark, monkeypatch, same_as_sql):
    monkeypatch.setattr(rel, "TASK_ROWS", 500)
    monkeypatch.setattr(store, "TASK_ROWS", 500)
    same_as_sql(plans.QUERIES["store_violations"], plans.SQL["store_violations"])
    found = store.violations(plans._store(plans.Tables(spark, "/root/testdata/sf0.001")))
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_passages_of_frequent_seeds_whose_parts_have_other_first_documents(spark):
    r = random.Random(68)
    fill = lambda n: r.choices([f"u{i}" for i in range(5000)], k=n)
    docs, want = [], set()
    for _ in range(12):
        parts = [fill(20) for _ in range(3)]
        alone = [fill(8) + p + fill(8) for p in parts for _ in range(substring_dedup.RARE + 1)]
        whole = sum(parts, [])
        fuzzy = [f"x{i}" if i in (8, 32, 52) else w for i, w in enumerate(whole)]
        docs += [*alone, fill(25) + whole + fill(25), fill(30) + fuzzy + fill(10)]
        want.add((len(docs) - 1, 30, 90, len(docs) - 2, 25, 85))
    rows = substring_dedup.passages(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")).collect()
    assert {tuple(x)[:6] for x in rows} == want


def test_exact_runs_of_fewer_than_three_seeds(spark):
    r = random.Random(69)
    text = " ".join(r.choices([f"u{i}" for i in range(5000)], k=300_000)).encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, doc = tx.words(data, np.array([0, len(data)]))
    at = substring_dedup._seeds(tx.word_hashes(data, starts, ends, lower=True), doc, 1)[2]
    edge = np.r_[-1, at]
    wide = edge[:-3][edge[3:] - edge[:-3] > 47]  # the 47 k-mers in between hold two seeds at most
    words = text.decode().split()
    runs = [words[i + 1 : i + 51] for i in wide.tolist()]
    assert len(runs) > 3
    fill = lambda n: r.choices([f"v{i}" for i in range(5000)], k=n)
    docs = [x for run in runs for x in (fill(9) + run + fill(7), fill(20) + run + fill(5))]
    rows = substring_dedup.passages(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")).collect()
    assert {tuple(x)[:6] for x in rows} == {(2 * i + 1, 20, 70, 2 * i, 9, 59) for i in range(len(runs))}


def test_lines_hash_each_word_once(spark):
    sets = line_dedup._sets(spark.createDataFrame([(1, "a b\nc")], "d long, text string"), ["d"])
    assert sets._jdf.queryExecution().analyzed().toString().count("xxhash64(lambda") == 1


def test_written_tables_leave_no_shuffle_files(spark):
    """op6: the check's disk was shuffle files of jobs that had ended."""
    from lodestone.llm.tables import CLEANUP, written

    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {x.rpartition("/")[2] for x in files.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}

    before, was = shuffled(), spark.conf.get(CLEANUP)
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert shuffled() <= before and spark.conf.get(CLEANUP) == was and table.count() == 7


def test_substring_dedup_aligns_many_chains_as_one_by_one():
    """op6: chains of one stretch are aligned at once, with the passages that align() gives, also in a part of a batch."""
    rng, rows, want = np.random.default_rng(3), [], []
    for i in range(300):
        x = rng.integers(0, 1 << 30, 40 + int(rng.integers(0, 120))).astype(np.uint32)
        y = x.copy()
        y[rng.random(len(x)) < rng.choice([0, 0.05, 0.3])] = 1
        y[10:20] = x[10:20]
        if i % 4 == 0:
            y = np.r_[y[:20], np.uint32(5), y[20:]]
            y[21:29] = x[20:28]
        b, a = np.array([10, 14, 16]), np.array([10, 14, 16])
        if i % 4 == 0:
            b, a = np.r_[b, 20, 24], np.r_[a, 21, 25]
        found = substring_dedup._stretches(b, a)
        rows.append((i, i, [v + 7 for s in found for v in s[:2]], [v + 3 for s in found for v in s[2:]], 7, 3, x.tobytes(), y.tobytes()))
        want.append([(i, s + 7, e + 7, i, t + 3, f + 3, m) for s, e, t, f, m in substring_dedup.align(x, y, b, a)])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = ["b_id", "a_id", "b", "a", "lo_b", "lo_a", "words_b", "words_a"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    for part in (slice(0, 300), slice(100, 250)):
        got = substring_dedup._passages(batch.slice(part.start, part.stop - part.start))
        assert sorted(tuple(r.values()) for r in got.to_pylist()) == sorted(x for w in want[part] for x in w)
    assert any(want) and not all(want)
