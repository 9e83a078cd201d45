from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from test_operators import brute_components

from lodestone.llm import line_dedup, mixing, sentencepiece_codec
from lodestone.llm.tables import read, written

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test")
        kept.append(docs)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
    source, rules, lines, similar, mixed, ids = (k.collect() for k in kept)
    assert 0 < len(rules) < len(source) and len(lines) == len(rules)
    cut = {r.doc_id: set(r.lines) for r in line_dedup.removed(kept[1], line_dedup.Keys(kept[1])).selectExpr("d as doc_id", "lines").collect()}
    assert {r.doc_id: r.text for r in lines} == {r.doc_id: "\n".join(s for i, s in enumerate(r.text.split("\n")) if i not in cut.get(r.doc_id, ())) for r in rules}
    assert all(r.n_chars == len(r.text) for r in lines if r.doc_id in cut)
    ordered = sorted(lines, key=lambda r: r.doc_id)
    _, label = brute_components([r.text for r in ordered], 5, 80)
    assert sorted(r.doc_id for r in similar) == [r.doc_id for i, r in enumerate(ordered) if label[i] == i]
    assert Counter(mixed) == Counter(similar) and mixed != similar
    vocabulary = sentencepiece_codec.Vocabulary(sentencepiece_codec.model_path())
    assert [r.doc_id for r in ids] == [r.doc_id for r in mixed] and all(vocabulary.decode(r.ids) == r.text for r in ids)


def test_last_stage_keeps_the_mixed_order_over_unequal_files(spark):
    r = random.Random(10)
    rows = [(i, " ".join(str(r.random()) for _ in range(r.choice((1, 2, 400)))), "en", r.choice("aaaaab"), 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        mixed = written(corpus_pipeline.mixed(spark, docs, SF), "test")
        got = corpus_pipeline.encode(spark, mixed, SF).select("doc_id", "source", "position").collect()
        want = mixing.slots(docs)[0].select("doc_id", "position").orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [(x.doc_id, x.position) for x in got] == [tuple(x) for x in want]


def test_stages_with_special_rows(spark):
    r = random.Random(11)
    text = lambda n: " ".join(f"w{r.randrange(9000)}" for _ in range(n))
    same = text(40)
    rows = [(1, same, "en", "a", 1, "x"), (1, same, "en", "a", 1, "x"), (2, None, None, None, None, None), (None, text(30), None, None, 3, ""), (3, "", "en", "a", 0, ""), (4, text(9000), "de", None, 5, ""), (5, same + " more", "en", "b", None, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, position string"
    every = spark.createDataFrame(rows, schema)
    for docs in (every, every.limit(0)):
        got = docs
        for _, stage in corpus_pipeline.STAGES:
            got = written(stage(spark, got, SF), "test")
        kept = got.collect()
        assert Counter(x.doc_id for x in kept) == (Counter([1, None, 4, 5]) if docs is every else Counter())
        assert "ids" in got.columns and dict(got.dtypes)["position"] == "bigint"


def test_run_applies_all_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert "ids" in got.columns and got.count() > 0
