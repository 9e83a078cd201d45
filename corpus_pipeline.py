"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all but the last
return the columns of documents. Quality rules drop documents, line dedup cuts lines out of texts, the Jaccard join leaves one
document of each group, mixing orders all documents by source weights (the order of rows in the files), and encoding adds ids
and the position. Files are not read in order, so the last stage makes the order anew from the schedule, which depends on the rows only.

Special rows: documents with null or empty text fail the quality rules and go; a null lang or source is a group of its own; rows
with a null doc_id stay, as nothing names them, whatever they resemble; of repeated rows one stays; an empty table gives an
empty table in each stage; further columns of documents are carried on, and one named ids, n_ids, round_trip or position
is replaced by the last stage's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import line_dedup, mixing, ngram_join, quality_rules, sentencepiece_codec
from lodestone.llm.tables import written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line resembles; n_chars follows the text."""
    return line_dedup.dedup(docs, length="n_chars")


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8."""
    return ngram_join.keep_one(docs, 5, 80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair schedule of their sources."""
    return mixing.interleave(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their SentencePiece ids and position, in the order of positions."""
    return sentencepiece_codec.encode(mixing.interleave(docs, position="position"), sentencepiece_codec.model_path(), remembered=200_000)


STAGES = [
    ("quality rules", rules),
    ("line dedup", lines),
    ("n-gram Jaccard join", similar),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can express neither the schedule nor the ids; the stages are tested one by one against SQL or brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
