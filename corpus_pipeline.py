"""A corpus pipeline of five operators, each over all that the one before it kept.

Quality rules reject documents; of each group of near copies the one with the smallest doc_id stays; strings of 400 bytes that
stand at several places are cut out of what is left; documents that hold a passage of the benchmark go; and the
rest is encoded. Each stage takes and returns whole tables; all but the last return the columns of documents.

A row is told apart by all its columns, so ids may be null or repeat. Extra columns come back unchanged, whatever they are
called. A null text counts as an empty one and is rejected by the first stage for having no words; so is an empty text. Rows
that are equal throughout are copies, of which one stays. Very long texts are processed whole. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solargrid.llm import decontaminate, ngram_jaccard, piece_codec, quality_rules, suffix_dedup
from solargrid.llm.storage import stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, no, ids, text: the pieces of every text in order of no, and what they decode to."""
    return piece_codec.decode(piece_codec.encode(docs)).select("doc_id", "no", F.size("ids").alias("n_pieces"), "ids", "text")


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding and decoding", encode),
]

#: Suffix arrays and segmentations are beyond SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
