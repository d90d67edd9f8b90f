"""The corpus pipeline: five operators in turn over the table of documents.

Each stage takes what its predecessor kept and returns the columns of documents; the last
one returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import bpe, decontaminate, minhash, substring, toxicity
from orbweave.llm.common import staged, table, without_ids
from orbweave.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a noisy-or model of all labelled documents scores under 0.5."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates: five-word
    shingles, a similarity of 0.8 or more."""
    groups = minhash.near_duplicates(docs, shingle=5, percent=80)
    return without_ids(docs, "doc_id", groups.filter("NOT kept").select("doc_id"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that stand earlier too."""
    return substring.without_duplicates(docs, min_words=50).withColumn("n_chars", F.length("text").cast("bigint"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without_ids(docs, "doc_id", found.select("doc_id").distinct())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and the text that they decode to."""
    path = tokenizer_path("word_bpe_49k.json")
    coded = bpe.encode_column(docs.select("doc_id", "lang", "source", "text"), decoded_col="decoded", path=path)
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", "decoded")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_duplicates", cut_repeats),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: SQL can express neither the trained model nor the tokenizer; tests/llm/test_pipeline.py holds each stage against
#: brute force, at its own parameters (the toxicity stage against the labels).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
