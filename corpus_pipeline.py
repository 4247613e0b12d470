"""A corpus, cleaned and encoded: five stages, each written as Parquet and read again by the next.

Rows with a null id are judged by their text alone and never removed as copies;
rows that repeat an id stay or go together as copies.  Null and empty texts fail
the base rule of the first stage.  An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.bpe import bpe_encode
from weftline.llm.decision_list import keep_good
from weftline.llm.decontaminate import drop_contaminated
from weftline.llm.line_dedup import dedup_passages
from weftline.llm.ngram_join import keep_first_of_groups
from weftline.llm.queries import vocabulary
from weftline.llm.store import stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of five-word shingle similarity 0.8 or more."""
    return keep_first_of_groups(docs, width=5, num=80, den=100)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and the passages of 50 words that others hold before them."""
    return dedup_passages(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the token ids of the text and the digest of what they decode to."""
    return bpe_encode(docs.select("doc_id", "source", "lang", "text"), vocabulary("word_bpe_49k.json"), digest_col="decoded_sha256").drop("text")


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", line_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding and decoding", token_stage),
]

#: The rules are learned, so no SQL gives these rows; a brute-force version in the tests does.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), "pipeline")
    return docs
