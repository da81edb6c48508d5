"""Corpus pipeline: four stages over the documents table, each written and read again.

quality classifier -> shingle Jaccard join -> benchmark decontamination -> token encoding. The
first three return rows of their input with all columns; the last returns the round trip of the
texts that are left: doc_id, n_tokens and the digests of ids and decoded text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidekeep.llm import bpe, decontaminate, jaccard, quality
from tidekeep.llm.frames import table, written
from tidekeep.llm.queries import BYTE_BPE

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows the classifier keeps. It is fitted to weak labels of these documents themselves."""
    return quality.keep_good(docs, quality.fit(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id, in one copy; rows
    without a doc_id stay, since nothing names them."""
    groups = jaccard.jaccard_join(docs)
    first = groups.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates()
    return kept.unionByName(docs.filter(F.col("doc_id").isNull())).select(docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, BYTE_BPE)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_documents),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", uncontaminated),
    ("bpe_encoding_and_decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


# The fitted scorer, the aligned passages and the token ids have no SQL; tests/llm compares the
# stages with brute-force versions instead.
ORACLE_SQL = None
