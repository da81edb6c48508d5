"""One query per corpus operator over the whole tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, chat, covertree, decontaminate, exactdedup, fim, jaccard, licenses, lmscore,
               planes, quality, warc, whitening)
from .frames import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@query("op1_bpe_round_trip")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


@query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


@query("op5_bit_plane_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.plane_round_trip(table(spark, sf_dir, "documents"), WORD_BPE)


@query("op10_cross_entropy_difference")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


#: A conversation whose texts hold control strings of the template.
TRAP = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op2_chat_formatting")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(
        spark.createDataFrame(TRAP, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_conversations(rows, BYTE_BPE), BYTE_BPE)


OP8_SQL = """
with v as (
  select vec_id, embedding from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), w as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::double) as ints from v
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.ints, c.ints)::bigint as score
  from w q join w c on q.vec_id <> c.vec_id and len(q.ints) = len(c.ints)
  where q.vec_id % 20 = 0
)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
) where rank <= 20
"""


@query("op8_exact_top_k", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = covertree.whole_vectors(table(spark, sf_dir, "embeddings"))
    return covertree.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20)


@query("op6_benchmark_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"),
                                    table(spark, sf_dir, "benchmark"))


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.classify(documents, quality.fit(documents))


@query("op3_license_scan", licenses.SCAN_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_digests(spark))


@query("op4_warc_derivatives", warc.DERIVE_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.responses(table(spark, sf_dir, "pages"), warc.DATE)
    return warc.derive(pages).drop("block")


@query("op11_fill_in_middle")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"), seed=7, percent=100, spm_percent=50)


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16, scale=64)


OP12_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as normal from documents
), k as (
  select doc_id, normal, count(*) over (partition by normal) as group_size,
         first_value(doc_id) over (partition by normal order by length(text) desc,
                                   doc_id nulls last) as keep_id from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(normal) as text_sha256 from k
"""


@query("op12_streaming_exact_dedup", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdedup.dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept",
                        F.lower(F.hex("digest")).alias("text_sha256"))
