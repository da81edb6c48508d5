import os

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_jaccard import brute as groups
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tidekeep.llm import quality

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the data folder")


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination",
                     "bpe_encoding_and_decoding"]
    good, single, clean, encoded = (f for _, f in cp.STAGES)

    kept = good(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    scores = {r["doc_id"]: r["keep"] for r in quality.classify(docs, quality.fit(docs)).collect()}
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(rows) == {i for i, k in scores.items() if k}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1")
    assert {r["doc_id"] for r in labels.collect()} <= set(rows)

    first = single(spark, kept, FOLDER)
    assert first.columns == docs.columns
    want = {i for i, _, low in groups(list(rows.items())) if i == low}
    assert {r["doc_id"] for r in first.collect()} == want

    passed = clean(spark, first, FOLDER)
    assert passed.columns == docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    exact = {i for i in want if any(t in rows[i] for t in items)}
    left = {r["doc_id"] for r in passed.collect()}
    assert left <= want - exact and len(want) - len(left) <= len(exact) + 2

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["n_tokens"] for r in encoded(spark, passed, FOLDER).collect()}
    assert got == {i: len(coder.encode(rows[i], add_special_tokens=False).ids) for i in left}


def test_empty_documents(spark):
    none = spark.read.parquet(f"{FOLDER}/documents.parquet").filter(F.lit(False))
    for _, stage in cp.STAGES[:3]:
        none = stage(spark, none, FOLDER)
        assert none.count() == 0
