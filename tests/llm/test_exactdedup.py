import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tidekeep.llm import exactdedup
from tidekeep.llm.exactdedup import dedup
from tidekeep.session import shared_dir

SCHEMA = ("doc_id long, text string, digest string, place string, n string, first string, "
          "salts string, key string, normal string")


def normal(text):
    return (text or "").translate({c: None for c in (9, 10, 11, 12, 13, 32)})


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append((-len(t or ""), i is None, i, t))
    out = []
    for body, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        for m in members:
            out.append((m[2], keep[2], len(members), hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr), len(groups)


def write(spark, rows, path, mode="overwrite", parts=3):
    spark.createDataFrame([(i, t, *"abcdefg") for i, t in rows], SCHEMA).repartition(
        parts).write.mode(mode).parquet(path)


def check(out, rows, digests=True):
    got = out.select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("digest"),
                     "kept").collect()
    want, groups = brute(rows)
    if digests:
        assert sorted((tuple(r)[:4] for r in got), key=repr) == want
    else:
        assert sorted((tuple(r)[:3] for r in got), key=repr) == [w[:3] for w in want]
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


ROWS = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \x0b\x0c\r"), (7, "x"),
        (8, "a b"), (9, "A B"), (None, "x"), (None, "only null"), (2, "ab"), (2, "other"),
        (10, "é é"), (11, "éé "), (12, "long " * 200_000), (13, "long" * 200_000),
        (0, " a b "), (20, "w" * 9), (21, "w" * 9)]


def test_defined_cases(spark):
    path = shared_dir(spark, "dedup-test")
    write(spark, ROWS, path)
    check(dedup(spark, path), ROWS)


def test_empty_table_and_single_file(spark, tmp_path):
    path = shared_dir(spark, "dedup-test")
    write(spark, [], path, parts=1)
    assert dedup(spark, path).count() == 0
    rows = [(i, f"t {i % 7}" + " " * (i % 3)) for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string").toPandas().to_parquet(
        tmp_path / "one.parquet")
    check(dedup(spark, str(tmp_path / "one.parquet")), rows)


def test_a_group_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "HOT_SHARE", 1 / 20)
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    path = shared_dir(spark, "dedup-test")
    write(spark, rows, path, parts=8)
    check(dedup(spark, path), rows)


@pytest.mark.parametrize("bits", [6, 27])
def test_equal_digests_of_different_texts(spark, monkeypatch, bits):
    """With a digest of four bits nearly every hit is false; only the bytes tell texts apart."""
    monkeypatch.setattr(exactdedup, "HOT_SHARE", 1 / 40)
    monkeypatch.setattr(exactdedup, "FILTER_BITS", bits)
    rows = ROWS + [(100 + i, f"text {i % 90}" + " " * (i % 4)) for i in range(600)]
    path = shared_dir(spark, "dedup-test")
    write(spark, rows, path)
    check(dedup(spark, path, digest=lambda t: F.unhex(F.concat(F.lit("0"), F.substring(
        F.sha2(t, 256), 1, 1)))), rows, digests=False)


def test_state_goes_on_over_batches_and_restarts(spark):
    path, checkpoint = shared_dir(spark, "dedup-test"), shared_dir(spark, "dedup-check")
    first = [(100 + i, f"t {i % 40}") for i in range(200)]
    write(spark, first, path, parts=6)
    query = exactdedup.follow(spark, path, checkpoint, batch_bytes=1)
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 5
    check(exactdedup.resolve(spark, path, checkpoint), first)
    # Later files bring longer copies, smaller ids and new texts.
    later = [(i, f"t {i}  " if i % 2 else f"t {i}") for i in range(60)]
    write(spark, later, path, mode="append")
    query = exactdedup.follow(spark, path, checkpoint)
    query.awaitTermination()
    assert sum(p["numInputRows"] for p in query.recentProgress) == 60
    check(exactdedup.resolve(spark, path, checkpoint), first + later)


def test_texts_of_single_rows_are_not_exchanged(spark):
    path = shared_dir(spark, "dedup-test")
    rows = [(i, f"text {i}") for i in range(500)] + [(1000 + i, "copy") for i in range(5)]
    write(spark, rows, path)
    frame = exactdedup.keyed(spark.read.parquet(path), "doc_id", "text", exactdedup.sha256)
    groups = exactdedup.spread(frame.groupBy("digest").agg(
        F.min("place").alias("first"), F.count("*").alias("n")), len(rows))
    rows = exactdedup.marked(frame, groups)
    assert rows.count() == 505 and 5 <= rows.filter("normal is not null").count() <= 8
    plan = exactdedup.decided(frame, groups)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the data folder")
def test_query_over_the_documents(spark):
    from tidekeep.llm.queries import QUERIES
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", "text").collect()]
    got = QUERIES["op12_streaming_exact_dedup"](spark, folder).collect()
    want, _ = brute(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got),
                  key=repr) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
