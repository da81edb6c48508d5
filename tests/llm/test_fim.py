import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidekeep.llm import fim

SCHEMA = "doc_id long, text string, n long, output string, key string, form string"


def brute(doc_id, text, percent=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    hexes = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexes[8 * k:8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if h4 % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 9, "o", "k", "f") for i, t in rows], SCHEMA).repartition(3)
    out = fim.transform(df, **options)
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output",
                     fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    key = repr
    want = sorted(((i, *brute(i, t, **options), t or "") for i, t in rows), key=key)
    assert sorted(map(tuple, got), key=key) == want


def texts(rng):
    words = ["a", "the", "\n", "\n\n", "é", "日本", "\r\n", "<P", "S>", "<", ">", "x" * 50, "😀"]
    return ["".join(rng.choice(words, size=n)) for n in rng.integers(0, 400, 120)]


def test_against_the_definition(spark):
    rng = np.random.default_rng(3)
    body = texts(rng)
    copies = [t + body[0] for t in body[:20]]
    check(spark, list(enumerate(body + body[:9] + copies)))


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "no end"), (6, "one\n"), (7, "<P>"),
            (8, "a <S> b\nc"), (9, "<M"), (None, "x\ny\nz\n"), (5, "no end"), (5, "other\ntext"),
            (10, "a\x00b\n\x0bc d\n"), (-7, "é\n" * 40)]
    check(spark, rows)
    check(spark, [])
    check(spark, [(i, "a\nb\nc") for i in range(60)], percent=40)


def test_very_long_texts(spark, monkeypatch):
    check(spark, [(0, "line of text é\n" * 700_000), (1, "q" * 9_000_000), (2, "\n" * 300_000)])


def test_marks_across_chunk_borders(monkeypatch):
    monkeypatch.setattr(fim, "MAX_CHUNK", 1)
    for text in ("ab<P>c", "<S>", "xx<M>", "<P <S M>", "<<P>"):
        data = np.frombuffer(text.encode(), np.uint8)
        assert fim.Lines(data, fim.Memo()).marked == any(
            m in text for m in ("<P>", "<S>", "<M>"))


def test_borders_follow_content_and_pieces_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    body = rng.integers(97, 123, 60_000, dtype=np.uint8)
    moved = np.concatenate((rng.integers(97, 123, 777, dtype=np.uint8), body))
    own, other = fim.borders(body), fim.borders(moved) - 777
    assert len(set(own) & set(other)) > 0.9 * len(own) > 10
    monkeypatch.setattr(fim, "PIECE_BYTES", 1000)
    assert np.array_equal(fim.borders(body), own)
    assert np.diff(fim.borders(np.full(200_000, 97, np.uint8))).max() <= fim.MAX_CHUNK


def test_memo_is_used_and_compares_contents():
    chunk = b"some words\n" * 300
    memo = fim.Memo()
    assert memo(chunk) is memo(chunk) and (memo.hits, memo.misses) == (1, 1)
    clash = fim.Memo(fingerprint=lambda content: 0)
    assert clash(b"a\nb").points == 3 and clash(b"longer\n").points == 7
    assert len(clash(b"x\n\n").line_ends) == 2 and clash.hits == 0
    small = fim.Memo(most=2000)
    for k in range(50):
        small(b"%d" % k * 100)
        assert small.held <= 2000


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the data folder")
def test_query_over_the_documents(spark):
    from tidekeep.llm.queries import QUERIES
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in
           QUERIES["op11_fill_in_middle"](spark, "/root/testdata/sf0.001").collect()}

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()
    for r in docs.collect():
        *head, output = brute(r["doc_id"], r["text"])
        assert got[r["doc_id"]] == (*head, digest(output), digest(r["text"]))
    assert len(got) == docs.count()
