import gzip
import hashlib
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidekeep.llm import licenses, warc


def test_equivalent_texts_have_one_digest(spark):
    mit = licenses.KNOWN[0][1]
    variants = [mit, mit.upper(), mit.replace("\n\n", "\n"), mit.replace(",", " ,"),
                mit.replace("Copyright (c) the authors", "(C) 2019 Someone\nCopyright 2020 Other"),
                "MIT Licence" + mit[11:], mit + "\n\nAll rights reserved."]
    other = [mit[:-40], mit + " and more", "", None]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(variants + other)],
                               "doc_id long, text string, license_id string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(df, licenses.known_digests(spark))
           .collect()}
    assert [got[k] for k in range(len(variants))] == ["MIT"] * len(variants)
    assert [got[k] for k in range(len(variants), len(got))] == [None] * len(other)


def test_notices_and_defined_cases(spark):
    df = spark.createDataFrame([
        (1, "words\n  Licensed under CC-BY-NC 4.0!\nReleased under the MIT licence.\nwords"),
        (1, "words\n  Licensed under CC-BY-NC 4.0!\nReleased under the MIT licence.\nwords"),
        (None, "Licensed under the Apache License, Version 2.0."), (3, None), (4, "x" * 100_000)],
        "doc_id long, text string")
    known = licenses.known_digests(spark)
    got = sorted(((r["doc_id"], r["license_id"], r["notices"]) for r in
                  licenses.scan(df, known).collect()), key=str)
    assert got == sorted([(1, None, "CC-BY-NC-4.0,MIT")] * 2 + [
        (None, "Apache-2.0", "Apache-2.0"), (3, None, ""), (4, None, "")], key=str)
    assert licenses.scan(df.limit(0), known).count() == 0


PAGES = [
    (1, "http://a.example/x", '<html lang="en"><title> A &amp; B </title><p>One<br>two  three<!-- no -->'
     '<script>if (a</p>) {}</script><a href="/l?a=1&amp;b=2">link</a> <b>bold</b></html>'),
    (2, None, None), (3, "http://b.example/", ""), (None, "u", "plain &lt;text&gt;\n\n\n  é"),
    (1, "http://a.example/x", "<p>again"),
]


@pytest.fixture
def derived(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return warc.derive(warc.responses(pages, warc.DATE))


def test_records_are_linked_and_digested(spark, derived):
    rows = derived.collect()
    assert len(rows) == 2 * len(PAGES)
    text = {(r["page_id"], r["target_uri"]): r["block"] for r in rows
            if r["warc_type"] == "conversion" and "again" not in r["block"]}
    assert text[1, "http://a.example/x"] == "One\ntwo threelink bold"
    assert text[None, "u"] == "plain <text>\né" and text[3, "http://b.example/"] == ""
    meta = next(r["block"] for r in rows if r["warc_type"] == "metadata" and "bold" in str(
        text) and "A & B" in r["block"])
    assert "title: A & B\r\nlanguage: en\r\noutlinks: 1\r\noutlink: /l?a=1&b=2\r\n" in meta
    assert "source-Content-Type: text/html; charset=utf-8" in meta
    for r in rows:
        raw = r["block"].encode()
        assert r["content_length"] == len(raw)
        assert r["block_digest"] == "sha256:" + hashlib.sha256(raw).hexdigest()
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-3[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}>",
                            r["record_id"])
    assert len({r["refers_to"] for r in rows}) == len(PAGES)


def test_files_read_back(derived, tmp_path):
    manifest = warc.write_files(derived, str(tmp_path / "out")).collect()
    assert sum(r["records"] for r in manifest) == derived.count()
    found = []
    for r in manifest:
        data = gzip.decompress(Path(tmp_path / "out" / r["file"]).read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            found.append((re.search(rb"WARC-Refers-To: (\S+)", head)[1].decode(), rest[:n].decode()))
            assert rest[n:n + 4] == b"\r\n\r\n"
            data = rest[n + 4:]
    assert sorted(found) == sorted((r["refers_to"], r["block"]) for r in derived.collect())


def test_sql_agrees(spark, derived):
    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PAGES)
    rows = con.execute(warc.DERIVE_SQL).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(rows, key=str) == sorted(map(tuple, derived.select(*names).collect()), key=str)
    assert derived.limit(0).count() == 0


def test_every_source_header_is_kept(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "<p>x</p>")],
                                  "page_id long, url string, html string")
    lines = [f"X-{k}: {k}" for k in range(1500)]
    records = warc.responses(pages, warc.DATE).withColumn(
        "http_headers", F.lit("\r\n".join(["HTTP/1.1 200 OK", *lines])))
    meta = warc.derive(records).filter("warc_type = 'metadata'").first()["block"]
    assert [x for x in meta.split("\r\n") if x.startswith("source-")] == [
        "source-" + x for x in lines]
