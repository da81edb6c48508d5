"""WARC derivatives: linked metadata and plain-text conversion records of response records.

Every response yields one metadata record (``application/warc-fields``: status, source headers,
lengths, title, language, outlinks) and one conversion record (``text/plain``). Both refer to the
response by its record id, keep its target URI and date, and carry the digest of their own block
and of the payload they were made from. All of it is column expressions over one scan.
"""

from __future__ import annotations

import gzip
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import batch, map_batches, written

CRLF = "\r\n"
# Entities with a name, the ampersand last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]
BLOCK_TAGS = ("p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer|title|head|body"
              "|html|blockquote|pre|hr|td|th|main|aside")
HIDDEN = [r"(?s)<!--.*?-->", r"(?is)<script\b[^>]*>.*?</script\s*>",
          r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?is)<title\b[^>]*>.*?</title\s*>"]
BLOCK = rf"(?i)</?({BLOCK_TAGS})\b[^>]*>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
LANGUAGE = r"(?is)<html\b[^>]*\blang=\"([^\"]*)\""
LINK = r"(?i)<a\b[^>]*\bhref=\"([^\"]*)\""


def record_id(kind: str, *parts: Column) -> Column:
    """A name-based URN: the MD5 of the parts in the layout of version 3."""
    h = F.md5(F.concat_ws("\n", F.lit(kind), *parts))
    piece = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-3"),
                    piece(14, 3), F.lit("-8"), piece(18, 3), F.lit("-"), piece(21, 12), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Response records of fetched pages (page_id, url, html): record_id, target_uri, date,
    http_headers and payload. A null url or page is empty."""
    page, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
                             "Content-Length: "), F.octet_length(page).cast("string"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        record_id("response", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url,
                  F.md5(page)).alias("record_id"),
        url.alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"),
        page.alias("payload"))


def _entities(text: Column) -> Column:
    for name, letter in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(letter))
    return text


def _tidy(text: Column) -> Column:
    text = F.regexp_replace(text, "[ \\t\\r]+", " ")
    return F.btrim(F.regexp_replace(text, " ?\\n[ \\n]*", "\n"), F.lit(" \n"))


def plain_text(html: Column) -> Column:
    """Text of a page: comments, scripts, styles and the title go, block tags break lines, other
    tags vanish, entities with a name are resolved, blanks are collapsed."""
    for pattern in HIDDEN:
        html = F.regexp_replace(html, pattern, "")
    html = F.regexp_replace(F.regexp_replace(html, BLOCK, "\n"), "<[^>]*>", "")
    return _tidy(_entities(html))


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of response records, two per row.

    Columns: page_id, warc_type, record_id, refers_to, target_uri, date, content_type,
    content_length (bytes), block_digest, payload_digest, block. Repeated responses give repeated
    records with equal ids; an empty payload gives an empty text and no title, language or links;
    other columns are ignored; an empty table gives none.
    """
    html = F.col("payload")
    links = F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), _entities)
    status = F.regexp_extract("http_headers", r"^HTTP/[0-9.]+ ([0-9]+)", 1)
    given = F.split("http_headers", CRLF)
    source = F.array_join(F.transform(
        F.slice(given, F.lit(2), F.size(given)),
        lambda x: F.concat(F.lit("source-"), x)), CRLF)
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    text = plain_text(html)
    metadata = F.concat_ws(
        CRLF, field("fetched-status", status), source,
        field("payload-length", F.octet_length(html).cast("string")),
        field("title", _tidy(_entities(F.regexp_extract(html, TITLE, 1)))),
        field("language", F.regexp_extract(html, LANGUAGE, 1)),
        field("outlinks", F.size(links).cast("string")),
        F.transform(links, lambda x: field("outlink", x)), F.lit(""))
    shared = ["page_id", F.col("record_id").alias("refers_to"), "target_uri", "date",
              _digest(html).alias("payload_digest")]
    made = records.select(*shared, F.explode(F.array(
        F.struct(F.lit("metadata").alias("warc_type"),
                 F.lit("application/warc-fields").alias("content_type"),
                 metadata.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"),
                 F.lit("text/plain; charset=utf-8").alias("content_type"),
                 text.alias("block")))).alias("r"))
    return made.select(
        "page_id", "r.warc_type", "refers_to", "target_uri", "date", "r.content_type", "r.block",
        "payload_digest").select(
        "page_id", "warc_type", record_id("derived", F.col("warc_type"), F.col("refers_to"))
        .alias("record_id"), "refers_to", "target_uri", "date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"),
        _digest(F.col("block")).alias("block_digest"), "payload_digest", "block")


def headers(derived: DataFrame) -> DataFrame:
    """Adds ``header``: the WARC header of each derived record, up to the empty line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    return derived.withColumn("header", F.concat_ws(
        CRLF, F.lit("WARC/1.1"), line("WARC-Type", F.col("warc_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Refers-To-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To-Date", F.col("date")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Source-Payload-Digest", F.col("payload_digest")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string"))))


def write_files(derived: DataFrame, folder: str) -> DataFrame:
    """Write records to ``folder`` (reachable from all executors), one gzip member per record, one
    file per task and WARC layout; returns (file, records). A file appears under its name only
    when it is complete, so repeated attempts do no harm."""
    slim = headers(derived).select("header", "block")

    def run(batches):
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, base = (fs.FileSystem.from_uri(folder) if "://" in folder
                       else (fs.LocalFileSystem(), folder.removeprefix("file:")))
        store.create_dir(base, recursive=True)
        name, n = f"derived-{part:06d}.warc.gz", 0
        with store.open_output_stream(f"{base}/_{part:06d}-{attempt}", compression=None) as out:
            for b in batches:
                for header, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    out.write(gzip.compress(f"{header}{CRLF}{CRLF}{block}{CRLF}{CRLF}".encode(),
                                            mtime=0))
                    n += 1
        store.move(f"{base}/_{part:06d}-{attempt}", f"{base}/{name}")
        yield batch(["file", "records"], [pa.array([name]), pa.array([n], pa.int64())])

    return written(map_batches(slim, run, "file string, records long"), "warc-files")


# ------------------------------------------------------------------ SQL
DATE = "2024-01-01T00:00:00Z"


def _sql_entities(text: str) -> str:
    for name, letter in ENTITIES:
        quoted = letter.replace("'", "''")
        text = f"replace({text}, '{name}', '{quoted}')"
    return text


def _sql_tidy(text: str) -> str:
    text = f"regexp_replace({text}, '[ \\t\\r]+', ' ', 'g')"
    return f"trim(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


def _sql_id(kind: str, rest: str) -> str:
    h = f"md5('{kind}' || chr(10) || {rest})"
    return (f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-3' || "
            f"substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) "
            "|| '>'")


def _sql_text() -> str:
    out = "html"
    for pattern in HIDDEN:
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    out = f"regexp_replace({out}, '{BLOCK}', chr(10), 'g')"
    return _sql_tidy(_sql_entities(f"regexp_replace({out}, '<[^>]*>', '', 'g')"))


_CRLF = "(chr(13) || chr(10))"
_ID = _sql_id("response", "coalesce(page_id::varchar, '') || chr(10) || url || chr(10) "
                          "|| md5(html)")
_DERIVED = _sql_id("derived", "warc_type || chr(10) || refers_to")
_LINKS = f"regexp_extract_all(html, '{LINK}', 1)"
DERIVE_SQL = f"""
with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
r as (select *, {_ID} as refers_to, list_transform({_LINKS}, lambda x: {_sql_entities('x')}) as links
      from p),
m as (select page_id, 'metadata' as warc_type, refers_to, url, html,
  'application/warc-fields' as content_type,
  'fetched-status: 200' || {_CRLF} || 'source-Content-Type: text/html; charset=utf-8' || {_CRLF}
  || 'source-Content-Length: ' || strlen(html) || {_CRLF} || 'payload-length: ' || strlen(html)
  || {_CRLF} || 'title: ' || {_sql_tidy(_sql_entities(f"regexp_extract(html, '{TITLE}', 1)"))}
  || {_CRLF} || 'language: ' || regexp_extract(html, '{LANGUAGE}', 1) || {_CRLF}
  || 'outlinks: ' || len(links) || {_CRLF}
  || coalesce(list_aggregate(list_transform(links, lambda x: 'outlink: ' || x || {_CRLF}),
                             'string_agg', ''), '') as block from r
  union all
  select page_id, 'conversion', refers_to, url, html, 'text/plain; charset=utf-8', {_sql_text()}
  from r)
select page_id, warc_type, {_DERIVED} as record_id, refers_to, url as target_uri,
  '{DATE}' as date, content_type, strlen(block) as content_length,
  'sha256:' || sha256(block) as block_digest, 'sha256:' || sha256(html) as payload_digest
from m
"""
