"""Fixed-length token ids from a vocabulary fitted on training texts."""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entities import BLANKS, blank_separated
from ..session import map_batches

# Size limits, reserved ids and the stripped punctuation.
MAX_TOKENS, LENGTH = 2000, 32
PAD, UNKNOWN = 0, 1
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"
_BUCKETS = 256

_ASCII_BLANKS = "".join(b for b in BLANKS if b.isascii())
_SPACED = bytes.maketrans(_ASCII_BLANKS.encode(), b" " * len(_ASCII_BLANKS))
_DROPPED = PUNCTUATION.encode()
_WIDE_BLANKS = [b.encode() for b in BLANKS if not b.isascii()]
_LEADS = sorted({b[:2] for b in _WIDE_BLANKS})
#: Distinct tokens that a worker counts before it hands them on.
HELD_TOKENS = 200_000


def tokens(text: Column) -> Column:
    return blank_separated(F.lower(text), PUNCTUATION)


def byte_tokens(lowered: bytes) -> list[bytes]:
    """What ``tokens`` finds, from a lowered text in a worker."""
    if not lowered.isascii():
        for lead in _LEADS:  # most texts have none
            if lead in lowered:
                for blank in _WIDE_BLANKS:
                    if blank.startswith(lead):
                        lowered = lowered.replace(blank, b" ")
    return lowered.translate(_SPACED, _DROPPED).split()


def lowered_bytes(text: str = "text") -> Column:
    return F.lower(F.col(text)).cast("binary").alias("_lowered")


def token_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token, n): every token with its count, added up by the workers before they are exchanged."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([
                pa.array(list(held), pa.binary()).cast(pa.string()),
                pa.array(list(held.values()), pa.int64())], ["token", "n"])
            held.clear()
            return out

        for b in batches:
            for lowered in b.column(0):
                held.update(byte_tokens(lowered.as_py() or b""))
                if len(held) >= HELD_TOKENS:
                    yield handed_on()
        yield handed_on()

    parts = map_batches(texts.select(lowered_bytes(text)), work, "token string, n bigint")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


def fit_vocabulary(texts: DataFrame, text: str = "text",
                   max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(token, n) of the most frequent tokens; ties by descending token.

    Two ids are reserved for padding and unknown tokens. Partial counts absorb frequent tokens
    and the limit is a per-partition heap.
    """
    counts = texts.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(
        F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("token").desc()).limit(max_tokens - 2)


def vocabulary_list(vocabulary: DataFrame, max_tokens: int = MAX_TOKENS) -> list[str]:
    """Tokens by id; at most ``max_tokens`` - 2 rows reach the driver."""
    rows = vocabulary.orderBy(F.col("n").desc(), F.col("token").desc()).limit(max_tokens - 2)
    return [r["token"] for r in rows.collect()]


def token_ids(token_array: Column, vocabulary: list[str], length: int = LENGTH) -> Column:
    """Ids of the first ``length`` tokens, zero-padded.

    The vocabulary is an array of small maps addressed by checksum, so a lookup touches a few
    entries instead of scanning all of them.
    """
    buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for rank, token in enumerate(vocabulary):
        buckets[zlib.crc32(token.encode("utf-8")) % _BUCKETS][token] = rank + 2
    # One literal, which the optimizer turns into the table once.
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")

    def one(token: Column) -> Column:
        slot = (F.crc32(token) % _BUCKETS + 1).cast("int")
        return F.coalesce(F.try_element_at(F.element_at(table, slot), token), F.lit(UNKNOWN))
    ids = F.transform(F.slice(token_array, 1, length), one)
    return F.slice(F.concat(ids, F.array_repeat(F.lit(PAD), length)), 1, length)


def vectorise(messages: DataFrame, vocabulary: list[str], text: str = "text",
              output: str = "token_ids", length: int = LENGTH) -> DataFrame:
    return messages.withColumn(output, token_ids(tokens(F.col(text)), vocabulary, length))
