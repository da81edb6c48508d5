"""Fill-in-the-middle rewriting by content-defined chunks.

A rolling hash over 32 bytes cuts every text into chunks whose borders follow from the bytes
around them, so copies and near copies share most of their chunks. A chunk is counted once per
task: its summary (line ends, code points, first and last bytes, whether a mark occurs in it) is
kept under a fingerprint and used again only after the stored bytes have been compared with the
chunk. Summaries of neighbours combine; the running sums of line ends over the chunks of a text say
in which chunk a cut lies, and only there the place is looked up.

Bytes held: the Arrow batch, the hash of one piece of it, the memo (``MEMO_BYTES``) and the
summaries of one text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import PIECE_BYTES, batch, bounded, map_batches, text_bytes

#: The marks of prefix, suffix and middle. Texts that hold one of them stay as they are.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
_REACH = max(map(len, _MARKS)) - 1

WINDOW = 32
#: A border is where the low bits of the rolling hash are zero, one place in 2,048 on average.
_LOW_BITS = np.uint32((1 << 11) - 1)
MIN_CHUNK, MAX_CHUNK = 64, 1 << 15
MEMO_BYTES = 32 << 20
_LINE_END = 10


def _gear() -> np.ndarray:
    """A fixed 32-bit word per byte value."""
    words = [hashlib.sha256(bytes([b])).digest()[:4] for b in range(256)]
    return np.frombuffer(b"".join(words), "<u4").astype(np.uint32)


_GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """At each place the sum of the words of the last 32 bytes, each shifted by its distance; a
    byte further back has left the 32 bits. Built by doubling the width five times."""
    out = _GEAR[data]
    width = 1
    while width < WINDOW:
        out[width:] += out[:-width] << np.uint32(width)
        width *= 2
    return out


def borders(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text, in order, the last one the end of the text.

    A place counts if its window lies in the text and no other place counts within ``MIN_CHUNK``
    bytes before it, which the bytes before it decide. Where none comes for ``MAX_CHUNK`` bytes a
    border is set. A long text is hashed in pieces that overlap by the bytes that decide.
    """
    lead = WINDOW + MIN_CHUNK
    found = []
    for at in range(0, len(data), PIECE_BYTES):
        first = max(0, at - lead)
        piece = rolling(data[first:at + PIECE_BYTES])
        hits = np.flatnonzero((piece & _LOW_BITS) == 0) + first + 1
        hits = hits[hits >= first + WINDOW]
        alone = np.diff(hits, prepend=-MIN_CHUNK) >= MIN_CHUNK
        found.append(hits[alone & (hits > at)])
    ends = np.concatenate([*found, [len(data)]]).astype(np.int64)
    ends = ends[np.diff(ends, prepend=0) > 0]
    sizes = np.diff(ends, prepend=0)
    if len(sizes) and sizes.max() > MAX_CHUNK:
        ends = np.concatenate([np.append(np.arange(end - size + MAX_CHUNK, end, MAX_CHUNK), end)
                               for end, size in zip(ends.tolist(), sizes.tolist())])
    return ends


@dataclass(slots=True)
class Summary:
    """What the cuts need to know of a run of bytes."""

    line_ends: np.ndarray
    points: int
    head: bytes
    tail: bytes
    marked: bool


def code_points(data: np.ndarray) -> int:
    """Bytes that open a character; adds up over any division of the bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def summarise(content: bytes) -> Summary:
    data = np.frombuffer(content, np.uint8)
    return Summary(np.flatnonzero(data == _LINE_END) + 1, code_points(data), content[:_REACH],
                   content[-_REACH:], any(m in content for m in _MARKS))


class Memo:
    """Summaries of chunks seen before, emptied when the kept chunks reach ``most`` bytes.

    ``fingerprint`` may collide: a kept summary counts only for the same bytes.
    """

    def __init__(self, most: int = MEMO_BYTES, fingerprint=xxhash.xxh3_64_intdigest):
        self.most, self.fingerprint = most, fingerprint
        self.known: dict[int, tuple[bytes, Summary]] = {}
        self.held = self.hits = self.misses = 0

    def __call__(self, content: bytes) -> Summary:
        mark = self.fingerprint(content)
        kept = self.known.get(mark)
        if kept is not None and kept[0] == content:
            self.hits += 1
            return kept[1]
        self.misses += 1
        out = summarise(content)
        if kept is None:
            # The places of line ends take 8 bytes each, and an entry some 400 besides.
            self.held += len(content) + 8 * len(out.line_ends) + 400
            if self.held > self.most:
                self.known.clear()
                self.held = len(content) + 8 * len(out.line_ends) + 400
            self.known[mark] = (content, out)
        return out


class Lines:
    """One text as chunk summaries with running sums; a unit is a line with its end, or what
    follows the last end."""

    def __init__(self, data: np.ndarray, memo: Memo):
        self.data, self.ends = data, borders(data)
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        parts, self.marked, tail = [], False, b""
        for a, z in zip(self.starts.tolist(), self.ends.tolist()):
            one = memo(data[a:z].tobytes())
            joint = tail + one.head
            self.marked = self.marked or one.marked or any(m in joint for m in _MARKS)
            tail = (tail + one.tail)[-_REACH:]
            parts.append(one)
        self.parts = parts
        self.upto = np.cumsum([len(p.line_ends) for p in parts], dtype=np.int64)
        self.points = np.cumsum([p.points for p in parts], dtype=np.int64)
        closed = int(self.upto[-1]) if parts else 0
        self.n = closed + (tail[-1:] not in (b"", b"\n"))

    def after(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``units`` units."""
        if units == 0:
            return 0, 0
        if units > (int(self.upto[-1]) if self.parts else 0):
            return len(self.data), int(self.points[-1])
        k = int(np.searchsorted(self.upto, units))
        before = int(self.upto[k - 1]) if k else 0
        place = int(self.parts[k].line_ends[units - before - 1])
        start = int(self.starts[k])
        points = (int(self.points[k - 1]) if k else 0) + code_points(
            self.data[start:start + place])
        return start + place, points


def draws(seed: int, key) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a row: the head of the SHA-256 of ``seed:key``."""
    text = f"{seed}:{'' if key is None else key}"
    return struct.unpack(">IIII", hashlib.sha256(text.encode()).digest()[:16])


def _rewritten(data: np.ndarray, key, memo: Memo, seed: int, percent: int, spm_percent: int):
    lines = Lines(data, memo)
    h1, h2, h3, h4 = draws(seed, key)
    whole = data.tobytes()
    if not len(data) or lines.marked or h3 % 100 >= percent:
        return lines.n, "plain", None, None, whole
    first, second = sorted((h1 % (lines.n + 1), h2 % (lines.n + 1)))
    (a, prefix), (z, upto) = lines.after(first), lines.after(second)
    p, s, m = _MARKS
    if h4 % 100 < spm_percent:
        return lines.n, "spm", prefix, upto - prefix, b"".join(
            (s, whole[z:], p, whole[:a], m, whole[a:z]))
    return lines.n, "psm", prefix, upto - prefix, b"".join(
        (p, whole[:a], s, whole[z:], m, whole[a:z]))


OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7,
              percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output), one row per row of ``df``.

    ``n`` counts the lines of the whole text. Two cuts after whole lines are drawn from ``seed`` and
    the key; ``percent`` of the rows are rewritten, of these ``spm_percent`` with the suffix first.
    A text that is empty or holds a mark stays plain, with null counts. A null text counts as
    empty and a null key as an empty one, repeated rows give repeated results, an empty table gives
    none; other columns are not read, whatever their names.
    """
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = slim.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        names = ["key", "n", "form", "prefix_chars", "middle_chars", "output"]
        for b in bounded(batches, 1):
            data, offsets = text_bytes(b.column(1))
            rows = [_rewritten(data[a:z], k, memo, seed, percent, spm_percent)
                    for k, a, z in zip(b.column(0).to_pylist(), offsets[:-1].tolist(),
                                       offsets[1:].tolist())]
            n, form, prefix, middle, out = zip(*rows) if rows else ((),) * 5
            yield batch(names, [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                                pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                                pa.array(out, pa.binary()).cast(pa.string())])

    return map_batches(slim, run, f"key {kind}, {OUT}").withColumnRenamed("key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` read, from its output and form alone."""
    # A rewritten text holds each mark once, so every piece between marks is found by literals.
    head = F.substring_index(output, MIDDLE, 1)
    middle = F.substr(output, F.length(head) + F.lit(len(MIDDLE) + 1))
    psm_prefix = F.substring_index(F.substr(head, F.lit(len(PREFIX) + 1)), SUFFIX, 1)
    psm_suffix = F.substring_index(head, SUFFIX, -1)
    spm_suffix = F.substring_index(F.substr(head, F.lit(len(SUFFIX) + 1)), PREFIX, 1)
    spm_prefix = F.substring_index(head, PREFIX, -1)
    return F.when(form == "psm", F.concat(psm_prefix, middle, psm_suffix)).when(
        form == "spm", F.concat(spm_prefix, middle, spm_suffix)).otherwise(output)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rewritten rows with the digests of output and rebuilt text in place of the texts."""
    out = transform(df, key, text, **options)
    return out.select(
        key, "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
