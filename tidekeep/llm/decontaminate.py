"""Benchmark passages in documents, found by the q-gram lemma and verified by banded alignment.

Texts are normalised first: lower case, and every run of characters that are neither ASCII letters
or digits nor beyond ASCII becomes one blank. Characters below are the UTF-8 bytes of that.

An item of m characters within k edits of a region shares at least m + 1 - q - k q of its q-grams
with it, and their diagonals (place in the document minus place in the item) span at most k + 1.
So hits are counted in bands of 2 (k + 1) diagonals that begin every k + 1, one of which holds
them all. Bands that reach the bound are kept, and their region is aligned with the item inside
the band, exactly. k is ``budget`` percent of m, less for short items, so that the bound is never
below one. Before bands are formed, hits are counted by stretch of text and item, without a sort: a
region lies in two neighbouring stretches, so hits of items with too few in both are dropped.

The benchmark is the query set: it is read in blocks of bounded size, each block is sent to the
tasks, and every document meets every block. Documents are never shuffled or held whole beside
others; a very long one is read in overlapping windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import batch, bounded, map_batches, text_bytes

Q = 8
BUDGET_PERCENT = 10
BLOCK_BYTES = 2 << 20
WINDOW_BYTES = 2 << 20
STRETCH_BYTES = 512
PIECE_BYTES = 1 << 20  # text of one step
_CELLS = 1 << 20
_FILTER_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)

_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def normalise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column, normalised; each text begins and ends without a blank."""
    data, offsets = text_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    keep = _KEEP[data]
    owner_starts = np.zeros(len(data) + 1, bool)
    owner_starts[offsets[:-1]] = True
    # A blank stays where a kept character follows it and something was kept before in the text.
    follows = np.append(keep[1:] & ~owner_starts[1:len(data)], False) if len(data) else keep
    kept_before = np.concatenate(([0], np.cumsum(keep)))
    seen = kept_before[:-1] - np.repeat(kept_before[offsets[:-1]], np.diff(offsets)) > 0
    stay = keep | (~keep & follows & seen)
    places = np.concatenate(([0], np.cumsum(stay)))
    return np.where(keep, data, 32)[stay].astype(np.uint8), places[offsets]


def grams(data: np.ndarray) -> np.ndarray:
    """The Q characters from each place on as one number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint64) | data[1:].astype(np.uint64) << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    return four[:-4] | four[4:] << np.uint64(32)


def budget_of(m: int, percent: int) -> int:
    return max(0, min(m * percent // 100, (m - Q) // Q))


class Items:
    """One block of the benchmark, indexed by q-gram."""

    def __init__(self, rows: list[tuple[int, str | None]], percent: int = BUDGET_PERCENT):
        data, offsets = normalise(pa.array([t for _, t in rows], pa.string()))
        self.ids = [i for i, _ in rows]
        self.texts = [data[a:z] for a, z in zip(offsets[:-1], offsets[1:])]
        sizes = np.diff(offsets)
        self.budget = np.array([budget_of(int(m), percent) for m in sizes], np.int64)
        self.need = sizes + 1 - Q - self.budget * Q
        codes, item, place = [], [], []
        for k, text in enumerate(self.texts):
            found = grams(text)
            codes.append(found)
            item.append(np.full(len(found), k))
            place.append(np.arange(len(found)))
        codes = np.concatenate([*codes, np.zeros(0, np.uint64)])
        order = np.argsort(codes, kind="stable")
        self.codes = codes[order]
        self.item = np.concatenate([*item, np.zeros(0, np.int64)]).astype(np.int64)[order]
        self.place = np.concatenate([*place, np.zeros(0, np.int64)]).astype(np.int64)[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._cell(self.codes)] = True
        self.longest = int((sizes + self.budget).max(initial=0))

    @staticmethod
    def _cell(codes: np.ndarray) -> np.ndarray:
        return (codes * _MIX >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in data, entry of the index) of every shared q-gram."""
        codes = grams(data)
        at = np.flatnonzero(self.filter[self._cell(codes)])
        codes = codes[at]
        low = np.searchsorted(self.codes, codes, side="left")
        many = np.searchsorted(self.codes, codes, side="right") - low
        total = np.cumsum(many)
        entry = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - many, many)
        return np.repeat(at, many), np.repeat(low, many) + entry

    def likely(self, at: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether the two stretches around a place in the data hold as many hits of the item as a
        match needs. Items share counters if there are many, so counts may be too high only."""
        if not len(at):
            return np.zeros(0, bool)
        stretch = at // max(STRETCH_BYTES, self.longest)
        rows = int(stretch.max()) + 1
        slots = min(len(self.ids), max(1, _CELLS // rows))
        cell = stretch * slots + item % slots
        count = np.bincount(cell, minlength=rows * slots).reshape(rows, slots)
        both = count[:-1] + count[1:]
        most = count
        most[:-1] = np.maximum(most[:-1], both)
        most[1:] = np.maximum(most[1:], both)
        return most.ravel()[cell] >= self.need[item]

    def search(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, edits) of every match in some texts laid end to end."""
        at, entry = self.hits(data)
        chosen = self.likely(at, self.item[entry])
        at, entry = at[chosen], entry[chosen]
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + Q <= offsets[doc + 1]
        at, entry, doc = at[inside], entry[inside], doc[inside]
        item, place = self.item[entry], self.place[entry]
        step = self.budget[item] + 1
        band = (at - offsets[doc] - place + self.longest) // step
        # Bands are numbered from the lowest diagonal; each hit lies in two of them.
        doc, item, place = (np.concatenate((x, x)) for x in (doc, item, place))
        band = np.concatenate((band, band - 1))
        order = np.lexsort((place, band, item, doc))
        doc, item, place, band = (x[order] for x in (doc, item, place, band))
        if not len(doc):
            return
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
                              | (band[1:] != band[:-1])))
        fresh = new | np.concatenate(([True], place[1:] != place[:-1]))
        heads = np.flatnonzero(new)
        shared = np.add.reduceat(fresh.astype(np.int64), heads)
        keep = heads[shared >= self.need[item[heads]]]
        best: dict[tuple[int, int], int] = {}
        for d, i, b in zip(doc[keep].tolist(), item[keep].tolist(), band[keep].tolist()):
            have = best.get((d, i))
            if have == 0:
                continue
            step = int(self.budget[i]) + 1
            first = b * step - self.longest
            edits = align(self.texts[i], data[offsets[d]:offsets[d + 1]], first,
                          first + 2 * step - 1, int(self.budget[i]))
            if edits is not None and (have is None or edits < have):
                best[d, i] = edits
        for (d, i), edits in best.items():
            yield d, i, edits


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> int | None:
    """Fewest edits that turn the whole item into some region of the text whose path stays on
    diagonals low to high; None if more than the budget."""
    m, width = len(item), high - low + 1
    start, stop = max(0, low), min(len(text), high + m)
    if item.tobytes() in text[start:stop].tobytes():
        return 0
    far = budget + m + 1
    steps = np.arange(width)
    column = steps + low           # the place in the text where row 0 of each diagonal stands
    row = np.where((column >= 0) & (column <= len(text)), 0, far)
    padded = np.concatenate((text, np.zeros(1, text.dtype)))
    for k in range(1, m + 1):
        end = column + k           # characters of the text used up
        inside = (end >= 1) & (end <= len(text))
        same = padded[np.clip(end - 1, 0, len(text))] == item[k - 1]
        change = np.where(inside, row + np.where(same, 0, 1), far)
        drop = np.append(row[1:], far) + 1
        new = np.minimum(change, np.where((end >= 0) & (end <= len(text)), drop, far))
        row = np.minimum.accumulate(new - steps) + steps
        row = np.where((end >= 0) & (end <= len(text)), row, far)
        if row.min() > budget:
            return None
    return int(row.min())


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        block.append(tuple(row))
        size += len(row[1] or "")
        if size > BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(documents: DataFrame, benchmark: DataFrame, percent: int = BUDGET_PERCENT,
               key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits): documents with a region within the edit budget of an item.

    One row per document, item and fewest edits. Null and empty texts, on either side, and items
    of fewer than Q characters match nothing; null ids are kept as null; rows that repeat, on
    either side, give one row. Other columns are not read; empty tables give no rows.
    """
    spark = documents.sparkSession
    slim = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text))
    found = None
    for rows in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(Items(rows, percent))

        def run(batches, shared=shared):
            for b in bounded(batches, 1, PIECE_BYTES):
                ids = b.column(0).to_pylist()
                out = [(ids[d], shared.value.ids[i], edits)
                       for d, i, edits in _matches(b.column(1), shared.value)]
                columns = list(zip(*out)) or [[]] * 3
                yield batch(["doc_id", "item_id", "edits"],
                            [pa.array(list(c), pa.int64()) for c in columns])

        part = map_batches(slim, run, "doc_id long, item_id long, edits long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, edits long")
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def without_leaks(documents: DataFrame, benchmark: DataFrame, percent: int = BUDGET_PERCENT,
                  text: str = "text") -> DataFrame:
    """The rows in which no item is found, all columns unchanged; no shuffle."""
    spark, at = documents.sparkSession, documents.columns.index(text)
    for rows in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(Items(rows, percent))

        def run(batches, shared=shared):
            for b in bounded(batches, at, PIECE_BYTES):
                clean = np.ones(len(b), bool)
                clean[[d for d, _, _ in _matches(b.column(at), shared.value)]] = False
                yield b.filter(pa.array(clean))

        documents = map_batches(documents, run, documents.schema)
    return documents


def _matches(texts: pa.Array, items: Items) -> Iterator[tuple[int, int, int]]:
    """(row, item, edits) of a batch."""
    data, offsets = normalise(texts)
    for first, part, bounds in _windows(data, offsets, items.longest + Q):
        for d, i, edits in items.search(part, bounds):
            yield first + d, i, edits


def _windows(data: np.ndarray, offsets: np.ndarray, overlap: int):
    """(first text, bytes, offsets) of runs of texts of about WINDOW_BYTES; a longer text comes as
    overlapping windows, so that a region of an item lies inside one."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + WINDOW_BYTES, side="right")) - 1
        if last > first:
            yield (first, data[offsets[first]:offsets[last]],
                   offsets[first:last + 1] - offsets[first])
            first = last
            continue
        at, stop = int(offsets[first]), int(offsets[first + 1])
        while True:
            end = min(at + max(WINDOW_BYTES, 2 * overlap), stop)
            yield first, data[at:end], np.array([0, end - at], np.int64)
            if end == stop:
                break
            at = end - overlap
        first += 1
