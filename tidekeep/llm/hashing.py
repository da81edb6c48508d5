"""Words and word shingles of whole columns of text as 64-bit hashes, computed on byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .frames import PIECE_BYTES

#: A word is a run of bytes other than these: blank, tab, line feed, vertical tab, form feed, return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Short documents are taken together up to so many bytes; the arrays of a run take up to 60 times
#: as much.
RUN_BYTES = 1 << 19

_PRIME = np.uint64(0x100000001B3)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (the splitmix finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * _PRIME) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS)), _PRIME, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


_POWERS = np.ones(1, np.uint64)


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first document, byte offset, bounds) of runs of documents of about RUN_BYTES; a document of
    up to PIECE_BYTES is one run, a longer one is cut at spaces, where no word is lost, and comes
    as several runs of one."""
    n, first, most = len(offsets) - 1, 0, min(RUN_BYTES, PIECE_BYTES)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        if last == first and offsets[first + 1] - offsets[first] <= PIECE_BYTES:
            last = first + 1
        if last > first:
            yield first, int(offsets[first]), offsets[first:last + 1] - offsets[first]
            first = last
            continue
        at, stop = int(offsets[first]), int(offsets[first + 1])
        while at < stop:
            end = min(at + PIECE_BYTES, stop)
            while end < stop:
                gap = np.flatnonzero(SPACES[data[end:min(end + PIECE_BYTES, stop)]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(end + PIECE_BYTES, stop)
            yield first, at, np.array([0, end - at], np.int64)
            at = end
        first += 1


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes [start, end); runs ascend and do not overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    upto = np.cumsum(size)
    place = np.arange(int(upto[-1])) - np.repeat(upto - size, size)
    value = _BYTE[data[np.repeat(start, size) + place]] * _powers(int(size.max()))[place]
    return mix(np.add.reduceat(value, upto - size))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word, in order; A to Z count as a to z."""
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for first, at, bounds in pieces(data, offsets):
        part = LOWER[data[at:at + int(bounds[-1])]]
        if not len(part):
            continue
        space = SPACES[part]
        head = np.zeros(len(part) + 1, bool)
        head[bounds[:-1]] = True
        opens = np.flatnonzero(~space & (head[:-1] | np.concatenate(([True], space[:-1]))))
        if not len(opens):
            continue
        lengths = np.diff(np.append(opens, len(part)))
        place = np.arange(int(opens[0]), len(part)) - np.repeat(opens, lengths)
        value = _BYTE[part[opens[0]:]] * _powers(int(lengths.max()))[place]
        value[space[opens[0]:]] = 0
        hashes.append(mix(np.add.reduceat(value, opens - opens[0])))
        docs.append(first + np.searchsorted(bounds, opens, side="right") - 1)
    return np.concatenate(docs), np.concatenate(hashes)


def shingles(docs: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``n`` words, and of the whole sequence of a document with
    fewer words."""
    if not len(docs):
        return docs, hashes
    full = max(0, len(docs) - n + 1)
    inside = docs[:full] == docs[n - 1:] if full else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total += hashes[at + k] * _PLACE[k]
    opens = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    lengths = np.diff(np.append(opens, len(docs)))
    few = lengths < n
    if few.any():
        short = np.repeat(few, lengths)
        rank = np.arange(len(docs)) - np.repeat(opens, lengths)
        value = np.where(short, hashes * _PLACE[np.minimum(rank, n - 1)], np.uint64(0))
        sums = np.add.reduceat(value, opens)[few] + lengths[few].astype(np.uint64) * _STEP
        at = np.concatenate((at, opens[few]))
        total = np.concatenate((total, sums))
    return docs[at], mix(total)


def distinct(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without repeats, by document and ascending (unsigned) hash."""
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    if not len(docs):
        return docs, hashes
    new = np.concatenate(([True], (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])))
    return docs[new], hashes[new]
