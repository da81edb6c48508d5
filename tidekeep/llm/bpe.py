"""Byte-pair encoding as a streaming transducer with bounded lookahead, and streaming decoding.

The merge list fixes how far to the right a byte can influence a token boundary. ``lookahead``
derives that bound once; the transducer then keeps a window of a few hundred bytes, emits every
token that ends at least that far before the end of the window, and goes on from the last emitted
boundary. Any suffix of a tokenization is the tokenization of its own bytes, because each merge
rule is built from bytes or from results of earlier rules (checked when a merge list is loaded).
Decoding turns each id into bytes and feeds them to an incremental UTF-8 state machine, so a
character may be spread over any number of tokens and calls.

Bytes of one text: the text that Arrow delivers, one window of pre-tokens, one window of bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .frames import batch, map_batches

#: How the byte-level vocabulary files split text before merging. Fixed value of the file format.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

# The same for texts of ASCII and Latin letters only, where plain character sets say the same.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(rf" ?[{_LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+"
                    rf"| ?[^\t-\r 0-9{_LATIN}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_UNUSUAL = re.compile(rf"[^\x00-\x1b -~{_LATIN}]")

WINDOW_CHARS = 1 << 16
GROUP_CHARS = 1 << 20
BLOCK_BYTES = 512
MEMO_ENTRIES = 400_000
_NONE = 1 << 62
_ID_BITS = 20
_ID_MASK = (1 << _ID_BITS) - 1
_SHORT = 96


def byte_letters() -> dict[str, int]:
    """Letter to byte, as byte-level vocabulary files write bytes: printable Latin-1 stands for
    itself, the other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in own}
    for step, value in enumerate(b for b in range(256) if b not in set(own)):
        letters[chr(256 + step)] = value
    return letters


def sufficient_lookahead(rules: list[tuple[bytes, bytes]]) -> int:
    """Bytes after which a token boundary cannot change any more, from the rules in merge order.

    More input changes what stands at a position p. Rule (u, v) carries the change from p to
    p - len(u), when v starts at p in one of the two histories and u ends there. A later rule
    carries it on if its right side is u itself or begins with u + v. The bound is the heaviest
    such chain of rules in merge order, found from the last rule to the first.
    """
    as_right: dict[bytes, int] = {}
    as_start: dict[bytes, int] = {}
    most = 0
    for left, right in reversed(rules):
        reach = len(left) + max(as_right.get(left, 0), as_start.get(left + right, 0))
        most = max(most, reach)
        if reach > as_right.get(right, 0):
            as_right[right] = reach
        for k in range(2, len(right) + 1):
            if reach > as_start.get(right[:k], 0):
                as_start[right[:k]] = reach
    return most


class Merges:
    """A merge list over bytes, its ids and its lookahead."""

    def __init__(self, rules: list[tuple[bytes, bytes]], ids: dict[bytes, int]):
        known = {bytes([b]) for b in range(256)}
        self.pairs: dict[int, int] = {}
        for rank, (left, right) in enumerate(rules):
            if left not in known or right not in known:
                raise ValueError(f"rule {rank} uses a part that no earlier rule makes")
            known.add(left + right)
            self.pairs.setdefault(ids[left] << _ID_BITS | ids[right],
                                  rank << _ID_BITS | ids[left + right])
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.bytes_of = {i: token for token, i in ids.items()}
        self.length_of = {i: len(token) for token, i in ids.items()}
        self.lookahead = sufficient_lookahead(rules)
        self.block = max(BLOCK_BYTES, max(map(len, known)))

    def whole(self, data: bytes) -> list[int]:
        """Tokens of a window, merged pair by pair: lowest rank first, leftmost first."""
        ids = [self.byte_ids[b] for b in data]
        return self._few(ids) if len(ids) <= _SHORT else self._many(ids)

    def bulk(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """``whole`` for many short windows at once, one merge per row and round."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out: list[tuple[int, ...]] = [()] * len(pieces)
        order = np.argsort(lengths, kind="stable")
        top = 8
        start = 0
        while start < len(order):
            stop = int(np.searchsorted(lengths[order], top, side="right"))
            for low in range(start, stop, 8192):
                rows = order[low:min(low + 8192, stop)]
                self._rows([pieces[i] for i in rows], lengths[rows], rows, out)
            start, top = max(start, stop), top * 2
        return out

    def _rows(self, pieces, lengths, places, out) -> None:
        if not self._table_ready:
            self._build_table()
        n, width = len(pieces), int(lengths.max())
        flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8)
        ids = self._byte_array[flat].reshape(n, width)
        columns = np.arange(width)
        ids[columns >= lengths[:, None]] = _ID_MASK  # no rule has this id
        left = lengths.copy()
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        live = np.arange(n)
        while width > 1 and len(live):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            going = best < _NONE
            if not going.all():
                self._put(ids[~going], left[live[~going]], places[live[~going]], out)
                ids, ranks, at, best, live = (x[going] for x in (ids, ranks, at, best, live))
                if not len(live):
                    return
            k = np.arange(len(live))
            left[live] -= 1
            move = (columns[:-1] > at[:, None]).astype(np.int64) + columns[:-1]
            ids[:, :-1] = np.take_along_axis(ids, move, axis=1)
            ids[:, -1] = _ID_MASK
            ids[k, at] = best & _ID_MASK
            move = np.minimum((columns[:-1] >= at[:, None]).astype(np.int64) + columns[:-1],
                              width - 2)
            ranks = np.take_along_axis(ranks, move, axis=1)
            ranks[:, -1] = _NONE
            before = at > 0
            ranks[k[before], at[before] - 1] = self._ranks(
                ids[k[before], at[before] - 1], ids[k[before], at[before]])
            after = at < width - 1
            ranks[k[after], at[after]] = self._ranks(
                ids[k[after], at[after]], ids[k[after], at[after] + 1])
        if len(live):
            self._put(ids, left[live], places[live], out)

    @staticmethod
    def _put(ids, left, places, out) -> None:
        for row, n, place in zip(ids.tolist(), left.tolist(), places.tolist()):
            out[place] = tuple(row[:n])

    _table_ready = False

    def _build_table(self) -> None:
        """Open addressing over the pair keys, for look-ups of whole arrays."""
        self._byte_array = np.array(self.byte_ids, np.int64)
        size = 1 << (4 * len(self.pairs)).bit_length()
        self._slot_mask, self._keys = size - 1, np.full(size, -1, np.int64)
        self._values = np.full(size, _NONE, np.int64)
        keys = np.array(list(self.pairs), np.int64)
        values = np.array(list(self.pairs.values()), np.int64)
        slots = self._slots(keys)
        while len(keys):
            free = self._keys[slots] == -1
            _, first = np.unique(np.where(free, slots, -1 - np.arange(len(slots))),
                                 return_index=True)
            chosen = first[free[first]]
            self._keys[slots[chosen]], self._values[slots[chosen]] = keys[chosen], values[chosen]
            rest = np.ones(len(keys), bool)
            rest[chosen] = False
            keys, values = keys[rest], values[rest]
            slots = (slots[rest] + 1) & self._slot_mask
        self._table_ready = True

    def _slots(self, keys):
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(40)).astype(np.int64) & self._slot_mask

    def _ranks(self, left, right):
        keys = left << _ID_BITS | right
        slots = self._slots(keys)
        seen = self._keys[slots]
        out = np.where(seen == keys, self._values[slots], _NONE)
        open_ = np.nonzero((seen != keys) & (seen != -1))
        while len(open_[0]):
            slots[open_] = (slots[open_] + 1) & self._slot_mask
            seen = self._keys[slots[open_]]
            hit = seen == keys[open_]
            found = tuple(x[hit] for x in open_)
            out[found] = self._values[slots[found]]
            open_ = tuple(x[~hit & (seen != -1)] for x in open_)
        return out

    def _few(self, ids: list[int]) -> list[int]:
        get = self.pairs.get
        ranks = [get(a << _ID_BITS | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            merged = best & _ID_MASK
            ids[i:i + 2] = (merged,)
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << _ID_BITS | merged, _NONE)
            if i < len(ranks):
                ranks[i] = get(merged << _ID_BITS | ids[i + 1], _NONE)
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        get, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            rank = get(ids[i] << _ID_BITS | ids[i + 1])
            if rank is not None:
                queue.append((rank, i, ids[i], ids[i + 1]))
        heapq.heapify(queue)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = rank & _ID_MASK, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                again = get(ids[i] << _ID_BITS | ids[after[i]])
                if again is not None:
                    heapq.heappush(queue, (again, i, ids[i], ids[after[i]]))
            if before[i] >= 0:
                k = before[i]
                again = get(ids[k] << _ID_BITS | ids[i])
                if again is not None:
                    heapq.heappush(queue, (again, k, ids[k], ids[i]))
        return [x for x in ids if x >= 0]


class Transducer:
    """Reads bytes, emits ids as soon as no later byte can change them."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""

    def push(self, data: bytes) -> Iterator[int]:
        m = self.merges
        window = m.block + m.lookahead
        self.held += data
        at = 0
        while len(self.held) - at > window:
            stable = at + m.block
            for token in m.whole(self.held[at:at + window]):
                end = at + m.length_of[token]
                if end > stable:
                    break
                at = end
                yield token
        self.held = self.held[at:]

    def flush(self) -> list[int]:
        rest, self.held = self.held, b""
        return self.merges.whole(rest)


class Encoder:
    """Text to ids for a byte-level vocabulary file, in chunks of bounded size."""

    def __init__(self, path: str, specials: bool = True):
        """Without ``specials`` their strings in a text are ordinary text."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        rules = [tuple(map(raw, x if isinstance(x, list) else x.split(" ", 1)))
                 for x in spec["model"]["merges"]]
        ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        self.merges = Merges(rules, ids)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]} if specials else {}
        self.bytes_of = dict(self.merges.bytes_of)
        self.bytes_of.update({i: t.encode() for t, i in self.special.items()})
        self._pretokens = regex.compile(PATTERN)
        self._cut = regex.compile(r"(?<=\P{White_Space})(?= \P{White_Space})")
        self._specials = regex.compile("(" + "|".join(
            regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")"
        ) if self.special else None
        self._memo: dict[str, tuple[int, ...]] = {}

    def _pretoken(self, piece: str) -> tuple[int, ...]:
        """Ids of a pre-token through the transducer; remembered if short."""
        data = piece.encode("utf-8", "surrogatepass")
        machine = Transducer(self.merges)
        ids = (*machine.push(data), *machine.flush())
        if len(data) <= 64:
            if len(self._memo) >= MEMO_ENTRIES:
                self._memo.clear()
            self._memo[piece] = ids
        return ids

    def _windows(self, text: str) -> Iterator[str]:
        """The text cut where a single space stands between two words; such a place always
        begins a pre-token. Without one the window grows."""
        start = 0
        while len(text) - start > 2 * WINDOW_CHARS:
            found = self._cut.search(text, start + WINDOW_CHARS)
            if not found:
                break
            yield text[start:found.start()]
            start = found.start()
        yield text[start:] if start else text

    def _split(self, window: str) -> list[str]:
        rule = self._pretokens if _UNUSUAL.search(window) else _PLAIN
        return rule.findall(window)

    def _units(self, text: str | None) -> Iterator[list[str] | int]:
        """Windows of a text as lists of pre-tokens, and the ids of special tokens between."""
        for part in self._specials.split(text or "") if self._specials else [text or ""]:
            if part in self.special:
                yield self.special[part]
            elif part:
                yield from map(self._split, self._windows(part))

    def streams(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[int]]]:
        """(number of the text, next ids of it), in order. Windows are gathered to groups of
        about GROUP_CHARS, also across texts; the unknown pre-tokens of a group are merged
        together."""
        group: list[tuple[int, list[str] | int]] = []
        size = 0
        for number, text in enumerate(texts):
            for unit in self._units(text):
                group.append((number, unit))
                size += 5 * len(unit) if isinstance(unit, list) else 1
                if size > GROUP_CHARS:
                    yield from self._group(group)
                    group, size = [], 0
        yield from self._group(group)

    def _group(self, group) -> Iterator[tuple[int, list[int]]]:
        pieces = set(chain.from_iterable(u for _, u in group if isinstance(u, list)))
        unseen = pieces.difference(self._memo)
        if len(self._memo) + len(unseen) > MEMO_ENTRIES:
            self._memo.clear()
            unseen = pieces
        long_ones: dict[str, tuple[int, ...]] = {}
        short, data = [], []
        for piece in unseen:
            raw = piece.encode("utf-8", "surrogatepass")
            if len(raw) <= 64:
                short.append(piece)
                data.append(raw)
            else:
                long_ones[piece] = self._pretoken(piece)
        self._memo.update(zip(short, self.merges.bulk(data)))
        known = self._memo.__getitem__ if not long_ones else (
            lambda x: self._memo.get(x) or long_ones[x])
        for number, unit in group:
            yield number, (list(chain.from_iterable(map(known, unit)))
                           if isinstance(unit, list) else [unit])

    def chunks(self, text: str | None) -> Iterator[list[int]]:
        """Lists of ids, one per window of the text."""
        for unit in self._units(text):
            if isinstance(unit, list):
                out: list[int] = []
                for piece in unit:
                    out += self._memo.get(piece) or self._pretoken(piece)
                yield out
            else:
                yield [unit]

    def decoder(self) -> Decoder:
        return Decoder(self.bytes_of)

    def encode(self, text: str | None) -> list[int]:
        return [i for chunk in self.chunks(text) for i in chunk]


class Decoder:
    """Ids to text; keeps at most the bytes of one unfinished character between calls. Bytes that
    are no UTF-8 become U+FFFD, unknown ids raise."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self._bytes = bytes_of.__getitem__
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: list[int]) -> str:
        return self._machine.decode(b"".join(map(self._bytes, ids)))

    def flush(self) -> str:
        return self._machine.decode(b"", final=True)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, specials: bool = True) -> Encoder:
    """One encoder per worker process and file."""
    if (path, specials) not in _ENCODERS:
        _ENCODERS[path, specials] = Encoder(path, specials)
    return _ENCODERS[path, specials]


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``df`` but ``text`` and any ``ids``, plus ``ids`` array<int>; a null or
    empty text gives an empty array."""
    kept = [c for c in df.columns if c not in (text, ids)]
    slim = df.select(*kept, text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields
                          if f.name != text), f"`{ids}` array<int>"])

    def run(batches):
        coder = encoder(path)
        for b in batches:
            rows: list[list[int]] = [[] for _ in range(len(b))]
            for number, chunk in coder.streams(t.as_py() for t in b.column(len(kept))):
                rows[number] += chunk
            yield batch([*kept, ids], [*(b.column(k) for k in range(len(kept))),
                                       pa.array(rows, pa.list_(pa.int32()))])

    return map_batches(slim, run, schema)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The inverse of ``encode_texts``; null ids give an empty text."""
    kept = [c for c in df.columns if c not in (text, ids)]
    slim = df.select(*kept, ids)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields
                          if f.name != ids), f"`{text}` string"])

    def run(batches):
        coder = encoder(path)
        for b in batches:
            rows = []
            for x in b.column(len(kept)):
                machine = coder.decoder()
                rows.append(machine.push(x.as_py() or []) + machine.flush())
            yield batch([*kept, text], [*(b.column(k) for k in range(len(kept))),
                                        pa.array(rows, pa.string())])

    return map_batches(slim, run, schema)


ROUND_TRIP = ["n_tokens", "ids_sha256", "decoded_sha256"]


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256), one row per row of ``df``.

    Every whole text is encoded and the ids decoded chunk by chunk; only the two running digests
    outlive a chunk. A null text counts as empty, a null key is kept, repeated rows give repeated
    results, an empty table gives none; other columns are not read.
    """
    slim = df.select(df[key], df[text])

    def run(batches):
        coder = encoder(path)
        decimals = {i: str(i) for i in coder.bytes_of}
        for b in batches:
            rows = len(b)
            counts, encoded, decoded = [0] * rows, [""] * rows, [""] * rows
            at, n = 0, 0
            id_hash, text_hash, back = hashlib.sha256(), hashlib.sha256(), coder.decoder()

            def close(row):
                text_hash.update(back.flush().encode())
                counts[row], encoded[row] = n, id_hash.hexdigest()
                decoded[row] = text_hash.hexdigest()

            for number, ids in coder.streams(v.as_py() for v in b.column(1)):
                while at < number:
                    close(at)
                    at, n = at + 1, 0
                    id_hash, text_hash, back = hashlib.sha256(), hashlib.sha256(), coder.decoder()
                glue = "," if n else ""
                id_hash.update((glue + ",".join(map(decimals.__getitem__, ids))).encode())
                text_hash.update(back.push(ids).encode())
                n += len(ids)
            while at < rows:
                close(at)
                at, n = at + 1, 0
                id_hash, text_hash, back = hashlib.sha256(), hashlib.sha256(), coder.decoder()
            yield batch([key, *ROUND_TRIP], [b.column(0), pa.array(counts, pa.int64()),
                                             pa.array(encoded), pa.array(decoded)])

    kind = slim.schema[0].dataType.simpleString()
    return map_batches(slim, run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, "
                                  "decoded_sha256 string")
