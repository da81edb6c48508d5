"""Batches of texts through the tokenizers library, each distinct word once.

The word vocabulary drops white space and marks the last token of a word, so a text in plain
letters is the sequence of its words: they are found on the lower-cased bytes, and only words not
met before go through the library, joined by blanks. Texts with other characters (where
composition or lower-casing may move a border) or with special tokens go through it whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from .hashing import SPACES, hash_runs

_LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ɏ"
_UNUSUAL = re.compile(rf"[^\x00-\x1b -~{_LETTERS}]|<\|")
MEMO_WORDS = 500_000
PIECE_CHARS = 2 << 20

_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[SPACES] = _SPACE
_KIND[[*range(97, 123), *range(128, 256)]] = _LETTER
_KIND[48:58] = _DIGIT


def word_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words of lower-cased plain bytes: runs of letters, single digits, runs
    of other characters, and the contractions 's 't 're 've 'm 'll 'd where an apostrophe opens a
    run. The pattern is fixed by the vocabulary file."""
    kind = _KIND[data]
    before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
    start = (kind != _SPACE) & ((kind != before) | (kind == _DIGIT))
    mark = np.flatnonzero(start[:-1] & (data[:-1] == 39) & (kind[1:] == _LETTER))
    if len(mark):
        one = data[mark + 1]
        two = data[np.minimum(mark + 2, len(data) - 1)]
        length = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, 0)
        for a, b in (b"re", b"ve", b"ll"):
            length = np.where((one == a) & (two == b) & (mark + 2 < len(data)), 2, length)
        mark, length = mark[length > 0], length[length > 0]
        start[mark + 1] = False
        after = mark + 1 + length
        after = after[after < len(data)]
        start[after[kind[after] == _LETTER]] = True
    edges = np.append(np.flatnonzero(start | (kind == _SPACE)), len(data))
    opens = start[edges[:-1]]
    return edges[:-1][opens], edges[1:][opens]


class WordEncoder:
    """ids of batches of texts, as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.coder = Tokenizer.from_file(path)
        self.coder.no_truncation()
        self.coder.no_padding()
        suffix = model["end_of_word_suffix"]
        self.ends = np.zeros(self.coder.get_vocab_size(), bool)
        for token, i in model["vocab"].items():
            self.ends[i] = token.endswith(suffix)
        self.memo: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, words: list[bytes]) -> None:
        if len(self.memo) + len(words) > MEMO_WORDS:
            self.memo.clear()
        for low in range(0, len(words), 20_000):
            part = words[low:low + 20_000]
            ids = self._whole(b" ".join(part).decode())
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and (not len(ids) or stops[-1] == len(ids)):
                found = np.split(ids, stops[:-1])
            else:
                found = [self._whole(w.decode()) for w in part]
            self.memo.update(zip(part, (x.tobytes() for x in found)))

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """ids per text, for texts without unusual characters."""
        raw = [t.lower().encode() for t in texts]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw])))
        start, end = word_runs(data)
        _, first, which = np.unique(hash_runs(data, start, end), return_index=True,
                                    return_inverse=True)
        source = data.tobytes()
        spelled = [source[a:z] for a, z in zip(start[first].tolist(), end[first].tolist())]
        new = [w for w in spelled if w not in self.memo]
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = spelled
        self._learn(new)
        coded = [self.memo[w] for w in spelled]
        flat = np.frombuffer(b"".join(coded), np.uint32)
        sizes = np.array([len(x) for x in coded], np.int64) // 4
        offset = np.cumsum(sizes) - sizes
        size = sizes[which]
        upto = np.cumsum(size)
        ids = flat[np.repeat(offset[which] - (upto - size), size) + np.arange(len(flat) and
                                                                              int(size.sum()))]
        words_upto = np.searchsorted(start, begins)
        cuts = np.concatenate(([0], upto))[words_upto]
        return [ids[a:z] for a, z in zip(cuts[:-1], cuts[1:])]

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        group: list[int] = []
        held: list[str] = []
        size = 0

        def close():
            for row, ids in zip(group, self.plain(held)):
                out[row] = ids

        for row, value in enumerate(texts):
            text = value.as_py() or ""
            if _UNUSUAL.search(text):
                out[row] = self._whole(text)
                continue
            group.append(row)
            held.append(text)
            size += len(text)
            if size > PIECE_CHARS:
                close()
                group, held, size = [], [], 0
        if held:
            close()
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
