"""Quality classifier from overlapping heuristics: a label model, then a hashed linear scorer.

Eight heuristics look at a text and vote good, bad or not at all. No one trusts any of them: the
label model (good, or bad in one of eight ways; votes independent given that) estimates how often
each votes what in each class by expectation-maximisation over the counts of all vote patterns of all documents,
of which there are at most 3^8. The posterior of a document's pattern is its weak label.

The scorer sees no heuristic: its features are the relative frequencies of hashed byte triples and of
words that repeat the word before, so it also judges texts on which the heuristics abstain. It is fitted to the weak labels of a
bounded sample (``SAMPLE_ROWS`` rows, the ones with the smallest hash of the key) and scores every
whole text in one pass without a shuffle.

Texts beyond a few megabytes are measured window by window; counts add up, and distinct words are
then counted per window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import batch, binary_column, bounded, map_batches, text_bytes
from .hashing import LOWER, SPACES, hash_runs, pieces

SAMPLE_ROWS = 4000
FEATURES = 1 << 14
EM_ROUNDS = 200
FIT_ROUNDS = 150
FIT_STEP = 2.0
KEEP_FROM = 0.5
BAD, NONE, GOOD = 0, 1, 2

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|<>{}[]^~=_\\@+/")] = True
(CHARS, LETTERS, UPPER, SYMBOLS, MARKS, WORDS, DISTINCT, SHORT, TAILS, REPEATS,
 ODD) = range(11)


def measures(texts: pa.Array) -> np.ndarray:
    """[rows, 11] counts of each text."""
    data, offsets = text_bytes(texts)
    out = np.zeros((len(texts), 11))
    for first, at, bounds in pieces(data, offsets):
        part = data[at:at + int(bounds[-1])]
        rows = slice(first, first + len(bounds) - 1)
        if not len(part):
            continue
        space, symbol = SPACES[part], _SYMBOL[part]
        letter = ((part | 32) >= 97) & ((part | 32) <= 122) | (part >= 0xC0)
        upper = (part >= 65) & (part <= 90)
        upper[1:] |= (part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E)
        tail = np.append(space[1:], True)
        tail[bounds[1:-1] - 1] = True
        exclaim = part == 33
        for k, mask in ((CHARS, ~space & ((part & 0xC0) != 0x80)), (LETTERS, letter),
                        (UPPER, upper), (SYMBOLS, symbol), (MARKS, exclaim),
                        (TAILS, tail & (symbol | exclaim))):
            out[rows, k] += np.diff(np.concatenate(([0], np.cumsum(mask)))[bounds])
        head = np.concatenate(([True], space[:-1]))
        head[bounds[:-1][bounds[:-1] < len(part)]] = True
        start, end = np.flatnonzero(head & ~space), np.flatnonzero(tail & ~space) + 1
        doc = np.searchsorted(bounds, start, side="right") - 1
        n = len(bounds) - 1
        odd = np.concatenate(([0], np.cumsum(symbol | exclaim | ((part >= 48) & (part <= 57)))))
        words = LOWER[part]
        hashes = hash_runs(words, start, end)
        seen = _firsts(doc, hashes)
        again = 1 + np.flatnonzero((doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1]))
        for k, chosen in ((WORDS, doc), (DISTINCT, doc[seen]), (SHORT, doc[end - start <= 3]),
                          (REPEATS, doc[again]),
                          (ODD, doc[odd[end] > odd[start]])):
            out[rows, k] += np.bincount(chosen, minlength=n)
    return out


def _firsts(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of the first of each (document, value)."""
    order = np.lexsort((value, doc))
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc[order]) != 0) | (value[order][1:] != value[order][:-1])
    return order[new]


def votes(m: np.ndarray) -> np.ndarray:
    """[rows, 8] votes of the heuristics; texts without words get no vote."""
    words, chars = np.maximum(m[:, WORDS], 1), np.maximum(m[:, CHARS], 1)

    def high_is_bad(value, good_to, bad_from):
        return np.where(value >= bad_from, BAD, np.where(value <= good_to, GOOD, NONE))

    def high_is_good(value, bad_to, good_from):
        return np.where(value <= bad_to, BAD, np.where(value >= good_from, GOOD, NONE))

    out = np.stack([
        high_is_bad(m[:, SYMBOLS] / chars, 0.02, 0.08),
        high_is_bad(m[:, UPPER] / np.maximum(m[:, LETTERS], 1), 0.12, 0.35),
        high_is_bad(m[:, MARKS] / words, 0.03, 0.2),
        high_is_bad(m[:, TAILS] / words, 0.05, 0.3),
        high_is_bad(m[:, ODD] / words, 0.15, 0.45),
        high_is_good(m[:, SHORT] / words, 0.08, 0.2),
        high_is_bad(m[:, REPEATS] / words, 0.05, 0.3),
        high_is_good(m[:, DISTINCT] / words, 0.15, 0.25),
    ], axis=1)
    # Shares of a few words say little.
    out[np.ix_(m[:, WORDS] < 10, [2, 3, 4])] = NONE
    out[np.ix_(m[:, WORDS] < 40, [5, 6, 7])] = NONE
    out[m[:, WORDS] == 0] = NONE
    return out


HEURISTICS = 8
_POWERS = 3 ** np.arange(HEURISTICS)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of each kind, chance [kind, heuristic, vote]) by expectation-maximisation, with one
    pseudo-count per cell. Kind 0 is good, kind 1 + h is bad in the way heuristic h sees. The
    chances are those of a vote that is cast; a heuristic that does not vote says nothing.

    A pattern starts as bad if at least two heuristics say so, by the first of them: what only one
    heuristic dislikes may be its mistake, and the fit decides.
    """
    seen = patterns[:, None] // _POWERS % 3
    bad = seen == BAD
    start = np.where(bad.sum(axis=1) >= 2, 1 + bad.argmax(axis=1), 0)
    kinds = np.full((HEURISTICS + 1, len(patterns)), 0.02 / HEURISTICS)
    kinds[start, np.arange(len(patterns))] = 0.98
    share, chance = np.zeros(HEURISTICS + 1), np.ones((HEURISTICS + 1, HEURISTICS, 3))
    for _ in range(EM_ROUNDS):
        weight = kinds * counts
        for vote in (BAD, GOOD):
            chance[:, :, vote] = weight @ (seen == vote) + 1.0
        chance /= chance[:, :, [BAD, GOOD]].sum(axis=2, keepdims=True)
        chance[:, :, NONE] = 1.0
        share = (weight.sum(axis=1) + 1) / (counts.sum() + len(share))
        new = _kinds(share, chance, seen)
        if np.abs(new - kinds).max(initial=0) < 1e-9:
            break
        kinds = new
    return share, chance


def _kinds(share: np.ndarray, chance: np.ndarray, seen: np.ndarray) -> np.ndarray:
    logs = np.log(share)[:, None] + np.log(
        chance[:, np.arange(HEURISTICS), seen]).sum(axis=2)
    kinds = np.exp(logs - logs.max(axis=0))
    return kinds / kinds.sum(axis=0)


def posterior(share: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Probability of good for each of the 3^8 patterns."""
    return _kinds(share, chance, np.arange(3 ** HEURISTICS)[:, None] // _POWERS % 3)[0]


def features(data: np.ndarray) -> np.ndarray:
    """Hashed byte triples of a stretch of text."""
    part = data.astype(np.uint32)
    code = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64)


def word_features(m: np.ndarray) -> np.ndarray:
    """[rows, 2] counts of words that do and do not repeat the word before; the last features."""
    return np.stack((m[:, REPEATS], m[:, WORDS] - m[:, REPEATS]), axis=1)


@dataclass
class Scorer:
    labels: np.ndarray   # posterior per pattern
    weights: np.ndarray  # of FEATURES triples and two kinds of words
    bias: float

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(probability of good, weak label) per text; a text without a triple scores 0."""
        data, offsets = text_bytes(texts)
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for first, at, bounds in pieces(data, offsets):
            part = data[at:at + int(bounds[-1])]
            if len(part) < 3:
                continue
            value = np.concatenate(([0.0], np.cumsum(self.weights[features(part)])))
            stop = np.maximum(bounds[1:] - 2, bounds[:-1])
            stop = np.minimum(stop, len(part) - 2)
            start = np.minimum(bounds[:-1], stop)
            rows = slice(first, first + len(bounds) - 1)
            total[rows] += value[stop] - value[start]
            n[rows] += stop - start
        m = measures(texts)
        words = word_features(m)
        total += words @ self.weights[FEATURES:]
        n += np.where(n > 0, words.sum(axis=1), 0)
        chance = 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(n, 1), -500, 500)))
        return (np.where(n > 0, chance, 0.0),
                self.labels[(votes(m) * _POWERS).sum(axis=1)])


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], labels: np.ndarray) -> Scorer:
    """Logistic regression on (features of a text, their counts, weak label), by Adam over the
    whole sample."""
    if not rows:
        return Scorer(labels, np.zeros(FEATURES + 2), 0.0)
    place = np.concatenate([p for p, _, _ in rows])
    value = np.concatenate([c / max(1, c.sum()) for _, c, _ in rows])
    owner = np.repeat(np.arange(len(rows)), [len(p) for p, _, _ in rows])
    target = np.array([t for _, _, t in rows])
    weights, bias = np.zeros(FEATURES + 2), 0.0
    state = np.zeros((2, FEATURES + 3))
    # Both classes weigh the same, so that a rare one is learned too.
    share = np.clip(target.mean(), 1e-6, 1 - 1e-6)
    balance = target / share + (1 - target) / (1 - share)
    for step in range(1, FIT_ROUNDS + 1):
        margin = bias + np.bincount(owner, value * weights[place], len(rows))
        error = (1 / (1 + np.exp(-margin)) - target) * balance / (2 * len(rows))
        slope = np.append(np.bincount(place, value * error[owner], FEATURES + 2), error.sum())
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.999 * state[1] + 0.001 * slope**2
        move = FIT_STEP * (state[0] / (1 - 0.9**step)) / (
            np.sqrt(state[1] / (1 - 0.999**step)) + 1e-6)
        weights -= move[:-1]
        bias -= move[-1] / 10
    return Scorer(labels, weights, float(bias))


def fit(documents: DataFrame, key: str = "doc_id", text: str = "text",
        sample_rows: int = SAMPLE_ROWS) -> Scorer:
    def patterns(batches):
        for b in batches:
            code = (votes(measures(b.column(0))) * _POWERS).sum(axis=1)
            found, n = np.unique(code, return_counts=True)
            yield batch(["pattern", "n"], [pa.array(found), pa.array(n)])

    counted = map_batches(documents.select(text), patterns, "pattern long, n long").groupBy(
        "pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    share, chance = fit_label_model(counted["pattern"].to_numpy(np.int64),
                                    counted["n"].to_numpy(np.float64))
    labels = posterior(share, chance)

    ids = documents.select(F.col(key).cast("long").alias("_key")).filter("_key is not null")
    chosen = ids.distinct().orderBy(F.xxhash64("_key"), "_key").limit(sample_rows)

    def triples(batches):
        for b in batches:
            m = measures(b.column(1))
            weak = labels[(votes(m) * _POWERS).sum(axis=1)]
            words = word_features(m).astype(np.int64)
            data, offsets = text_bytes(b.column(1))
            found = [np.bincount(features(data[a:z]), minlength=FEATURES)
                     if z - a > 2 else np.zeros(FEATURES, np.int64)
                     for a, z in zip(offsets[:-1], offsets[1:])]
            found = [np.concatenate((f, w)) for f, w in zip(found, words)]
            yield batch(["_key", "weak", "places", "counts"], [
                b.column(0), pa.array(weak),
                binary_column([np.flatnonzero(c).astype(np.uint16).tobytes() for c in found]),
                binary_column([c[c > 0].astype(np.uint32).tobytes() for c in found])])

    # At most sample_rows keys, so the list may be sent to every task.
    sample = documents.select(F.col(key).cast("long").alias("_key"), F.col(text)).join(
        F.broadcast(chosen), "_key")
    picked = map_batches(sample, triples, "_key long, weak double, places binary, counts binary")
    rows = picked.groupBy("_key").agg(F.min(F.struct("weak", "places", "counts")).alias("r")) \
        .orderBy("_key").select("r.*").toLocalIterator()
    return fit_scorer([(np.frombuffer(r["places"], np.uint16),
                        np.frombuffer(r["counts"], np.uint32), r["weak"]) for r in rows], labels)


def classify(documents: DataFrame, scorer: Scorer, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """(doc_id, score, weak_label, keep), one row per row: the chance of good by the scorer, the
    posterior of the heuristics, and 1 where the score reaches KEEP_FROM.

    A null text is empty; texts of fewer than three bytes score 0 and are not kept. Repeated rows
    score alike, null keys stay null, other columns are not read, no rows give none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for b in batches:
            score, weak = shared.value.score(b.column(1))
            score = np.round(score, 6)
            yield batch(["doc_id", "score", "weak_label", "keep"], [
                b.column(0), pa.array(score), pa.array(np.round(weak, 6)),
                pa.array((score >= KEEP_FROM).astype(np.int32))])

    slim = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text))
    return map_batches(slim, run, "doc_id long, score double, weak_label double, keep int")


def keep_good(documents: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """The rows the scorer keeps, all columns unchanged; no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(scorer)
    at = documents.columns.index(text)

    def run(batches):
        for b in bounded(batches, at):
            score, _ = shared.value.score(b.column(at))
            yield b.filter(pa.array(np.round(score, 6) >= KEEP_FROM))

    return map_batches(documents, run, documents.schema)
