"""Cross-entropy difference of documents under two matched bigram models.

The background model counts every document, the target model those flagged as target. Both share
one vocabulary, the same smoothing and the same order:

    P(w | v) = (count(v w) + MASS * P1(w)) / (count(v .) + MASS),  P1(w) = (count(w) + 1) / (N + V)

The vocabulary holds every word of at least ``MIN_COUNT`` occurrences, at every size; all others
are the unknown word, and each document starts after a start mark. A document scores the mean over
its tokens of target loss minus background loss (nats), so low values are close to the target.

Words are 64-bit hashes. A word below MIN_COUNT occurs once, so its count names the document that
has it, and documents get their unknown words by a join; the words of every document are then
written once, for all later passes. Occurrences (document, previous word,
word) are dealt once, by word, and sorted by Spark, with its spill; words and their pairs are
counted where they pass by. Each of PARTS passes deals the words of one part by hash, and its
shuffle files go before the next begins, so the disk holds one part of the occurrences at a time.
Words with a large share of all tokens (at most 1 / HOT_SHARE of them by arithmetic) are counted
first and their pairs dealt by pair; pairs with such a share are scored where the document is. Only
these two tables are sent to every task.
Losses are summed as whole micro-nats, so results do not depend on the order of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import batch, bounded, map_batches, text_bytes, written
from .hashing import mix, words

MIN_COUNT = 2
MASS = 50.0
HOT_SHARE = 1 / 4096
MICRO = 1e6
UNKNOWN, START = 0, 1
_BINS = 4096
PAIR_BYTES = 4 << 20  # words of one step
PARTS = 3             # one part of the occurrences is dealt in each pass
PAIR_ROWS = 1 << 18   # dealt rows of one step
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n, name) of all words of (name, text), by 64-bit hash; for a word that occurs once
    ``name`` is its document."""

    def count(batches):
        for b in bounded(batches, 1):
            docs, hashes = words(*text_bytes(b.column(1)))
            found, first, n = np.unique(hashes, return_index=True, return_counts=True)
            yield batch(["word", "n", "name"], [
                pa.array(found.view(np.int64)), pa.array(n, pa.int64()),
                pa.array(b.column(0).to_numpy()[docs[first]], pa.int64())])

    return map_batches(documents.select("name", "text"), count, "word long, n long, name long") \
        .groupBy("word").agg(F.sum("n").alias("n"), F.min("name").alias("name"))


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest count, from MIN_COUNT on, that at most ``most`` words reach. Exact: the power
    of two in which the cut falls is divided until single counts are told apart."""

    def boundary(level, rows):
        nonlocal taken
        for row in sorted(rows.groupBy(level.alias("level")).agg(F.count("*").alias("k"))
                          .collect(), reverse=True):
            if taken + row["k"] > most:
                return int(row["level"])
            taken += row["k"]
        return None

    taken = 0
    rows = counts.filter(F.col("n") >= MIN_COUNT)
    power = boundary(F.length(F.bin("n")) - 1, rows)
    if power is None:
        return MIN_COUNT
    low = width = 1 << power
    while True:
        step = max(1, width // _BINS)
        inside = rows.filter((F.col("n") >= low) & (F.col("n") < low + width))
        low += step * boundary(F.floor((F.col("n") - low) / step), inside)
        if step == 1:
            return low + 1
        width = step


def _find(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at, known[at] == values


def _pair(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return mix(before * _LEFT + now * _RIGHT)


def hashed(documents: DataFrame, known: np.ndarray | None) -> DataFrame:
    """(doc_id, target, n, words) of (doc_id, text, target, rare): the hashes of the n words of a
    text in order, 8 bytes each, with UNKNOWN for what is rare or, if given, not known."""
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for b in bounded(batches, 1):
            row, now = words(*text_bytes(b.column("text")))
            if shared.value is None:
                # Rare is a property of the word, so the rows need not be told apart.
                rare = np.unique(b.column("rare").flatten().to_numpy(zero_copy_only=False))
                unknown = _find(np.sort(rare.astype(np.int64).view(np.uint64)), now)[1]
            else:
                unknown = ~_find(shared.value, now)[1]
            now[unknown] = UNKNOWN
            sizes = np.bincount(row, minlength=len(b))
            ends = (8 * np.concatenate(([0], np.cumsum(sizes)))).astype(np.int32)
            packed = pa.Array.from_buffers(
                pa.binary(), len(b), [None, pa.py_buffer(ends), pa.py_buffer(now)])
            yield batch(["doc_id", "target", "n", "words"], [
                b.column("doc_id"), b.column("target"), pa.array(sizes, pa.int64()), packed])

    return map_batches(documents.select("doc_id", "text", "target", "rare"), run,
                       "doc_id long, target boolean, n long, words binary")


def _tokens(b: pa.RecordBatch):
    """(row, previous word, word, last of its row) of every token of a batch (words, ..)."""
    data, bounds = text_bytes(b.column("words"))
    now = data.view(np.uint64)
    row = np.repeat(np.arange(len(b)), np.diff(bounds) // 8)
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    before = np.where(new, np.uint64(START), np.roll(now, 1))
    return row, before, now, np.roll(new, -1) if len(new) else new


@dataclass
class Model:
    """Counts that every task needs: of the words and pairs with a large share."""

    word: np.ndarray        # sorted, with the unknown word and the start mark
    now: np.ndarray         # [2, words]: background, target
    context: np.ndarray     # [2, words]
    pair: np.ndarray        # sorted hashes
    pair_now: np.ndarray    # place of the pair's second word
    pair_count: np.ndarray  # [2, pairs]
    total: np.ndarray       # [2] tokens
    kinds: int

    def pair_loss(self) -> np.ndarray:
        single = (self.now[:, self.pair_now] + 1.0) / (self.total[:, None] + self.kinds)
        return np.rint(-np.log(self.pair_count + MASS * single) * MICRO)

    def context_loss(self) -> np.ndarray:
        return np.rint(np.log(self.context + MASS) * MICRO)


def count_model(tokens: DataFrame, counts: DataFrame, least: int) -> Model:
    """Exact counts of the words and pairs with a large share of all tokens."""
    sums = counts.agg(F.sum("n").alias("n"), F.count_if(F.col("n") >= least).alias("kinds")).first()
    bar = max(2.0, (sums["n"] or 0) * HOT_SHARE)
    hot = counts.filter((F.col("n") >= least) & (F.col("n") >= bar)).select("word").toPandas()
    word = np.sort(np.concatenate((np.array([UNKNOWN, START], np.uint64),
                                   hot["word"].to_numpy(np.int64).view(np.uint64))))

    share = HOT_SHARE

    def often(batches):
        for b in bounded(batches, 0, PAIR_BYTES):
            _, before, now, _ = _tokens(b)
            both = np.flatnonzero(_find(word, now)[1] & _find(word, before)[1])
            _, first, n = np.unique(_pair(before[both], now[both]), return_index=True,
                                    return_counts=True)
            chosen = n >= max(2.0, len(now) * share / 2)
            at = both[first[chosen]]
            yield batch(["before", "now", "n"], [
                pa.array(before[at].view(np.int64)), pa.array(now[at].view(np.int64)),
                pa.array(n[chosen], pa.int64())])

    slim = tokens.select("words", "target")
    # At most 1 / HOT_SHARE pairs can have this share of all tokens; both their words have it too.
    found = map_batches(slim, often, "before long, now long, n long").groupBy("before", "now") \
        .agg(F.sum("n").alias("n")).filter(F.col("n") >= bar).toPandas()
    second = found["now"].to_numpy(np.int64).view(np.uint64)
    pair = _pair(found["before"].to_numpy(np.int64).view(np.uint64), second)
    order = np.argsort(pair)
    pair, pair_now = pair[order], np.searchsorted(word, second[order])

    def exact(batches):
        total = np.zeros((4, len(word) + len(pair) + 1), np.int64)
        for b in bounded(batches, 0, PAIR_BYTES):
            row, before, now, _ = _tokens(b)
            target = b.column("target").to_numpy(zero_copy_only=False)[row]
            both = np.ones(len(row), bool)
            for k, values in ((0, now), (2, before)):
                at, inside = _find(word, values)
                both &= inside
                total[k, :len(word)] += np.bincount(at[inside], minlength=len(word))
                total[k + 1, :len(word)] += np.bincount(at[inside & target], minlength=len(word))
            at, inside = _find(pair, _pair(before[both], now[both]))
            total[0, len(word):-1] += np.bincount(at[inside], minlength=len(pair))
            total[1, len(word):-1] += np.bincount(at[inside & target[both]], minlength=len(pair))
            total[0, -1] += len(now)
            total[1, -1] += int(target.sum())
        yield batch(["id", "a", "b", "c", "d"], [
            pa.array(np.arange(total.shape[1])), *(pa.array(x) for x in total)])

    names = ["a", "b", "c", "d"]
    rows = map_batches(slim, exact, "id long, a long, b long, c long, d long").groupBy("id").agg(
        *[F.sum(c).alias(c) for c in names]).toPandas()
    table = np.zeros((4, len(word) + len(pair) + 1), np.int64)
    table[:, rows["id"].to_numpy(np.int64)] = rows[names].to_numpy(np.int64).T
    return Model(word, table[:2, :len(word)], table[2:, :len(word)], pair, pair_now,
                 table[:2, len(word):-1], table[:2, -1], (sums["kinds"] or 0) + 2)


def _deal(tokens: DataFrame, model: Model, part: int) -> DataFrame:
    """(a, b, id, m) of one part. Per row with words, in the first part, m = -words, a = id, b and
    id the sums of background and target losses of what is known everywhere. Per other pair of a
    row, m = times * 8 + 4 if the word has a large share + 2 if the row ends with it + 1 if target;
    (a, b) is (word, previous word), or (pair, word) if the word has a large share. The part is
    a % PARTS. A step comes by word and previous word, so that neighbours share most bytes; a
    pair of a row may come in two rows."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)
    parts, half = np.uint64(PARTS), np.uint64(32)

    def run(batches):
        m = shared.value
        pair_loss, context_loss = m.pair_loss(), m.context_loss()
        for b in bounded(batches, 0, PAIR_BYTES):
            row, before, now, last = _tokens(b)
            if not len(row):
                continue
            ids = b.column("id").to_numpy()
            target = b.column("target").to_numpy(zero_copy_only=False)
            large = _find(m.word, now)[1]
            at_large = np.flatnonzero(large)
            pairs = _pair(before[at_large], now[at_large])
            at_p, in_p = _find(m.pair, pairs)
            if part == 0:
                sums = np.zeros((2, len(b)))
                at_v, in_v = _find(m.word, before)
                for k in range(2):  # whole numbers far below 2**53, so exact
                    sums[k] = np.bincount(row[in_v], context_loss[k][at_v[in_v]], len(b))
                    if len(m.pair):
                        sums[k] += np.bincount(row[at_large[in_p]], pair_loss[k][at_p[in_p]],
                                               len(b))
                sums = sums.astype(np.int64)
                sizes = np.bincount(row, minlength=len(b))
                some = np.flatnonzero(sizes)
                yield _dealt(ids[some], sums[0][some], sums[1][some], -sizes[some])
            a = now.copy()
            a[at_large] = pairs
            own = a % parts == part
            own[at_large[in_p]] = False
            own = np.flatnonzero(own)
            if not len(own):
                continue
            key = (now[own] >> half << half) | (before[own] >> half)
            own = own[np.argsort(key, kind="stable")]  # the rows ascend
            row, before, now = row[own], before[own], now[own]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (before[1:] != before[:-1]) | (now[1:] != now[:-1])
            opens = np.flatnonzero(new)
            times = np.diff(np.append(opens, len(row)))
            ends = np.add.reduceat(last[own].astype(np.int64), opens)
            row, before, now, own = row[opens], before[opens], now[opens], own[opens]
            yield _dealt(a[own].view(np.int64), np.where(large[own], now, before).view(np.int64),
                         ids[row], times * 8 + large[own] * 4 + ends * 2 + target[row])

    return map_batches(tokens.select("words", "target", "id"), run,
                       "a long, b long, id long, m long")


def _dealt(a, b, ids, m) -> pa.RecordBatch:
    return batch(["a", "b", "id", "m"], [pa.array(x, pa.int64()) for x in (a, b, ids, m)])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns in steps of about PAIR_ROWS rows that never part equal values of the first, by
    which the rows are sorted."""
    held, size, most = [], 0, PAIR_ROWS
    for b in chain(batches, [None]):
        if b is not None:
            held.append([c.to_numpy() for c in b.columns])
            size += len(b)
            if size < most:
                continue
        if not size:
            continue
        rows = [np.concatenate(c) for c in zip(*held)]
        cut = size if b is None else int(np.searchsorted(rows[0], rows[0][-1]))
        if cut:
            yield [c[:cut] for c in rows]
        held, size = [[c[cut:] for c in rows]], size - cut
        most = max(PAIR_ROWS, 2 * size)


def _group_sums(values: np.ndarray, opens: np.ndarray) -> np.ndarray:
    return np.repeat(np.add.reduceat(values, opens), np.diff(np.append(opens, len(values))))


def _opens(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))


def _score(dealt: DataFrame, model: Model) -> DataFrame:
    """(id, background, aim) in micro-nats, a row for each row of ``_deal``, sorted by ``a``."""
    shared = dealt.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        for a, b, ids, m in _whole(batches):
            done, large = m < 0, (m & 4) != 0
            times, ends = np.where(done, 0, m >> 3), np.where(done, 0, (m >> 1) & 1)
            opens, pairs = _opens(a), _pair(b.view(np.uint64), a.view(np.uint64))
            order = np.argsort(pairs)
            pairs = _opens(pairs[order])
            at = _find(known.word, b.view(np.uint64))[0]
            losses = []
            for k, use in enumerate((times >= 0, (m & 1) != 0)):
                own, count = times * use, np.empty(len(a), np.int64)
                count[order] = _group_sums(own[order], pairs)
                now = np.where(large, known.now[k][at], _group_sums(own, opens))
                context = _group_sums(own - ends * use, opens)
                single = (now + 1.0) / (known.total[k] + known.kinds)
                loss = np.where(large, 0, times - ends) * np.rint(np.log(context + MASS) * MICRO) \
                    - times * np.rint(np.log(count + MASS * single) * MICRO)
                losses.append(np.where(done, ids if k else b, loss.astype(np.int64)))
            yield batch(["id", "background", "aim"],
                        [pa.array(x) for x in (np.where(done, a, ids), *losses)])

    return map_batches(dealt, run, "id long, background long, aim long")


def score_tokens(tokens: DataFrame, model: Model) -> DataFrame:
    """(id, background, aim): micro-nats of every row with words."""
    spark = tokens.sparkSession
    slices = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTS)
    slices = max(slices, spark.sparkContext.defaultParallelism)
    sums = [F.sum(c).alias(c) for c in ("background", "aim")]
    parts = None
    for part in range(PARTS):
        rows = _deal(tokens, model, part).repartition(slices, "a")
        scored = _score(rows.sortWithinPartitions("a"), model).groupBy("id").agg(*sums)
        scored = written(scored, f"part-{part}", release=True)
        parts = scored if parts is None else parts.union(scored)
    return parts.groupBy("id").agg(*sums)


def cross_entropy_difference(documents: DataFrame, targets: DataFrame, key: str = "doc_id",
                             text: str = "text", vocabulary: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference), one row per row.

    ``targets`` holds the ids (column ``key``) of target documents; repeats and unknown ids do no
    harm. Documents without words have null losses; a row with a null id is background. Words are
    runs of other characters than blanks, A-Z as a-z. With no target at all the target model is
    the smoothing alone. Rows that repeat are scored each, other columns are not read.

    ``vocabulary`` is for callers that want a smaller model: with it, the vocabulary is the words
    of at least the smallest count that at most so many words reach, and is sent to every task.
    """
    if vocabulary is not None and vocabulary < 1:
        raise ValueError("vocabulary must be at least 1")
    # Rows of one name are equal; a null id is skipped by the hash.
    slim = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")) \
        .withColumn("name", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    counts = written(word_counts(slim), "words", release=True)
    least, known = MIN_COUNT, None
    if vocabulary is not None:
        least = least_count(counts, vocabulary)
        known = np.sort(counts.filter(F.col("n") >= least).select("word").toPandas()["word"]
                        .to_numpy(np.int64).view(np.uint64))
    flags = targets.select(F.col(key).cast("long").alias("doc_id")).filter("doc_id is not null") \
        .distinct()
    # The same joins at every size: the flags and the rare words grow with the corpus.
    hits = slim.select("doc_id", "name").join(flags.hint("merge"), "doc_id").select(
        "name", F.lit(True).alias("hit"), F.lit(None).cast("long").alias("word"))
    marks = hits.union(counts.filter((F.col("n") < MIN_COUNT) & F.lit(known is None)).select(
        "name", F.lit(False), "word")).groupBy("name").agg(
        F.max("hit").alias("hit"), F.collect_list("word").alias("rare"))
    marked = slim.join(marks.hint("merge"), "name", "left").select(
        "doc_id", "text", F.coalesce("hit", F.lit(False)).alias("target"),
        F.coalesce("rare", F.array().cast("array<long>")).alias("rare"))
    # The files fix the ids; they name rows from here on, in fewer bytes than a hash.
    tokens = written(hashed(marked, known).withColumn("id", F.monotonically_increasing_id()),
                     "tokens", release=True)
    sums = score_tokens(tokens, count_model(tokens, counts, least))

    def mean(column):
        return column / (F.col("n") * F.lit(MICRO))

    return tokens.select("id", "doc_id", "n").join(sums, "id", "left").select(
        "doc_id", F.col("n").alias("n_tokens"),
        mean(F.col("aim")).alias("target_loss"), mean(F.col("background"))
        .alias("background_loss"), mean(F.col("aim") - F.col("background")).alias("difference"))
