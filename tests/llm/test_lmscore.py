import math
import random
import re
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidekeep.llm import lmscore
from tidekeep.llm.lmscore import MASS, cross_entropy_difference

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, targets, most):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))) for i, t in rows]
    counts = Counter(w for _, ws in texts for w in ws)
    levels = Counter(n for n in counts.values() if n > 1)
    taken, least = 0, None
    for level in sorted(levels, reverse=True):
        taken += levels[level]
        if taken > most:
            break
        least = level
    known = {w for w, n in counts.items() if least and n >= least}
    models = []
    for chosen in (None, targets):
        word, context, pair = Counter(), Counter(), Counter()
        for i, ws in texts:
            if chosen is None or i in chosen:
                before = "<start>"
                for w in ws:
                    w = w if w in known else None
                    word[w] += 1
                    context[before] += 1
                    pair[before, w] += 1
                    before = w
        models.append((word, context, pair, sum(word.values())))
    out = []
    for i, ws in texts:
        losses = []
        for word, context, pair, total in models:
            before, loss = "<start>", 0.0
            for w in ws:
                w = w if w in known else None
                single = (word[w] + 1) / (total + len(known) + 2)
                loss -= math.log((pair[before, w] + MASS * single) / (context[before] + MASS))
                before = w
            losses.append(loss / len(ws) if ws else None)
        out.append((i, len(ws), losses[1], losses[0]))
    return out


@pytest.mark.parametrize("share", [1 / 4096, 0.02])
def test_matches_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(lmscore, "HOT_SHARE", share)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(words, weights=range(1, 61), k=rng.randrange(0, 50)))
             + " The end" * rng.randrange(0, 3)) for k in range(120)]
    rows += [(500, None), (501, "  \n"), (7, rows[7][1]), (502, "hapax " * 1 + "x" * 3000)]
    targets = set(range(0, 120, 3))
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n string")
    flags = spark.createDataFrame([(i,) for i in [*targets, *targets, 9999, None]], "doc_id long")
    got = sorted(cross_entropy_difference(df, flags, vocabulary=40).collect(), key=str)
    want = sorted(brute(rows, targets, 40), key=str)
    assert len(got) == len(want)
    key = lambda r: (r[0], r[1], round(r[2] or 0, 3))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:2] == w[:2]
        if w[1]:
            assert g[2] == pytest.approx(w[2], abs=2e-6)
            assert g[3] == pytest.approx(w[3], abs=2e-6)
            assert g[4] == pytest.approx(w[2] - w[3], abs=4e-6)
        else:
            assert g[2:] == (None, None, None)


def test_empty_tables_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    flags = spark.createDataFrame([(1,)], "doc_id long")
    assert cross_entropy_difference(none, flags).count() == 0
    df = spark.createDataFrame([(None, "a a b"), (1, "a a b")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in cross_entropy_difference(df, flags.limit(0)).collect()}
    assert set(got) == {None, 1} and got[None]["n_tokens"] == 3


def test_no_bound_on_the_vocabulary(spark):
    rows = [(k, " ".join(f"v{j % 70_000}" for j in range(200 * k, 200 * k + 200)) + f" once{k} v0")
            for k in range(700)]
    targets = set(range(0, 700, 5))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    flags = spark.createDataFrame([(i,) for i in targets], "doc_id long")
    got = {r["doc_id"]: r for r in cross_entropy_difference(df, flags).collect()}
    for i, n, target, background in brute(rows, targets, 10**9):
        assert got[i]["n_tokens"] == n
        assert got[i]["target_loss"] == pytest.approx(target, abs=2e-6)
        assert got[i]["background_loss"] == pytest.approx(background, abs=2e-6)


def test_large_counts_are_told_apart(spark):
    counts = spark.createDataFrame(
        [(1, 4100), (2, 5000), (3, 8000), (4, 10**9), (5, 10**9 + 1), (6, 2), (7, 1)],
        "word long, n long")
    want = {1: 10**9 + 1, 2: 8001, 3: 5001, 4: 4101, 5: 3, 6: 2, 7: 2}
    assert {m: lmscore.least_count(counts, m) for m in want} == want


def test_parts_are_dealt_one_at_a_time(spark):
    """The disk holds the shuffle files of one part, not of all occurrences."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def held():
        found = files.getAllFiles()
        found = [found.apply(k) for k in range(found.size())]
        return sum(f.length() for f in found if f.getName().startswith("shuffle_"))

    rng = random.Random(5)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(1500)))
            for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    flags = spark.createDataFrame([(i,) for i in range(0, 400, 3)], "doc_id long")
    floor = held()
    got = cross_entropy_difference(df, flags).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, got)) == [(k, 1500) for k in range(400)]
    for _ in range(100):
        if held() - floor < 1_000_000:
            return
        time.sleep(0.2)
    raise AssertionError(f"{held() - floor} bytes of shuffle files stay")


def test_every_pair_is_in_one_part(spark):
    df = spark.createDataFrame([(k, f"a b c d{k % 7} a b e{k % 5}") for k in range(200)],
                               "doc_id long, text string")
    slim = df.withColumns({"target": F.col("doc_id") % 3 == 0,
                           "rare": F.array().cast("array<long>")})
    tokens = lmscore.hashed(slim, None).withColumn("id", F.col("doc_id")).cache()
    counts = lmscore.word_counts(df.withColumn("name", F.col("doc_id"))).cache()
    model = lmscore.count_model(tokens, counts, 2)
    model.pair, model.pair_now = model.pair[:0], model.pair_now[:0]
    model.pair_count = model.pair_count[:, :0]
    parts = [lmscore._deal(tokens, model, k).filter("m > 0").collect()
             for k in range(lmscore.PARTS)]
    assert sum((r["m"] >> 3) for p in parts for r in p) == 200 * 7
    keys = [{r["a"] for r in p} for p in parts]
    assert all(keys) and not any(keys[i] & keys[j] for i in range(len(keys)) for j in range(i))


def test_steps_keep_equal_values_together(monkeypatch):
    monkeypatch.setattr(lmscore, "PAIR_ROWS", 10)
    values = [1] * 3 + [2] * 40 + list(range(3, 30)) + [50] * 11
    batches = [pa.RecordBatch.from_arrays([pa.array(values[k:k + 7])] * 2, names=["a", "b"])
               for k in range(0, len(values), 7)]
    steps = [a.tolist() for a, _ in lmscore._whole(iter(batches))]
    assert sum(steps, []) == values and len(steps) > 3
    assert all(x[-1] != y[0] for x, y in zip(steps, steps[1:]))
    assert list(lmscore._whole(iter([]))) == []
