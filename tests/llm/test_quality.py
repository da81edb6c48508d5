import random

import numpy as np
import pyarrow as pa

from tidekeep.llm import hashing
from tidekeep.llm import quality as q


def plain(texts):
    """The counts in plain Python."""
    out = []
    for t in texts:
        words = (t or "").split()
        low = [w.lower() for w in words]
        out.append((len(words), len(set(low)), sum(len(w.encode()) <= 3 for w in words),
                    sum(a == b for a, b in zip(low, low[1:])), sum(c == "!" for c in t or "")))
    return out


def test_measures():
    rng = random.Random(1)
    parts = ["The", "the", "a", " ", "\n", "!", "word", "ab12", "Été", "xxx", "#"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(300)] + ["", None]
    m = q.measures(pa.array(texts))
    got = m[:, [q.WORDS, q.DISTINCT, q.SHORT, q.REPEATS, q.MARKS]].astype(int).tolist()
    ascii_only = [k for k, t in enumerate(texts) if (t or "").isascii()]
    want = plain(texts)
    assert [got[k] for k in ascii_only] == [list(want[k]) for k in ascii_only]


def make_corpus(n=600):
    rng = random.Random(2)
    syllables = ["the", "re", "on", "er", "an", "ti", "ou", "ha", "en", "st"]

    def word():
        return "".join(rng.choices(syllables, k=rng.randrange(1, 4)))

    rows, truth = [], []
    for k in range(n):
        words = [word() + rng.choice(["", "", "", ","]) for _ in range(rng.randrange(60, 160))]
        words[::3] = [rng.choice(["of", "to", "is", "a"]) for _ in words[::3]]
        kind = k % 12
        if kind == 0:
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        elif kind == 2:
            words = sorted(rng.choices(words[:8], k=len(words)))
        rows.append((k, " ".join(words) + ".", "n"))
        truth.append(kind > 2)
    return rows, np.array(truth)


def test_learns_without_labels_and_is_right_on_rows_it_was_not_fitted_to(spark):
    rows, truth = make_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    scorer = q.fit(df.filter("doc_id < 300"))
    got = {r["doc_id"]: r["keep"] for r in q.classify(df, scorer).collect()}
    keep = np.array([got[k] for k in range(len(rows))]) == 1
    held = np.arange(len(rows)) >= 300
    assert keep[held & truth].mean() == 1.0
    assert keep[held & ~truth].mean() < 0.1
    kept = q.keep_good(df, scorer)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if v}


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    n = 20_000
    good = rng.random(n) < 0.8
    seen = np.full((n, q.HEURISTICS), q.NONE)
    for h in range(4):
        right = rng.random(n) < (0.99, 0.97, 0.95, 0.9)[h]
        seen[:, h] = np.where(good == right, q.GOOD, q.BAD)
    pattern, count = np.unique((seen * q._POWERS).sum(axis=1), return_counts=True)
    share, chance = q.fit_label_model(pattern, count.astype(float))
    assert abs(share[0] - 0.8) < 0.02
    assert np.abs(chance[0, :4, q.GOOD] - [0.99, 0.97, 0.95, 0.9]).max() < 0.02
    weak = q.posterior(share, chance)[(seen * q._POWERS).sum(axis=1)] > 0.5
    assert (weak == good).mean() > 0.98


def test_defined_cases(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    scorer = q.fit(none)
    assert q.classify(none, scorer).count() == 0 and q.keep_good(none, scorer).count() == 0
    df = spark.createDataFrame([(None, None), (1, ""), (1, "ab"), (2, "a word " * 40_000)],
                               "doc_id long, text string")
    got = q.classify(df, q.fit(df)).collect()
    assert sorted(r["keep"] for r in got)[:3] == [0, 0, 0] and len(got) == 4


def test_long_texts_are_measured_window_by_window(monkeypatch):
    from tidekeep.llm import hashing
    text = "one two two three. " * 500
    whole = q.measures(pa.array([text, "x", None]))
    monkeypatch.setattr(hashing, "PIECE_BYTES", 100)
    cut = q.measures(pa.array([text, "x", None]))
    same = [c for c in range(11) if c not in (q.DISTINCT, q.REPEATS)]
    assert (whole[:, same] == cut[:, same]).all()


def test_short_documents_are_taken_in_small_runs(monkeypatch):
    monkeypatch.setattr(hashing, "RUN_BYTES", 1000)
    sizes = [400] * 9 + [5000, 0, 400, 999, 1, 1]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    runs = list(hashing.pieces(np.full(int(offsets[-1]), 97, np.uint8), offsets))
    assert [(first, len(bounds) - 1) for first, _, bounds in runs] == [
        (0, 2), (2, 2), (4, 2), (6, 2), (8, 1), (9, 1), (10, 2), (12, 2), (14, 1)]
    assert all(at == offsets[first] for first, at, _ in runs)
    assert sum(int(bounds[-1]) for _, _, bounds in runs) == offsets[-1]


def test_kept_rows_leave_in_small_batches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q, "map_batches", lambda df, run, schema: seen.append(run))
    table = pa.record_batch({"text": ["a b c " * 300_000] * 12, "n": list(range(12))})
    scorer = q.Scorer(np.ones(3 ** q.HEURISTICS), np.zeros(q.FEATURES + 2), 9.0)
    df = spark.createDataFrame([], "text string, n long")
    q.keep_good(df, scorer)
    out = list(seen[0](iter([table])))
    assert [r for b in out for r in b.column(1).to_pylist()] == list(range(12)) and len(out) > 1
