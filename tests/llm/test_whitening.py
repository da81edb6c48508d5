import os

import numpy as np
import pytest

from tidekeep.llm import whitening
from tidekeep.llm.whitening import whiten

SCHEMA = ("vec_id long, embedding array<double>, component string, n string, x string, "
          "key string, cell string, deviation string")


def brute(rows, k=16):
    """Rows that take part, the fit by numpy's eigenvectors, exact deviations."""
    kept = [(i, tuple(int(np.floor(64.0 * c)) for c in v)) for i, v in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in kept}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = np.array((fit * n - sums) / n, float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for i, x in kept:
        gap = np.array(x, object) * n - sums
        out.append((i, int((gap * gap).sum()), np.array(gap / n, float) @ vectors
                    / np.sqrt(values)))
    return n, values / np.trace(cov), out


def collect(spark, rows, **options):
    df = spark.createDataFrame([(i, v, *"abcdef") for i, v in rows], SCHEMA).repartition(3)
    return whiten(df, **options).collect()


def check(spark, rows, k=16, places=1e-9, **options):
    got = collect(spark, rows, **options)
    n, explained, want = brute(rows, k)
    assert len(got) == len(want) * len(explained)
    table = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
        table.setdefault((r["vec_id"], r["deviation"]), []).append((r["component"], r["whitened"]))
    signs = np.zeros(len(explained))
    for i, deviation, w in want:
        own = np.array([x for _, x in sorted(table[i, deviation])])
        reps = len(own) // len(w)
        own = own.reshape(len(w), reps)[:, 0]
        turned = np.sign(own * w)
        sure = np.abs(w) > 1e-3
        assert np.all((signs == 0) | (signs == turned) | ~sure)
        signs = np.where((signs == 0) & sure, turned, signs)
        assert np.allclose(np.abs(own), np.abs(w), atol=places * max(1, np.abs(w).max()))
    return got


def test_matches_eigenvectors(spark):
    rng = np.random.default_rng(2)
    spread = rng.normal(size=(300, 20)) * np.geomspace(40, 0.5, 20) + 1e5
    rows = [(i, v.tolist()) for i, v in enumerate(spread @ np.linalg.qr(rng.normal(
        size=(20, 20)))[0])]
    check(spark, rows + rows[:40] + [(1000 + i, v) for i, v in rows[:40]], places=1e-7)
    check(spark, rows, k=3, components=3, places=1e-7)


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 4)) * [8, 4, 2, 1])]
    odd = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0]), (103, [float("nan")] * 4),
           (104, [1.0, float("inf"), 0.0, 0.0]), (105, [1e300, 0.0, 0.0, 0.0])]
    got = check(spark, rows + [(None, [1.0, 2.0, 3.0, 4.0])])
    again = collect(spark, rows + odd + [(None, [1.0, 2.0, 3.0, 4.0]), (106, [1.0, 2.0])])
    assert {r["vec_id"] for r in again} == {r["vec_id"] for r in got}
    assert {r["deviation"] for r in again} == {r["deviation"] for r in got}


def test_small_tables(spark):
    assert collect(spark, []) == []
    assert collect(spark, [(1, None)]) == []
    assert collect(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    two = collect(spark, [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [3.0, 4.0])])
    assert [(r["component"], r["n"], r["explained"]) for r in two] == [(1, 2, 1.0)] * 3
    assert sorted(abs(r["whitened"]) for r in two) == pytest.approx([1.0] * 3)


def test_dimensions_that_repeat_or_stand_still(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(200, 5)) * 10
    wide = np.concatenate((base, base[:, :2], np.full((200, 2), 7.0), base[:, :1]), axis=1)
    got = collect(spark, [(i, v.tolist()) for i, v in enumerate(wide)])
    assert {r["component"] for r in got} == {1, 2, 3, 4, 5}
    assert max(r["identity_error"] for r in got) < 1e-9


def test_ill_conditioned_rows_need_the_shift(spark, monkeypatch):
    """Plain Cholesky QR breaks down at a condition of 1e8; the composed R must not."""
    rng = np.random.default_rng(7)
    left = np.linalg.qr(rng.normal(size=(500, 8)))[0]
    right = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    a = left * np.geomspace(1e11, 1, 8) @ right.T
    a -= a.mean(axis=0)
    monkeypatch.setattr(whitening, "_gram", lambda rows, center, triangles, d: _solved(a, triangles))
    r = whitening.composed_r(None, None, 500, 8)
    q = np.linalg.solve(r.T, a.T).T
    assert np.abs(q.T @ q - np.eye(8)).max() < 1e-4
    assert np.allclose(np.linalg.svd(r)[1][:6], np.linalg.svd(a)[1][:6], rtol=1e-6)


def _solved(a, triangles):
    for t in triangles:
        a = whitening.solve_rows(a, t)
    return a.T @ a


def test_exact_numbers(spark):
    rows = [(1, [1e9, -1e9]), (2, [1e9 + 1, 5.0]), (3, [-1e9, 1e9]), (4, [0.0, 7e8])]
    n, _, want = brute(rows)
    got = {r["vec_id"]: r["deviation"] for r in collect(spark, rows)}
    assert got == {i: (d if d < 2 ** 63 else None) for i, d, _ in want}
    assert None in got.values()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the data folder")
def test_query_over_the_embeddings(spark):
    from tidekeep.llm.queries import QUERIES
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = QUERIES["op13_embedding_whitening"](spark, "/root/testdata/sf0.001").collect()
    n, explained, want = brute(rows)
    assert len(got) == 16 * len(rows)
    own = np.zeros((len(rows), 16))
    place = {i: k for k, (i, _, _) in enumerate(want)}
    for r in got:
        own[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == want[place[r["vec_id"]]][1] and r["n"] == n
        assert r["identity_error"] < 1e-10
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-10
    theirs = np.array([w for _, _, w in want])
    signs = np.sign((own * theirs).sum(axis=0))
    assert np.allclose(own * signs, theirs, atol=1e-8)
