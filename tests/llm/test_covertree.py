import numpy as np
import pytest

from tidekeep.llm import covertree
from tidekeep.llm.covertree import top_k, whole_vectors

SCHEMA = "vec_id long, embedding array<float>, form string"


def brute(rows, k):
    """Every row for itself: equal rows are as many candidates and as many queries."""
    rows = [(i, tuple(np.floor(64 * np.array(v, np.float32).astype(float)).astype(int).tolist()))
            for i, v in rows if i is not None and v
            and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in rows:
        if i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in rows
                           if j != i and len(c) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def answer(spark, rows, k):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(3)
    vectors = whole_vectors(df)
    return sorted(map(tuple, top_k(vectors, vectors.filter("vec_id % 20 = 0"), k).collect()))


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies", "line"])
def test_matches_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(covertree, "LEAF", 8)
    monkeypatch.setattr(covertree, "NET", 5)
    monkeypatch.setattr(covertree, "BLOCK_ROWS", 256)
    monkeypatch.setattr(covertree, "QUERY_ROWS", 32)
    rng = np.random.default_rng(1)
    n = 400
    if kind == "clusters":
        vectors = rng.normal(size=(8, 6))[rng.integers(0, 8, n)] + rng.normal(size=(n, 6)) / 30
    elif kind == "noise":
        vectors = rng.normal(size=(n, 16))
    elif kind == "copies":
        vectors = rng.normal(size=(3, 4))[rng.integers(0, 3, n)]
    else:
        vectors = np.outer(2.0 ** -np.arange(n / 10), np.ones(3)).repeat(10, axis=0)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(n) - 50, vectors)]
    assert answer(spark, rows, 7) == brute(rows, 7)


def test_rows_that_take_no_part_and_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]),
            (None, [1.0, 1.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (6, [1.0]), (7, [-1.0, -2.0]),
            (20, [1.0]), (40, [3.0, 3.0]), (40, [1e6, 3e6]), (60, []), (8, []),
            (5, [0.5, 0.5]), (80, [1.0, -1.0]), (80, [1.0, -1.0])]
    assert answer(spark, rows, 20) == brute(rows, 20)
    assert answer(spark, rows, 2) == brute(rows, 2)
    assert answer(spark, [], 20) == []


def test_large_components(spark):
    """Scores beyond double precision are exact, vectors whose scores need not fit a long stay
    out."""
    rows = [(i, [float(2**18 + i), float(2**20 - i * i), float(2**24)]) for i in range(60)]
    assert answer(spark, rows, 9) == brute(rows, 9)
    big = [(0, [3e18, 1.0]), (20, [1.0, 1.0]), (1, [2.0, 2.0]), (2, [1e30, 0.0])]
    assert answer(spark, big, 20) == [(20, 1, 1, 2 * 64 * 128)]


def test_sql_agrees_on_repeats_and_empty_vectors(spark, tmp_path):
    import duckdb

    from tidekeep.llm.queries import OP8_SQL, QUERIES
    rows = [(i, [i / 7, 1 - i / 9]) for i in range(1, 30)] + [
        (3, [3 / 7, 1 - 3 / 9]), (40, []), (5, []), (6, None), (7, [None, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(
        str(tmp_path / "embeddings.parquet"))
    engine = duckdb.connect()
    engine.execute("create view embeddings as select * from "
                   f"read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = sorted(map(tuple, QUERIES["op8_exact_top_k"](spark, str(tmp_path)).collect()))
    assert got == sorted(engine.execute(OP8_SQL).fetchall())
