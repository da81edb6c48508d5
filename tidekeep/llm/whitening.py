"""Whitening of embeddings by shifted Cholesky QR.

The rows of the centred matrix A are spread over the cluster; only d x d matrices meet. A pass
multiplies each task's rows with themselves and adds up the cells of the Gram matrix with a grouped
sum. The driver factors that matrix, with a small shift on its diagonal where rounding could make
it indefinite, and the next pass solves its rows against the triangles found so far. After a few
passes the solved rows are orthonormal to working precision, so A = Q R with R the product of all
triangles, and the singular values and right vectors of the small R are those of A.

Vectors are whole numbers (``scale`` times the component, rounded down), so means are subtracted
from exact sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import batch, map_batches, written

#: A pass ends the orthogonalisation when its Gram matrix is this close to the identity.
ORTHONORMAL = 1e-12
MAX_PASSES = 8
#: Rows worked on at once; d of them in double precision are held a few times over.
ROWS = 8192
#: Whole numbers above this are not exact in double precision; such vectors take no part.
EXACT = float(1 << 52)


def whole_vectors(embeddings: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(key, x): floor(scale * component) as array<long>. Vectors that are null or empty, or hold
    a null or a value that is not finite or too large for exact work, are left out; repeated rows
    and null keys stay."""
    v = F.col(vector)
    scaled = F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    fine = F.forall(v, lambda c: F.coalesce(
        F.abs(F.lit(float(scale)) * c.cast("double")) < F.lit(EXACT), F.lit(False)))
    return embeddings.filter(v.isNotNull() & (F.size(v) > 0) & fine).select(
        F.col(key).alias("key"), scaled.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of whole numbers as rows of a matrix."""
    flat = np.asarray(column.flatten(), np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for b in batches:
        for at in range(0, len(b), ROWS):
            yield _matrix(b.column(column).slice(at, ROWS))


def _grouped(rows: DataFrame, cells: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Cell by cell sum over all pieces of ``rows``. A task sends one row per cell, the grouped sum
    runs in Spark, and as many cells as one task sent come back."""
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches):
        total = None
        for x in _pieces(batches, 0):
            part = cells(x)
            total = part if total is None else total + part
        if total is not None:
            yield batch(["cell", "value"], [pa.array(np.arange(len(total)), pa.int32()),
                                            pa.array(total.astype(dtype))])

    found = map_batches(rows.select("x"), run, f"cell int, value {kind}").groupBy("cell").agg(
        F.sum("value").alias("value")).orderBy("cell").collect()
    return np.array([r["value"] for r in found], dtype)


class Center:
    """x - S / n, from whole numbers of any offset: the whole part of the mean leaves first."""

    def __init__(self, n: int, sums: list[int]):
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest


def solve_rows(a: np.ndarray, triangle: np.ndarray) -> np.ndarray:
    """a times the inverse of an upper triangle, by substitution column by column."""
    out = np.empty_like(a)
    for j in range(a.shape[1]):
        out[:, j] = (a[:, j] - out[:, :j] @ triangle[:j, j]) / triangle[j, j]
    return out


def _gram(rows: DataFrame, center: Center, triangles: list[np.ndarray], d: int) -> np.ndarray:
    def cells(x: np.ndarray) -> np.ndarray:
        a = center(x)
        for t in triangles:
            a = solve_rows(a, t)
        return (a.T @ a).ravel()
    return _grouped(rows, cells, "double").reshape(d, d)


def triangle_of(gram: np.ndarray, n: int, shift: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix of ``n`` rows. The shift is the bound on what
    rounding can take from the smallest eigenvalue; it is added at once or where it is needed."""
    d = len(gram)
    most = 11.0 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(gram, 2)
    for _ in range(60):
        try:
            return np.linalg.cholesky(gram + most * np.eye(d) if shift else gram).T
        except np.linalg.LinAlgError:
            most, shift = (most * 4 if shift else most), True
    raise np.linalg.LinAlgError("no Cholesky factor")


def composed_r(rows: DataFrame, center: Center, n: int, d: int) -> np.ndarray:
    """R of A = Q R: a shifted pass, then passes until the solved rows are orthonormal."""
    triangles: list[np.ndarray] = []
    r = np.eye(d)
    for k in range(MAX_PASSES):
        gram = _gram(rows, center, triangles, d)
        if not gram.any():
            return np.zeros((d, d))
        if k and np.abs(gram - np.eye(d)).max() < ORTHONORMAL:
            break
        triangles.append(triangle_of(gram, n, shift=k == 0))
        r = triangles[-1] @ r
    return r


class Whitener:
    """What a fit leaves: n, exact sums, the components and eigenvalues kept, the share of the
    trace of each, and the largest deviation of the whitened covariance from the identity."""

    def __init__(self, rows: DataFrame, components: int = 16):
        """``rows`` are distinct vectors (column x) of one length, from a written table."""
        first = rows.first()
        self.n, self.sums = 0, []
        self.d = len(first["x"]) if first else 0
        self.vectors, self.values = np.zeros((self.d, 0)), np.zeros(0)
        self.explained, self.identity_error = np.zeros(0), 0.0
        if not first:
            return
        self.n, self.sums = rows.count(), _sums(rows, self.d)
        self.center = Center(self.n, self.sums)
        r = composed_r(rows, self.center, self.n, self.d)
        _, sigma, right = np.linalg.svd(r)
        # Directions without variance are no components: their singular values are rounding.
        floor = sigma[0] * np.finfo(float).eps * 8 * max(self.d, self.n ** 0.5)
        kept = int(np.count_nonzero(sigma[:components] > floor)) if sigma[0] > 0 else 0
        self.vectors, self.values = right[:kept].T, sigma[:kept] ** 2 / self.n
        if kept:
            self.explained = self.values / (sigma ** 2 / self.n).sum()
            self.identity_error = self._identity_error(rows, kept)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.center(x) @ self.vectors) / np.sqrt(self.values)

    def _identity_error(self, rows: DataFrame, k: int) -> float:
        def cells(x):
            w = self.project(x)
            return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))
        total = _grouped(rows, cells, "double") / self.n
        mean = total[:k]
        return float(np.abs(total[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _sums(rows: DataFrame, d: int) -> list[int]:
    """Exact sums per dimension: high and low 26 bits are added up apart, so a long holds either
    sum of 2**36 rows."""
    def cells(x):
        return np.concatenate(((x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)))
    halves = _grouped(rows, cells, "long")
    return [(int(high) << 26) + int(low) for high, low in zip(halves[:d], halves[d:])]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)**2, exact; null where a long cannot hold it."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    away = x - base
    most = int(np.abs(away).max(initial=0)) + 1
    if x.shape[1] * (most * n) ** 2 < 2 ** 63:
        gaps = away * n - rest
        return np.einsum("ij,ij->i", gaps, gaps).tolist()
    gaps = away.astype(object) * n - rest.astype(object)
    exact = (gaps * gaps).sum(axis=1)
    return [int(e) if e < 2 ** 63 else None for e in exact]


OUT = ("component int, n long, deviation long, whitened double, explained double, "
       "identity_error double")


def whiten(embeddings: DataFrame, components: int = 16, scale: int = 64, key: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per vector and
    component, components numbered from 1 by falling variance.

    Fitted to the distinct vectors, applied to all. Left out are vectors that are null, empty, or
    hold a null, a value that is not finite or one of 2**52 / ``scale`` and more, and vectors of
    another length than the most frequent one (of equally frequent lengths the longest). Directions
    without variance are no components: a table of one distinct vector, or an empty one, gives no
    rows. Repeated rows give repeated results and null keys are kept; other columns are not read.
    """
    vectors = whole_vectors(embeddings, key, vector, scale)
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("d")).first()
    vectors = vectors.filter(F.size("x") == F.lit(usual["d"] if usual else 0))
    fitted = Whitener(written(vectors.select("x").distinct(), "whitening-fit"), components)
    kind = vectors.schema[0].dataType.simpleString()
    names = ["key", *(part.split()[0] for part in OUT.split(", "))]
    k = len(fitted.values)

    def run(batches):
        for b in batches:
            for at in range(0, len(b) if k else 0, ROWS):
                keys, x = b.column(0).slice(at, ROWS), _matrix(b.column(1).slice(at, ROWS))
                rows = len(keys)
                away = pa.array(deviations(x, fitted.n, fitted.sums), pa.int64())
                each = pa.array(np.repeat(np.arange(rows), k))
                yield batch(names, [
                    keys.take(each), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array(np.full(rows * k, fitted.n)), away.take(each),
                    pa.array(fitted.project(x).ravel()),
                    pa.array(np.tile(fitted.explained, rows)),
                    pa.array(np.full(rows * k, fitted.identity_error))])

    return map_batches(vectors, run, f"key {kind}, {OUT}").withColumnRenamed("key", key)
