"""Softmax regressions over shared token counts, all fitted side by side.

The counts are kept once, as blocks of rows of one fold in the smallest integers that hold them.
A pass over the blocks gives the loss and the gradient of every unfinished fit, whatever its head,
penalty or left-out fold, by two dense products per block; the driver takes the steps. These are
the steps of Spark's LogisticRegression (multinomial, inputs scaled by their deviation and centred,
L2 penalty on the scaled weights, L-BFGS of ten pairs with a strong Wolfe search), so the weights
are those of one such fit after the other, up to rounding.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame, SparkSession

from ..session import map_batches

PAIRS, TOLERANCE, WINDOW = 10, 1e-6, 20
MAX_SEARCH, MAX_ZOOM = 10, 10
BLOCKS = "fold int, block binary"
#: Sums of more tasks than this are added up in between before they reach the driver.
DIRECT = 64


# ------------------------------------------------------------ blocks
def block_rows(width: int) -> int:
    """Rows of a block: as a dense table it takes up to 4 MB."""
    return max(1, min(256, (4 << 20) // (8 * max(width, 1))))


def _smallest(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max()))) if len(values) else values


def pack(labels: list[tuple], columns: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """A block of rows with a label per head, -1 where it is unknown."""
    return pickle.dumps((np.array(labels, np.int16),
                         _smallest(np.array([len(c) for c in columns], np.int64)),
                         _smallest(np.concatenate(columns)), _smallest(np.concatenate(counts))), 5)


@dataclass(frozen=True)
class Blocks:
    """Blocks of counts of ``width`` columns, the first ``inputs`` of which the fits see, kept in
    ``tasks`` partitions."""

    rows: DataFrame
    width: int
    inputs: int
    tasks: int


def summed(blocks: Blocks, size: int, visit: Callable) -> np.ndarray:
    """The total, of ``size`` numbers, of ``visit()(total, fold, labels, counts)`` over all
    blocks; the counts are dense. What ``visit()`` gives is used by one task."""
    width = blocks.width

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, see, space = np.zeros(size), visit(), np.zeros(block_rows(width) * width)
        for b in batches:
            for fold, block in zip(b.column(0).to_pylist(), b.column(1)):
                labels, sizes, at, counts = pickle.loads(block.as_py())
                flat = np.repeat(np.arange(len(sizes)) * width, sizes) + at
                space[flat] = counts
                see(total, fold, labels, space[:len(sizes) * width].reshape(len(sizes), width))
                space[flat] = 0.0
        yield _part(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for part in b.column(0):
                total += np.frombuffer(part.as_py())
        yield _part(total)

    # The products of a worker are small, and there is a worker per core.
    blocks.rows.sparkSession.sparkContext.environment.setdefault("OMP_NUM_THREADS", "1")
    parts = map_batches(blocks.rows, work, "part binary")
    if blocks.tasks > DIRECT:
        parts = map_batches(parts.repartition(int(blocks.tasks ** 0.5)), merge, "part binary")
    total = np.zeros(size)
    for part in parts.toArrow().column(0):
        total += np.frombuffer(part.as_py())
    return total


def _part(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])


# ------------------------------------------------------------ moments
@dataclass(frozen=True)
class Moments:
    """Rows per label, and sums and sums of squares per column, of the rows of a head."""

    per_label: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    @property
    def rows(self) -> int:
        return int(self.per_label.sum())

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.per_label + other.per_label, self.sums + other.sums,
                       self.squares + other.squares)

    def mean(self) -> np.ndarray:
        return self.sums / self.rows

    def inverse_deviation(self) -> np.ndarray:
        """One over the sample deviation, 0 for a column that never varies. Sums of whole numbers
        are exact, and so is the test."""
        n = self.rows
        spread = [max(n * int(q) - int(s) ** 2, 0) for s, q in zip(self.sums, self.squares)]
        return np.array([(n * (n - 1) / v) ** 0.5 if v else 0.0 for v in spread])


def moments(blocks: Blocks, labels: list[int], folds: int)\
        -> tuple[dict[tuple[int, int], Moments], list[np.ndarray]]:
    """Moments of the inputs by (head, fold), and per head the sums of all counts by label."""
    width = blocks.width
    of = [n + 2 * width for n in labels]
    starts = np.cumsum([0] + [folds * k for k in of]).tolist()
    sums_at = np.cumsum([starts[-1]] + [n * width for n in labels]).tolist()

    def visit():
        def see(total, fold, given, x):
            for h, n in enumerate(labels):
                known = given[:, h] >= 0
                rows, a = x if known.all() else x[known], starts[h] + fold * of[h]
                own = np.eye(n)[given[known, h]]
                total[a:a + n] += own.sum(0)
                total[a + n:a + n + width] += rows.sum(0)
                total[a + n + width:a + of[h]] += np.einsum("ij,ij->j", rows, rows)
                total[sums_at[h]:sums_at[h + 1]] += (own.T @ rows).ravel()
        return see

    total = summed(blocks, sums_at[-1], visit)
    found = {}
    for h, n in enumerate(labels):
        for k in range(folds):
            a = starts[h] + k * of[h]
            per_label, sums, squares = np.split(total[a:a + of[h]], [n, n + width])
            found[h, k] = Moments(per_label, sums[:blocks.inputs], squares[:blocks.inputs])
    return found, [total[a:z].reshape(n, width) for a, z, n in zip(sums_at, sums_at[1:], labels)]


# ------------------------------------------------------------ steps
class _Failed(Exception):
    pass


Steps = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def _descent(gradient: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton direction; ``pairs`` of (step, change of gradient), the last one first."""
    direction, scale, used = gradient.copy(), 1.0, []
    if pairs:
        s, y = pairs[0]
        if not s @ y >= 0:
            raise _Failed
        scale = (s @ y) / (y @ y)
    for s, y in pairs:
        rho = s @ y
        a = (s @ direction) / rho
        if np.isnan(a):
            raise _Failed
        direction -= a * y
        used.append((s, y, rho, a))
    direction *= scale
    for s, y, rho, a in reversed(used):
        direction += (a - (y @ direction) / rho) * s
    return -direction


def _search(x: np.ndarray, value: float, slope: float, direction: np.ndarray,
            first: float) -> Generator:
    """(step, value, gradient) that meets the strong Wolfe conditions."""
    def at(t):
        v, g = yield x + direction * t
        return t, v, g @ direction, g

    def between(a, b):
        d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
        root = d1 * d1 - a[2] * b[2]
        d2 = root ** 0.5 if root >= 0 else np.nan
        width = b[0] - a[0]
        t = b[0] - width * (b[2] + d2 - d1) / (b[2] - a[2] + 2 * d2)
        low, high = a[0] + 0.1 * width, a[0] + 0.9 * width
        return low if t < low else high if t > high else t

    def zoom(low, high):
        for _ in range(MAX_ZOOM):
            t = between(high, low) if low[0] > high[0] else between(low, high)
            if np.isnan(t):
                raise _Failed
            c = yield from at(t)
            if c[1] > value + 1e-4 * t * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope):
                    return c
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _Failed

    if slope > 0:
        raise _Failed
    t, low = first, (0.0, value, slope, None)
    for k in range(MAX_SEARCH):
        c = yield from at(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and k > 0):
            return (yield from zoom(low, c))
        if abs(c[2]) <= 0.9 * abs(slope):
            return c
        if c[2] >= 0:
            return (yield from zoom(c, low))
        low, t = c, t * 1.5
    raise _Failed


def minimise(x: np.ndarray, max_iter: int) -> Steps:
    """Yields points, is sent their value and gradient, and returns the last point."""
    value, gradient = yield x
    start, values, pairs, done, failed = abs(value), [np.inf], [], 0, False
    while done < max_iter:
        if len(values) > 1 and abs(value - max(values)) <= TOLERANCE * start:
            break
        if np.linalg.norm(gradient) <= max(TOLERANCE * abs(value), 1e-8):
            break
        try:
            direction = _descent(gradient, pairs)
            first = 1.0 if done else 1.0 / np.linalg.norm(direction)
            t, v, _, g = yield from _search(x, value, gradient @ direction, direction, first)
            if t * np.linalg.norm(gradient) < 1e-10:
                raise _Failed
        except _Failed:
            if failed:
                break
            failed, pairs = True, []
            continue
        step = direction * t
        pairs = [(step, g - gradient), *pairs][:PAIRS]
        x, value, gradient = x + step, v, g
        values, done, failed = [*values, v][-WINDOW:], done + 1, False
    return x


# ------------------------------------------------------------ fits
@dataclass
class Fit:
    """A regression on the rows of a head, all of them or those outside a fold: at first as its
    rows describe it, after ``solve`` with weights and intercepts of the plain counts."""

    head: int
    without: int
    reg: float
    max_iter: int
    moments: Moments

    def __post_init__(self):
        n = self.moments
        if not n.rows:
            raise ValueError("no rows to fit")
        per_label = n.per_label[:int(np.flatnonzero(n.per_label)[-1]) + 1]
        self.classes, self.width = len(per_label), len(n.sums)
        self.weights = np.zeros((self.classes, self.width))
        self.intercepts = np.zeros(self.classes)
        self.steps = None
        if np.count_nonzero(per_label) == 1:  # one label: nothing to learn
            self.intercepts[-1] = np.inf
            return
        self.inverse = n.inverse_deviation()
        self.centre = n.mean() * self.inverse
        first = np.log1p(per_label)
        self.steps = minimise(np.concatenate([np.zeros(self.classes * self.width),
                                              first - first.mean()]), self.max_iter)
        self._set(next(self.steps))

    def _set(self, point: np.ndarray) -> None:
        self.scaled = point[:-self.classes].reshape(self.classes, self.width)
        self.weights = self.scaled * self.inverse
        self.intercepts = point[-self.classes:] - self.scaled @ self.centre

    def take(self, loss: float, errors: np.ndarray, products: np.ndarray) -> None:
        """The next point from the sums at this one: the loss, the errors (share less truth) of
        each class, and the counts times the errors."""
        n = self.moments.rows
        slope = (products * self.inverse - np.outer(errors, self.centre)) / n \
            + self.reg * self.scaled
        value = loss / n + 0.5 * self.reg * float((self.scaled ** 2).sum())
        try:
            self._set(self.steps.send((value, np.concatenate([slope.ravel(), errors / n]))))
        except StopIteration as last:
            self._set(last.value)
            self.steps = None
            if not self.reg:
                self.weights = self.weights - self.weights.mean(0)
            self.intercepts = self.intercepts - self.intercepts.mean()

    def model(self, spark: SparkSession, uid: str, **columns: str) -> LogisticRegressionModel:
        """The fit as Spark's own model."""
        sc = spark.sparkContext
        java = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
            uid, _py2java(sc, DenseMatrix(self.classes, self.width, self.weights.ravel("F"))),
            _py2java(sc, DenseVector(self.intercepts)), self.classes, True)
        return LogisticRegressionModel(java)._set(
            family="multinomial", regParam=self.reg, maxIter=self.max_iter, **columns)


def _groups(fits: list[Fit]) -> dict[tuple[int, int, int], list[int]]:
    """Positions of the fits by (head, left-out fold, classes)."""
    found: dict = {}
    for i, f in enumerate(fits):
        found.setdefault((f.head, f.without, f.classes), []).append(i)
    return found


def solve(blocks: Blocks, fits: list[Fit]) -> None:
    """Take every fit to its end, a pass over the blocks for a step of all that are unfinished."""
    while active := [f for f in fits if f.steps]:
        _step(blocks, active)


def _step(blocks: Blocks, fits: list[Fit]) -> None:
    # A class is left out of the products: shares depend on differences, and errors add up to 0.
    width = blocks.inputs
    groups, places, at = [], [], len(fits)
    for (head, without, classes), members in _groups(fits).items():
        weights = np.stack([fits[i].weights for i in members])
        bias = np.stack([fits[i].intercepts for i in members])
        groups.append((head, without, classes, members,
                       (weights[:, 1:] - weights[:, :1]).reshape(-1, width).T.copy(),
                       bias - bias[:, :1]))
        m = len(members)
        places.append((at, at := at + m * classes, at := at + m * (classes - 1) * width))
    sent = blocks.rows.sparkSession.sparkContext.broadcast(groups)

    def visit():
        known, by_fold = sent.value, {}

        def see(total, fold, labels, x):
            if fold not in by_fold:
                mine = [i for i, g in enumerate(known) if g[1] != fold]
                by_fold[fold] = mine, np.hstack([known[i][4] for i in mine] or [
                    np.zeros((width, 0))])
            mine, weights = by_fold[fold]
            if not mine:
                return
            x = x[:, :width]
            z, errors, a = x @ weights, [], 0
            for i in mine:
                head, _, classes, members, own, bias = known[i]
                m, y = len(members), labels[:, head]
                scores = np.zeros((len(x), m, classes))
                scores[:, :, 1:] = z[:, a:(a := a + own.shape[1])].reshape(len(x), m, classes - 1)
                scores += bias
                top = scores.max(2, keepdims=True)
                scores -= top
                has = np.flatnonzero(y >= 0)
                true = scores[has, :, y[has]]
                np.exp(scores, out=scores)
                all_ = scores.sum(2, keepdims=True)
                total[members] += np.log(all_[has, :, 0]).sum(0) - true.sum(0)
                scores /= all_
                scores[has, :, y[has]] -= 1.0
                scores[y < 0] = 0.0
                s, e, _ = places[i]
                total[s:e] += scores.sum(0).ravel()
                errors.append(scores[:, :, 1:].reshape(len(x), -1))
            products, a = np.hstack(errors).T @ x, 0
            for i, own in zip(mine, errors):
                _, s, e = places[i]
                total[s:e] += products[a:(a := a + own.shape[1])].ravel()
        return see

    total = summed(blocks, at, visit)
    sent.destroy()
    for (_, _, classes, members, _, _), (a, b, z) in zip(groups, places):
        m = len(members)
        errors = total[a:b].reshape(m, classes)
        rest = total[b:z].reshape(m, classes - 1, width)
        for j, i in enumerate(members):
            fits[i].take(total[i], errors[j], np.vstack([-rest[j].sum(0), rest[j]]))


def hits(blocks: Blocks, fits: list[Fit]) -> list[int]:
    """For every fit the rows of its left-out fold that it labels rightly."""
    sent = blocks.rows.sparkSession.sparkContext.broadcast(
        [(f.head, f.without, f.weights.T.copy(), f.intercepts) for f in fits])

    width = blocks.inputs

    def visit():
        known = sent.value

        def see(total, fold, labels, x):
            x = x[:, :width]
            for i, (head, without, weights, bias) in enumerate(known):
                if without == fold:
                    total[i] += ((x @ weights + bias).argmax(1) == labels[:, head]).sum()
        return see

    found = summed(blocks, len(fits), visit)
    sent.destroy()
    return [int(n) for n in found]
