"""Regularised logistic regression to working precision, by Newton steps over aggregates.

The churn model has a few well-known inputs, so its gradient and Hessian are about a hundred sums.
Each step is one grouped sum over the written inputs, combined map-side, of which those sums
reach the driver; the driver solves the small system. Unlike a fit that stops at a tolerance
of the loss, the result does not depend on the optimiser: ``optimality`` proves it from the data.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.assess import guard_features
from ..operators.literal import literal_table
from ..schemas import BOOLEAN, NUMERIC, SEGMENTS
from ..session import written
from . import store

INPUTS = NUMERIC + BOOLEAN
FEATURES = [*INPUTS, *[f"segment_{s}" for s in SEGMENTS]]
MAX_STEPS = 40
#: A step below this, in standard deviations of the inputs, is the last: the error left is of the
#: order of its square.
STEP = 1e-8


@dataclass(frozen=True)
class LogisticFit:
    """Weights of standardised inputs and segment dummies; ``strength`` is 1/C of the penalty."""

    means: list[float]
    scales: list[float]
    weights: list[float]
    intercept: float
    strength: float
    rows: int
    steps: int
    features: list[str] = field(default_factory=lambda: list(FEATURES))

    def save(self, spark, path: str) -> None:
        """A new version below ``path``, as one JSON row."""
        row = spark.createDataFrame([(json.dumps(asdict(self)),)], "fit string")
        store.save(spark, path, lambda to: row.write.text(to))

    @classmethod
    def load(cls, spark, path: str) -> LogisticFit | None:
        """The current saved fit, or None so that callers fall back to the prior."""
        return store.load(spark, path, lambda at: cls(
            **json.loads(spark.read.text(at).filter("value <> ''").first()["value"])))

    def columns(self) -> list[Column]:
        """The design columns, named x0, x1, ...; an unknown segment is all zeros."""
        return design(self.means, self.scales)

    def logit(self) -> Column:
        z = F.lit(self.intercept)
        for w, x in zip(self.weights, self.columns()):
            z = z + F.lit(w) * x
        return z

    def __call__(self, profile: DataFrame) -> DataFrame:
        """A ``score_book`` scorer: one JVM expression per row, no model stage."""
        return profile.withColumn("behaviour", sigmoid(self.logit()))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def design(means: list[float], scales: list[float]) -> list[Column]:
    numbers = [(F.col(c).cast("double") - F.lit(m)) / F.lit(s)
               for c, m, s in zip(INPUTS, means, scales)]
    dummies = [F.coalesce((F.col("segment") == s).cast("double"), F.lit(0.0)) for s in SEGMENTS]
    return numbers + dummies


def _complete(profile: DataFrame) -> DataFrame:
    """Inputs and outcome of the rows that have all numbers and an outcome."""
    wanted = [*INPUTS, "churned"]
    return profile.select(*wanted, "segment").dropna(subset=wanted)


def _moments(profile: DataFrame) -> tuple[int, list[float], list[float]]:
    """Rows, means and population deviations; an input that never varies has deviation 1."""
    row = profile.agg(F.count("*").alias("n"), *[
        f(F.col(c).cast("double")).alias(f"{name}_{c}") for c in INPUTS
        for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return row["n"], [row[f"m_{c}"] for c in INPUTS], [row[f"s_{c}"] or 1.0 for c in INPUTS]


def _sums(table: DataFrame, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the summed log loss at ``theta`` (weights, intercept)."""
    d = len(theta)
    x = [F.col(f"x{k}") for k in range(d - 1)] + [F.lit(1.0)]
    # The weights as one array: numbers in the expressions would compile every step anew.
    products = F.zip_with(F.array(*x), F.lit(theta.tolist()), lambda a, b: a * b)
    z = F.aggregate(products, F.lit(0.0), lambda total, e: total + e)
    rows = table.withColumn("z", z).withColumn("p", sigmoid(F.col("z"))).withColumn(
        "w", F.col("p") * (1.0 - F.col("p")))
    # log(1 + exp(z)) without overflow.
    loss = F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("y") * F.col("z")
    # A row per weight, one for the error and one for the loss, each summed times every input: a
    # hundred sums side by side would outgrow compiled code.
    terms = [*[F.col("w") * xi for xi in x], F.col("p") - F.col("y"), loss]
    found = rows.select(F.posexplode(F.array(*terms)).alias("term", "u"),
                        *[f"x{k}" for k in range(d - 1)]).groupBy("term").agg(
        F.array(*[F.sum(F.col("u") * xi) for xi in x]).alias("sums")).collect()
    sums = {r["term"]: np.array(r["sums"]) for r in found}
    return sums[d + 1][-1], sums[d], np.array([sums[i] for i in range(d)])


def fit(profile: DataFrame, c: float = 1.0) -> LogisticFit:
    """The minimum of summed log loss + |weights|^2 / (2 c); the intercept is free.

    Rows with a null input or outcome are left out. A table without rows, or with one outcome only,
    has no minimum and raises.
    """
    guard_features([*INPUTS, "segment"])
    known = written(_complete(profile), "fit-rows")
    n, means, scales = _moments(known)
    if not n:
        raise ValueError("no rows to fit")
    table = known.select(F.col("churned").cast("double").alias("y"), *[
        x.alias(f"x{k}") for k, x in enumerate(design(means, scales))])
    d = len(FEATURES) + 1
    penalty = np.append(np.full(d - 1, 1.0 / c), 0.0)
    theta, best, step = np.zeros(d), np.inf, np.zeros(d)
    for k in range(1, MAX_STEPS + 1):
        loss, gradient, hessian = _sums(table, theta)
        loss += float(penalty @ theta ** 2) / 2
        if k == 1 and abs(gradient[-1]) == n / 2:
            raise ValueError("one outcome only: the intercept has no minimum")
        if loss > best * (1 + 1e-12):
            step = step / 2
            theta = theta - step
            continue
        best = loss
        step = np.linalg.solve(hessian + np.diag(penalty), -(gradient + penalty * theta))
        theta = theta + step
        if np.abs(step).max() < STEP:
            break
    return LogisticFit(means, scales, theta[:-1].tolist(), float(theta[-1]), 1.0 / c, n, k)


def coefficients(model: LogisticFit, spark) -> DataFrame:
    """(feature, coefficient), a row per input and one for the intercept."""
    return literal_table(spark, ["feature", "coefficient"], [
        *zip(model.features, model.weights), ("(intercept)", model.intercept)])


def optimality(model: LogisticFit, profile: DataFrame) -> DataFrame:
    """(feature, gradient): the derivative of the penalised loss per row at the fitted weights,
    from the data the model was fitted on. All are zero at the minimum and nowhere else, because
    the loss is strictly convex."""
    rows = _complete(profile).select(
        (sigmoid(model.logit()) - F.col("churned").cast("double")).alias("e"),
        *[x.alias(f"x{k}") for k, x in enumerate(model.columns())])
    names = [*model.features, "(intercept)"]
    columns = [*[F.col(f"x{k}") for k in range(len(model.features))], F.lit(1.0)]
    pulls = [*[model.strength * w for w in model.weights], 0.0]
    sums = rows.agg(F.count("*").alias("n"), *[
        F.sum(F.col("e") * x).alias(f"g{k}") for k, x in enumerate(columns)])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("feature"),
                 ((F.col(f"g{k}") + F.lit(pull)) / F.col("n")).alias("gradient"))
        for k, (name, pull) in enumerate(zip(names, pulls))])))
