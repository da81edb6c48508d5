"""Tabular churn model: Spark ML logistic regression, with boosted trees for comparison."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assess import guard_features
from ..operators.literal import literal_table
from ..schemas import BOOLEAN, NUMERIC
from . import store


def feature_stages() -> list:
    """Standardised numbers and one-hot segment; an unknown segment is all zeros."""
    return [
        VectorAssembler(inputCols=NUMERIC + BOOLEAN, outputCol="_numbers"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        StringIndexer(inputCol="segment", outputCol="_segment", handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["_segment"], outputCols=["_onehot"], dropLast=True),
        VectorAssembler(inputCols=["_scaled", "_onehot"], outputCol="features"),
    ]


def labelled_features(profile: DataFrame) -> DataFrame:
    """Features and label in one projection (no self-join)."""
    guard_features(NUMERIC + BOOLEAN + ["segment"])
    return profile.select(
        "customer_id", *[F.col(c).cast("double").alias(c) for c in NUMERIC + BOOLEAN], "segment",
        F.col("churned").cast("double").alias("label"))


def fit_logistic(profile: DataFrame, c: float = 1.0, max_iter: int = 2000) -> PipelineModel:
    """L2-regularised fit; ``c`` is the inverse strength on the summed loss."""
    train = labelled_features(profile).persist()
    n = max(train.count(), 1)
    fit = Pipeline(stages=[*feature_stages(), LogisticRegression(
        regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
        maxIter=max_iter)]).fit(train)
    train.unpersist()
    return fit


def fit_trees(profile: DataFrame, trees: int = 200, depth: int = 3, rate: float = 0.1,
              seed: int = 42) -> PipelineModel:
    """Boosted trees. The node-id checkpoint interval bounds lineage when a checkpoint folder is
    set."""
    train = labelled_features(profile).persist()
    fit = Pipeline(stages=[*feature_stages(), GBTClassifier(
        maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed,
        checkpointInterval=10)]).fit(train)
    train.unpersist()
    return fit


def scorer(model: PipelineModel):
    """A ``score_book`` scorer: adds ``behaviour`` = P(churn) and keeps the profile columns."""
    def apply(profile: DataFrame) -> DataFrame:
        # ML stages read double copies; the original columns travel along under a prefix.
        carried = profile.select(
            *[F.col(c) for c in profile.columns if c not in NUMERIC + BOOLEAN],
            *[F.col(c).alias(f"_o_{c}") for c in NUMERIC + BOOLEAN],
            *[F.col(c).cast("double").alias(c) for c in NUMERIC + BOOLEAN])
        scored = model.transform(carried)
        return scored.select(
            *[F.col(f"_o_{c}").alias(c) if c in NUMERIC + BOOLEAN else F.col(c)
              for c in profile.columns],
            vector_to_array("probability")[1].alias("behaviour"))
    return apply


def load_or_none(spark, path: str) -> PipelineModel | None:
    """The current saved model, or None so that callers fall back to the prior."""
    return store.load(spark, path, PipelineModel.load)


def save(model: PipelineModel, path: str) -> None:
    """A new version below ``path``; the models loaded from it before are not touched."""
    store.save(SparkSession.active(), path, lambda to: model.write().save(to))


def coefficients(model: PipelineModel, spark) -> DataFrame:
    """Coefficient per feature (four decimals), ascending. A row per feature slot."""
    labels = model.stages[2].labels
    names = [*NUMERIC, *BOOLEAN, *[f"segment_{s}" for s in labels]]
    weights = model.stages[-1].coefficients.toArray().tolist()
    return literal_table(spark, ["feature", "coefficient"],
                         [(n, round(w, 4)) for n, w in zip(names, weights)]).orderBy(
        "coefficient", "feature")


def hard_label(probability: str = "behaviour"):
    return F.when(F.col(probability) >= 0.5, 1).otherwise(0)


def standardised(profile: DataFrame) -> DataFrame:
    """Numeric features as (x - mean) / population deviation, from one aggregate row."""
    columns = NUMERIC + BOOLEAN
    base = profile.select("customer_id", *[F.col(c).cast("double").alias(c) for c in columns])
    stats = base.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns],
                              *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
                     .alias("stats")).scalar()
    wide = base.withColumn("stats", stats)
    return wide.select("customer_id", *[
        ((F.col(c) - F.col(f"stats.m_{c}")) / F.when(F.col(f"stats.s_{c}") == 0, 1.0)
         .otherwise(F.col(f"stats.s_{c}"))).alias(c) for c in columns])
