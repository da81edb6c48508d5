"""Model comparison and data-quality checks over evaluation sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import accuracy

HITS = {"issue_acc": ("issue_type", "pred_issue"), "signal_acc": ("churn_signal", "pred_signal")}


def predictions(labelled: DataFrame, model: str, dataset: str) -> DataFrame:
    """Labels of one model on one data set, keyed by message."""
    return labelled.select(F.lit(model).alias("model"), F.lit(dataset).alias("dataset"),
                           "message_id", F.col("issue_type").alias("pred_issue"),
                           F.col("churn_signal").alias("pred_signal"))


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def with_truth(preds: DataFrame, messages: DataFrame) -> DataFrame:
    return preds.join(messages.select("message_id", "language", "issue_type", "churn_signal"),
                      "message_id")


def bakeoff(scored: DataFrame) -> DataFrame:
    """Accuracies per model and data set, overall and per language."""
    hits = {n: F.col(a) == F.col(p) for n, (a, p) in HITS.items()}
    return accuracy(scored, ["model", "dataset"], hits)


def bakeoff_table(report: DataFrame, datasets: list[str]) -> DataFrame:
    """One wide row per model from the overall rows."""
    overall = report.filter(F.col("language") == "(all)")
    return overall.groupBy("model").agg(*[
        F.max(F.when(F.col("dataset") == d, F.col(m))).alias(f"{d}_{m}")
        for d in datasets for m in HITS])


def report_grid(scored: DataFrame) -> DataFrame:
    """Every model x data set cell with its row count, 0 for cells not run.

    Both axes are distinct values of a small aggregate, held as two arrays of one row.
    """
    cells = scored.groupBy("model", "dataset").agg(F.count("*").alias("n"))
    axes = cells.agg(F.collect_set("model").alias("m"), F.collect_set("dataset").alias("d"))
    grid = axes.select(F.explode("m").alias("model"), "d").select(
        "model", F.explode("d").alias("dataset"))
    return grid.join(cells, ["model", "dataset"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)).cast("bigint"))


def shared_texts(a: DataFrame, b: DataFrame, text: str = "text") -> DataFrame:
    """Distinct texts present in both sets, by SHA-256 digest (leakage; must be empty).

    Only digests go through the shuffle, whatever the length of the texts.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.select(F.sha2(text, 256).alias("digest")).distinct()
    return keyed(a).join(keyed(b), "digest", "left_semi")


def cell_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("issue_type", "churn_signal").agg(F.count("*").alias("n"))


def unbalanced_cells(messages: DataFrame, per_cell: int) -> DataFrame:
    return cell_counts(messages).filter(F.col("n") != per_cell)


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and column value; fixed columns, zero where absent."""
    wide = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    return wide.na.fill(0, [str(v) for v in values])


def row_shares(counts: DataFrame, row: str) -> DataFrame:
    """A crosstab as shares of its rows, two decimals."""
    columns = [c for c in counts.columns if c != row]
    total = sum((F.col(c) for c in columns), F.lit(0))
    return counts.select(row, *[
        (F.rint(F.col(c).cast("double") / total * 100.0) / 100.0).alias(c) for c in columns])


def driver_means(profile: DataFrame) -> DataFrame:
    return profile.groupBy("churned").agg(
        F.avg("balance_trend_3m").alias("balance_trend_3m"),
        F.avg(F.col("salary_credit_active").cast("double")).alias("salary_credit_active"),
        F.avg(F.col("intl_transfer_spike").cast("double")).alias("intl_transfer_spike"))


def orphans(messages: DataFrame, profile: DataFrame) -> DataFrame:
    """Messages of customers without a profile."""
    return messages.join(profile.select("customer_id"), "customer_id", "left_anti")
