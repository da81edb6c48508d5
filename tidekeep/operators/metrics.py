"""Classifier metrics as aggregates over (truth, prediction) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .literal import literal_table
from .ranking import running_totals


def accuracy(scored: DataFrame, keys: list[str], hits: dict[str, Column],
             by: str = "language") -> DataFrame:
    """n and hit rates per ``keys``, overall and per ``by``.

    Rows are counted once per (keys, by); the overall rows add those few counts up.
    """
    counts = scored.groupBy(*keys, by).agg(F.count("*").alias("_n"), *[
        F.count_if(h).alias(f"_{name}") for name, h in hits.items()])
    sets = [[F.col(k) for k in keys], [F.col(k) for k in [*keys, by]]]
    rolled = counts.groupingSets(sets, *keys, by).agg(
        F.grouping(by).cast("int").alias("_overall"), F.sum("_n").alias("n"),
        *[F.sum(f"_{name}").alias(f"_{name}") for name in hits])
    return rolled.select(
        *keys, F.when(F.col("_overall") == 1, F.lit("(all)")).otherwise(F.col(by)).alias(by), "n",
        *[(F.col(f"_{name}").cast("double") / F.col("n")).alias(name) for name in hits])


def label_pairs(spark, labels: list) -> DataFrame:
    return literal_table(spark, ["actual", "predicted"],
                         [(a, p) for a in labels for p in labels])


def confusion(scored: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """Long confusion matrix over fixed labels; absent pairs count 0."""
    counts = scored.groupBy(F.col(actual).alias("actual"),
                            F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return label_pairs(scored.sparkSession, labels).join(
        counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def class_report(scored: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """Precision, recall, F1 and support per label, plus accuracy, macro and weighted rows.

    The data is aggregated once to label pairs; all the rest works on that handful of rows.
    """
    pairs = confusion(scored, actual, predicted, labels)
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("called"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
                 .alias("tp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("called"), F.lit(0).cast("bigint").alias("tp")))))
    sums = sides.groupBy(F.col("label").cast("string").alias("label")).agg(
        F.sum("tp").alias("tp"), F.sum("called").alias("called"),
        F.sum("support").alias("support"))
    tp, called, support = F.col("tp"), F.col("called"), F.col("support")
    per = sums.select("label", _ratio(tp, called).alias("precision"),
                      _ratio(tp, support).alias("recall"),
                      _ratio(2 * tp, called + support).alias("f1"), "support", "tp")
    whole = F.sum("support").cast("double")
    names = ["precision", "recall", "f1"]
    average = per.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[_ratio(F.sum(F.col(m) * support), F.sum("support")).alias(f"weighted_{m}")
          for m in names],
        _ratio(F.sum("tp"), whole).alias("accuracy"), F.sum("support").alias("total"))

    def row(label: str, *values: Column) -> Column:
        return F.struct(F.lit(label).alias("label"),
                        *[v.alias(m) for v, m in zip(values, names)],
                        F.col("total").alias("support"))
    a = F.col
    totals = average.select(F.inline(F.array(
        row("accuracy", a("accuracy"), a("accuracy"), a("accuracy")),
        row("macro avg", *[a(f"macro_{m}") for m in names]),
        row("weighted avg", *[a(f"weighted_{m}") for m in names]))))
    return per.drop("tp").unionByName(totals)


def roc_auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve with ties counted half.

    Rows collapse to distinct scores first, written once because borders, cell sums and
    positions each read them; pairs won are running sums over them.
    """
    points = scored.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum(1 - F.col(label).cast("bigint")).alias("neg"))
    run = running_totals(written(points, "scores"), "score", ["neg"])
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + 0.5 * F.col("neg")))
    return run.agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))
