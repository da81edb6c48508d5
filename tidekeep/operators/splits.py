"""Deterministic stratified splits without per-stratum sorting.

``ceil(ratio * rows)`` rows are held out in all, shared out to the strata in proportion with the
left-over rows going to the largest remainders. Within a stratum the rows with the smallest md5
of their key are taken. Only the key at the last such position is looked up (in the one hash cell
that contains it); membership is then a comparison, so the rows themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import written

_HEX = 3


def _order_key(key: str) -> Column:
    return F.concat(F.md5(F.col(key).cast("string")), F.col(key).cast("string"))


def quotas(cells: DataFrame, ratio: float) -> DataFrame:
    """(stratum, need) from counts per stratum; whole-number arithmetic, ties by stratum."""
    strata = cells.groupBy("_stratum").agg(F.sum("_n").alias("_n"))
    n, total = F.col("_n"), F.sum("_n").over(W.partitionBy())
    sized = strata.select("_stratum", n, total.alias("_total"),
                          F.ceil(total * F.lit(float(ratio))).alias("_take"))
    based = sized.select(
        "_stratum", "_take", F.expr("_n * _take div _total").alias("_base"),
        (F.col("_n") * F.col("_take") % F.col("_total")).alias("_rest"))
    order = W.orderBy(F.col("_rest").desc(), "_stratum")
    spare = F.col("_take") - F.sum("_base").over(W.partitionBy())
    return based.select("_stratum", (F.col("_base") + F.when(
        F.row_number().over(order) <= spare, 1).otherwise(0)).alias("_need"))


def cut_points(df: DataFrame, stratum: Column, key: str, ratio: float) -> DataFrame:
    """(stratum, cut): largest order key of the held-out part of each stratum.

    Everything before the last join works on counts: at most 4096 per stratum, one per stratum
    for the quotas. The counts are written once, because they are read three times.
    """
    keyed = df.select(stratum.alias("_stratum"), _order_key(key).alias("_k")).withColumn(
        "_cell", F.substring("_k", 1, _HEX))
    cells = written(keyed.groupBy("_stratum", "_cell").agg(F.count("*").alias("_n")), "cells")
    per = W.partitionBy("_stratum")
    placed = cells.select("_stratum", "_cell", "_n", F.sum("_n").over(
        per.orderBy("_cell")).alias("_upto")).join(quotas(cells, ratio), "_stratum")
    target = placed.filter((F.col("_upto") >= F.col("_need"))
                           & (F.col("_upto") - F.col("_n") < F.col("_need"))).select(
        "_stratum", "_cell", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_nth"))
    position = F.row_number().over(W.partitionBy("_stratum", "_cell").orderBy("_k"))
    return (keyed.join(target, ["_stratum", "_cell"]).withColumn("_pos", position)
            .filter(F.col("_pos") == F.col("_nth"))
            .select("_stratum", F.col("_k").alias("_cut")))


def stratified_split(df: DataFrame, stratum: Column, key: str, ratio: float,
                     output: str = "held_out", among: Column | None = None) -> DataFrame:
    """Adds a boolean column; ``key`` must be unique. With ``among`` only those rows are split
    and all others get false, so nested splits need no join of the rows.

    Counting and finding the cuts runs at once, not lazily: both are written tables, one row per
    cell and per stratum. Their measured size decides how the cuts are joined.
    """
    pool = df if among is None else df.filter(among)
    cuts = written(cut_points(pool, stratum, key, ratio), "cuts")
    marked = df.withColumns({"_stratum": stratum, "_k": _order_key(key)})
    taken = F.coalesce(F.col("_k") <= F.col("_cut"), F.lit(False))
    return (marked.join(cuts, "_stratum", "left")
            .withColumn(output, taken if among is None else among & taken)
            .select(*df.columns, output))


def message_stratum() -> Column:
    return F.concat_ws("_", "issue_type", "churn_signal")
