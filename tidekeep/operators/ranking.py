"""Exact global ranks and running totals without a single-task window.

``row_number() over (order by ...)`` pulls the whole table into one task. Here rows fall into
ordered cells; cell sizes are summed first (a small aggregate), and the position inside a cell
is the only thing a window computes.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_HEX = 3  # hex digits of the tie hash per cell: 4096 cells for every level


def tie_hash(key: str | Column) -> Column:
    return F.md5(F.col(key).cast("string") if isinstance(key, str) else key)


def rank_rows(df: DataFrame, level: Column, key: str, output: str = "rank") -> DataFrame:
    """Rank by ``level`` ascending, ties by md5 of ``key``, then ``key``.

    ``level`` must take a bounded number of values (a rounded score). Even one level holding
    most rows is spread over the cells of its hash.
    """
    named = df.withColumns({"_level": level, "_tie": tie_hash(key)}).withColumn(
        "_cell", F.substring("_tie", 1, _HEX))
    cells = named.groupBy("_level", "_cell").agg(F.count("*").alias("_n"))
    levels = cells.groupBy("_level").agg(F.sum("_n").alias("_level_n"))
    before_level = levels.select("_level", (F.sum("_level_n").over(
        W.orderBy("_level")) - F.col("_level_n")).alias("_before_level"))
    within = cells.select("_level", "_cell", (F.sum("_n").over(
        W.partitionBy("_level").orderBy("_cell")) - F.col("_n")).alias("_before_cell"))
    offsets = within.join(before_level, "_level").select(
        "_level", "_cell", (F.col("_before_level") + F.col("_before_cell")).alias("_before"))
    position = F.row_number().over(W.partitionBy("_level", "_cell").orderBy("_tie", key))
    return (named.withColumn("_pos", position).join(offsets, ["_level", "_cell"])
            .withColumn(output, (F.col("_before") + F.col("_pos")).cast("bigint"))
            .select(*df.columns, output))


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """A page of a ranking: per-partition heaps of size n, never a full sort."""
    return df.orderBy(*order).limit(n)


def running_totals(df: DataFrame, key: str, values: list[str], cells: int = 256) -> DataFrame:
    """Exclusive running sums of ``values`` in ascending ``key`` order.

    ``key`` is a unique double. Cell borders are approximate quantiles (``cells`` numbers on the
    driver), which only affects balance; the sums are exact for any borders.
    """
    probes = [i / cells for i in range(1, cells)]
    borders = sorted(set(df.approxQuantile(key, probes, 0.5 / cells)))
    split = Bucketizer(splits=[float("-inf"), *borders, float("inf")], inputCol=key,
                       outputCol="_cell")
    celled = split.transform(df)
    totals = celled.groupBy("_cell").agg(*[F.sum(v).alias(f"_cell_{v}") for v in values])
    before = totals.select("_cell", *[
        (F.sum(f"_cell_{v}").over(W.orderBy("_cell")) - F.col(f"_cell_{v}")).alias(f"_off_{v}")
        for v in values])
    inside = W.partitionBy("_cell").orderBy(key)
    run = celled.select(*df.columns, "_cell", *[
        (F.sum(v).over(inside) - F.col(v)).alias(f"_in_{v}") for v in values])
    return run.join(before, "_cell").select(*df.columns, *[
        (F.col(f"_in_{v}") + F.col(f"_off_{v}")).alias(f"{v}_before") for v in values])
