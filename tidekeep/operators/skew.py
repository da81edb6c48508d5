"""A left join that stays balanced when few keys hold much of the left side."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys holding at least ``share`` of the rows. By arithmetic there are at most 1/share."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_total"))
    return counts.filter(F.col("_n") >= total.scalar() * share).select(key)


def left_join(left: DataFrame, right: DataFrame, key: str, spread_by: str,
              hot_share: float | None = None, salts: int | None = None,
              unmatched: Column | None = None) -> DataFrame:
    """``left`` join ``right`` on ``key``.

    With ``hot_share``, rows of hot keys are spread over ``salts`` values of a hash of
    ``spread_by`` and only the matching right rows of those few keys are repeated that often.
    The hot list is broadcast: ``hot_keys`` bounds it to 1/hot_share rows. Every other key
    keeps salt 0, so the result equals the plain join. Rows without a key, and rows of which
    ``unmatched`` says that ``right`` has no such key, are dealt out evenly: however many they
    are, they meet nothing.
    """
    if hot_share is None:
        return left.join(right, key, "left")
    salts = salts or max(2, math.ceil(4 / hot_share))
    hot = F.broadcast(hot_keys(left, key, hot_share).withColumn("_hot", F.lit(True)))
    alone = F.col(key).isNull()
    if unmatched is not None:
        alone = alone | F.coalesce(unmatched, F.lit(False))
    dealt = F.pmod(F.xxhash64(spread_by), F.lit(salts))
    salted_left = left.join(hot, key, "left").withColumn(
        "_salt", F.when(alone, dealt + 1).when(F.col("_hot"), dealt)
        .otherwise(F.lit(0).cast("bigint"))).drop("_hot")
    salted_right = right.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0).cast("bigint"),
                                                            F.lit(salts - 1).cast("bigint")))
                           .otherwise(F.array(F.lit(0).cast("bigint"))))).drop("_hot")
    return salted_left.join(salted_right, [key, "_salt"], "left").drop("_salt")
