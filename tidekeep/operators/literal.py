"""Small fixed tables and lookups as literals of the plan."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A constant table; it stays on the JVM side and folds to a local scan."""
    structs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def lookup(key: Column, table: dict) -> Column:
    """Value of ``key`` in a small constant map, null when absent."""
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, key)
