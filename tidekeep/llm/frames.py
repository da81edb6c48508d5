"""Helpers shared by the corpus operators: reading tables, Arrow stages, buffers of text columns."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Texts of one Arrow batch are worked on in pieces of about this many bytes.
PIECE_BYTES = 4 << 20

_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def find_package(spark: SparkSession) -> None:
    """Workers find this package also where it is not installed: the source folder joins their
    module path. On a cluster ship the package with ``--py-files``."""
    paths = spark.sparkContext.environment
    known = paths.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(x for x in (known, ROOT) if x)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` whose workers find this package."""
    find_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def written(df: DataFrame, purpose: str, release: bool = False) -> DataFrame:
    """Write once to the folder all executors share and read it back; this cuts the lineage, and
    the files outlive any executor. With ``release`` the shuffle files behind it go when it is
    written, not when the driver happens to collect its garbage."""
    path = shared_dir(df.sparkSession, purpose)
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_RELEASE, "false")
    conf.set(_RELEASE, "true" if release else before)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_RELEASE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    flat = column.cast(pa.large_binary())
    flat = flat.fill_null(b"") if flat.null_count else flat
    _, offsets, data = flat.buffers()
    bounds = np.frombuffer(offsets, np.int64)[flat.offset:flat.offset + len(flat) + 1]
    if data is None or not len(flat):
        return np.zeros(0, np.uint8), np.zeros(len(flat) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def bounded(batches: Iterator[pa.RecordBatch], column: int,
            most: int = 2 * PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut where the texts of a column reach about ``most`` bytes; at least a row."""
    for b in batches:
        sizes = np.diff(text_bytes(b.column(column))[1])
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(b)]
        for a, z in zip(cuts, cuts[1:]):
            if z > a or not len(b):
                yield b.slice(a, z - a)


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def batch(names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names=names)
