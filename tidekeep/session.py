"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# Adaptive execution re-plans joins from measured sizes and splits skewed partitions, so no
# join in the package carries a broadcast hint for data that grows.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def build_session(app: str = "tidekeep", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    The setting names storage every executor can reach. Only a local master, where driver and
    executors are one machine, may go without it; its folder goes when the program ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="tidekeep-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df, purpose: str = "stage"):
    """Write ``df`` once to the shared folder and read it back.

    For a narrow result of an expensive scan that several later stages read. Unlike cached
    blocks the files survive the loss of an executor.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def find_package(spark: SparkSession) -> None:
    """Workers find this package also where it is not installed: the source folder joins their
    module path. On a cluster ship the package with ``--py-files``."""
    paths = spark.sparkContext.environment
    known = paths.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(x for x in (known, ROOT) if x)


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers find this package."""
    find_package(df.sparkSession)
    return df.mapInArrow(fn, schema)
