"""Folders of versions with a pointer that is switched last.

A writer fills a folder of its own and then moves a small pointer file over the old one, in one
step of the file system. Readers follow the pointer: they see the old state or the new one, never a
part. One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

POINTER = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> dict | None:
    """What the pointer holds, or None before the first ``publish``."""
    jvm, path, fs = _hadoop(spark, f"{root.rstrip('/')}/{POINTER}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, state: dict) -> None:
    """Switch the pointer to ``state``; everything it names must be written by now."""
    root = root.rstrip("/")
    jvm, path, fs = _hadoop(spark, f"{root}/{POINTER}")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{root}/_{POINTER}.new")
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    finally:
        stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(
        jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(files.makeQualified(fresh), files.makeQualified(path), options)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a version that no pointer names any more."""
    _, target, fs = _hadoop(spark, path)
    fs.delete(target, True)
