"""The audit log as a stream, with the current status of every message beside it.

A batch of the stream owns a folder of the log, named by its number, so a batch delivered again
replaces itself. The status table is keyed: a batch adds the last verdict of the messages it
touches (a delta), and every few batches the deltas are folded into a new base. The latest row per
message by log order wins, whatever the order of batches, so folding changes nothing. A pointer
names the base and the deltas that count and is switched after both log and status are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.review import log_order, reviewed
from ..schemas import AUDIT
from ..sources import versions

STATUS = "message_id string, status string, timestamp string, seq bigint"
#: Deltas that are read beside the base before they are folded into a new one.
FOLD_EVERY = 16


def _last(rows: DataFrame) -> DataFrame:
    """The newest status row per message; hot messages collapse before the shuffle."""
    newest = F.max_by(F.struct("status", "timestamp", "seq"), log_order()).alias("_last")
    return rows.groupBy("message_id").agg(newest).select("message_id", "_last.*")


def _verdicts(batch: DataFrame) -> DataFrame:
    named = [c for c in ("timestamp", "seq") if c in batch.columns]
    missing = {c: F.lit(None).cast(t) for c, t in (("timestamp", "string"), ("seq", "bigint"))
               if c not in named}
    return reviewed(batch).withColumns(missing).select(
        "message_id", F.col("human_verdict").alias("status"), "timestamp",
        F.col("seq").cast("bigint").alias("seq"))


class Ledger:
    """Log and status below one root folder that all executors reach. One stream writes."""

    def __init__(self, spark: SparkSession, root: str, fold_every: int = FOLD_EVERY):
        self.spark, self.root, self.fold_every = spark, root.rstrip("/"), fold_every

    def _state(self) -> dict:
        return versions.current(self.spark, f"{self.root}/status") or {
            "base": None, "deltas": [], "upto": -1}

    def _paths(self, state: dict) -> list[str]:
        names = [*([f"base-{state['base']}"] if state["base"] is not None else []),
                 *[f"delta-{n}" for n in state["deltas"]]]
        return [f"{self.root}/status/{n}" for n in names]

    def keep(self, batch: DataFrame, number: int) -> None:
        """Take one batch in. A number the pointer already covers has been taken in whole and is
        left alone; after a crash half-way the same number overwrites what was begun."""
        state = self._state()
        if number <= state["upto"]:
            return
        batch.write.mode("overwrite").json(f"{self.root}/log/batch-{number}")
        # From the files just written: the batch itself is not computed twice.
        own = self.spark.read.schema(AUDIT).json(f"{self.root}/log/batch-{number}")
        _last(_verdicts(own)).write.mode("overwrite").parquet(
            f"{self.root}/status/delta-{number}")
        state = {**state, "deltas": [*state["deltas"], number], "upto": number}
        old: list[str] = []
        if len(state["deltas"]) >= self.fold_every:
            old = self._paths(state)
            _last(self.spark.read.schema(STATUS).parquet(*old)).write.mode("overwrite").parquet(
                f"{self.root}/status/base-{number}")
            state = {"base": number, "deltas": [], "upto": number, "old": old}
        versions.publish(self.spark, f"{self.root}/status", state)
        if old:
            # Readers of the state before this one may still be at work; those before it are not.
            for path in self._state_before(number):
                versions.remove(self.spark, path)

    def _state_before(self, number: int) -> list[str]:
        """Folders replaced by the fold before the one at ``number``."""
        mark = f"{self.root}/folds"
        before = versions.current(self.spark, mark) or {"old": []}
        versions.publish(self.spark, mark, {"at": number, "old": self._state()["old"]})
        return before["old"]

    def follow(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in everything a stream of log rows has, batch by batch."""
        return (rows.writeStream.foreachBatch(self.keep)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

    def log(self) -> DataFrame:
        """All log rows of batches taken in; a missing log is empty."""
        upto = self._state()["upto"]
        if upto < 0:
            return self.spark.createDataFrame([], AUDIT)
        rows = self.spark.read.schema(AUDIT).option("recursiveFileLookup", True).json(
            f"{self.root}/log")
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/batch-(\d+)/", 1).cast("long")
        return rows.filter(number <= upto)

    def status(self) -> DataFrame:
        """(message_id, status) of every message with a verdict, from base and deltas."""
        paths = self._paths(self._state())
        if not paths:
            return self.spark.createDataFrame([], "message_id string, status string")
        return _last(self.spark.read.schema(STATUS).parquet(*paths)).select("message_id", "status")
