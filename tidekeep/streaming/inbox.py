"""Live inbox and audit log as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lexicon import DEFAULT, Lexicon
from ..operators.assess import Scorer
from ..plans.queue import build_queue
from ..session import shared_dir
from .ledger import Ledger


def read_stream(spark: SparkSession, path: str, schema: T.StructType,
                fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def score_stream(messages: DataFrame, profile: DataFrame, scorer: Scorer | None = None,
                 lex: Lexicon = DEFAULT, classify=None) -> DataFrame:
    """The queue plan on a stream: map-only expressions and one stream-static left join."""
    return build_queue(messages, profile, scorer, lex, classify)


def without_repeats(messages: DataFrame, time: str = "ts", delay: str = "1 day",
                    key: str = "message_id") -> DataFrame:
    """Drops repeated deliveries; state is kept for ``delay`` only."""
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def high_risk_windows(cases: DataFrame, time: str = "ts", width: str = "1 day",
                      delay: str = "1 day") -> DataFrame:
    """Customers at high or critical risk per tumbling window.

    A customer counts once per window: repeats are dropped on (window, customer) before the
    count, which streams allow where count(distinct) is not.
    """
    risky = cases.filter(F.col("risk_band").isin("High", "Critical")).withWatermark(time, delay)
    once = risky.select(F.window(time, width).alias("window"), "customer_id",
                        F.col(time)).dropDuplicates(["window", "customer_id"])
    return once.groupBy("window").agg(F.count("*").alias("customers"))


def trend_table(cases: DataFrame, purpose: str, time: str = "ts",
                delay: str = "1 day") -> DataFrame:
    """(day, customers, is_final) of everything available, the open days included.

    Each micro-batch leaves the (day, customer) pairs at high or critical risk and its latest time
    in a folder named after the batch, so a repeated batch replaces itself. Pairs are counted when
    the table is read. A day is final once the latest time lies ``delay`` past its end.
    """
    spark = cases.sparkSession
    out, checkpoint = shared_dir(spark, purpose), shared_dir(spark, f"{purpose}-offsets")
    day = F.to_date(time)
    seen = cases.select(day.alias("day"), F.when(
        F.col("risk_band").isin("High", "Critical"), F.col("customer_id")).alias("customer_id"),
        F.col(time).alias("latest"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy("day", "customer_id").agg(F.max("latest").alias("latest")).write.mode(
            "overwrite").parquet(f"{out}/batch={number}")

    seen.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    rows = spark.read.schema(seen.schema).parquet(out)
    latest = rows.agg(F.max("latest").alias("latest"))
    counted = rows.filter("customer_id is not null").select("day", "customer_id").distinct() \
        .groupBy("day").agg(F.count("*").alias("customers"))
    end = F.col("day").cast("timestamp") + F.expr("interval 1 day") + F.expr(f"interval {delay}")
    return counted.withColumn("is_final", end <= latest.scalar())


def drain(stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Process everything available into a parquet table in the shared folder and return it."""
    spark = stream.sparkSession
    out, checkpoint = shared_dir(spark, purpose), shared_dir(spark, f"{purpose}-offsets")
    query = (stream.writeStream.format("parquet").outputMode(mode)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def score_batches(messages: DataFrame, profile: DataFrame, purpose: str,
                  scorer: Scorer | None = None, lex: Lexicon = DEFAULT, classify=None,
                  hot_share: float = 1 / 64) -> DataFrame:
    """The queue of everything available, with hot customers split in every micro-batch.

    A stream-static join is not re-planned for skew. Here each batch is a plain table: customers
    above ``hot_share`` of *its* messages are counted anew and salted, and messages that no profile
    can match are dealt out evenly. A batch owns a folder, so a repeated batch replaces itself.
    """
    spark = messages.sparkSession
    out, checkpoint = shared_dir(spark, purpose), shared_dir(spark, f"{purpose}-offsets")
    shape = build_queue(messages, profile, scorer, lex, classify).schema

    def keep(batch: DataFrame, number: int) -> None:
        build_queue(batch, profile, scorer, lex, classify, hot_share=hot_share).write.mode(
            "overwrite").parquet(f"{out}/batch-{number}")

    messages.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(shape).option("recursiveFileLookup", True).parquet(out)


def log_stream(rows: DataFrame, log_path: str, checkpoint: str):
    """Append a stream of log rows; a repeated batch changes nothing (see ``Ledger``)."""
    return Ledger(rows.sparkSession, log_path).follow(rows, checkpoint)


def current_status(spark: SparkSession, log_path: str) -> DataFrame:
    return Ledger(spark, log_path).status()
