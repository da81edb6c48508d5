"""Exact deduplication as a stateful stream.

A stream over the Parquet files of a folder keys every text by the digest of its normal form. The
state, kept on disk by RocksDB and never expired, holds per digest the number of rows, the row that
stays so far (the longest original text, then the smallest id) and where its bytes lie: file and row
number. Further files go through the same state, after any restart.

A hit is a row that meets another one at its digest. Digests alone prove nothing, so the bytes of
every hit are compared with those of the row that stays, read again through its locator; digests
that stand for several texts are then grouped by the texts themselves. Texts are never part of the
state; those of hits are written once and exchanged, the others are not.

DataFrame functions throughout; the only rows that reach the driver are two counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_dir
from .frames import written

#: Deleted from a text before it is compared: blank, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of files that one micro-batch takes: what a lost driver has to do again.
BATCH_BYTES = 64 << 30
#: A digest with this share of all rows is spread over several tasks.
HOT_SHARE = 1 / 1024
#: Places of the filter that finds texts of hits at the scan: at most 2**21 words are broadcast.
FILTER_BITS = 27

STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # Else each of the many small stores sets aside megabytes of disk for its logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

Digest = Callable[[Column], Column]


def sha256(normal: Column) -> Column:
    return F.unhex(F.sha2(normal, 256))


def normal_form(text: Column) -> Column:
    """The text without blanks; a null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def keyed(rows: DataFrame, key: str, text: str, digest: Digest) -> DataFrame:
    """(digest, normal, place): what the order of a group and the locator need. Of two places the
    smaller stays: more code points, then a smaller id (null last), then file and row."""
    normal = normal_form(F.col(text))
    return rows.select(
        digest(normal).alias("digest"), normal.alias("normal"),
        F.struct((-F.coalesce(F.char_length(text), F.lit(0))).alias("size"),
                 F.col(key).isNull().alias("no_key"), F.col(key).alias("key"),
                 F.col("_metadata.file_path").alias("file"),
                 F.col("_metadata.row_index").alias("row")).alias("place"))


def follow(spark: SparkSession, path: str, checkpoint: str, key: str = "doc_id",
           text: str = "text", digest: Digest = sha256,
           batch_bytes: int = BATCH_BYTES) -> StreamingQuery:
    """Run all files not yet seen through the state below ``checkpoint``, a shared folder."""
    schema = spark.read.parquet(path).schema
    # A file source follows folders; as a pattern the path may also be a single file.
    pattern = f"{path[:-1]}[{path[-1]}]"
    rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(
        pattern)
    groups = keyed(rows, key, text, digest).groupBy("digest").agg(
        F.min("place").alias("first"), F.count("*").alias("n"))
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        return (groups.writeStream.format("noop").outputMode("update")
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, first, n) as the stream left them: a row per digest."""
    kept = spark.read.format("statestore").load(checkpoint)
    names = ["size", "no_key", "key", "file", "row"]
    fields = kept.schema["value"].dataType["min"].dataType.names
    return kept.select("key.digest", F.struct(*[
        F.col(f"value.min.{f}").alias(n) for f, n in zip(fields, names)]).alias("first"),
        F.col("value.count").alias("n"))


def spread(groups: DataFrame, rows: int) -> DataFrame:
    """The groups with the number of tasks each is dealt to: 1, or for a hot one its rows by the
    hot number of rows. Together at most 2 / HOT_SHARE more than there are groups."""
    hot = max(1.0, rows * HOT_SHARE)
    return groups.withColumn("salts", F.ceil(F.col("n") / F.lit(hot)).cast("int"))


def meet(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (with digest and place) joined to ``groups`` (with digest and salts) by digest. Rows
    of hot groups are dealt by their place; the hot list is broadcast, 1 / HOT_SHARE rows at most."""
    hot = F.broadcast(groups.filter("salts > 1").select("digest", F.col("salts").alias("_of")))
    dealt = rows.join(hot, "digest", "left").withColumn("_salt", F.coalesce(F.pmod(
        F.xxhash64("place.file", "place.row"), F.col("_of")).cast("int"), F.lit(0))).drop("_of")
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return dealt.join(copies.drop("salts"), ["digest", "_salt"]).drop("_salt")


def marked(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with ``normal`` null but in groups of two and more, and few others: the hashes of
    such digests set bits in 64-bit words, of which there are 2**21 at most, and those are sent to
    the scan. More digests than bits let more texts pass, none is lost."""
    def at() -> Column:
        return F.xxhash64("digest").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))

    def bit(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"),
                               place.bitwiseAND(F.lit(63)).cast("int"))
    words = groups.filter("n > 1").groupBy(F.shiftright(at(), 6).alias("_word")).agg(
        F.bit_or(bit(at())).alias("_bits"))
    return rows.withColumn("_word", F.shiftright(at(), 6)).join(
        F.broadcast(words), "_word", "left").select("digest", "place", F.when(
            F.col("_bits").bitwiseAND(bit(at())) != 0, F.col("normal")).alias("normal"))


def differing(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests that stand for more than one text: the normal form of every hit is compared, byte by
    byte, with that of the row that stays."""
    several = groups.filter("n > 1")
    hits = rows.filter(F.col("normal").isNotNull())
    stays = F.col("place.file").eqNullSafe(F.col("first.file")) & F.col("place.row").eqNullSafe(
        F.col("first.row"))
    firsts = meet(hits, several.select("digest", "salts", "first")).filter(stays).select(
        "digest", F.col("normal").alias("_first")).join(
        several.select("digest", "salts"), "digest")
    return meet(hits, firsts).filter(F.col("normal") != F.col("_first")).select(
        "digest").distinct()


def decided(rows: DataFrame, groups: DataFrame) -> DataFrame:
    found = meet(rows.drop("normal"), groups)
    return found.select(
        F.col("place.key").alias("key"), F.col("first.key").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("place.file") == F.col("first.file")) & (F.col("place.row") == F.col("first.row")))
        .alias("kept"), "digest")


def by_text(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """``decided`` for rows of digests that stand for several texts, grouped by the texts."""
    own = rows.join(digests, "digest", "left_semi")
    groups = own.groupBy("digest", "normal").agg(F.min("place").alias("first"),
                                                 F.count("*").alias("n"))
    return own.join(groups, ["digest", "normal"]).select(
        F.col("place.key").alias("key"), F.col("first.key").alias("keep_id"),
        F.col("n").alias("group_size"), (F.col("place") == F.col("first")).alias("kept"), "digest")


def resolve(spark: SparkSession, path: str, checkpoint: str, key: str = "doc_id",
            text: str = "text", digest: Digest = sha256) -> DataFrame:
    """(key, keep_id, group_size, kept, digest) for every row of the files that the stream below
    ``checkpoint`` has seen."""
    found = written(state(spark, checkpoint), "dedup-groups")
    groups = spread(found, found.agg(F.sum("n")).first()[0] or 0)
    rows = keyed(spark.read.parquet(path), key, text, digest)
    rows = written(marked(rows, groups), "dedup-rows")
    clashes = written(differing(rows, groups), "dedup-clashes")
    if clashes.isEmpty():
        out = decided(rows, groups)
    else:
        sure = rows.join(clashes, "digest", "left_anti")
        out = decided(sure, groups).unionByName(by_text(rows, clashes))
    return out.withColumnRenamed("key", key)


def dedup(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text",
          digest: Digest = sha256, batch_bytes: int = BATCH_BYTES,
          checkpoint: str | None = None) -> DataFrame:
    """(key, keep_id, group_size, kept, digest), one row per row of the Parquet files at ``path``.

    Texts are equal when they are the same bytes after blanks are deleted; a null text counts as
    empty and is equal to a text of blanks. Of each group the row with the most code points stays,
    then the smallest key (null last), of repeated rows the first by file and row number; exactly
    one row per group has ``kept``. Keys need not be unique. An empty table gives no rows; other
    columns are not read, whatever their names. With ``checkpoint``, the state of an earlier call
    goes on and only new files are streamed.
    """
    checkpoint = checkpoint or shared_dir(spark, "dedup-state")
    follow(spark, path, checkpoint, key, text, digest, batch_bytes).awaitTermination()
    return resolve(spark, path, checkpoint, key, text, digest)
