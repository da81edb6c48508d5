"""A filter of bounded size for the keys a join will keep, applied at the scan of its big side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of the filter: hashes of keys set bits in at most 2**21 words of 64 bits.
PLACES = 27


def may_match(rows: DataFrame, keys: DataFrame, key: str, places: int = PLACES) -> DataFrame:
    """The rows whose key is among ``keys``, and few others, before any exchange.

    Hashes of the keys set bits in 64-bit words, which are broadcast: 32 MB at most, however many
    keys there are. More keys than bits let more rows pass; no match is lost. Null keys match
    nothing.
    """
    place = F.xxhash64(key).bitwiseAND(F.lit((1 << places) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"),
                          place.bitwiseAND(F.lit(63)).cast("int"))

    def worded(df: DataFrame) -> DataFrame:
        return df.filter(F.col(key).isNotNull()).withColumns({
            "_word": F.shiftright(place, 6), "_bit": bit})
    words = worded(keys.select(key)).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return worded(rows).join(F.broadcast(words), "_word").filter(
        F.col("_bits").bitwiseAND(F.col("_bit")) != 0).drop("_word", "_bit", "_bits")
