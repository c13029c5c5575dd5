"""Bloom filters of a fixed size as DataFrames, built and read with built-in
functions only.

A filter is a table ``(word, bits)`` of at most ``2**WORDS_LOG2`` rows.  A key
hash sets two bits of one 64-bit word, so a probe is one broadcast join on the
word number and one bit test.  The table's size does not grow with the data
(2**20 words of 64 bits, about 50 MB as a broadcast relation when full): with
more keys more rows test positive by chance, which costs work and never
changes a result, because every positive is checked by an exact join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS_LOG2 = 20
_WORD, _BITS = "__bf_word", "__bf_bits"


def _positions(h, words_log2: int):
    word = h.bitwiseAND(F.lit((1 << words_log2) - 1))
    first = F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")
    second = F.shiftrightunsigned(h, 48).bitwiseAND(F.lit(63)).cast("int")
    return word, first, second


def _bit(position):
    return F.call_function("shiftleft", F.lit(1).cast("long"), position)


def keys_filter(hashes: DataFrame, column: str, words_log2: int = WORDS_LOG2) -> DataFrame:
    """Filter over every hash in ``column`` (nulls skipped)."""
    word, first, second = _positions(F.col(column), words_log2)
    return (hashes.where(F.col(column).isNotNull())
            .select(word.alias(_WORD), _bit(first).bitwiseOR(_bit(second)).alias(_BITS))
            .groupBy(_WORD).agg(F.bit_or(_BITS).alias(_BITS)))


def repeats_filter(hashes: DataFrame, column: str, words_log2: int = WORDS_LOG2) -> DataFrame:
    """Filter over the hashes that may occur more than once: a bit is set when
    at least two rows touch it."""
    word, first, second = _positions(F.col(column), words_log2)
    touched = (hashes.where(F.col(column).isNotNull())
               .select(word.alias(_WORD), F.explode(F.array_distinct(F.array(first, second))).alias("__bf_bit"))
               .groupBy(_WORD, "__bf_bit").agg(F.count(F.lit(1)).alias("__bf_n")))
    return (touched.where(F.col("__bf_n") > 1)
            .select(_WORD, _bit(F.col("__bf_bit")).alias(_BITS))
            .groupBy(_WORD).agg(F.bit_or(_BITS).alias(_BITS)))


def probe(df: DataFrame, column: str, bloom: DataFrame, flag: str,
          words_log2: int = WORDS_LOG2) -> DataFrame:
    """``df`` with the boolean ``flag``: false means that the hash in ``column``
    is certainly not in the filter (a null hash never is)."""
    word, first, second = _positions(F.col(column), words_log2)
    mask = _bit(first).bitwiseOR(_bit(second))
    joined = df.withColumn("__bf_key", word).join(
        F.broadcast(bloom), F.col("__bf_key") == F.col(_WORD), "left")
    hit = F.coalesce(F.col(_BITS), F.lit(0).cast("long")).bitwiseAND(mask) == mask
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__bf_key", _WORD, _BITS)


def drop_rows(df: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """``df`` without the rows whose ``key`` is in the one-column table
    ``dropped``.  Rows that the filter clears pass straight through; only the
    others shuffle to the exact anti join."""
    names = df.columns
    gone = dropped.select(F.col(dropped.columns[0]).alias("__gone")).where(F.col("__gone").isNotNull())
    bloom = keys_filter(gone.select(F.xxhash64("__gone").alias("__h")), "__h")
    flagged = probe(df.withColumn("__h", F.when(F.col(f"`{key}`").isNotNull(), F.xxhash64(f"`{key}`"))),
                    "__h", bloom, "__maybe")
    passed = flagged.where(~F.col("__maybe"))
    checked = flagged.where(F.col("__maybe")).join(gone, F.col(f"`{key}`") == F.col("__gone"), "left_anti")
    cols = [F.col(f"`{c}`") for c in names]
    return passed.select(cols).unionAll(checked.select(cols))
