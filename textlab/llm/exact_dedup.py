"""Exact deduplication by two-pass Bloom filtering, with built-in functions only.

Pass 1 hashes every text and builds a filter of the hashes that may be
repeated.  Pass 2 probes it: a row that the filter clears is certainly the
only one of its text and passes straight through; the others shuffle by their
SHA-256 and are grouped exactly.  A group may hold any share of the rows: its
largest id and size come from a partial aggregation, and the join that brings
them back is a plain sort-merge join whose hot partitions Spark splits.

Cases: a null text counts as empty (all empty texts are one group); texts are
equal when identical after lower-casing A-Z only; null ids sort below every
other id; rows that repeat an id get the same decision as that id
(``one_per_text`` keeps one of them); an empty table gives an empty result;
input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import ascii_lower, first_rows, without

OUTPUT = ("keep_id", "group_size", "kept", "text_sha256")


def with_digest(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus ``text_sha256`` of the normalised text."""
    norm = ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    digest = F.sha2(norm.cast("binary"), 256)
    return without(df.withColumn("__digest", digest), "text_sha256").withColumnRenamed("__digest", "text_sha256")


def exact_dedup(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` (which has ``text_sha256``) plus ``keep_id`` (the largest
    id of the group), ``group_size`` and ``kept``."""
    alone, checked = _decided(df, key)
    return alone.unionAll(checked)


def one_per_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, as :func:`exact_dedup` gives it: of the rows that
    have the largest id, the one whose text sorts first."""
    alone, checked = _decided(df, key)
    # another expression than the join's, so that its hot partitions still split
    return alone.unionAll(first_rows(checked.where("kept"), F.reverse("text_sha256"), F.col(f"`{text}`")))


def _decided(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows that are certainly alone, and the others with their groups."""
    df = without(df, *OUTPUT[:3])
    names = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.withColumn("__h", F.xxhash64("text_sha256"))
    maybe = bloom.repeats_filter(hashed.select("__h"), "__h")
    flagged = bloom.probe(hashed, "__h", maybe, "__maybe")
    alone = flagged.where(~F.col("__maybe")).select(
        *names, F.col(f"`{key}`").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"))
    again = flagged.where(F.col("__maybe"))
    groups = again.groupBy(F.col("text_sha256").alias("__digest")).agg(
        F.max(f"`{key}`").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    checked = again.join(groups, F.col("text_sha256") == F.col("__digest")).select(
        *names, "keep_id", "group_size", F.col(f"`{key}`").eqNullSafe(F.col("keep_id")).alias("kept"))
    return alone, checked
