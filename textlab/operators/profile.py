"""Corpus profiling: value counts, thresholds, numeric profiles, histograms,
top terms, label drift.  Every operator is a distributed aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _c
from . import heavy_hitters, quantiles
from .tables import combine_rows


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """(value, count); nulls are dropped unless ``dropna=False``.
    Order for display: ``orderBy(desc('count'), col)``."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    return src.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def counts_having(df: DataFrame, col: str, min_count: int) -> DataFrame:
    """Entities with at least ``min_count`` rows (inclusive)."""
    return value_counts(df, col).where(F.col("count") >= min_count)


def numeric_profile(df: DataFrame, value: Column | str, group_cols: Sequence[str] = (),
                    exact: bool = True, accuracy: int = 10000,
                    extra: dict[str, Column] | None = None) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 % (linear interpolation), max.

    ``exact=True`` selects the quartiles by brackets
    (:func:`quantiles.exact_quantiles`; ``df`` is read twice), ``exact=False``
    uses ``percentile_approx``.  ``extra`` names further aggregates to take in
    the same pass.
    """
    v = _c(value).cast("double")
    quartiles = [0.25, 0.5, 0.75]
    q = [] if exact else [F.percentile_approx(v, quartiles, accuracy).alias("quantiles")]
    out = df.groupBy(*group_cols).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), *q, *[c.alias(name) for name, c in (extra or {}).items()])
    if exact:
        found = quantiles.exact_quantiles(df, v, quartiles, group_cols, accuracy)
        names = [f"_q_{k}" for k in range(len(group_cols))]
        found = found.select(*[F.col(g).alias(k) for g, k in zip(group_cols, names)], "quantiles")
        if group_cols:  # one row per group on both sides
            same = [out[g].eqNullSafe(found[k]) for g, k in zip(group_cols, names)]
            out = out.join(found, same, "left")
        else:
            out = combine_rows(out, found)
    return out.select(*group_cols, *(extra or {}), "count", "mean", "std", "min",
                      F.col("quantiles")[0].alias("q25"), F.col("quantiles")[1].alias("q50"),
                      F.col("quantiles")[2].alias("q75"), "max")


def histogram(df: DataFrame, value: Column | str, bins: int = 30) -> DataFrame:
    """Equal-width histogram of an integer column over [min, max]; the last bin
    is closed on the right.  Bin = floor((v - min) * bins / (max - min)); for
    integer values this equals exact integer division.  Empty bins are included (count 0).

    Two passes: a global min/max (a one-row aggregate) and the bin counts.
    """
    spark = df.sparkSession
    v = _c(value).cast("long")
    ext = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    lo, hi = ext["lo"], ext["hi"]
    if lo is None:
        return spark.createDataFrame([], "bin long, lo double, hi double, count long")
    span = max(hi - lo, 1)
    b = F.least(F.floor((v - F.lit(lo)) * bins / F.lit(span)), F.lit(bins - 1))
    counts = df.where(v.isNotNull()).groupBy(b.cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    edges = spark.range(bins).select(
        F.col("id").alias("bin"),
        (F.lit(float(lo)) + F.col("id") * (hi - lo) / float(bins)).alias("lo"),
        (F.lit(float(lo)) + (F.col("id") + 1) * (hi - lo) / float(bins)).alias("hi"))
    return (edges.join(counts, "bin", "left").fillna(0, subset=["count"])
            .select("bin", "lo", "hi", F.col("count").cast("long").alias("count")))


def top_terms(df: DataFrame, tokens: Column | str, n: int) -> DataFrame:
    """The n most frequent tokens: (term, count), ties by term."""
    return heavy_hitters.top_ngrams(df, _c(tokens), n).withColumnRenamed("gram", "term")


def top_ngrams(df: DataFrame, tokens: Column | str, n: int, sizes: Sequence[int]) -> DataFrame:
    """The n most frequent runs of tokens of the given sizes: (gram, count)."""
    return heavy_hitters.top_ngrams(df, _c(tokens), n, sizes)


def top_bigrams(df: DataFrame, tokens: Column | str, n: int) -> DataFrame:
    """The n most frequent adjacent token pairs: (w1, w2, count)."""
    pair = F.split("gram", " ")
    return heavy_hitters.top_ngrams(df, _c(tokens), n, (2,)).select(
        pair[0].alias("w1"), pair[1].alias("w2"), "count").orderBy(F.desc("count"), "w1", "w2")


def label_drift(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, count) for rows whose two labels differ (null-safe)."""
    return (df.where(~F.col(a).eqNullSafe(F.col(b)))
            .groupBy(F.col(a).alias("from"), F.col(b).alias("to"))
            .agg(F.count(F.lit(1)).alias("count")))
