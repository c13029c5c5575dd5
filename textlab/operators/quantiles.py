"""Exact quantiles by group without a buffer of all values.

A quantile sketch (``percentile_approx``, which Spark merges from map-side
buffers of a size set by ``accuracy``) gives for every quantile a bracket of two
values, some ranks to either side.  One more pass counts the values below each
bracket and, by value, those inside; only these counts are shuffled.  The
values at the two ranks beside the quantile are then read off a running sum and
interpolated.  If a rank is not in its bracket, the brackets are widened for all
groups and the pass repeated, so the result never rests on the sketch's error.

Cases: null values do not count; a group of nulls only has null quantiles; one
value is every quantile; NaN is larger than all numbers; null group keys are a
group; an empty table has no rows (without groups: one row of nulls).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

ACCURACY = 10_000
WIDER = 16


def _brackets(src: DataFrame, groups: Sequence[str], ps: Sequence[float], accuracy: int, margin: float) -> DataFrame:
    """(groups, n, b): for each quantile the bracket's ends, null where open."""
    edges = [min(max(p + d, 0.0), 1.0) for p in ps for d in (-margin, margin)]
    found = src.groupBy(*groups).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", edges, accuracy).alias("_e"))
    ends = []
    for k, p in enumerate(ps):
        lo = F.col("_e")[2 * k] if p - margin > 0 else F.lit(None).cast("double")
        hi = F.col("_e")[2 * k + 1] if p + margin < 1 else F.lit(None).cast("double")
        ends.append(F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p"), lo.alias("lo"), hi.alias("hi")))
    return found.select(*groups, "_n", F.array(*ends).alias("_b"))


def _selected(src: DataFrame, groups: Sequence[str], brackets: DataFrame) -> DataFrame:
    """(groups, k, p, n, lower, upper): the values at the ranks beside quantile k."""
    keys = [f"_g{i}" for i in range(len(groups))]
    b = brackets.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], "_n", "_b")
    if groups:
        same = src[groups[0]].eqNullSafe(b[keys[0]])
        for g, k in zip(groups[1:], keys[1:]):
            same = same & src[g].eqNullSafe(b[k])
        rows = src.join(b, same)
    else:  # one row
        row = b.first()
        known = [F.struct(F.lit(x["k"]).alias("k"), F.lit(x["p"]).alias("p"), F.lit(x["lo"]).cast("double").alias("lo"),
                          F.lit(x["hi"]).cast("double").alias("hi")) for x in row["_b"]]
        rows = src.withColumns({"_n": F.lit(row["_n"]).cast("long"), "_b": F.array(*known)})
    hit = rows.select(*groups, "_n", "_v", F.explode("_b").alias("_s")).select(
        *groups, "_n", "_v", F.col("_s.k").alias("k"), F.col("_s.p").alias("p"), "_s.lo", "_s.hi")
    hit = hit.where(F.col("hi").isNull() | (F.col("_v") <= F.col("hi")))
    inside = F.when(F.col("lo").isNull() | (F.col("_v") >= F.col("lo")), F.col("_v"))  # null: below the bracket
    counts = hit.groupBy(*groups, "k", "p", "_n", inside.alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*groups, "k").orderBy(F.col("_x").asc_nulls_first()))
    at = F.col("p") * (F.col("_n") - 1)
    ranked = counts.withColumn("_upto", upto)
    here = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)
    return ranked.groupBy(*groups, "k", "p", "_n").agg(
        F.max(F.when(here(F.floor(at)), F.col("_x"))).alias("lower"), F.max(F.when(here(F.ceil(at)), F.col("_x"))).alias("upper"))


def exact_quantiles(df: DataFrame, value: Column | str, ps: Sequence[float], groups: Sequence[str] = (),
                    accuracy: int = ACCURACY) -> DataFrame:
    """(groups, quantiles): linearly interpolated quantiles ``ps`` of the values
    that are not null, as an array in the order of ``ps``.  The table is read
    twice, more often only where a sketch misses its own bound."""
    from ..session import checkpoint_root

    checkpoint_root(df.sparkSession)
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    src = df.select(*groups, v.alias("_v"))
    margin = 2.0 / accuracy
    while True:
        brackets = _brackets(src, groups, ps, accuracy, margin).checkpoint(eager=True)  # one row per group
        found = _selected(src.where(F.col("_v").isNotNull()), groups, brackets).checkpoint(eager=True)
        if margin >= 1 or found.where("lower IS NULL OR upper IS NULL").isEmpty():
            break
        margin *= WIDER
    at = F.col("p") * (F.col("_n") - 1)
    value_at = F.col("lower") + (F.col("upper") - F.col("lower")) * (at - F.floor(at))
    lists = found.groupBy(*groups).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", value_at.alias("q")))), lambda s: s["q"]).alias("quantiles"))
    empty = brackets.where("_n = 0").select(*groups, F.array(*[F.lit(None).cast(T.DoubleType())] * len(ps)).alias("quantiles"))
    return lists.where(F.size("quantiles") > 0).unionByName(empty) if groups else lists.where(
        F.size("quantiles") > 0).unionByName(empty)
