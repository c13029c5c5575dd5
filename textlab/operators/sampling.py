"""Replayable sampling.

A pandas ``sample(random_state=...)`` cannot be replayed on a cluster, so
every sampler here orders rows by ``md5('<seed>:' || key)`` with the key as
tie-break: the same rows are chosen whatever the partitioning, in Spark and
in SQL.  Per-group caps use ``row_number() <= n`` with a literal upper bound,
which Spark plans as a partial ``WindowGroupLimit`` before the shuffle: each
map task forwards at most n rows per group, so a dominant group never ships
whole to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import patterns as P
from ..functions.text import _c, hash_order
from . import rules, tables


def _case_map(key: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def top_n_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str],
                    n: int | Column, max_n: int | None = None, rank_col: str = "rank") -> DataFrame:
    """First ``n`` rows of each group in ``order_cols`` order (``n`` may be a
    per-row Column; a literal upper bound ``max_n`` lets Spark cap the
    groups before the shuffle)."""
    w = W.partitionBy(*group_cols).orderBy(*[_c(o) for o in order_cols])
    ranked = df.withColumn(rank_col, F.row_number().over(w).cast("long"))
    if isinstance(n, int):
        return ranked.where(F.col(rank_col) <= n)
    if max_n is not None:
        ranked = ranked.where(F.col(rank_col) <= max_n)
    return ranked.where(F.col(rank_col) <= n)


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in hash order (a replayable simple random sample / shuffle)."""
    return df.orderBy(hash_order(key, seed), F.col(key)).limit(n)


def length_bands(length: Column, edges=P.LENGTH_EDGES) -> Column:
    lo, hi = edges
    return (F.when(length < lo, F.lit("short")).when(length < hi, F.lit("medium"))
            .otherwise(F.lit("long")))


def length_quotas(n: int, shares=P.LENGTH_SHARES) -> dict[str, int]:
    n_short = int(n * shares[0])
    n_medium = int(n * shares[1])
    return {"short": n_short, "medium": n_medium, "long": n - n_short - n_medium}


def length_stratified_sample(df: DataFrame, text_col: str, key: str, n: int = 500,
                             seed: int = 42, id_col: str = "id") -> DataFrame:
    """Quotas 60/25/15 % of n by length band (<80, 80-159, >=160), each capped
    by the band size; blank texts are never chosen; ids 1..m in shuffle order.

    Blank rows get a null band (quota 0) instead of a separate filter: a
    filter on a derived text column would be pushed below the projection and
    re-evaluate an expensive text expression (e.g. cleaning) per reference.
    """
    quotas = length_quotas(n)
    banded = df.select(key, text_col, F.length(F.col(text_col)).cast("long").alias("length"),
                       tables.is_blank_col(text_col).alias("_blank"))
    banded = banded.select(key, "length", F.when(~F.col("_blank"), length_bands(F.col("length"))).alias("band"))
    quota = _case_map(F.col("band"), quotas, 0)
    picked = top_n_per_group(banded, ["band"], [hash_order(key, seed), F.col(key)], quota,
                             max_n=max(quotas.values())).drop("rank")
    return tables.sequential_ids(picked.withColumn("_h", hash_order(key, f"{seed}s")),
                                 ["_h", key], id_col, bounded=True).drop("_h")


def quota_sample(df: DataFrame, class_col: str, key: str, quotas: dict[str, int],
                 seed: int = 42) -> DataFrame:
    """Up to ``quotas[c]`` rows of each class c in hash order (all rows of a
    class smaller than its quota); classes without a quota are not sampled."""
    quota = _case_map(F.col(class_col), quotas, 0)
    return top_n_per_group(df, [class_col], [hash_order(key, seed), F.col(key)], quota,
                           max_n=max(quotas.values())).drop("rank")


def quota_gap(df: DataFrame, class_col: str, quotas: dict[str, int]) -> DataFrame:
    """Per target class: target, available, taken = min(available, target),
    shortfall = target - taken."""
    spark = df.sparkSession
    targets = spark.createDataFrame(list(quotas.items()), f"{class_col} string, target long")
    avail = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("available"))
    j = F.broadcast(targets).join(avail, class_col, "left").fillna(0, subset=["available"])
    taken = F.least(F.col("available"), F.col("target"))
    return j.select(class_col, "target", "available", taken.alias("taken"),
                    (F.col("target") - taken).alias("shortfall"))


def proportional_sample(df: DataFrame, class_col: str, key: str, total: int = 30,
                        floor: int = 2, seed: int = 99) -> DataFrame:
    """Per class ``max(floor, round_half_even(total·n_c/N))`` rows (capped by
    n_c), then trimmed or topped up to exactly ``total`` rows: order all rows
    by (chosen first, hash order) and keep ``total``."""
    counts = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("_nc"))
    n_rows = counts.agg(F.sum("_nc")).first()[0] or 1
    quotas = counts.select(class_col, F.greatest(F.lit(floor), F.bround(
        (F.col("_nc") * total) / F.lit(n_rows), 0).cast("long")).alias("_q"))
    j = df.join(quotas, class_col)
    h = hash_order(key, seed)
    ranked = top_n_per_group(j.withColumn("_h", h), [class_col], ["_h", key], F.col("_q"),
                             max_n=total).withColumn("_chosen", F.lit(1))
    allrows = j.join(ranked.select(key, "_chosen"), key, "left").withColumn("_h", h).fillna(0, subset=["_chosen"])
    return (allrows.orderBy(F.col("_chosen").desc(), F.col("_h"), F.col(key)).limit(total)
            .drop("_q", "_h", "_chosen"))


def topup_candidates(df: DataFrame, key: str, text_col: str, used: DataFrame, used_text_col: str,
                     patterns=P.TOPUP_PATTERNS, targets: dict[str, int] = P.TOPUP_TARGETS,
                     seed: int = 42) -> DataFrame:
    """Top-up mining: of the texts not used yet, up to ``targets[intent]`` per
    under-represented intent whose pattern they match; a text that several
    intents choose keeps the first.  Output: key, text, tag."""
    tags = [(intent, rules.regex_filter(text_col, pat, min_len=P.MIN_MINED_LENGTH), targets[intent], seed)
            for intent, pat in patterns]
    return tagged_sample(tables.exclude_texts(df, text_col, used, used_text_col), key, text_col, tags)


def tagged_sample(df: DataFrame, key: str, text_col: str,
                  tags: Sequence[tuple[str, Column, int, int]]) -> DataFrame:
    """Several tagged predicates; up to n rows per tag (hash order with the
    tag's seed); a text chosen by several tags keeps the first tag in list
    order.  Output: key, text, tag."""
    structs = [F.when(pred, F.struct(F.lit(i).alias("prio"), F.lit(tag).alias("tag"),
                                     hash_order(key, seed).alias("h")))
               for i, (tag, pred, _n, seed) in enumerate(tags)]
    exploded = df.select(key, text_col, F.explode(F.array_compact(F.array(*structs))).alias("t"))
    flat = exploded.select(key, text_col, "t.prio", "t.tag", "t.h")
    n_of = _case_map(F.col("tag"), {t: n for t, _p, n, _s in tags}, 0)
    picked = top_n_per_group(flat, ["tag"], ["h", key], n_of,
                             max_n=max(n for _t, _p, n, _s in tags)).drop("rank")
    first = tables.dedupe_keep_first(picked, [text_col], ["prio", "h", key])
    return first.select(key, text_col, "tag")
