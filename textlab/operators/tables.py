"""Table maintenance: filters, alignment and union, keep-first dedupe,
exclusion and resume joins, corrections, sequential ids.

Nothing here relies on row order: every "first" takes an explicit order key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import _c


def label_progress(df: DataFrame, col: str = "intent") -> DataFrame:
    """One row: total, labelled and unlabelled counts."""
    lab = F.col(col).isNotNull() & (F.trim(F.col(col)) != "")
    return df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(lab).alias("n_labelled"),
                  F.count_if(~F.coalesce(lab, F.lit(False))).alias("n_unlabelled"))


def is_blank_col(col: str):
    """Null or whitespace-only, with a single reference to the column."""
    return F.coalesce(F.length(F.trim(F.col(col))) == 0, F.lit(True))


def keep_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key occurs in ``keys`` (left semi join; never ``IN`` lists)."""
    return df.join(keys, on=on, how="left_semi")


def exclude_keys(df: DataFrame, used: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key does not occur in ``used`` (left anti join, null-safe:
    a null key in ``used`` does not empty the result as ``NOT IN`` would)."""
    return df.join(used, on=on, how="left_anti")


def exclude_texts(df: DataFrame, text_col: str, used: DataFrame, used_text_col: str) -> DataFrame:
    """Anti join on long text: the shuffle key is md5(text), the text itself is
    compared too, so a hash collision can never drop a row."""
    # distinct first (partial aggregation map-side): copies of one used text
    # never pile up on the build side of the join
    u = used.select(F.md5(F.col(used_text_col)).alias("_h"), F.col(used_text_col).alias("_t")).distinct()
    d = df.withColumn("_h", F.md5(F.col(text_col)))
    return (d.join(u, (d["_h"] == u["_h"]) & (d[text_col] == u["_t"]), "left_anti").drop("_h"))


def union_aligned(main: DataFrame, extra: DataFrame, fill: str = "") -> DataFrame:
    """Union by name onto ``main``'s columns; columns missing from ``extra`` are
    padded with ``fill`` (text columns) or null."""
    types = {f.name: f.dataType for f in main.schema.fields}
    fill_for = {c: (fill if isinstance(t, T.StringType) else None) for c, t in types.items()}
    have = set(extra.columns)
    cols = [F.col(c).cast(types[c]).alias(c) if c in have
            else F.lit(fill_for[c]).cast(types[c]).alias(c) for c in main.columns]
    return main.unionByName(extra.select(*cols))


def dedupe_keep_first(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[Column | str],
                      hash_text: bool = True) -> DataFrame:
    """Keep one row per key: the first by ``order_cols`` (which must be a total
    order, e.g. end with a unique id).

    Implemented as a grouped ``min_by`` so copies are collapsed by the partial
    aggregation inside each map task before the shuffle: a group of copies that
    holds a third of all rows is reduced map-side instead of landing whole in
    one task.  Text keys are grouped by ``md5(text)`` next to the text, so sort
    comparisons on long texts only happen between true duplicates.
    """
    cols = df.columns
    keys = [F.col(k) for k in key_cols]
    group = ([F.md5(F.col(k).cast("string")).alias(f"_h{k}") for k in key_cols] if hash_text else []) + keys
    order = F.struct(*[(_c(o)).alias(f"_o{i}") for i, o in enumerate(order_cols)])
    agg = df.groupBy(*group).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), order).alias("_r"))
    return agg.select("_r.*")


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Merge one-row results side by side without a join: union them (each
    fills its own columns) and take the first non-null value per column."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in u.columns])


def exclusive_running_sum(df: DataFrame, order_cols: Sequence[str], value_col: str,
                          out_col: str, partitions: int | None = None) -> DataFrame:
    """Σ value over all rows strictly before each row in ``order_cols`` order.

    No single-partition window: the table is range-partitioned, each partition
    is summed, the per-partition sums (one row per partition) become offsets,
    and a within-partition running sum is added.

    The range-partitioned table is materialised once with ``checkpoint()`` in
    the shared checkpoint folder.  Partition ids are then fixed: two separate
    evaluations of a range exchange can sample different boundaries, and
    adaptive execution may coalesce its partitions differently per branch, so
    ``spark_partition_id()`` is only stable on materialised data.  The
    checkpoint also makes the ids identical when a lost task is recomputed.
    """
    from ..session import checkpoint_root

    spark = df.sparkSession
    checkpoint_root(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *[F.col(c) for c in order_cols])
              .checkpoint(eager=True)
              .withColumn("_pid", F.spark_partition_id()))
    sums = ranged.groupBy("_pid").agg(F.sum(value_col).alias("_psum"))
    # one row per partition: the single-partition window here is bounded
    offsets = sums.select("_pid", F.coalesce(
        F.sum("_psum").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0)).alias("_offset"))
    within = W.partitionBy("_pid").orderBy(*order_cols).rowsBetween(W.unboundedPreceding, -1)
    return (ranged.withColumn("_before", F.coalesce(F.sum(value_col).over(within), F.lit(0)))
            .join(F.broadcast(offsets), "_pid")
            .withColumn(out_col, (F.col("_offset") + F.col("_before")).cast("long"))
            .drop("_pid", "_offset", "_before"))


def sequential_ids(df: DataFrame, order_cols: Sequence[str], id_col: str = "id",
                   start: int = 1, bounded: bool = False) -> DataFrame:
    """Assign ``start, start+1, ...`` in ``order_cols`` order (a total order).

    ``bounded=True`` is for results whose size is capped by a parameter (a
    sample of n rows): one global ``row_number``.  Otherwise the partition
    offset method keeps the work spread over all partitions.
    """
    if bounded:
        return df.withColumn(id_col, (F.row_number().over(W.orderBy(*order_cols)) + (start - 1)).cast("long"))
    one = df.withColumn("_one", F.lit(1))
    return exclusive_running_sum(one, order_cols, "_one", id_col).withColumn(
        id_col, F.col(id_col) + start).drop("_one")


def sorted_positions(df: DataFrame, order_cols: Sequence[str], out_col: str = "position") -> DataFrame:
    """1-based position in ``order_cols`` order, nulls last in every column
    (the columns must form a total order)."""
    flags = [f"_null{k}" for k in range(len(order_cols))]
    flagged = df.withColumns({f: F.col(c).isNull() for f, c in zip(flags, order_cols)})
    order = [x for pair in zip(flags, order_cols) for x in pair]
    return sequential_ids(flagged, order, out_col).drop(*flags)


def resume(todo: DataFrame, previous: DataFrame, key: str, done_col: str) -> tuple[DataFrame, DataFrame]:
    """Split work for a resumable job: (rows of ``previous`` that are done,
    rows of ``todo`` still to process).  A blank result is not done."""
    done = previous.where(F.col(done_col).isNotNull() & (F.trim(F.col(done_col)) != ""))
    remaining = todo.join(done.select(key), on=key, how="left_anti")
    return done, remaining


def apply_corrections(table: DataFrame, corrections: DataFrame, key: str, seq_col: str,
                      columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Update ``columns`` of ``table`` by key from a corrections table.

    Several corrections for one key: the one with the highest ``seq`` wins
    (pre-aggregated with ``max_by`` before the join).  Returns (updated table
    with a boolean ``corrected`` column, corrections whose key is unknown).
    """
    last = corrections.groupBy(key).agg(
        F.max_by(F.struct(*[F.col(c).alias(f"_new_{c}") for c in columns]), F.col(seq_col)).alias("_c"))
    last = last.select(key, "_c.*", F.lit(True).alias("_hit"))
    joined = table.join(last, on=key, how="left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = joined.select(
        *[F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
          for c in table.columns],
        hit.alias("corrected"))
    unknown = last.join(table.select(key), on=key, how="left_anti").select(key)
    return out, unknown


REVIEW_COLUMNS = ["intent", "escalation_ground_truth", "escalation_reason", "golden_reply",
                  "difficulty", "is_edge_case", "notes"]


def review_workbook(df: DataFrame, id_col: str, text_col: str, reply_col: str | None,
                    guess_col: str | None, edge: bool = False, edge_tag_col: str | None = None) -> DataFrame:
    """Shape rows as a review workbook in the fixed column order: id, message,
    reply, the model guess kept as ``intent_llm_guess``, empty review columns,
    ``is_edge_case``; for edge cases the tag goes to ``notes``, the guess is
    blanked and difficulty starts at 'hard'."""
    blank = F.lit("")
    return df.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("customer_msg_clean"),
        (F.col(reply_col) if reply_col else blank).alias("brand_reply_clean"),
        (blank if edge else (F.col(guess_col) if guess_col else blank)).alias("intent_llm_guess"),
        blank.alias("intent"), blank.alias("escalation_ground_truth"), blank.alias("escalation_reason"),
        blank.alias("golden_reply"),
        F.lit("hard" if edge else "").alias("difficulty"),
        F.lit(edge).alias("is_edge_case"),
        (F.col(edge_tag_col) if (edge and edge_tag_col) else blank).alias("notes"))
