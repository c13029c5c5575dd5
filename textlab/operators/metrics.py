"""Classification metrics from one pass over (truth, prediction) pairs.

The only pass over the data is ``groupBy(truth, pred).count()`` (partial
aggregation map-side, so a dominant class never lands in one task).  Every
metric is then computed from that count table, whose size is bounded by the
square of the closed label vocabulary.  F1 is computed from integer counts,
``2·tp / (support + predicted)``, so it is a single division and identical
in every engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import combine_rows


def join_truth_predictions(truth: DataFrame, preds: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Inner join on the key; returns (matched rows, unmatched truth rows).

    Unmatched truth rows are ignored by the metrics (they are reported, not
    scored).  Duplicate prediction keys would multiply rows, so callers should
    validate uniqueness with :func:`duplicate_keys`.
    """
    matched = truth.join(preds, on=key, how="inner")
    missing = truth.join(preds, on=key, how="left_anti")
    return matched, missing


def truth_with_predictions(truth: DataFrame, preds: DataFrame, key: str = "id") -> DataFrame:
    """Every truth row once joined, with a boolean ``has_prediction``: for
    callers that want the metrics and the count of unmatched rows in one pass."""
    found = preds.withColumn("has_prediction", F.lit(True))
    return truth.join(found, on=key, how="left").withColumn(
        "has_prediction", F.coalesce("has_prediction", F.lit(False)))


def duplicate_keys(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).count().where(F.col("count") > 1)


def pair_counts(df: DataFrame, truth: str, pred: str, fill_pred: str | None = None) -> DataFrame:
    """(t, p, n) counts; a null prediction is first replaced by ``fill_pred``."""
    p = F.col(pred) if fill_pred is None else F.coalesce(F.col(pred), F.lit(fill_pred))
    return (df.select(F.col(truth).cast("string").alias("t"), p.cast("string").alias("p"))
            .groupBy("t", "p").agg(F.count(F.lit(1)).alias("n")))


def _labels_df(spark: SparkSession, labels: Sequence[str]) -> DataFrame:
    rows = [(lab, k) for k, lab in enumerate(labels)]
    return spark.createDataFrame(rows, "label string, label_order int")


def _label_totals(counts: DataFrame, labels: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Per (group, label): tp, support, predicted -- one aggregation over the
    count table, no join.  Every cell (t, p, n) feeds label t (support, tp)
    and label p (predicted); the fixed label list enters as zero rows."""
    g = [F.col(c) for c in group]
    cells = counts.select(*g, F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).cast("long").alias("tp")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("tp")))).alias("c")).select(*g, "c.*")
    zero = F.struct(F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("support"),
                    F.lit(0).cast("long").alias("predicted"), F.lit(0).cast("long").alias("tp"))
    keys = counts.select(*g).distinct() if group else counts.sparkSession.range(1).select()
    dims = keys.select(*g, F.explode(F.array(*[zero.withField("label", F.lit(x)) for x in labels])).alias("c")
                       ).select(*g, "c.*")
    tot = (cells.where(F.col("label").isNotNull()).unionByName(dims)
           .groupBy(*g, "label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                     F.sum("predicted").alias("predicted")))
    order = F.lit(None).cast("int")
    for k, x in enumerate(labels):
        order = F.when(F.col("label") == x, F.lit(k)).otherwise(order)
    return tot.withColumn("label_order", order).withColumn("in_list", F.col("label_order").isNotNull())


def per_class(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """precision, recall, f1, support for every label of the fixed list
    (zero_division -> 0; labels never seen still appear with zeros), plus any
    label seen in the data outside the list (``in_list`` false).

    The truth column must be non-null (labelled rows only).
    """
    out = _label_totals(counts, labels)
    tp_, s_, p_ = (F.col(c).cast("double") for c in ("tp", "support", "predicted"))
    return out.select(
        "label", "label_order", "in_list",
        F.when(p_ > 0, tp_ / p_).otherwise(0.0).alias("precision"),
        F.when(s_ > 0, tp_ / s_).otherwise(0.0).alias("recall"),
        F.when(s_ + p_ > 0, 2 * tp_ / (s_ + p_)).otherwise(0.0).alias("f1"),
        F.col("support").cast("long").alias("support"),
        F.col("predicted").cast("long").alias("predicted"),
        F.col("tp").cast("long").alias("tp"))


def summary(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row: n, accuracy, macro P/R/F1 over the fixed list (divides by the
    list length, like sklearn with ``labels=``), weighted F1 over the labels
    present (weights = true support)."""
    pc = per_class(counts, labels)
    L = float(len(labels))
    inl = F.col("in_list")
    return pc.agg(
        F.sum("support").cast("long").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.when(inl, F.col("precision")).otherwise(0.0)) / L).alias("macro_precision"),
        (F.sum(F.when(inl, F.col("recall")).otherwise(0.0)) / L).alias("macro_recall"),
        (F.sum(F.when(inl, F.col("f1")).otherwise(0.0)) / L).alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def confusion_matrix(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows = truth (every label of the list), one column per predicted label
    in list order; zero-filled.  Predictions outside the list are not shown."""
    spark = counts.sparkSession
    zeros = _labels_df(spark, labels).select(F.col("label").alias("t"), F.lit(None).cast("string").alias("p"),
                                             F.lit(0).cast("long").alias("n"))
    cells = counts.select("t", "p", F.col("n").cast("long").alias("n")).where(F.col("t").isin(*labels))
    piv = cells.unionByName(zeros).groupBy(F.col("t").alias("label")).pivot("p", list(labels)).agg(F.sum("n"))
    order = F.lit(None).cast("int")
    for k, x in enumerate(labels):
        order = F.when(F.col("label") == x, F.lit(k)).otherwise(order)
    return piv.fillna(0, subset=list(labels)).select(
        "label", order.alias("label_order"), *[F.col(c).cast("long").alias(c) for c in labels])


def masked_agreement(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Exact-match rate over rows whose prediction is non-blank; null truth
    counts as a mismatch; null when no prediction is non-blank."""
    has = F.coalesce(F.col(pred), F.lit("")) != ""
    hit = F.when(F.col(truth).eqNullSafe(F.col(pred)), 1.0).otherwise(0.0)
    return df.agg(F.avg(F.when(has, hit)).alias("agreement"),
                  F.count(F.when(has, 1)).alias("n_scored"))


def eval_document(system: str, matched: DataFrame, intent_labels: Sequence[str],
                  escalation_labels: Sequence[str], truth_intent="intent",
                  pred_intent="predicted_intent", truth_esc="escalation_ground_truth",
                  pred_esc="predicted_escalation", truth_reason="escalation_reason",
                  pred_reason="predicted_reason", fill_intent="other",
                  fill_escalation="auto_handle") -> DataFrame:
    """The nested metrics document (one row): intent, escalation, reason
    agreement and a per-intent map -- ready for ``write.json``.

    One pass over the rows: a single grouped count table carries the intent
    cells, the escalation cells and the reason-agreement tallies; every
    metric is derived from it.
    """
    has = F.coalesce(F.col(pred_reason), F.lit("")) != ""
    hit = has & F.col(truth_reason).eqNullSafe(F.col(pred_reason))
    cells = matched.groupBy(
        F.col(truth_intent).cast("string").alias("ti"),
        F.coalesce(F.col(pred_intent), F.lit(fill_intent)).cast("string").alias("pi"),
        F.col(truth_esc).cast("string").alias("te"),
        F.coalesce(F.col(pred_esc), F.lit(fill_escalation)).cast("string").alias("pe"),
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(has).alias("n_has"), F.count_if(hit).alias("n_hit"))
    ci = cells.groupBy(F.col("ti").alias("t"), F.col("pi").alias("p")).agg(F.sum("n").alias("n"))
    ce = cells.groupBy(F.col("te").alias("t"), F.col("pe").alias("p")).agg(F.sum("n").alias("n"))
    si = summary(ci, intent_labels).select(
        F.struct("accuracy", "macro_f1", "weighted_f1").alias("intent"), "n")
    se = summary(ce, escalation_labels).select(F.struct("accuracy", "macro_f1").alias("escalation"))
    ra = cells.agg(F.when(F.sum("n_has") > 0, F.sum("n_hit") / F.sum("n_has")).alias("reason_agreement"))
    pc = per_class(ci, intent_labels).where("in_list").agg(F.map_from_entries(F.collect_list(
        F.struct("label", F.struct("precision", "recall", "f1", "support")))).alias("per_intent"))
    doc = combine_rows(si, se, ra, pc)
    return doc.select(F.lit(system).alias("system"), F.col("n").alias("n_evaluated"),
                      "intent", "escalation", "reason_agreement", "per_intent")


def summary_by(df: DataFrame, truth: str, pred: str, group: str, labels: Sequence[str]) -> DataFrame:
    """:func:`summary` for several systems at once (one ``groupBy`` pass):
    per ``group`` value: n, accuracy, macro F1 over the fixed list, weighted F1."""
    c = df.groupBy(group, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    j = _label_totals(c, labels, [group])
    s_, p_ = F.col("support").cast("double"), F.col("predicted").cast("double")
    f1 = F.when(s_ + p_ > 0, 2 * F.col("tp") / (s_ + p_)).otherwise(0.0)
    L = float(len(labels))
    return j.groupBy(group).agg(
        F.sum("support").cast("long").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.when(F.col("in_list"), f1).otherwise(0.0)) / L).alias("macro_f1"),
        (F.sum(f1 * s_) / F.sum("support")).alias("weighted_f1"))
