"""Registered queries over the driver tables.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame built from the
whole input tables.  Computed columns carry explicit names and types that
match the DuckDB oracle in :mod:`textlab.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as TX
from ..operators import metrics as M
from ..operators import pairing, rule_table, rules
from ..operators.tables import combine_rows
from . import lexicons as LX
from .common import load, r6


_r6 = r6


# ---------------------------------------------------------------------------
# pairing and cleaning


def reply_pairs_q(spark, sf_dir):
    conv = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return pairing.conversation_reply_pairs(conv)


def answered_messages_q(spark, sf_dir):
    conv = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return pairing.answered_messages(conv).select("conv_id", "turn")


def clean_text_q(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    clean = TX.clean_text("text")
    return docs.select(
        "doc_id",
        F.md5(clean).alias("clean_md5"),
        TX.char_length(clean).alias("clean_chars"),
        TX.is_blank(clean).alias("is_blank"))


def clean_pages_q(spark, sf_dir):
    pages = load(spark, sf_dir, "pages", "page_id", "html")
    clean = TX.clean_text("html")
    return pages.select(
        "page_id",
        F.md5(clean).alias("clean_md5"),
        TX.char_length(clean).alias("clean_chars"),
        (TX.char_length("html") - TX.char_length(clean)).alias("removed_chars"))


# ---------------------------------------------------------------------------
# policy


def _scored_messages(spark, sf_dir) -> DataFrame:
    """Cleaned user messages that got a reply, with a lexicon intent."""
    pairs = reply_pairs_q(spark, sf_dir)
    msg = TX.clean_text("customer_msg")
    return pairs.select("conv_id", "turn", msg.alias("msg"),
                        TX.clean_text("brand_reply").alias("reply")).select(
        "*", rules.first_keyword_label("msg", LX.INTENT_LEXICON, LX.INTENT_DEFAULT).alias("intent"))


def _escalation(intent="intent", msg="msg"):
    return rules.escalation_for(intent, msg, critical=LX.CRITICAL_WORDS, repeat=LX.REPEAT_WORDS)


def policy_decision_q(spark, sf_dir):
    s = _scored_messages(spark, sf_dir)
    return s.select(
        "conv_id", "turn", "intent",
        _escalation().alias("escalation"),
        rules.reason_for("intent", "msg", "hybrid", rules=LX.REASON_RULES).alias("reason_hybrid"),
        rules.reason_for("intent", "msg", "simple", rules=LX.REASON_RULES).alias("reason_simple"))


def reason_priority_q(spark, sf_dir):
    s = _scored_messages(spark, sf_dir).withColumn("escalation", _escalation())
    return s.select(
        "conv_id", "turn", "intent", "escalation",
        rules.reason_for("intent", "msg", "hybrid", rules=LX.REASON_RULES).alias("reason_code_order"),
        rules.policy_reason("intent", "msg", "escalation", rules=LX.REASON_RULES).alias("reason_policy_order"))


def policy_from_rules_q(spark, sf_dir):
    """The policy as rows of a rules table, with the amount thresholds; every
    message names an amount that follows from its conversation."""
    s = _scored_messages(spark, sf_dir).select(
        "conv_id", "turn", "intent", F.concat("msg", F.lit(" $"), (F.col("conv_id") * 37 % 9000).cast("string")).alias("msg"))
    rows = rule_table.policy_table(critical=LX.CRITICAL_WORDS, repeat=LX.REPEAT_WORDS, reasons=LX.REASON_RULES,
                                   amounts=P.AMOUNT_THRESHOLDS)
    decisions = ["escalation", "reason_hybrid", "reason_simple", "reason_policy"]
    return rule_table.decide(s, spark.createDataFrame(rows, rule_table.SCHEMA), decisions, "msg", "intent").drop("msg")


def reason_consistency_q(spark, sf_dir):
    s = _scored_messages(spark, sf_dir).select(
        "conv_id", "turn", F.col("intent").alias("predicted_intent"),
        _escalation().alias("predicted_escalation"),
        rules.reason_for("intent", "msg", "hybrid", rules=LX.REASON_RULES).alias("predicted_reason"))
    fixed = rules.fix_reasons(s)
    return fixed.select("conv_id", "turn", "predicted_intent", "predicted_escalation",
                        "predicted_reason", "fix_kind")


# ---------------------------------------------------------------------------
# evaluation

QUALITY_LABELS = ["low", "high"]


def _quality_truth_and_predictions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Truth = labels.quality, prediction = a length/junk threshold rule."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    labels = load(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    junk = TX.contains_words("text", "worthless|stupid|idiot")
    preds = docs.select(
        "doc_id",
        F.when(junk | (F.col("n_chars") < 300), F.lit("low")).otherwise(F.lit("high")).alias("pred"),
        F.when(F.col("n_chars") < 200, F.lit(""))
         .when(junk, F.lit("abusive")).otherwise(F.lit("clean")).alias("pred_reason"),
        F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("confidence"))
    truth = labels.select(
        "doc_id",
        F.when(F.col("quality") == 1, F.lit("high")).otherwise(F.lit("low")).alias("truth"),
        F.when(F.col("toxic") == 1, F.lit("abusive")).otherwise(F.lit("clean")).alias("truth_reason"))
    return truth, preds


def eval_metrics_q(spark, sf_dir):
    """All headline metrics from one grouped pass over truth ⋈ prediction:
    (truth, pred) counts carry the reason-agreement and low-confidence
    tallies, so the documents are scanned and matched once."""
    truth, preds = _quality_truth_and_predictions(spark, sf_dir)
    rows = M.truth_with_predictions(truth, preds, "doc_id")
    has = F.coalesce(F.col("pred_reason"), F.lit("")) != ""
    cells = rows.groupBy(F.col("truth").alias("t"), F.col("pred").alias("p"), "has_prediction").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(has).alias("n_has"),
        F.count_if(has & F.col("truth_reason").eqNullSafe(F.col("pred_reason"))).alias("n_hit"),
        F.count_if(F.col("confidence") < P.LOW_CONFIDENCE).alias("n_low"))
    counts = cells.where("has_prediction")
    summ = M.summary(counts.select("t", "p", "n"), QUALITY_LABELS)
    extra = counts.agg(F.sum("n_has").alias("n_scored"), F.sum("n_hit").alias("n_hit"),
                       F.sum("n_low").alias("n_low_confidence"))
    miss = cells.agg(F.coalesce(F.sum(F.when(~F.col("has_prediction"), F.col("n"))), F.lit(0)).alias("n_missing"))
    out = combine_rows(summ, extra, miss)
    return out.select(
        F.col("n").alias("n_evaluated"), F.col("n_missing").cast("long").alias("n_missing"),
        _r6(F.col("accuracy")).alias("accuracy"),
        _r6(F.col("macro_precision")).alias("macro_precision"),
        _r6(F.col("macro_recall")).alias("macro_recall"),
        _r6(F.col("macro_f1")).alias("macro_f1"),
        _r6(F.col("weighted_f1")).alias("weighted_f1"),
        _r6(F.when(F.col("n_scored") > 0, F.col("n_hit") / F.col("n_scored"))).alias("reason_agreement"),
        F.col("n_scored").cast("long").alias("n_reason_scored"),
        F.col("n_low_confidence").cast("long").alias("n_low_confidence"))


def per_class_metrics_q(spark, sf_dir):
    matched, _ = M.join_truth_predictions(*_quality_truth_and_predictions(spark, sf_dir), key="doc_id")
    pc = M.per_class(M.pair_counts(matched, "truth", "pred"), QUALITY_LABELS)
    return pc.select("label", _r6(F.col("precision")).alias("precision"),
                     _r6(F.col("recall")).alias("recall"), _r6(F.col("f1")).alias("f1"),
                     "support", "predicted")


def confusion_matrix_q(spark, sf_dir):
    matched, _ = M.join_truth_predictions(*_quality_truth_and_predictions(spark, sf_dir), key="doc_id")
    cm = M.confusion_matrix(M.pair_counts(matched, "truth", "pred"), QUALITY_LABELS)
    return cm.select(F.col("label").alias("truth"), *QUALITY_LABELS)


from . import corpus, labelling, scoring  # noqa: E402

QUERIES = {
    "reply_pairs": reply_pairs_q,
    "answered_messages": answered_messages_q,
    "clean_text": clean_text_q,
    "clean_pages": clean_pages_q,
    "policy_decision": policy_decision_q,
    "reason_priority": reason_priority_q,
    "policy_from_rules": policy_from_rules_q,
    "reason_consistency": reason_consistency_q,
    "eval_metrics": eval_metrics_q,
    "per_class_metrics": per_class_metrics_q,
    "confusion_matrix": confusion_matrix_q,
    "csv_documents": corpus.csv_documents_q,
    "raw_message_pairs": corpus.raw_message_pairs_q,
    "messy_scores": corpus.messy_scores_q,
    "text_profile": corpus.text_profile_q,
    "length_histogram": corpus.length_histogram_q,
    "value_counts": corpus.value_counts_q,
    "counts_having": corpus.counts_having_q,
    "top_unigrams": corpus.top_unigrams_q,
    "top_bigrams": corpus.top_bigrams_q,
    "top_ngrams": corpus.top_ngrams_q,
    "price_quantiles": corpus.price_quantiles_q,
    "length_stratified_sample": corpus.length_stratified_sample_q,
    "quota_sample": corpus.quota_sample_q,
    "quota_gap": corpus.quota_gap_q,
    "review_workbook": corpus.review_workbook_q,
    "proportional_sample": corpus.proportional_sample_q,
    "edge_cases": corpus.edge_cases_q,
    "weak_labels": corpus.weak_labels_q,
    "dedupe_keep_first": corpus.dedupe_keep_first_q,
    "merge_topup": corpus.merge_topup_q,
    "exclude_used": corpus.exclude_used_q,
    "resume_remaining": corpus.resume_remaining_q,
    "topup_mining": corpus.topup_mining_q,
    "review_order": corpus.review_order_q,
    "apply_corrections": corpus.apply_corrections_q,
    "unknown_corrections": corpus.unknown_corrections_q,
    "correct_files": corpus.correct_files_q,
    "label_audit": labelling.label_audit_q,
    "audit_summary": labelling.audit_summary_q,
    "audit_top_rows": labelling.audit_top_rows_q,
    "label_drift": labelling.label_drift_q,
    "difficulty_downgrade": labelling.downgrade_q,
    "kappa": labelling.kappa_q,
    "two_pass_kappa": labelling.two_pass_kappa_q,
    "pass_disagreements": labelling.pass_disagreements_q,
    "label_progress": labelling.label_progress_q,
    "random_sample": labelling.random_sample_q,
    "stratified_folds": labelling.stratified_folds_q,
    "rank_agreement": labelling.rank_agreement_q,
    "compare_systems": labelling.compare_systems_q,
    "compare_baselines": labelling.compare_baselines_q,
    "majority_baseline": labelling.majority_baseline_q,
    "response_parse": labelling.response_parse_q,
    "rubric_scores": labelling.rubric_scores_q,
    "rubric_by_class": labelling.rubric_by_class_q,
    "tfidf_weights": scoring.tfidf_weights_q,
    "retrieve_top1": scoring.retrieve_top1_q,
    "retrieve_top3_prompt": scoring.retrieve_top3_prompt_q,
    "retrieve_all_pairs": scoring.retrieve_all_pairs_q,
    "oof_classifier": scoring.oof_classifier_q,
    "cv_accuracy": scoring.cv_accuracy_q,
    "scoring_job": scoring.scoring_job_q,
    "evaluate_job": scoring.evaluate_job_q,
    "stream_reply_pairs": scoring.stream_reply_pairs_q,
    "stream_scoring": scoring.stream_scoring_q,
}

FLAGSHIP = "scoring_job"
