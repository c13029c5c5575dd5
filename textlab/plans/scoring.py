"""Registered queries: TF-IDF, retrieval, classifier, scoring job, stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as TX
from ..operators import classify, features, retrieval, rules
from ..operators.tables import combine_rows
from ..session import shared_path
from ..streaming import pairing as stream_pairing
from ..streaming import scoring as stream
from . import lexicons as LX
from .common import load, r6


def tfidf_weights_q(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", TX.clean_text("text").alias("c"))
    w, _ = features.tfidf(docs, "doc_id", "c", ngram_max=2, min_df=2, max_features=5000)
    return w.select("doc_id", "term", r6(F.col("weight")).alias("weight"))


def reply_pool(spark, sf_dir) -> DataFrame:
    """Reply pairs with cleaned texts and one pair key of conversation, turn
    and reply, which sorts as they do; blank replies are dropped (they cannot
    serve as an answer)."""
    from .queries import reply_pairs_q
    pairs = reply_pairs_q(spark, sf_dir)
    pool = pairs.select(
        F.concat_ws(":", F.lpad(F.col("conv_id").cast("string"), 19, "0"), F.lpad(F.col("turn").cast("string"), 19, "0"),
                    F.md5("brand_reply")).alias("pair_key"), "conv_id", "turn",
        TX.clean_text("customer_msg").alias("customer_msg_clean"),
        TX.clean_text("brand_reply").alias("brand_reply_clean"))
    # one reference to the cleaned reply: a pushed-down filter re-evaluates it
    return pool.where(F.length(F.trim("brand_reply_clean")) > 0)


def _benchmark_queries(spark, sf_dir):
    return load(spark, sf_dir, "benchmark", "item_id", "text").select(
        "item_id", TX.clean_text("text").alias("q"))


def retrieve_top1_q(spark, sf_dir):
    pool = reply_pool(spark, sf_dir)
    queries = _benchmark_queries(spark, sf_dir)
    m = retrieval.retrieve(queries, "item_id", "q", pool, "pair_key", "customer_msg_clean",
                           k=1, max_features=5000, min_df=1)
    best = retrieval.with_fallback(m, queries, "item_id", pool, "pair_key", "null")
    out = best.join(pool.select("pair_key", "conv_id", "turn", "brand_reply_clean"), "pair_key", "left")
    return out.select("item_id", "conv_id", "turn", r6(F.col("score")).alias("score"),
                      F.col("brand_reply_clean").alias("reply"))


def retrieve_top3_prompt_q(spark, sf_dir):
    # the k=3 variant also drops pairs whose customer message is blank (it
    # changes the document count of the idf)
    pool = reply_pool(spark, sf_dir).where(F.length(F.trim("customer_msg_clean")) > 0)
    queries = _benchmark_queries(spark, sf_dir)
    m = retrieval.retrieve(queries, "item_id", "q", pool, "pair_key", "customer_msg_clean",
                           k=3, max_features=8000, min_df=2)
    lines = m.join(pool, "pair_key").select(
        "item_id", "rank",
        TX.fill_template(P.PROMPT_LINE,
                         customer=TX.truncate("customer_msg_clean", P.PROMPT_CUSTOMER_CHARS),
                         reply=TX.truncate("brand_reply_clean", P.PROMPT_REPLY_CHARS)).alias("line"))
    per_q = lines.groupBy("item_id").agg(  # at most k rows per query
        F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("_l"))
    prompt = per_q.select("item_id", F.size("_l").cast("long").alias("n_examples"),
                          F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("prompt"))
    out = queries.select("item_id").join(prompt, "item_id", "left")
    return out.select("item_id", F.coalesce("n_examples", F.lit(0).cast("long")).alias("n_examples"),
                      F.coalesce("prompt", F.lit(P.PROMPT_EMPTY)).alias("prompt"))


def retrieve_all_pairs_q(spark, sf_dir):
    """Every reply pair's message against all other pairs (self excluded):
    the case where both sides grow with the data."""
    from ..session import checkpoint_root

    checkpoint_root(spark)
    pool = reply_pool(spark, sf_dir).checkpoint(eager=True)  # read by both sides and the key join
    queries = pool.select(F.col("pair_key").alias("q_key"), "customer_msg_clean")
    m = retrieval.retrieve(queries, "q_key", "customer_msg_clean", pool, "pair_key",
                           "customer_msg_clean", k=1, max_features=5000, min_df=1,
                           exclude_self=True)
    keys = pool.select("pair_key", "conv_id", "turn")
    out = (m.join(keys.withColumnRenamed("pair_key", "q_key"), "q_key")
           .select(F.col("conv_id").alias("q_conv_id"), F.col("turn").alias("q_turn"), "pair_key", "score")
           .join(keys, "pair_key"))
    return out.select("q_conv_id", "q_turn", F.col("conv_id").alias("m_conv_id"),
                      F.col("turn").alias("m_turn"), r6(F.col("score")).alias("score"))


def oof_classifier_q(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang").select(
        "doc_id", TX.clean_text("text").alias("c"), "lang")
    return classify.out_of_fold(docs, "doc_id", "c", "lang", k=5, seed=42)


def cv_accuracy_q(spark, sf_dir):
    oof = oof_classifier_q(spark, sf_dir)
    docs = load(spark, sf_dir, "documents", "lang")
    majority = classify.majority_label(docs, "lang")
    acc = classify.fold_accuracy(oof, "lang")
    base = docs.agg(F.avg(F.when(F.col("lang") == majority, 1.0).otherwise(0.0)).alias("majority_accuracy"))
    return combine_rows(acc, base)


def scoring_job_q(spark, sf_dir):
    """The end-to-end scoring job over every reply pair of the conversations:
    out-of-fold intent (classifier trained on lexicon weak labels), escalation
    and reason rules, the consistency fix, and the top-1 retrieved reply from
    the other pairs (self excluded).

    The classifier and the retrieval are independent: both are materialised
    concurrently (two driver threads submitting Spark jobs), so the cluster
    is busy with retrieval while the small logistic-regression iterations run.
    """
    from concurrent.futures import ThreadPoolExecutor

    from ..session import checkpoint_root

    checkpoint_root(spark)
    # the pool feeds the classifier, both retrieval sides and the final joins:
    # materialise it once instead of re-running the pairing join and cleaning
    pool = reply_pool(spark, sf_dir).checkpoint(eager=True)
    weak = pool.select("pair_key", "customer_msg_clean", rules.first_keyword_label(
        "customer_msg_clean", LX.INTENT_LEXICON, LX.INTENT_DEFAULT).alias("intent"))
    queries = pool.select(F.col("pair_key").alias("q_key"), "customer_msg_clean")

    def classify_all():
        return classify.out_of_fold(weak, "pair_key", "customer_msg_clean", "intent", k=5, seed=42)

    def retrieve_all():
        m = retrieval.retrieve(queries, "q_key", "customer_msg_clean", pool, "pair_key",
                               "customer_msg_clean", k=1, max_features=5000, min_df=1,
                               exclude_self=True)
        return m.select(F.col("q_key").alias("pair_key"), F.col("pair_key").alias("match_key")
                        ).checkpoint(eager=True)  # one row per query

    with ThreadPoolExecutor(max_workers=2) as ex:
        oof_f, best_f = ex.submit(classify_all), ex.submit(retrieve_all)
        oof, best = oof_f.result(), best_f.result()
    preds = oof.join(pool.select("pair_key", "conv_id", "turn", "customer_msg_clean"), "pair_key")
    preds = preds.select(
        "pair_key", "conv_id", "turn", F.col("intent").alias("weak_intent"),
        F.col("prediction").alias("predicted_intent"),
        rules.escalation_for("prediction", "customer_msg_clean", critical=LX.CRITICAL_WORDS,
                             repeat=LX.REPEAT_WORDS).alias("predicted_escalation"),
        rules.reason_for("prediction", "customer_msg_clean", "hybrid",
                         rules=LX.REASON_RULES).alias("predicted_reason"))
    fixed = rules.fix_reasons(preds)
    replies = pool.select(F.col("pair_key").alias("match_key"), F.col("brand_reply_clean").alias("predicted_reply"))
    out = fixed.join(best, "pair_key", "left").join(replies, "match_key", "left")
    return out.select("conv_id", "turn", "weak_intent", "predicted_intent", "predicted_escalation",
                      "predicted_reason", "fix_kind",
                      F.coalesce("predicted_reply", F.lit("")).alias("predicted_reply"))


def evaluate_job_q(spark, sf_dir):
    """Evaluate the scoring job: truth = lexicon intent, the policy decision on
    it and the code-order reason; one nested metrics document."""
    from ..operators import metrics

    preds = scoring_job_q(spark, sf_dir)
    pool = reply_pool(spark, sf_dir).select("conv_id", "turn", "customer_msg_clean")
    truth = preds.join(pool, ["conv_id", "turn"]).select(
        "*", F.col("weak_intent").alias("intent"),
        rules.escalation_for("weak_intent", "customer_msg_clean", critical=LX.CRITICAL_WORDS,
                             repeat=LX.REPEAT_WORDS).alias("escalation_ground_truth"),
        rules.reason_for("weak_intent", "customer_msg_clean", "hybrid",
                         rules=LX.REASON_RULES).alias("escalation_reason"))
    return metrics.eval_document("scoring_job", truth, P.INTENTS, P.ESCALATIONS)


def _stream_score(batch: DataFrame) -> DataFrame:
    msgs = batch.where(F.col("role") == "user").select(
        "conv_id", "turn", TX.clean_text("text").alias("msg"))
    s = msgs.select("conv_id", "turn", "msg", rules.first_keyword_label(
        "msg", LX.INTENT_LEXICON, LX.INTENT_DEFAULT).alias("intent"))
    s = s.select("conv_id", "turn", "intent", rules.escalation_for(
        "intent", "msg", critical=LX.CRITICAL_WORDS, repeat=LX.REPEAT_WORDS).alias("escalation"),
        rules.reason_for("intent", "msg", "hybrid", rules=LX.REASON_RULES).alias("reason"))
    return s.select("conv_id", "turn", "intent", "escalation",
                    rules.consistent_reason("escalation", "reason", "intent").alias("reason"))


def _event_time():
    """Conversations carry no clock; one starts a minute, one turn a second."""
    return F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 60 + F.col("turn"))


def stream_reply_pairs_q(spark, sf_dir):
    """Reply pairs of the conversations consumed as a file stream."""
    run = stream_pairing.run_available(spark, sf_dir, "conversations.parquet", stream.CONVERSATION_SCHEMA, _event_time(),
                                       shared_path(spark, "pairs-sink"), shared_path(spark, "pairs-ckpt"))
    return run.pairs.select("conv_id", "turn", "customer_msg", "brand_reply")


def stream_scoring_q(spark, sf_dir):
    """Conversations consumed as a file stream (every file available now),
    scored per message, exactly-once by (conv_id, turn)."""
    sink = shared_path(spark, "stream-sink")
    ckpt = shared_path(spark, "stream-ckpt")
    out = stream.run_available(spark, sf_dir, "conversations.parquet", stream.CONVERSATION_SCHEMA,
                               _stream_score, ["conv_id", "turn"], sink, ckpt, wanted="role = 'user'",
                               event_time=_event_time())
    return out.select("conv_id", "turn", "intent", "escalation", "reason")
