"""Registered queries: audits, agreement, baselines, rubric, responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as TX
from ..operators import agreement, classify, metrics, responses, rubric, rules, sampling, tables
from . import lexicons as LX
from .common import load, r6


def _case(col, mapping: dict, default):
    expr = None
    for k, v in mapping.items():
        expr = F.when(F.col(col) == k, F.lit(v)) if expr is None else expr.when(F.col(col) == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def golden_like(spark, sf_dir):
    """documents ⋈ labels shaped like a labelled review table."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang", "n_chars")
    labels = load(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    j = docs.join(labels, "doc_id")
    j = j.withColumn("customer_msg_clean", TX.clean_text("text"))  # once: the labels and rules refer to it
    return j.select(
        F.col("doc_id").alias("id"), "customer_msg_clean",
        rules.first_keyword_label("customer_msg_clean", LX.INTENT_LEXICON, LX.INTENT_DEFAULT).alias("intent"),
        F.when(F.col("toxic") == 1, "escalate").otherwise("auto_handle").alias("escalation_ground_truth"),
        F.when(F.col("quality") == 0, "kb_unavailable").when(F.col("toxic") == 1, "low_risk")
         .otherwise("deterministic_action").alias("escalation_reason"),
        F.when(F.col("n_chars") < 500, "easy").when(F.col("n_chars") < 3000, "medium")
         .otherwise("hard").alias("difficulty"),
        _case("lang", LX.LANG_HINTS, "other").alias("intent_llm_guess"),
        F.lit(None).cast("string").alias("intent_llm_guess_v2"))


def label_audit_q(spark, sf_dir):
    return rules.audit(golden_like(spark, sf_dir), "id")


def audit_summary_q(spark, sf_dir):
    flags = label_audit_q(spark, sf_dir)
    per_rule = flags.groupBy("rule").agg(F.count(F.lit(1)).alias("n_flags"),
                                        F.countDistinct("id").alias("n_ids"))
    total = flags.agg(F.lit("(all)").alias("rule"), F.count(F.lit(1)).alias("n_flags"),
                      F.countDistinct("id").alias("n_ids"))
    return per_rule.unionByName(total)


def audit_top_rows_q(spark, sf_dir):
    """The review report: first 20 flags ordered by id (then rule)."""
    flags = label_audit_q(spark, sf_dir)
    return (flags.orderBy("id", "rule").limit(20)
            .select("id", "intent", "escalation", "reason", "difficulty", "rule"))


def label_drift_q(spark, sf_dir):
    """Two label passes side by side: pass one = quality label, pass two =
    the inverted toxicity label; counts of every changed (from, to) pair."""
    from ..operators import profile
    labels = load(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    two = labels.select(F.when(F.col("quality") == 1, "keep").when(F.col("quality") == 0, "drop").alias("pass1"),
                        F.when(F.col("toxic") == 0, "keep").when(F.col("toxic") == 1, "drop").alias("pass2"))
    return profile.label_drift(two, "pass1", "pass2")


def downgrade_q(spark, sf_dir):
    g = golden_like(spark, sf_dir)
    return g.select("id", "difficulty", rules.downgrade_difficulty(
        "difficulty", "intent", "intent_llm_guess_v2", "intent_llm_guess").alias("difficulty_after"))


def kappa_q(spark, sf_dir):
    labels = load(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    k = agreement.cohen_kappa(labels.select(F.col("quality").alias("a"),
                                            (1 - F.col("toxic")).alias("b")), "a", "b")
    return k.select("n", r6(F.col("p_observed")).alias("p_observed"),
                    r6(F.col("p_expected")).alias("p_expected"), r6(F.col("kappa")).alias("kappa"))


def _annotation_passes(spark, sf_dir):
    """Pass one: the quality label; pass two: long documents are good."""
    one = load(spark, sf_dir, "labels", "doc_id", "quality").select("doc_id", F.col("quality").cast("long").alias("label"))
    two = load(spark, sf_dir, "documents", "doc_id", "n_chars").select(
        "doc_id", (F.col("n_chars") >= 1000).cast("long").alias("label"))
    return agreement.two_passes(one, two, "doc_id", "label")


def two_pass_kappa_q(spark, sf_dir):
    k = agreement.cohen_kappa(_annotation_passes(spark, sf_dir), "a", "b")
    return k.select("n", r6(F.col("p_observed")).alias("p_observed"),
                    r6(F.col("p_expected")).alias("p_expected"), r6(F.col("kappa")).alias("kappa"))


def pass_disagreements_q(spark, sf_dir):
    return agreement.disagreements(_annotation_passes(spark, sf_dir))


def label_progress_q(spark, sf_dir):
    return tables.label_progress(load(spark, sf_dir, "documents", "lang"), "lang")


def random_sample_q(spark, sf_dir):
    return sampling.hash_sample(load(spark, sf_dir, "documents", "doc_id", "lang"), "doc_id", 200, 42)


def stratified_folds_q(spark, sf_dir):
    labels = load(spark, sf_dir, "labels", "doc_id", "quality")
    return classify.stratified_folds(labels, "quality", "doc_id").select("doc_id", "quality", "fold")


def rank_agreement_q(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem", "l_quantity", "l_discount")
    ra = agreement.rank_agreement(li, "l_quantity", "l_discount")
    # 9 decimals: means of 2-decimal values terminate within 7 decimals, so a
    # rounding tie (where engines round differently) cannot occur at 9
    return ra.select("n", *[F.round(F.col(c), 9).alias(c) for c in
                            ("judge_mean", "human_mean", "rho", "t_stat", "p_value", "mae", "exact", "within1")],
                     "band", "bias")


SYSTEMS = {"len300": 300, "len1000": 1000}


def compare_systems_q(spark, sf_dir):
    """Two threshold systems scored side by side in one pass, plus how many
    predictions changed between them."""
    docs = load(spark, sf_dir, "documents", "doc_id", "n_chars")
    labels = load(spark, sf_dir, "labels", "doc_id", "quality")
    j = docs.join(labels, "doc_id")
    truth = F.when(F.col("quality") == 1, "high").otherwise("low")
    preds = {name: F.when(F.col("n_chars") >= t, "high").otherwise("low") for name, t in SYSTEMS.items()}
    wide = j.select("doc_id", truth.alias("truth"), *[c.alias(n) for n, c in preds.items()])
    long = wide.select("truth", F.explode(F.array(*[
        F.struct(F.lit(n).alias("system"), F.col(n).alias("pred")) for n in SYSTEMS])).alias("s")).select(
        "truth", "s.system", "s.pred")
    per = metrics.summary_by(long, "truth", "pred", "system", ["low", "high"])
    names = list(SYSTEMS)
    # predictions that differ between the two systems: the same count on each
    # system's row (a two-row table joined on the system name)
    n_changed = wide.agg(F.count_if(~F.col(names[0]).eqNullSafe(F.col(names[1]))).alias("n_changed"))
    changed = n_changed.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("system"), F.col("n_changed").alias("n_changed")) for n in names])).alias("c")
    ).select("c.*")
    out = per.join(changed, "system")
    return out.select("system", "n", r6(F.col("accuracy")).alias("accuracy"),
                      r6(F.col("macro_f1")).alias("macro_f1"), "n_changed")


def compare_baselines_q(spark, sf_dir):
    """The trivial, the simple and the hybrid system's reasons side by side
    against the documented policy's reason, in one pass over the messages."""
    from .queries import _escalation, _scored_messages
    s = _scored_messages(spark, sf_dir).withColumn("escalation", _escalation())
    s = s.select(
        "intent", "escalation", rules.policy_reason("intent", "msg", "escalation", rules=LX.REASON_RULES).alias("truth"),
        rules.reason_for("intent", "msg", "simple", rules=LX.REASON_RULES).alias("simple"),
        rules.reason_for("intent", "msg", "hybrid", rules=LX.REASON_RULES).alias("coded"))
    preds = {"trivial": F.lit(P.TRIVIAL_REASON), "simple": F.col("simple"),
             "hybrid": rules.consistent_reason("escalation", "coded", "intent")}
    long = s.select("truth", F.explode(F.array(*[
        F.struct(F.lit(name).alias("system"), p.alias("pred")) for name, p in preds.items()])).alias("s")).select(
        "truth", "s.system", "s.pred")
    per = metrics.summary_by(long, "truth", "pred", "system", P.REASONS)
    return per.select("system", "n", r6(F.col("accuracy")).alias("reason_agreement"),
                      r6(F.col("macro_f1")).alias("macro_f1"), r6(F.col("weighted_f1")).alias("weighted_f1"))


def majority_baseline_q(spark, sf_dir):
    ev = load(spark, sf_dir, "events", "event_id", "event_type")
    top = (ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), F.asc("event_type")).limit(1).first())
    majority = top["event_type"] if top else None
    return ev.select("event_id", F.lit(majority).alias("predicted_type"),
                     F.lit(P.TRIVIAL_ESCALATION).alias("predicted_escalation"),
                     F.lit(P.TRIVIAL_REASON).alias("predicted_reason"),
                     F.lit(P.TRIVIAL_REPLY).alias("predicted_reply"))


def _raw_responses(spark, sf_dir):
    ev = load(spark, sf_dir, "events", "event_id", "event_type", "props")
    plain = F.concat(F.lit('{"intent": "'), _case("event_type", LX.EVENT_INTENTS, "other"),
                     F.lit('", '), F.expr("substring(props, 2)"))
    variant = F.pmod(F.col("event_id"), F.lit(5))
    raw = (F.when(variant == 0, plain)
           .when(variant == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
           .when(variant == 2, F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('\\"')), F.lit('"')))
           .when(variant == 3, F.concat(F.lit("Sure, here it is: "), plain, F.lit(" Hope this helps.")))
           .otherwise(F.substring(plain, 1, 12)))
    return ev.select("event_id", variant.cast("int").alias("variant"), raw.alias("raw_response"))


def response_parse_q(spark, sf_dir):
    parsed = responses.parse_responses(_raw_responses(spark, sf_dir), "raw_response",
                                       keep=["event_id", "variant"])
    return parsed.select("event_id", "variant", "parsed", "intent", "escalation", "reason",
                         F.try_variant_get("_obj", "$.k", "bigint").alias("k"))


def _rubric_rows(spark, sf_dir):
    """Reply pairs scored by the rubric; the reference reply is the next
    assistant reply of the same conversation (null at the end)."""
    from .queries import _escalation, _scored_messages
    s = _scored_messages(spark, sf_dir).withColumn("escalation", _escalation())
    ref = s.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("reply").alias("reference"))
    j = s.join(ref, ["conv_id", "turn"], "left")
    return rubric.score_replies(j, "reply", "reference", "intent", "escalation")


def rubric_scores_q(spark, sf_dir):
    return _rubric_rows(spark, sf_dir).select(
        "conv_id", "turn", "intent", "relevance", "groundedness", "tone", "actionability",
        "safety", "overall")


def rubric_by_class_q(spark, sf_dir):
    return rubric.mean_by(_rubric_rows(spark, sf_dir), "intent")
