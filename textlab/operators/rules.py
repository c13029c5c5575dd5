"""Rule operators: keyword weak labels, escalation policy, reasons,
decision/reason consistency, label audit and difficulty downgrade.

Every rule is a Column expression evaluated in one scan (whole-stage codegen);
there is no row loop and no UDF.  Rule tables are plain Python data turned
into ordered ``CASE WHEN`` expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import _c, contains_words, fill_template, has_non_ascii, hint_coalesce

# ---------------------------------------------------------------------------
# keyword weak labelling (O65, O23)


def keyword_labels(text, dictionary: Sequence[tuple[str, str]]) -> Column:
    """Array of every label whose ``\\b(pattern)\\b`` matches (case-insensitive),
    in dictionary order.  Null text -> empty array."""
    hits = [F.when(contains_words(text, pat), F.lit(label)) for label, pat in dictionary]
    return F.array_compact(F.array(*hits))


def first_keyword_label(text, dictionary: Sequence[tuple[str, str]], default=None) -> Column:
    """The first dictionary label that matches, else ``default``."""
    expr = None
    for label, pat in dictionary:
        cond = contains_words(text, pat)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def regex_filter(text, pattern: str, min_len: int = 0, max_len: int | None = None) -> Column:
    """Case-insensitive ``\\b(pattern)\\b`` match with inclusive length bounds."""
    n = F.length(_c(text))
    cond = contains_words(text, pattern) & (n >= min_len)
    if max_len is not None:
        cond = cond & (n <= max_len)
    return F.coalesce(cond, F.lit(False))


# ---------------------------------------------------------------------------
# escalation policy (O66), reasons (O67, O68), consistency (O69)


def escalation_for(intent, msg, always_escalate=P.ALWAYS_ESCALATE,
                   critical=P.CRITICAL_WORDS, repeat=P.REPEAT_WORDS,
                   repeat_intents=P.REPEAT_INTENTS) -> Column:
    """Always-escalate intents, then critical words, then repeat words for
    the repeat intents, else auto_handle."""
    i = _c(intent)
    return (F.when(i.isin(*always_escalate), F.lit("escalate"))
            .when(contains_words(msg, critical), F.lit("escalate"))
            .when(contains_words(msg, repeat) & i.isin(*repeat_intents), F.lit("escalate"))
            .otherwise(F.lit("auto_handle")))


def reason_for(intent, msg, variant: str = "hybrid",
               rules=P.REASON_RULES, by_intent=P.REASON_BY_INTENT) -> Column:
    """Reason tag in code order: keyword rules, then by intent, then the tail.

    ``variant='hybrid'``: info_request/other/cancellation -> low_risk, any
    other intent -> deterministic_action.  ``variant='simple'``: -> low_risk.
    """
    i = _c(intent)
    expr = None
    for tag, alternation in rules:
        cond = contains_words(msg, alternation)
        expr = F.when(cond, F.lit(tag)) if expr is None else expr.when(cond, F.lit(tag))
    for name, tag in by_intent:
        expr = expr.when(i == name, F.lit(tag))
    if variant == "hybrid":
        return (expr.when(i.isin(*P.HYBRID_LOW_RISK_INTENTS), F.lit("low_risk"))
                .otherwise(F.lit("deterministic_action")))
    if variant == "simple":
        return expr.otherwise(F.lit("low_risk"))
    raise ValueError(f"unknown variant {variant!r}")


def message_amount(msg) -> Column:
    """First currency amount in the message (₹ / $ / rs / inr), as a long;
    grouping commas are read, an amount beyond a long is null."""
    a = F.regexp_extract(F.lower(F.coalesce(_c(msg), F.lit(""))), P.AMOUNT_RE, 1)
    return F.when(a != "", F.replace(a, F.lit(","), F.lit("")).try_cast("long"))


def over_amount(intent, msg, thresholds=P.AMOUNT_THRESHOLDS) -> Column:
    """True when the message's amount exceeds the intent's documented threshold."""
    i, amt = _c(intent), message_amount(msg)
    cond = F.lit(False)
    for name, limit in thresholds.items():
        cond = cond | ((i == name) & (amt > limit))
    return F.coalesce(cond, F.lit(False))


def policy_reason(intent, msg, escalation, priority=P.POLICY_PRIORITY,
                  rules=P.REASON_RULES, by_intent=P.REASON_BY_INTENT,
                  amount_thresholds: dict | None = None) -> Column:
    """Reason under the documented priority (policy v1.1): every candidate tag
    that applies is collected, the one with the best priority wins.

    Candidates: the keyword rules and intent defaults; ``high_value`` when
    ``amount_thresholds`` are given and the message's amount exceeds its
    intent's threshold; ``kb_unavailable`` never fires (no knowledge base);
    then deterministic_action / low_risk for auto-handled rows.
    """
    i, e = _c(intent), _c(escalation)
    rank = {tag: n for n, tag in enumerate(priority)}
    cands = []
    for tag, alternation in rules:
        cands.append(F.when(contains_words(msg, alternation), F.lit(rank[tag])))
    for name, tag in by_intent:
        cands.append(F.when(i == name, F.lit(rank[tag])))
    if amount_thresholds:
        cands.append(F.when(over_amount(i, msg, amount_thresholds), F.lit(rank["high_value"])))
    cands.append(F.when((e == "auto_handle") & ~i.isin(*P.HYBRID_LOW_RISK_INTENTS),
                        F.lit(rank["deterministic_action"])))
    cands.append(F.lit(rank["low_risk"]))
    best = F.least(*cands)
    expr = None
    for tag, n in rank.items():
        expr = F.when(best == n, F.lit(tag)) if expr is None else expr.when(best == n, F.lit(tag))
    return expr


def _lookup(key: Column, mapping: dict, default: str) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def consistent_reason(escalation, reason, intent) -> Column:
    """Post-processor: auto_handle + escalate-reason -> AUTO_FALLBACK[intent]
    (default low_risk); escalate + auto-reason -> ESC_FALLBACK[intent]
    (default high_emotion); otherwise unchanged."""
    e, r, i = _c(escalation), _c(reason), _c(intent)
    return (F.when((e == "auto_handle") & r.isin(*P.ESC_REASONS),
                   _lookup(i, P.AUTO_FALLBACK, P.AUTO_FALLBACK_DEFAULT))
            .when((e == "escalate") & r.isin(*P.AUTO_REASONS),
                  _lookup(i, P.ESC_FALLBACK, P.ESC_FALLBACK_DEFAULT))
            .otherwise(r))


def reason_fix_kind(escalation, reason) -> Column:
    """'auto' / 'escalate' when the post-processor changes the row, else null."""
    e, r = _c(escalation), _c(reason)
    return (F.when((e == "auto_handle") & r.isin(*P.ESC_REASONS), F.lit("auto"))
            .when((e == "escalate") & r.isin(*P.AUTO_REASONS), F.lit("escalate")))


def fix_reasons(predictions: DataFrame, intent="predicted_intent",
                escalation="predicted_escalation", reason="predicted_reason") -> DataFrame:
    """Apply the consistency post-processor; adds ``fix_kind``."""
    return (predictions
            .withColumn("fix_kind", reason_fix_kind(escalation, reason))
            .withColumn(reason, consistent_reason(escalation, reason, intent)))


# ---------------------------------------------------------------------------
# label audit (O70) and difficulty downgrade (O71)


def audit_rules(intent="intent", escalation="escalation_ground_truth",
                reason="escalation_reason", difficulty="difficulty",
                message="customer_msg_clean", hint_v2="intent_llm_guess_v2",
                hint_v1="intent_llm_guess") -> list[tuple[str, Column, Column]]:
    """The twelve audit rules as ``(rule, predicate, why)`` Columns.

    Null text is treated as ''.  Predicates are null-safe (coalesced to false).
    """
    i, e, r, d = _c(intent), _c(escalation), _c(reason), _c(difficulty)
    m = F.coalesce(_c(message), F.lit(""))
    n = F.length(m)
    hint = hint_coalesce(hint_v2, hint_v1)
    preds = [
        (e == "auto_handle") & r.isin(*P.ESC_REASONS),
        (e == "escalate") & r.isin(*P.AUTO_REASONS),
        (i == "complaint") & contains_words(m, P.AUDIT_TOPIC_WORDS),
        (i == "info_request") & contains_words(m, P.AUDIT_PROBLEM_WORDS),
        (i == "product_issue") & contains_words(m, P.AUDIT_MONEY_WORDS),
        (i == "order_status") & contains_words(m, P.AUDIT_DISPUTE_WORDS),
        (n < P.AUDIT_SHORT_LEN) & ~i.isin("other", "complaint"),
        (i == "account_access") & ~e.eqNullSafe("escalate"),
        (i == "complaint") & ~e.eqNullSafe("escalate"),
        (i == "billing_payment") & ~e.eqNullSafe("escalate"),
        (d == "easy") & (i != "") & (hint != "") & (hint != i),
        (i == "complaint") & has_non_ascii(m),
        (r == "kb_unavailable") & ~contains_words(m, P.AUDIT_KB_WORDS) & (n < P.AUDIT_KB_SHORT_LEN),
    ]
    fields = {"reason": r, "intent": i, "length": n, "hint": hint}
    rules = [(name, pred, fill_template(msg, **fields))
             for (name, msg), pred in zip(P.AUDIT_MESSAGES, preds)]
    return [(name, F.coalesce(pred, F.lit(False)), why) for name, pred, why in rules]


def audit(labelled: DataFrame, id_col: str = "id", rules=None, **cols) -> DataFrame:
    """One scan: every row -> zero or more ``(rule, why)`` flags, first flag per
    (id, rule) kept (rule order).  Output columns: id, intent, escalation,
    reason, difficulty, message (first 150 chars), rule, why."""
    rules = rules if rules is not None else audit_rules(**cols)
    names = {"intent": cols.get("intent", "intent"),
             "escalation": cols.get("escalation", "escalation_ground_truth"),
             "reason": cols.get("reason", "escalation_reason"),
             "difficulty": cols.get("difficulty", "difficulty"),
             "message": cols.get("message", "customer_msg_clean")}
    flags = F.array_compact(F.array(*[
        F.when(pred, F.struct(F.lit(k).alias("seq"), F.lit(name).alias("rule"), why.alias("why")))
        for k, (name, pred, why) in enumerate(rules)]))
    exploded = labelled.select(
        F.col(id_col).alias("id"),
        F.col(names["intent"]).alias("intent"),
        F.col(names["escalation"]).alias("escalation"),
        F.col(names["reason"]).alias("reason"),
        F.col(names["difficulty"]).alias("difficulty"),
        F.substring(F.coalesce(F.col(names["message"]), F.lit("")), 1,
                    P.AUDIT_MESSAGE_CHARS).alias("message"),
        F.explode(flags).alias("f"))
    # (id, rule) is unique without a shuffle: the two R1 predicates exclude
    # each other and every other rule fires at most once per row; ids are
    # unique in a labelled table.
    return exploded.select("id", "intent", "escalation", "reason", "difficulty", "message",
                           F.col("f.rule").alias("rule"), F.col("f.why").alias("why"))


def downgrade_difficulty(difficulty, intent, hint_v2, hint_v1) -> Column:
    """easy -> medium when the final intent overrides a non-blank hint."""
    d, i = _c(difficulty), _c(intent)
    hint = hint_coalesce(hint_v2, hint_v1)
    cond = (d == "easy") & (i != "") & (hint != "") & (hint != i)
    return F.when(F.coalesce(cond, F.lit(False)), F.lit("medium")).otherwise(d)
