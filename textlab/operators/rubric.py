"""Rule-based reply rubric: relevance, groundedness, tone, actionability,
safety and the overall mean -- five integer Column expressions.

Null reply or reference is treated as ''.  Substring tests are substring
tests on purpose (``log`` hits "apologize", ``here`` hits "where"), as the
rubric is defined; word tests use the portable word class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import _c, contains_any, count_contained

GROUND_WORD_RE = f"{P.WORD}{{{P.GROUNDED_MIN_WORD},}}"


def _txt(col) -> Column:
    return F.coalesce(_c(col), F.lit(""))


def _short(reply: Column) -> Column:
    return F.length(reply) < P.RUBRIC_MIN_LEN


def relevance(reply, intent, topics=P.RUBRIC_TOPICS) -> Column:
    """>=2 topic substrings of the intent -> 5, one -> 4, a generic topic word
    -> 3, else 2; empty or shorter than 15 characters -> 1."""
    r = _txt(reply)
    lo = F.lower(r)
    i = _c(intent)
    hits = None
    for name, kws in topics.items():
        hits = (F.when(i == name, count_contained(lo, kws)) if hits is None
                else hits.when(i == name, count_contained(lo, kws)))
    hits = hits.otherwise(F.lit(0))
    return (F.when(_short(r), 1).when(hits >= 2, 5).when(hits == 1, 4)
            .when(contains_any(lo, P.RUBRIC_GENERIC), 3).otherwise(2))


def groundedness(reply, reference) -> Column:
    """Share of the reply's distinct >=4-character words also in the reference:
    >= .3 -> 5, >= .15 -> 4, >= .05 -> 3, else 2; no such words -> 2;
    empty reply or reference -> 3."""
    r, f = _txt(reply), _txt(reference)
    rw = F.array_distinct(F.regexp_extract_all(F.lower(r), F.lit(GROUND_WORD_RE), F.lit(0)))
    fw = F.array_distinct(F.regexp_extract_all(F.lower(f), F.lit(GROUND_WORD_RE), F.lit(0)))
    share = F.size(F.array_intersect(rw, fw)).cast("double") / F.size(rw).cast("double")
    expr = F.when((r == "") | (f == ""), 3).when(F.size(rw) == 0, 2)
    for lo, score in P.GROUNDED_STEPS:
        expr = expr.when(share >= lo, score)
    return expr.otherwise(2)


def is_shouting(reply) -> Column:
    """Python ``str.isupper()`` and longer than 30 characters."""
    r = _txt(reply)
    return (F.upper(r) == r) & (F.lower(r) != r) & (F.length(r) > P.TONE_SHOUT_LEN)


def tone(reply) -> Column:
    """3, +1 empathy, +0.5 politeness, -3 abuse, -1 shouting; rounded half to
    even (4.5 -> 4) and clamped to 1..5; empty or short -> 1."""
    r = _txt(reply)
    lo = F.lower(r)
    score = (F.lit(3.0)
             + F.when(contains_any(lo, P.TONE_EMPATHY), 1.0).otherwise(0.0)
             + F.when(contains_any(lo, P.TONE_POLITE), 0.5).otherwise(0.0)
             - F.when(contains_any(lo, P.TONE_ABUSE), 3.0).otherwise(0.0)
             - F.when(is_shouting(r), 1.0).otherwise(0.0))
    clamped = F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.bround(score, 0)))
    return F.when(_short(r), 1).otherwise(clamped.cast("int"))


def actionability(reply, escalation) -> Column:
    r = _txt(reply)
    lo = F.lower(r)
    esc = _c(escalation) == "escalate"
    return (F.when(_short(r), 1)
            .when(esc & contains_any(lo, P.ACT_ESC_CONTACT), 5)
            .when(esc & contains_any(lo, P.ACT_ESC_FOLLOW), 4)
            .when(esc, 2)
            .when(contains_any(lo, P.ACT_AUTO_STEPS), 5)
            .when(contains_any(lo, P.ACT_AUTO_HELP), 4)
            .otherwise(3))


def safety(reply) -> Column:
    """Invented order code -> 2; money amount without "refund" -> 3; absolute
    promise -> 3; else 5; empty -> 1."""
    r = _txt(reply)
    lo = F.lower(r)
    code = r.rlike(f"(?:^|{P.NOT_WORD}){P.SAFETY_CODE}(?:$|{P.NOT_WORD})")
    money = r.rlike(P.SAFETY_MONEY) & ~lo.contains("refund")
    promise = (lo.rlike(P.words(P.SAFETY_PROMISE_WORDS))
               | lo.rlike(f"(?:^|{P.NOT_WORD}){P.SAFETY_PROMISE_PERCENT}"))
    return (F.when(r == "", 1).when(code, 2).when(money, 3).when(promise, 3).otherwise(5))


def score_replies(df: DataFrame, reply: str, reference: str, intent: str, escalation: str) -> DataFrame:
    """Adds the five criteria and ``overall`` (mean, one decimal)."""
    out = df.select("*",
                    relevance(reply, intent).cast("int").alias("relevance"),
                    groundedness(reply, reference).cast("int").alias("groundedness"),
                    tone(reply).cast("int").alias("tone"),
                    actionability(reply, escalation).cast("int").alias("actionability"),
                    safety(reply).cast("int").alias("safety"))
    total = (F.col("relevance") + F.col("groundedness") + F.col("tone")
             + F.col("actionability") + F.col("safety"))
    return out.withColumn("overall", F.round(total.cast("double") / 5.0, 1))


def mean_by(scored: DataFrame, group: str) -> DataFrame:
    """Per group: mean overall and count.  The mean is one division of exact
    integer totals (``Σ criteria / (5·n)``), so it is the same double in every
    engine; round it for display only."""
    total = (F.col("relevance") + F.col("groundedness") + F.col("tone")
             + F.col("actionability") + F.col("safety"))
    return scored.groupBy(group).agg(
        (F.sum(total).cast("double") / (F.count(F.lit(1)) * 5.0)).alias("mean_overall"),
        F.count(F.lit(1)).alias("count"))
