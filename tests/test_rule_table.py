"""Rules as data against the rule expressions."""

import random

import pytest
from pyspark.sql import functions as F

from textlab.functions import patterns as P
from textlab.functions.text import contains_words
from textlab.operators import rule_table, rules

WORDS = ["refund", "money back", "lawyer", "sue", "charged", "overcharged", "log in", "login", "unauthorised", "close my account", "fire",
         "hacked", "again", "third time", "étoile", "x_refund", "refunds", "ok", "7", "$ 6,000", "₹900", "legal", "injury", "ſue"]
DECISIONS = ["escalation", "reason_hybrid", "reason_simple", "reason_policy"]


def messages(spark, n=400):
    r = random.Random(3)
    rows = [(i, r.choice([*P.INTENTS, None]), " ".join(r.choice(WORDS) + r.choice(["", "!", ","]) for _ in range(r.randint(0, 5))).title())
            for i in range(n)] + [(n, "other", None), (n + 1, "complaint", "")]
    return spark.createDataFrame(rows, "id long, intent string, msg string").repartition(3)


def test_policy_table_equals_the_expressions(spark):
    df = messages(spark)
    table = spark.createDataFrame(rule_table.policy_table(amounts=P.AMOUNT_THRESHOLDS), rule_table.SCHEMA)
    got = rule_table.decide(df, table, DECISIONS, "msg", "intent")
    assert got.columns == ["id", "intent", "msg", *DECISIONS]
    want = df.withColumn("escalation", rules.escalation_for("intent", "msg")).select(
        "*", rules.reason_for("intent", "msg", "hybrid").alias("reason_hybrid"), rules.reason_for("intent", "msg", "simple").alias("reason_simple"),
        rules.policy_reason("intent", "msg", "escalation", amount_thresholds=P.AMOUNT_THRESHOLDS).alias("reason_policy"))
    differ = [(a, b) for a, b in zip(got.orderBy("id").collect(), want.orderBy("id").collect()) if a != b]
    assert not differ
    assert {r.reason_policy for r in got.collect()} >= {"high_value", "legal_threat", "low_risk"}


@pytest.mark.parametrize("pattern", ["refund|money back|lawyer", P.RARE_INTENT_PATTERNS[1][1], P.RARE_INTENT_PATTERNS[2][1], P.TOPUP_PATTERNS[1][1], "7|ok"])
def test_hits_equal_the_word_test(spark, pattern):
    df = messages(spark, 200).withColumn("want", contains_words("msg", pattern))
    got = rule_table.with_hits(df, "msg", ["zzz", pattern]).select("want", F.array_contains("hits", F.lit(1)).alias("got"))
    assert got.where("want <> got").count() == 0 and got.where("want").count() > 0


def test_alternatives_outside_brackets_only():
    assert rule_table.alternatives("a b|c(?:d|e)|[|x]y|z") == ["a b", "c(?:d|e)", "[|x]y", "z"]


def test_a_new_rule_changes_rows_and_not_the_plan(spark):
    df = messages(spark, 30)
    base = [("d", 5, "none", None, None, None, None, None)]
    more = [*base, ("d", 1, "found", "refund", None, ["other"], None, None), ("d", 1, "first", "refund", None, None, None, None)]
    shapes = []
    for rows in (base, more, []):
        out = rule_table.decide(df, spark.createDataFrame(rows, rule_table.SCHEMA), ["d"], "msg", "intent")
        tags = {r.d for r in out.where(contains_words("msg", "refund")).collect()}
        assert tags == ({"none"} if rows == base else {"first"} if rows else {None})
        assert {r.d for r in out.where(~contains_words("msg", "refund")).collect()} == ({None} if not rows else {"none"})
        shapes.append([line.strip(" +-:*()0123456789").split(" ")[0] for line in out._jdf.queryExecution().executedPlan().toString().splitlines()])
    assert shapes[0] == shapes[1]
