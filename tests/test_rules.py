from textlab.operators import rules
from textlab.functions import patterns as P

from conftest import rows


def test_escalation_policy_as_coded(spark):
    df = spark.createDataFrame([
        ("complaint", "fine thanks"),                 # always-escalate intent
        ("order_status", "it says delivered but nothing"),   # critical words
        ("order_status", "still waiting"),             # repeat word, repeat intent
        ("info_request", "still waiting"),             # repeat word, other intent
        ("other", "I was unauthorised"),               # dead stem never matches
        ("cancellation", None),
    ], "intent string, msg string")
    got = [r["e"] for r in df.select(rules.escalation_for("intent", "msg").alias("e")).collect()]
    assert got == ["escalate", "escalate", "escalate", "auto_handle", "auto_handle", "auto_handle"]


def test_reason_variants(spark):
    df = spark.createDataFrame([
        ("other", "my password was hacked and I will go to court"),   # security before legal
        ("other", "the charger caught fire"),                         # 'fire' word
        ("order_status", "again no package"),
        ("billing_payment", "hello"),
        ("order_status", "hello"),
        ("cancellation", "hello"),
    ], "intent string, msg string")
    out = df.select(rules.reason_for("intent", "msg", "hybrid").alias("h"),
                    rules.reason_for("intent", "msg", "simple").alias("s")).collect()
    assert [r["h"] for r in out] == ["security_sensitive", "safety_issue", "repeat_failure",
                                     "financial_risk", "deterministic_action", "low_risk"]
    assert [r["s"] for r in out] == ["security_sensitive", "safety_issue", "repeat_failure",
                                     "financial_risk", "low_risk", "low_risk"]


def test_policy_priority_order(spark):
    # code order picks security first; the documented priority puts legal first
    df = spark.createDataFrame([("other", "hacked account, lawsuit coming", "escalate")],
                               "intent string, msg string, esc string")
    r = df.select(rules.reason_for("intent", "msg").alias("code"),
                  rules.policy_reason("intent", "msg", "esc").alias("doc")).first()
    assert (r["code"], r["doc"]) == ("security_sensitive", "legal_threat")


def test_consistency_post_processor(spark):
    df = spark.createDataFrame([
        ("order_status", "auto_handle", "financial_risk"),
        ("weird", "auto_handle", "high_emotion"),
        ("account_access", "escalate", "low_risk"),
        ("weird", "escalate", "deterministic_action"),
        ("complaint", "escalate", "high_emotion"),
    ], "predicted_intent string, predicted_escalation string, predicted_reason string")
    out = rules.fix_reasons(df).collect()
    assert [r["predicted_reason"] for r in out] == [
        "deterministic_action", "low_risk", "security_sensitive", "high_emotion", "high_emotion"]
    assert [r["fix_kind"] for r in out] == ["auto", "auto", "escalate", "escalate", None]


def test_audit_rules_fire(spark):
    data = [
        (1, "auto_handle", "financial_risk", "order_status", "medium", "where is my parcel please", None, None),
        (2, "escalate", "low_risk", "complaint", "medium", "my refund never came back to me", None, None),
        (3, "escalate", "high_emotion", "info_request", "medium", "the app is not working for me today", None, None),
        (4, "auto_handle", "deterministic_action", "product_issue", "medium", "I want my money back for this", None, None),
        (5, "auto_handle", "deterministic_action", "order_status", "medium", "tracking said delivered but no", None, None),
        (6, "auto_handle", "low_risk", "info_request", "medium", "hi?", None, None),
        (7, "auto_handle", "security_sensitive", "account_access", "medium", "cannot log into the account here", None, None),
        (8, "escalate", "high_emotion", "billing_payment", "easy", "i was charged twice this month", "other", " "),
        (9, "escalate", "high_emotion", "complaint", "medium", "c'est vraiment très mauvais service", None, None),
        (10, "escalate", "kb_unavailable", "other", "medium", "short one", None, None),
    ]
    df = spark.createDataFrame(data, "id long, escalation_ground_truth string, escalation_reason string, "
                                     "intent string, difficulty string, customer_msg_clean string, "
                                     "intent_llm_guess string, intent_llm_guess_v2 string")
    flags = rows(rules.audit(df), "id", "rule")
    assert (1, "R1-escalation-mismatch") in flags
    assert (2, "R1-escalation-mismatch") in flags and (2, "R2-complaint-topic") in flags
    assert (3, "R3-info-but-problem") in flags
    assert (4, "R4-product-but-money") in flags
    assert (5, "R5-order-status-dispute") in flags
    assert (6, "R6-short-fragment") in flags
    assert (7, "R7-account-access-auto") in flags and (7, "R1-escalation-mismatch") in flags
    assert (8, "R10-easy-but-override") in flags
    assert (9, "R11-non-english-complaint") in flags
    assert (10, "R12-suspicious-kb") in flags
    assert len(flags) == len(set(flags))


def test_downgrade_difficulty(spark):
    df = spark.createDataFrame([("easy", "other", None, "complaint"), ("easy", "other", "other", "x"),
                                ("hard", "a", "b", "c"), ("easy", "x", " ", "")],
                               "d string, i string, v2 string, v1 string")
    got = [r["x"] for r in df.select(rules.downgrade_difficulty("d", "i", "v2", "v1").alias("x")).collect()]
    assert got == ["medium", "easy", "hard", "easy"]


def test_keyword_labels_dictionary_order(spark):
    df = spark.createDataFrame([("I want a refund and my password reset",)], "t string")
    got = df.select(rules.keyword_labels("t", P.RARE_INTENT_PATTERNS).alias("x")).first()["x"]
    assert got == ["refund_return", "account_access"]


def test_documented_amount_thresholds(spark):
    df = spark.createDataFrame([
        ("refund_return", "please refund ₹1500 now", "escalate"),
        ("refund_return", "please refund $900 now", "escalate"),
        ("order_status", "order worth rs 6000 lost", "escalate"),
        ("order_status", "order worth rs 6000 lost, lawsuit", "escalate"),
    ], "intent string, msg string, esc string")
    got = [r["x"] for r in df.select(rules.policy_reason(
        "intent", "msg", "esc", amount_thresholds=P.AMOUNT_THRESHOLDS).alias("x")).collect()]
    # financial words outrank high_value in the documented priority
    assert got == ["financial_risk", "financial_risk", "high_value", "legal_threat"]
    amounts = [r["a"] for r in df.select(rules.message_amount("msg").alias("a")).collect()]
    assert amounts == [1500, 900, 6000, 6000]


def test_message_amounts(spark):
    cases = [("refund of ₹12,500", 12500), ("a ₹12,000 TV", 12000), ("lost ₹8,500 order", 8500), ("₹1,00,000 gone", 100000),
             ("hours 9000", None), ("orders 5001", None), ("Rs. 700", 700), ("INR 42", 42), ("$ 15", 15), ("₹١٢٣٤", None),
             ("₹99999999999999999999", None), ("no amount", None), (None, None)]
    df = spark.createDataFrame(cases, "msg string, want long").coalesce(1)
    assert [(r["msg"], r["got"]) for r in df.select("msg", rules.message_amount("msg").alias("got")).collect()] == cases


def test_review_workbook_shape(spark):
    from textlab.operators import tables
    df = spark.createDataFrame([(1, "msg", "rep", "complaint", "very_long")],
                               "k long, m string, r string, g string, tag string")
    wb = tables.review_workbook(df, "k", "m", "r", "g").first()
    assert list(wb.asDict()) == ["id", "customer_msg_clean", "brand_reply_clean", "intent_llm_guess",
                                 "intent", "escalation_ground_truth", "escalation_reason",
                                 "golden_reply", "difficulty", "is_edge_case", "notes"]
    assert wb["intent_llm_guess"] == "complaint" and wb["is_edge_case"] is False
    edge = tables.review_workbook(df, "k", "m", "r", "g", edge=True, edge_tag_col="tag").first()
    assert (edge["intent_llm_guess"], edge["difficulty"], edge["notes"]) == ("", "hard", "very_long")
