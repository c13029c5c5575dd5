from textlab.operators import responses


def test_parse_variants(spark):
    raw = [
        '{"intent": "refund_return", "escalation": "escalate", "reason": "financial_risk", "confidence": 0.8}',
        '```json\n{"intent": "complaint"}\n```',
        '"{\\"intent\\": \\"cancellation\\"}"',
        'Here you go: {"intent": "other", "reason": "nonsense"} thanks',
        '{"intent": "unknown_label"}',
        '{"intent": ',
        '[1, 2]',
        None,
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "id long, raw string")
    out = {r["id"]: r for r in responses.parse_responses(df, "raw", keep=["id"]).collect()}
    assert (out[0]["intent"], out[0]["escalation"], out[0]["reason"], out[0]["confidence"]) == \
        ("refund_return", "escalate", "financial_risk", 0.8)
    assert out[1]["intent"] == "complaint" and out[1]["parsed"]
    assert out[2]["intent"] == "cancellation"
    assert out[3]["intent"] == "other" and out[3]["reason"] == "low_risk"
    assert out[4]["intent"] == "other" and out[4]["parsed"]
    for i in (5, 6, 7):
        assert not out[i]["parsed"]
        assert (out[i]["intent"], out[i]["escalation"], out[i]["confidence"]) == ("other", "auto_handle", 0.0)
