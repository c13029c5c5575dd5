from textlab.operators import rubric


def score(spark, reply, reference="", intent="other", escalation="auto_handle"):
    df = spark.createDataFrame([(reply, reference, intent, escalation)],
                               "reply string, reference string, intent string, escalation string")
    return rubric.score_replies(df, "reply", "reference", "intent", "escalation").first()


def test_short_reply_boundary(spark):
    assert score(spark, "a" * 14)["relevance"] == 1
    assert score(spark, "a" * 15)["relevance"] == 2


def test_relevance_substrings(spark):
    r = score(spark, "Thank you, glad to help", intent="other")
    assert r["relevance"] == 5
    assert score(spark, "We apologize for this", intent="account_access")["relevance"] == 4  # 'log' in apologize
    assert score(spark, "Your order is noted here", intent="complaint")["relevance"] == 3


def test_tone_half_even(spark):
    # 3 + 1 (sorry) + 0.5 (please) = 4.5 -> 4 (half to even): 5 is unreachable this way
    assert score(spark, "Sorry about that, please wait")["tone"] == 4
    assert score(spark, "Please wait a little while now")["tone"] == 4   # 3.5 -> 4
    assert score(spark, "You are an idiot, go away now")["tone"] == 1    # 3 - 3 = 0 -> clamp 1
    assert score(spark, "THIS IS A VERY LOUD REPLY WITHOUT ANY CARE")["tone"] == 2


def test_groundedness_thresholds(spark):
    ref = "alpha beta gamma delta"
    assert score(spark, "alpha beta gamma zzzz wwww vvvv uuuu tttt ssss rrrr", ref)["groundedness"] == 5  # .3
    assert score(spark, "alpha zzzz wwww vvvv uuuu tttt", ref)["groundedness"] == 4    # 1/6
    assert score(spark, "alpha " + " ".join(f"w{i:03d}" for i in range(19)), ref)["groundedness"] == 3  # .05
    assert score(spark, "abc de fg hi jk lm no", ref)["groundedness"] == 2   # no >=4-char words
    assert score(spark, "alpha beta gamma delta", None)["groundedness"] == 3


def test_actionability(spark):
    assert score(spark, "Please DM us the details", escalation="escalate")["actionability"] == 5
    assert score(spark, "We will look into it soon", escalation="escalate")["actionability"] == 4
    assert score(spark, "Nothing to add from our side", escalation="escalate")["actionability"] == 2
    assert score(spark, "Anywhere works for the courier")["actionability"] == 5   # 'here' in 'anywhere'


def test_safety(spark):
    assert score(spark, "Your order AB12345 is ready now")["safety"] == 2
    assert score(spark, "We can give you $5 for the trouble")["safety"] == 3
    assert score(spark, "A refund of $5 was issued to you")["safety"] == 5
    assert score(spark, "We guarantee it will arrive today")["safety"] == 3
    assert score(spark, "We are 100% sure it works fine")["safety"] == 3
    assert score(spark, "")["safety"] == 1


def test_overall_and_mean(spark):
    r = score(spark, "Thank you, glad to help")
    total = r["relevance"] + r["groundedness"] + r["tone"] + r["actionability"] + r["safety"]
    assert r["overall"] == round(total / 5, 1)
