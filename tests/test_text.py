import re

from pyspark.sql import functions as F

from textlab.functions import patterns as P
from textlab.functions import text as TX


def one(spark, value, expr_fn, schema="t string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr_fn("t").alias("x")).first()["x"]


def ref_clean(text):
    """The cleaning rule written with Python's re, for comparison."""
    text = re.sub(r"http\S+|www\S+|https\S+", "", text, flags=re.MULTILINE)
    text = re.sub(r"@\w+", "", text)
    return re.sub(r"\s+", " ", text).strip()


CASES = [
    "see https://t.co/abc now", "only http://x.y", "@ShopHelp my order", "mail me a@b.com please",
    "awwww yes", "tab\there\nnew  line", "nbsp\u00a0here\u2003em\u3000x\x1cy\x0bz", "emoji 😀 ok", "Привет @мир тест",
    "NA", "", "   ", "trailing www.site.com/x?y=1 end", "wwwhat is this",
]


def test_clean_text_matches_python_rule(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "t string")
    got = [r["x"] for r in df.select(TX.clean_text("t").alias("x")).collect()]
    assert got == [ref_clean(c) for c in CASES]


def test_clean_text_null_in_null_out(spark):
    assert one(spark, None, TX.clean_text) is None


def test_eda_tokens_unicode_boundaries(spark):
    assert one(spark, "Éclair and the CAT's naïve cafe_bar x1yz hello", TX.eda_tokens) == \
        ["and", "the", "cat", "hello"]


def test_adjacent_pairs_short_input(spark):
    df = spark.createDataFrame([(["a"],), ([],), (["a", "b", "c"],)], "t array<string>")
    got = [r["x"] for r in df.select(TX.adjacent_pairs("t").alias("x")).collect()]
    assert [[(p["w1"], p["w2"]) for p in g] for g in got] == [[], [], [("a", "b"), ("b", "c")]]


def test_vector_terms_unigrams_then_bigrams(spark):
    df = spark.createDataFrame([("I am OK a b",)], "t string")
    got = df.select(TX.vector_unigrams("t").alias("u")).select(TX.vector_terms("u").alias("x")).first()["x"]
    assert got == ["am", "ok", "am ok"]


def test_non_english_heuristic(spark):
    assert one(spark, "hola señor", TX.looks_non_english) is True
    assert one(spark, "plain ascii", TX.looks_non_english) is False
    assert one(spark, "😀 ₹ 100!", TX.looks_non_english) is False   # no letter at all
    assert one(spark, "just 😀", TX.looks_non_english) is True      # ASCII letters count too
    assert one(spark, None, TX.looks_non_english) is False


def test_hint_coalesce(spark):
    df = spark.createDataFrame([(" ", "a"), ("b", "a"), (None, None), ("", " ")], "v2 string, v1 string")
    assert [r["h"] for r in df.select(TX.hint_coalesce("v2", "v1").alias("h")).collect()] == ["a", "b", "", ""]


def test_contains_words_dead_stems(spark):
    # a stem inside \b...\b only matches the bare stem, as in the original rules
    df = spark.createDataFrame([("it was cancelled",), ("please cancel",), ("unauthorised use",)], "t string")
    got = [r["x"] for r in df.select(TX.contains_words("t", "cancel|unauthori").alias("x")).collect()]
    assert got == [False, True, False]


def test_normalize_id(spark):
    df = spark.createDataFrame([(" 12 ",), ("nan",), ("",), (None,)], "t string")
    assert [r["x"] for r in df.select(TX.normalize_id("t").alias("x")).collect()] == ["12", None, None, None]


def test_no_dialect_dependent_classes_in_shipped_patterns():
    bad = re.compile(r"(?<!\\)\\[wWbBsSdD]")
    for name in [n for n in dir(P) if not n.startswith("__")]:
        v = getattr(P, name)
        if isinstance(v, str):
            assert not bad.search(v), name
    for v in (TX.URL_RE, TX.MENTION_RE, TX.WS_RUN_RE, TX.TOKEN_RE, TX.VECTOR_TOKEN_RE,
              TX.URL_RE_PORTABLE, TX.WS_RUN_RE_PORTABLE):
        assert not bad.search(v)


def test_spark_whitespace_class_equals_python_isspace(spark):
    chars = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF)
    df = spark.createDataFrame([(chars,)], "t string")
    got = df.select(F.regexp_replace("t", TX.WS_RUN_RE, "#").alias("a"),
                    F.regexp_replace("t", TX.WS_RUN_RE_PORTABLE, "#").alias("b")).first()
    assert got["a"] == got["b"] == re.sub(r"\s+", "#", chars)
