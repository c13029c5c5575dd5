from pyspark.sql import functions as F

from textlab.functions.text import normalize_id
from textlab.operators import pairing

from conftest import rows


def test_reply_pairs_on_raw_messages(spark):
    data = [
        ("1", "cust", True, "t1", "where is my parcel", None),
        ("2", "brand", False, "t2", "first reply", "1"),
        ("3", "brand", False, "t3", "second reply", " 1 "),      # padded id
        ("4", "brand", False, "t4", "reply to a missing message", "99"),
        ("5", "other", False, "t5", "another brand replies", "1"),
        ("6", "brand", False, "t6", "no parent", "nan"),
    ]
    msgs = spark.createDataFrame(data, "tweet_id string, author_id string, inbound boolean, created_at string, "
                                       "text string, in_response_to_tweet_id string")
    pairs = pairing.reply_pairs(
        msgs,
        is_message=F.col("inbound"),
        is_reply=~F.col("inbound") & (F.col("author_id") == "brand"),
        message_key=[normalize_id("tweet_id")],
        reply_to_key=[normalize_id("in_response_to_tweet_id")],
        message_cols={"customer_msg": F.col("text"), "customer_created_at": F.col("created_at")},
        reply_cols={"brand_reply": F.col("text"), "brand_created_at": F.col("created_at")},
        key_names=["tweet_id"])
    # a message with two replies gives two pairs; other brands and orphans give none
    assert rows(pairs, "tweet_id", "brand_reply") == [("1", "first reply"), ("1", "second reply")]
    assert pairs.columns == ["tweet_id", "customer_msg", "customer_created_at", "brand_reply", "brand_created_at"]


def test_answered_messages(spark):
    conv = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"),
                                  (2, 0, "user", "d"), (2, 2, "assistant", "e")],
                                 "conv_id long, turn long, role string, text string")
    assert rows(pairing.answered_messages(conv).select("conv_id", "turn")) == [(1, 0)]


def test_pair_keys_of_long_conversations_and_two_replies(spark, tmp_path):
    from textlab.plans.scoring import reply_pool

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c, n in ((1, 1200), (2, 2)) for t in range(n)]
    rows.append((2, 1, "assistant", "another reply"))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pool = reply_pool(spark, str(tmp_path))
    keys = [r["pair_key"] for r in pool.collect()]
    assert len(keys) == len(set(keys)) == 602
