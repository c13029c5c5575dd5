"""Message -> reply pairing (a self equi-join of one message table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reply_pairs(messages: DataFrame, *, is_message: Column, is_reply: Column,
                message_key: list[Column], reply_to_key: list[Column],
                message_cols: dict[str, Column], reply_cols: dict[str, Column],
                key_names: list[str] | None = None) -> DataFrame:
    """Pair every inbound message with each outbound row that answers it.

    ``message_key`` identifies a message; ``reply_to_key`` is, on a reply row,
    the key of the message it answers.  Inner equi-join: a message with two
    replies gives two pairs, replies to missing messages give none.

    Both sides are filtered scans of the same table; filters and the column
    projection reach the parquet scan.  The join shuffles on the full key, so
    one very large conversation is still spread over many tasks.
    """
    m = messages.where(is_message).select(
        *[k.alias(f"_k{i}") for i, k in enumerate(message_key)],
        *[c.alias(n) for n, c in message_cols.items()])
    r = messages.where(is_reply).select(
        *[k.alias(f"_r{i}") for i, k in enumerate(reply_to_key)],
        *[c.alias(n) for n, c in reply_cols.items()])
    cond = [m[f"_k{i}"] == r[f"_r{i}"] for i in range(len(message_key))]
    joined = m.join(r, on=cond, how="inner")
    names = key_names or [f"key{i}" for i in range(len(message_key))]
    return joined.select(*[F.col(f"_k{i}").alias(n) for i, n in enumerate(names)],
                         *message_cols.keys(), *reply_cols.keys())


def conversation_reply_pairs(conversations: DataFrame, user_role: str = "user",
                             reply_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, customer_msg, brand_reply): user turn t answered by the
    reply-role turn t+1 of the same conversation."""
    pairs = reply_pairs(
        conversations,
        is_message=F.col("role") == user_role,
        is_reply=F.col("role") == reply_role,
        message_key=[F.col("conv_id"), F.col("turn")],
        reply_to_key=[F.col("conv_id"), F.col("turn") - 1],
        message_cols={"customer_msg": F.col("text")},
        reply_cols={"brand_reply": F.col("text")},
        key_names=["conv_id", "turn"],
    )
    return pairs.select("conv_id", "turn", "customer_msg", "brand_reply")


def answered_messages(conversations: DataFrame, user_role: str = "user",
                      reply_role: str = "assistant") -> DataFrame:
    """Messages that received at least one reply (a left-semi join)."""
    msgs = conversations.where(F.col("role") == user_role)
    replies = conversations.where(F.col("role") == reply_role).select(
        "conv_id", (F.col("turn") - 1).alias("turn"))
    return msgs.join(replies, on=["conv_id", "turn"], how="left_semi")
