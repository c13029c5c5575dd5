"""Reply pairing on a message stream, with state that expires.

Messages and replies arrive in one stream, in any order within ``delay``.  A
message waits in the state for its reply and a reply for its message until the
watermark, ``delay`` behind the latest event time, shows that the other side can
no longer come: a reply is at most ``max_gap`` after its message.  The same row
delivered again within ``delay`` is dropped before the join, by a state that the
watermark empties as well.  So the state holds the rows of the last
``delay + max_gap`` of event time, however long the stream runs.

Rows behind the watermark come too late: they are dropped and counted, and the
pairs of all other rows equal those of the batch operator.

Cases: rows without an event time or a key pair with nothing and are not kept;
a message with several replies gives several pairs; replies to unknown messages
give none; a stream without rows gives no pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import stream_files


def paired(messages: DataFrame, event_time: Column, delay: str, max_gap: str, user_role: str = "user",
           reply_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, customer_msg, brand_reply, msg_time, reply_time) of a
    stream of (conv_id, turn, role, text)."""
    timed = messages.withColumn("_at", event_time).where(
        F.col("role").isin(user_role, reply_role) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("_at").isNotNull())
    once = timed.withWatermark("_at", delay).dropDuplicatesWithinWatermark(["conv_id", "turn", "role"])
    asked = once.where(F.col("role") == user_role).select(
        "conv_id", "turn", F.col("text").alias("customer_msg"), F.col("_at").alias("msg_time"))
    replies = once.where(F.col("role") == reply_role).select(
        F.col("conv_id").alias("r_conv"), (F.col("turn") - 1).alias("r_turn"), F.col("text").alias("brand_reply"),
        F.col("_at").alias("reply_time"))
    in_time = F.col("reply_time").between(F.col("msg_time"), F.col("msg_time") + F.expr(f"INTERVAL {max_gap}"))
    return asked.join(replies, (F.col("conv_id") == F.col("r_conv")) & (F.col("turn") == F.col("r_turn")) & in_time).select(
        "conv_id", "turn", "customer_msg", "brand_reply", "msg_time", "reply_time")


@dataclass
class Run:
    """What a run over the files available now has done."""
    pairs: DataFrame
    late_rows: int
    state_rows: list[int]  # after each batch, all stateful operators together


def run_available(spark: SparkSession, source_dir: str, file_glob: str, schema: T.StructType, event_time: Column, sink: str,
                  checkpoint: str, delay: str = "10 minutes", max_gap: str = "1 hour",
                  max_files_per_trigger: int | None = None) -> Run:
    """Pairs the files that are there now into ``sink`` and stops.  Spark's file
    sink commits a batch's files once, so a restarted run doubles nothing."""
    out = paired(stream_files(spark, source_dir, file_glob, schema, max_files_per_trigger), event_time, delay, max_gap)
    query = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    late, rows = 0, []
    for progress in query.recentProgress:
        state = progress["stateOperators"]
        late += sum(s["numRowsDroppedByWatermark"] for s in state)
        rows.append(sum(s["numRowsTotal"] for s in state))
    return Run(spark.read.schema(out.schema).parquet(sink), late, rows)
