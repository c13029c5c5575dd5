"""Stream pairing against the batch operator; late rows; bounded state."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import rows
from textlab.operators import pairing
from textlab.streaming import pairing as stream_pairing
from textlab.streaming import scoring as stream_scoring
from textlab.streaming.scoring import CONVERSATION_SCHEMA



def at():
    return F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 60 + F.col("turn"))


def write_files(folder, files):
    folder.mkdir()
    for n, some in enumerate(files):
        path = folder / f"f{n:03d}.parquet"
        pq.write_table(pa.table({"conv_id": pa.array([r[0] for r in some], pa.int64()), "turn": pa.array([r[1] for r in some], pa.int64()),
                                 "role": [r[2] for r in some], "text": [r[3] for r in some]}), path)
        os.utime(path, (1_600_000_000 + n, 1_600_000_000 + n))  # the file source goes by time


def conversation(c):
    return [(c, 0, "user", f"q{c}"), (c, 1, "assistant", f"a{c}"), (c, 2, "user", "again"), (c, 3, "system", "x"), (c, 4, "assistant", "no")]


def run(spark, tmp_path, name, **how):
    return stream_pairing.run_available(spark, str(tmp_path / "in"), "*.parquet", CONVERSATION_SCHEMA, at(),
                                        str(tmp_path / f"{name}-sink"), str(tmp_path / f"{name}-ckpt"), **how)


def test_pairs_equal_the_batch_operator_and_state_expires(spark, tmp_path):
    files = []
    for n in range(14):  # ten conversations a file; replies come one file later, and the file before comes again
        now = [r for c in range(10 * n, 10 * n + 10) for r in conversation(c)]
        asked = [r for r in now if r[2] != "assistant"]
        files.append(asked + (held + before if n else []))
        held, before = [r for r in now if r[2] == "assistant"], asked
    files.append(held + [(None, 0, "user", "no key"), (5000, None, "user", "no turn")])
    write_files(tmp_path / "in", files)
    out = run(spark, tmp_path, "a", delay="30 minutes", max_gap="10 minutes", max_files_per_trigger=1)
    batch = pairing.conversation_reply_pairs(spark.read.schema(CONVERSATION_SCHEMA).parquet(str(tmp_path / "in")).distinct())
    assert rows(out.pairs, "conv_id", "turn", "customer_msg", "brand_reply") == rows(batch)
    assert out.late_rows == 0 and len(out.state_rows) >= 15
    # the state stops growing when delay and gap are full: 140 conversations, of which some 40 to 60 are held
    assert max(out.state_rows) == max(out.state_rows[:9]) and out.state_rows[13] <= out.state_rows[8]
    again = run(spark, tmp_path, "a", delay="30 minutes", max_gap="10 minutes")
    assert rows(again.pairs) == rows(out.pairs)  # a restarted run doubles nothing


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    write_files(tmp_path / "in", [conversation(1), conversation(500), conversation(501), conversation(2), conversation(502)])
    out = run(spark, tmp_path, "b", delay="5 minutes", max_files_per_trigger=1)
    assert sorted(r.conv_id for r in out.pairs.where("turn = 0").collect()) == [1, 500, 501, 502]
    assert out.late_rows >= 4  # the user and assistant rows of conversation 2


def test_reply_after_the_gap_does_not_pair(spark, tmp_path):
    write_files(tmp_path / "in", [[(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 100, "user", "q"), (2, 101, "assistant", "a")]])
    assert run(spark, tmp_path, "c", max_gap="2 seconds").pairs.count() == 2
    assert run(spark, tmp_path, "d", max_gap="0 seconds").pairs.count() == 0


def test_scoring_with_an_event_time_scores_once(spark, tmp_path):
    write_files(tmp_path / "in", [conversation(c) + (conversation(c - 1) if c else []) for c in range(6)])
    out = stream_scoring.run_available(
        spark, str(tmp_path / "in"), "*.parquet", CONVERSATION_SCHEMA, lambda b: b.select("conv_id", "turn"), ["conv_id", "turn"],
        str(tmp_path / "sink"), str(tmp_path / "ckpt"), max_files_per_trigger=1, event_time=at(), delay="10 minutes")
    assert rows(out) == sorted((c, t) for c in range(6) for t in range(5))


def test_a_table_may_be_a_folder_of_part_files(spark, tmp_path):
    from textlab.plans import scoring

    write_files(tmp_path / "conversations.parquet", [conversation(c) for c in range(3)])
    write_files(tmp_path / "other.parquet", [conversation(9)])
    scored = rows(scoring.stream_scoring_q(spark, str(tmp_path)), "conv_id", "turn")
    assert scored == [(c, t) for c in range(3) for t in (0, 2)]
    assert rows(scoring.stream_reply_pairs_q(spark, str(tmp_path)), "conv_id", "turn") == [(0, 0), (1, 0), (2, 0)]
