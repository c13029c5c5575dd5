import csv
import json
import os
import random

import pytest
from pyspark.sql import types as T

from textlab.functions import patterns as P
from textlab.operators import metrics
from textlab.sources import io, split_csv


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def test_read_csv_null_policy_and_ids(spark, tmp_path):
    p = write(tmp_path / "raw.csv",
              'tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n'
              '1234567890123456789,u1,true,t0,"line one\nline two, with comma",,\n'
              '2,brand,false,t1,"he said ""hi""",,1234567890123456789\n'
              '3,u2,true,t2,NA,,\n'
              '4,u3,true,t3,"   ",,\n')
    df = io.read_csv(spark, p, io.RAW_MESSAGES)
    got = {r["tweet_id"]: r for r in df.collect()}
    assert got["1234567890123456789"]["text"] == "line one\nline two, with comma"   # no float hop
    assert got["2"]["text"] == 'he said "hi"'
    assert got["2"]["in_response_to_tweet_id"] == "1234567890123456789"
    assert got["3"]["text"] == "NA"          # literal NA stays text
    assert got["4"]["text"] is None          # blank -> null
    assert got["1234567890123456789"]["in_response_to_tweet_id"] is None


def test_read_messy_scores(spark, tmp_path):
    p = write(tmp_path / "sample.csv",
              "id, intent , overall, human_overall ,\n"
              "1, other, 3.4, 3 ,\n"
              "2, complaint, 4.0, n/a,\n"
              "3, other, 2.2, ,\n"
              "4, other, 2.6, 2.5,\n")
    df = io.read_messy_scores(spark, p, ["overall", "human_overall"])
    assert "human_overall" in df.columns and "intent" in df.columns
    got = sorted((r["id"], r["overall"], r["human_overall"]) for r in df.collect())
    assert got == [("1", 3.4, 3.0), ("4", 2.6, 2.5)]


def test_versioned_write_never_overwrites(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    path = io.write_versioned(df, str(tmp_path / "golden"), "1")
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(Exception):
        io.write_versioned(df, str(tmp_path / "golden"), "1")


def test_metrics_document_json(spark, tmp_path):
    df = spark.createDataFrame([
        (1, "complaint", "escalate", "high_emotion", "complaint", "escalate", "high_emotion"),
        (2, "other", "auto_handle", "low_risk", "other", "escalate", "low_risk"),
    ], "id long, intent string, escalation_ground_truth string, escalation_reason string, "
       "predicted_intent string, predicted_escalation string, predicted_reason string")
    doc = metrics.eval_document("agent", df, P.INTENTS, P.ESCALATIONS)
    out = str(tmp_path / "eval")
    io.write_metrics_document(doc, out)
    files = [f for f in os.listdir(out) if f.endswith(".json")]
    rec = json.loads(open(os.path.join(out, files[0])).read())
    assert rec["system"] == "agent" and rec["n_evaluated"] == 2
    assert rec["escalation"]["accuracy"] == 0.5
    assert set(rec["per_intent"]) == set(P.INTENTS)


def test_first_rows_by_explicit_order(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "k long")
    assert [r["k"] for r in io.first_rows(df, "k", 2).collect()] == [1, 2]


def test_csv_columns_are_found_by_header(spark, tmp_path):
    from pyspark.sql import types as T

    from textlab.sources import io

    path = tmp_path / "swapped.csv"
    path.write_text("b,extra, a\n1,9,2\nx,9,3\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    assert [tuple(r) for r in io.read_csv(spark, str(path), schema).collect()] == [(2, 1), (3, None)]
    with pytest.raises(ValueError):
        io.read_csv(spark, str(path), T.StructType([T.StructField("c", T.LongType())]))


# -- byte ranges of quoted CSV ---------------------------------------------------


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[1], "1")
    yield lambda size: spark.conf.set(names[0], str(size))
    for n, v in before.items():
        spark.conf.set(n, v)


def awkward_csv(path, rows, **style):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, **style)
        w.writerow(["id", "text, long", "lang"])
        w.writerows(rows)


@pytest.mark.parametrize("size", [150, 1000, 1 << 20])
def test_ranges_cut_records_anywhere(spark, tmp_path, small_ranges, size):
    r = random.Random(2)
    rows = [(str(i), "".join(r.choice(["a", "é", ",", '"', "\n", "\r\n", " ", "日", '""', "\r"])
                             for _ in range(r.choice([0, 1, 5, 40, 300]))), r.choice(["", "x", "NA"])) for i in range(50)]
    awkward_csv(tmp_path / "a.csv", rows, lineterminator="\n")
    awkward_csv(tmp_path / "b.csv", [("1" + x[0].zfill(3), *x[1:]) for x in rows], lineterminator="\r\n", quoting=csv.QUOTE_ALL)
    small_ranges(size)
    df = split_csv.read_strings(spark, str(tmp_path))
    assert df.columns == ["id", "text, long", "lang"]
    got = {x[0]: (x[1] or "", x[2] or "") for x in df.collect()}
    want = {x[0]: x[1:] for x in rows} | {"1" + x[0].zfill(3): x[1:] for x in rows}
    assert got == want
    if size < 1 << 20:
        assert split_csv._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 8


def test_one_record_over_many_ranges(spark, tmp_path, small_ranges):
    text = "\n".join(f"line {i} \"quoted\", and more" for i in range(200))
    awkward_csv(tmp_path / "a.csv", [("1", "x", ""), ("2", text, "y"), ("3", "z", "")], lineterminator="\n")
    small_ranges(200)
    got = {x[0]: x[1] for x in split_csv.read_strings(spark, str(tmp_path)).collect()}
    assert got == {"1": "x", "2": text, "3": "z"}
    assert [r.record for r in split_csv.records(spark, str(tmp_path)).orderBy("record").collect()] == [0, 1, 2, 3]


def test_csv_without_rows_with_blank_lines_and_unclosed(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    df = split_csv.read_strings(spark, str(tmp_path / "h.csv"))
    assert df.columns == ["a", "b"] and df.count() == 0
    (tmp_path / "l.csv").write_text('a,b\n\n1,"x\n\ny"\r\n\r\n2,\n')
    assert sorted(map(tuple, split_csv.read_strings(spark, str(tmp_path / "l.csv")).collect())) == [("1", "x\n\ny"), ("2", None)]
    (tmp_path / "u.csv").write_text('a,b\n1,"never closed\n2,x\n')
    with pytest.raises(ValueError, match="inside a quoted field"):
        split_csv.read_strings(spark, str(tmp_path / "u.csv"))
    (tmp_path / "o.csv").write_text("b,a\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        split_csv.read_strings(spark, [str(tmp_path / "h.csv"), str(tmp_path / "o.csv")])
