from pyspark.sql import functions as F

from textlab.operators import classify
from textlab.plans import scoring
from textlab.session import shared_path
from textlab.streaming import scoring as stream

from conftest import SF_SMALL, rows


def test_stratified_folds_balanced_and_complete(spark):
    data = [(i, ["a", "b", "c"][i % 3] if i % 4 else "a") for i in range(300)]
    df = spark.createDataFrame(data, "id long, y string").repartition(6)
    f = classify.stratified_folds(df, "y", "id", k=5)
    assert f.count() == 300
    per = rows(f.groupBy("y", "fold").count())
    by_label = {}
    for y, _fold, n in per:
        by_label.setdefault(y, []).append(n)
    for counts in by_label.values():
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_out_of_fold_predicts_each_row_once(spark):
    base = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    oof = classify.out_of_fold(base, "doc_id", "text", "lang", k=3, max_iter=30)
    out = oof.collect()
    assert len(out) == base.count()
    assert len({r["doc_id"] for r in out}) == len(out)
    acc = sum(r["lang"] == r["prediction"] for r in out) / len(out)
    majority = max(base.groupBy("lang").count().collect(), key=lambda r: r["count"])["count"] / len(out)
    assert acc > majority


def test_vocabularies_of_all_folds_come_from_one_count(spark):
    from textlab.operators import features

    base = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 3).cast("int").alias("fold"))
    lists = features.token_lists(base, "doc_id", "text")[0].join(base.select("doc_id", "fold"), "doc_id")
    sizes = {r["fold"]: r["count"] for r in base.groupBy("fold").count().collect()}
    got = features.fit_without_each(lists, "fold", sizes, 2, 300)
    for f in range(3):
        train = base.where(F.col("fold") != f)
        _, vocab = features.tfidf(train, "doc_id", "text", min_df=2, max_features=300)
        want = {r["term"]: round(r["idf"], 12) for r in vocab.terms.collect()}
        assert {t: round(x, 12) for t, x in got[f].items()} == want


def test_out_of_fold_writes_counts_not_terms(spark, monkeypatch):
    from textlab import session

    written = []
    monkeypatch.setattr(session, "shared_path", lambda s, name, f=session.shared_path: written.append(f(s, name)) or written[-1])
    data = [(i, " ".join(["red blue", "green gold"][i % 2] + f" only{i} rare{i}" for _ in range(40)), "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(data, "id long, t string, y string").repartition(3)
    out = classify.out_of_fold(df, "id", "t", "y", k=4, max_iter=20).collect()
    assert len(out) == len({r["id"] for r in out}) == 40 and all(r["y"] == r["prediction"] for r in out)
    counts = spark.read.parquet(written[0])
    assert set(counts.columns) == {"id", "y", "fold", "_tf"}
    assert {v["_tf"].size for v in counts.collect()} == {6}  # the terms with a document frequency of 2, none of single documents
    twice = classify.out_of_fold(df.union(df.where("id = 3")), "id", "t", "y", k=4, max_iter=20)
    assert twice.count() == 41


def test_stream_equals_batch_and_is_idempotent(spark):
    sink, ckpt = shared_path(spark, "t-sink"), shared_path(spark, "t-ckpt")
    args = (spark, SF_SMALL, "conversations.parquet", stream.CONVERSATION_SCHEMA,
            scoring._stream_score, ["conv_id", "turn"], sink, ckpt)
    first = rows(stream.run_available(*args))
    again = rows(stream.run_available(*args))      # same checkpoint: nothing new
    batch = rows(scoring._stream_score(spark.read.parquet(f"{SF_SMALL}/conversations.parquet")))
    assert first == batch == again


def test_stream_duplicate_delivery_scored_once(spark, tmp_path):
    src = str(tmp_path / "in")
    a = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "hi")],
                              stream.CONVERSATION_SCHEMA)
    b = spark.createDataFrame([(1, 0, "user", "hello there"), (2, 0, "user", "was it")],
                              stream.CONVERSATION_SCHEMA)
    a.coalesce(1).write.parquet(src + "/part=a")
    b.coalesce(1).write.parquet(src + "/part=b")
    sink, ckpt = shared_path(spark, "t2-sink"), shared_path(spark, "t2-ckpt")
    schema = type(stream.CONVERSATION_SCHEMA)([*stream.CONVERSATION_SCHEMA.fields]).add("part", "string")
    out = stream.run_available(spark, src, "*.parquet", schema, scoring._stream_score,
                               ["conv_id", "turn"], sink, ckpt, max_files_per_trigger=1)
    got = rows(out.select("conv_id", "turn"))
    assert got == [(1, 0), (2, 0)]


def test_stream_rows_that_are_not_wanted_stay_out(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, "assistant", "hi"), (1, 0, "user", "hello there")],
                          stream.CONVERSATION_SCHEMA).coalesce(1).write.parquet(src)
    sink, ckpt = shared_path(spark, "t3-sink"), shared_path(spark, "t3-ckpt")
    out = stream.run_available(spark, src, "*.parquet", stream.CONVERSATION_SCHEMA, scoring._stream_score,
                               ["conv_id", "turn"], sink, ckpt, wanted="role = 'user'")
    assert rows(out.select("conv_id", "turn")) == [(1, 0)]
