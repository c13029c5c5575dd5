"""WARC round trip, and the pipeline stage by stage against brute force."""

import glob
import gzip
import hashlib
import io
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from textlab.llm import warc
from textlab.llm.common import materialise

from conftest import rows
from .conftest import SCHEMA, awkward_documents, texts_of
from .test_dedup import brute_exact, brute_join
from .test_scans import brute_contained

PAGES = [(5, "http://a/\n1", "x" * 100), (3, "http://a/2", "x" * 100), (9, None, "x" * 99), (8, "u", "x" * 99), (1, "u", None), (2, "u", ""),
         (7, "u", "é漢" * 40000), (6, "u", "é漢" * 40000), (4, "u", "WARC/1.1\r\n\r\n" * 30), (None, "u", "x" * 100)]


def brute_warc(pages):
    first = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        f = first.get(b)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if f in (None, i) else "revisit", None if f in (None, i) else f))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1 << 28, 300])
def test_warc_round_trip(spark, size, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", size)
    folder = tempfile.mkdtemp(prefix="warc-")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3, "url")
    files = warc.write_warc(pages, folder)
    read = warc.read_warc(files, folder, with_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read), key=str) == brute_warc(PAGES)
    html = {i: (h or "").encode() for i, _, h in PAGES}
    assert all(r.payload == html[r.page_id] for r in read if r.record_type == "response")
    names = sorted(glob.glob(folder + "/*"))
    assert sorted(r.name for r in files.collect()) == [n.rsplit("/", 1)[1] for n in names]
    assert sum(gzip.open(n).read().count(b"WARC-Record-ID") for n in names) == len(PAGES)


def test_warc_of_nothing(spark):
    folder = tempfile.mkdtemp(prefix="warc-")
    pages = spark.createDataFrame([], "page_id long, html string")
    assert warc.read_warc(warc.write_warc(pages, folder), folder).collect() == []


def test_reader_finds_damage():
    def archive(*records):
        return io.BytesIO(b"".join(warc.member(r) for r in records))

    good = warc.record(1, "u", b"hello" * 50, hashlib.sha256(b"hello" * 50).hexdigest(), None)
    other = warc.record(2, None, b"", hashlib.sha256(b"").hexdigest(), None)
    assert [r[0] for r in warc.read_records(archive(good, other))] == ["1", "2"]
    for bad in (good.replace(b"hello", b"jello", 1), good[:-30], good + b"x", b"x" + good):
        with pytest.raises(ValueError):
            list(warc.read_records(archive(bad, other)))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(warc.member(good)[:-40])))


def test_whole_warc_query(spark):
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    got = rows(entry.queries()["op10_warc"](spark, "/root/testdata/sf0.01"), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(got, key=str) == brute_warc(pages)


def _pipeline(spark, docs, sf_dir):
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, sf_dir))
        seen.append((name, docs, out))
        docs = out
    return seen


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A folder with awkward documents, clashing extra columns and a benchmark."""
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(awkward_documents(), SCHEMA).withColumns({"KEPT": F.lit(1), "score": F.lit("s"), "component_id": F.lit(2)})
    docs.write.parquet(f"{d}/documents.parquet")
    item = awkward_documents()[13][1].split()[10:40]
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("which", ["awkward", "sf0.01"])
def test_pipeline_stages(spark, sf_dir, which):
    d = sf_dir if which == "awkward" else "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = _pipeline(spark, docs, d)
    for name, before, after in stages[:-1]:
        assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString(), name
    kept = {name: (texts_of(before), {r.doc_id for r in after.collect()}) for name, before, after in stages}
    texts, ids = kept["language_id"]
    assert {i for i, t in texts.items() if t and any(map(str.isalpha, t))} >= ids
    if which != "awkward":
        assert ids == set(texts)
    texts, ids = kept["exact_dedup"]
    assert ids == {i for i, _, _, k, _ in brute_exact(texts) if k}
    texts, ids = kept["ngram_join"]
    assert ids == {i for i, _, c in brute_join(texts) if i == c}
    texts, ids = kept["decontamination"]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    assert ids == set(texts) - {w[0] for w in brute_contained(texts, items)}
    texts, ids = kept["packing"]
    assert ids == set(texts)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [after.count() for _, _, after in _pipeline(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))] == [0] * 5


def test_texts_reach_workers_in_bounded_batches(spark):
    from textlab.llm.common import BATCH_LIMIT, on_workers

    before = spark.conf.get(BATCH_LIMIT, None)
    try:
        spark.conf.unset(BATCH_LIMIT)
        on_workers(spark)
        big = spark.range(30, numPartitions=1).selectExpr("id", "repeat('x', 1000000) AS text")
        sizes = big.mapInArrow(lambda batches: (b.select(["id"]).slice(0, 1) for b in batches), "id long").count()
        assert sizes >= 3  # 30 MB in batches of about 8 MB
        spark.conf.set(BATCH_LIMIT, "64m")
        on_workers(spark)
        assert spark.conf.get(BATCH_LIMIT) == "64m"
    finally:
        spark.conf.unset(BATCH_LIMIT) if before is None else spark.conf.set(BATCH_LIMIT, before)
