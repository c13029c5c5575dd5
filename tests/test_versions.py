"""Corrections that rewrite touched files only."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from textlab.operators import tables
from textlab.sources import versions


def on_disk(name):
    return hashlib.md5(open(name.partition(":")[2].replace("///", "/"), "rb").read()).hexdigest()


@pytest.fixture
def table(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("v"), F.lit("x").alias("other"))
    df = df.unionByName(spark.createDataFrame([(None, 9, "null key")], "k long, v int, other string"))
    base = str(tmp_path / "t")
    assert versions.create(df.repartitionByRange(8, "k"), base) == 1
    return df, base


def test_only_touched_files_are_written(spark, table):
    df, base = table
    fixes = spark.createDataFrame([(1, 10, 70), (2, 10, 71), (1, 11, 72), (1, 9999, 5), (3, None, 4)], "seq int, k long, v int")
    before = {f: on_disk(f) for f in versions.files(spark, base, 1)}
    version, touched, unknown = versions.correct(spark, base, 1, df.schema, fixes, "k", "seq", ["v"])
    assert version == 2 and len(touched) == 1 and rows(unknown) == [(9999,)]
    want, _ = tables.apply_corrections(df, fixes.where("k IS NOT NULL"), "k", "seq", ["v"])
    assert sorted(map(repr, versions.read(spark, base, 2, df.schema).collect())) == sorted(map(repr, want.drop("corrected").collect()))
    assert sorted(map(repr, versions.read(spark, base, 1, df.schema).collect())) == sorted(map(repr, df.collect()))
    after = versions.files(spark, base, 2)
    assert len(set(after) & set(before)) == 7 and {f: on_disk(f) for f in before} == before


def test_unknown_keys_touch_nothing_and_versions_are_written_once(spark, table):
    df, base = table
    fixes = spark.createDataFrame([(1, -5, 0)], "seq int, k long, v int")
    version, touched, unknown = versions.correct(spark, base, 1, df.schema, fixes, "k", "seq", ["v"])
    assert touched == [] and rows(unknown) == [(-5,)] and versions.files(spark, base, 2) == versions.files(spark, base, 1)
    with pytest.raises(Exception):
        versions.correct(spark, base, 1, df.schema, fixes, "k", "seq", ["v"])  # version 2 is there
    assert os.listdir(os.path.join(base, "versions"))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "k long, v int")
    base = str(tmp_path / "e")
    versions.create(df, base)
    fixes = spark.createDataFrame([(1, 5, 0)], "seq int, k long, v int")
    version, touched, unknown = versions.correct(spark, base, 1, df.schema, fixes, "k", "seq", ["v"])
    assert touched == [] and versions.read(spark, base, version, df.schema).count() == 0 and rows(unknown) == [(5,)]
