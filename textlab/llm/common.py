"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BATCH_BYTES = "8m"
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


_kept: dict = {}


def kept(name: str, make):
    """A table that a worker process keeps from task to task; of all operators
    only the latest has one, so they never add up."""
    if name not in _kept:
        drop_kept()
        _kept[name] = make()
    return _kept[name]


def drop_kept() -> None:
    """Frees what earlier tasks left in this worker process: their tables, and
    freed memory that the allocators still hold."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver found it (on a
    cluster the package is installed on every machine and this changes nothing),
    and hands them texts in batches of ``BATCH_BYTES``, however long the texts
    are, unless the session names another limit.  A longer text is a batch of
    its own."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One input table; the projection prunes the parquet scan."""
    on_workers(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def ascii_lower(text):
    """Lower-case A-Z only.  Pure ASCII text takes the fast built-in; other
    text goes through ``translate``, which leaves letters like É alone."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less every column that clashes (ignoring case) with ``names``:
    an operator's own output columns replace input columns of that name."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def first_rows(df: DataFrame, group, order) -> DataFrame:
    """One row of each group, the first by ``order``; Spark limits the groups
    before the shuffle."""
    first = df.withColumn("__group", group).withColumn(
        "__nth", F.row_number().over(Window.partitionBy("__group").orderBy(order)))
    return first.where("__nth = 1").drop("__group", "__nth")


def aside(df: DataFrame, *names: str):
    """``df`` with the columns that clash with ``names`` put under other names,
    and a function that gives a result the columns of ``df`` again."""
    taken, was = {n.lower() for n in names}, df.columns
    now = [f"__aside_{k}" if c.lower() in taken else c for k, c in enumerate(was)]

    def back(out: DataFrame) -> DataFrame:
        return out.select([F.col(f"`{a}`").alias(b) for a, b in zip(now, was)])

    return df.toDF(*now), back


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.  Where it
    names none, only a local session, whose tasks run on this machine, gets one
    of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="textlab-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    Readers after the loss of an executor find the
    files in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise_table(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`materialise`, as a Parquet table below the shared folder:
    smaller for wide rows, and later readers read only the columns they need."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``."""
    root = checkpoint_folder(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
