"""Tables kept as versions of file lists, for corrections that rewrite little.

A version is a small table of the data files that make it up, below
``<base>/versions``; data files are written once, below ``<base>/data``, and
never changed.  A correction finds the files that hold a named key, writes only
their rows anew and makes a version of the untouched files plus the new ones.
Every earlier version stays readable: it is the backup taken before the change.
The version's own folder is the pointer; it is written once, and a second writer
of the same version fails instead of replacing it.

Cases: corrections of unknown keys touch no file and come back as unknown; a
correction that changes nothing still makes a version; null keys are never
corrected; of several corrections of a key the last by sequence wins.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables

_FILES = "file string"


def _version_path(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/versions/v={version}"


def _write_data(df: DataFrame, base: str) -> list[str]:
    """Writes the rows below ``data`` and returns the files, as Spark names them."""
    folder = f"{base.rstrip('/')}/data/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    written = df.sparkSession.read.schema(df.schema).parquet(folder)
    return written.inputFiles()


def _publish(spark: SparkSession, base: str, version: int, files: Sequence[str]) -> int:
    spark.createDataFrame([(f,) for f in sorted(files)], _FILES).coalesce(1).write.mode("errorifexists").parquet(_version_path(base, version))
    return version


def create(df: DataFrame, base: str) -> int:
    """Version 1 of a table, in the files of ``df``'s partitions."""
    return _publish(df.sparkSession, base, 1, _write_data(df, base))


def files(spark: SparkSession, base: str, version: int) -> list[str]:
    """The data files of a version: one row per file, as many as its scan lists."""
    return sorted(r["file"] for r in spark.read.schema(_FILES).parquet(_version_path(base, version)).collect())


def read(spark: SparkSession, base: str, version: int, schema) -> DataFrame:
    names = files(spark, base, version)
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def correct(spark: SparkSession, base: str, version: int, schema, corrections: DataFrame, key: str, seq_col: str,
            columns: Sequence[str]) -> tuple[int, list[str], DataFrame]:
    """The next version with ``corrections`` applied; returns its number, the
    files that were rewritten, and the keys that no row has.

    The scan for touched files reads the key column only."""
    names = files(spark, base, version)
    now = read(spark, base, version, schema)
    wanted = corrections.where(F.col(key).isNotNull()).select(key).distinct()
    places = now.select(key, F.col("_metadata.file_path").alias("_file")).join(wanted, key, "left_semi")
    touched = sorted(r["_file"] for r in places.select("_file").distinct().collect())
    unknown = wanted.join(now.select(key), key, "left_anti")
    if not touched:
        return _publish(spark, base, version + 1, names), [], unknown
    fixed, _ = tables.apply_corrections(spark.read.schema(schema).parquet(*touched), corrections, key, seq_col, columns)
    new = _write_data(fixed.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]), base)
    same = _same_files(names, touched)
    return _publish(spark, base, version + 1, [*same, *new]), touched, unknown


def _same_files(names: Sequence[str], touched: Sequence[str]) -> list[str]:
    """The files that are not touched; a scheme may be written with one or three slashes."""
    def plain(name: str) -> str:
        scheme, colon, rest = name.partition(":")
        return f"{scheme}:/{rest.lstrip('/')}" if colon else name

    gone = {plain(t) for t in touched}
    kept = [n for n in names if plain(n) not in gone]
    if len(kept) + len(gone) != len(names):
        raise RuntimeError("touched files are not files of the version")
    return kept
