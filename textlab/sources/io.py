"""Readers and writers with declared schemas and one null policy.

Null policy (decided once): an empty or whitespace-only field is null; the
literal strings ``NA``, ``None`` and ``null`` stay text.  Schemas are always
declared -- ``inferSchema`` is never used, so ids never take a float detour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import split_csv

#: blanks beside separators do not belong to the field
STRIP = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}

RAW_MESSAGES = T.StructType([
    T.StructField("tweet_id", T.StringType(), False),
    T.StructField("author_id", T.StringType()),
    T.StructField("inbound", T.BooleanType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("response_tweet_id", T.StringType()),
    T.StructField("in_response_to_tweet_id", T.StringType()),
])

PREDICTIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("predicted_intent", T.StringType()),
    T.StructField("predicted_escalation", T.StringType()),
    T.StructField("predicted_reason", T.StringType()),
    T.StructField("predicted_reply", T.StringType()),
])


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet is the preferred format; a projection prunes the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def stream_files(spark: SparkSession, source_dir: str, files: str, schema: T.StructType,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of Parquet files below ``source_dir``.

    ``files`` with a wildcard is a pattern of file names, in any subfolder.
    Without one it names a table, which is a single file or a folder of part files."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if any(c in files for c in "*?[{"):
        return reader.option("pathGlobFilter", files).parquet(source_dir)
    # a pattern that only the name meets: Spark refuses a plain file as the path of a stream
    return reader.parquet(f"{source_dir.rstrip('/')}/{{{files}}}")


def _blank_strings_to_null(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            out.append(F.when(F.trim(F.col(f.name)) == "", F.lit(None).cast("string"))
                       .otherwise(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             messy: bool = False) -> DataFrame:
    """CSV with quoted multi-line fields, declared schema and the null policy.

    One file is read by many tasks (:mod:`textlab.sources.split_csv`).  Columns are found by their header, whatever their order in the file; a
    declared column that the file lacks is an error, others are not read.
    ``messy=True`` also strips blanks after separators.  Fields that fail to
    parse become null.
    """
    raw = split_csv.read_strings(spark, path, STRIP if messy else None)
    by_name = {c.strip(): c for c in raw.columns}
    missing = [f.name for f in schema.fields if f.name not in by_name]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return _blank_strings_to_null(raw.select([
        F.col(f"`{by_name[f.name]}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]))


def read_messy_scores(spark: SparkSession, path: str, numeric: list[str]) -> DataFrame:
    """Read a hand-edited score sheet: padded headers, blanks after commas,
    bad numbers.  Columns are read as text, names stripped, numbers parsed with
    ``try_cast`` and rows missing any numeric value dropped."""
    raw = split_csv.read_strings(spark, path, STRIP)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    for c in numeric:
        raw = raw.withColumn(c, F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)"))
    return raw.dropna(subset=numeric)


def first_rows(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """``nrows``: the first n rows by an explicit order key (files have none)."""
    return df.orderBy(F.col(order_col).asc()).limit(n)


def fill_blank(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null-to-empty recast of review columns."""
    return df.fillna("", subset=columns)


def write_versioned(df: DataFrame, base: str, version: str, fmt: str = "parquet") -> str:
    """Write to ``<base>/v=<version>``; never overwrite a path read in the same job."""
    path = f"{base.rstrip('/')}/v={version}"
    df.write.mode("errorifexists").format(fmt).save(path)
    return path


def write_metrics_document(doc: DataFrame, path: str) -> None:
    """One-row nested metrics document as JSON."""
    doc.coalesce(1).write.mode("overwrite").json(path)
