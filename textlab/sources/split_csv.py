"""Quoted CSV whose files are read by many tasks, one byte range each.

A quoted field may hold line breaks, so a line's start is a record's start only
if the number of quotes before it, from the file's first byte on, is even.  A
doubled quote inside a field adds two and changes nothing.

1. Every byte range counts its quotes and, for either parity at its start, the
   lines at which a record would start.
2. A prefix sum over the ranges of a file gives each range its parity and the
   number of its first record.
3. Every range then cuts its lines into records.  Records inside a range are
   whole; only the first and last piece of a range may be parts of a record, and
   only these are brought together, by file and record number.

Ranges and the lines in them are those of Spark's text source (a line belongs to
the range that holds its first byte), so any file system that Spark reads will
do.  The driver sees one small row per range, as many as the scan has.  Fields
are parsed by Spark's own CSV expression.

Cases: a record may span any number of ranges; ``\\r\\n`` ends a record like
``\\n``, inside quotes both stay as they are; empty lines between records are
skipped; files without a record give no rows; all files must have the same
header; a file that ends inside quotes is an error; a quote inside an unquoted
field is taken as a quote (RFC 4180 does not allow it).
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

QUOTE = '"'
PIECE = T.StructType([T.StructField("file", T.StringType()), T.StructField("record", T.LongType()),
                      T.StructField("start", T.LongType()), T.StructField("edge", T.BooleanType()),
                      T.StructField("text", T.StringType())])


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _by_range(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, start, lines) for the stretches of a batch that are in one range."""
    file, start = batch.column(0), batch.column(1).to_numpy()
    codes = file.dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(start) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield file[a].as_py(), int(start[a]), batch.column(2).slice(a, b - a)


def _odd_before(lines: pa.Array, odd: int) -> tuple[np.ndarray, int]:
    """Parity of the quotes before each line, and after the last one."""
    quotes = pc.count_substring(lines, QUOTE).to_numpy().astype(np.int64)
    before = (np.cumsum(quotes) - quotes + odd) % 2
    return before, int((quotes.sum() + odd) % 2)


def range_counts(lines: DataFrame) -> DataFrame:
    """(file, start, odd, even_starts, odd_starts) of each range."""
    def count(batches):
        seen: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            if batch.num_rows:
                for file, start, some in _by_range(batch):
                    c = seen.setdefault((file, start), [0, 0, 0])
                    before, c[0] = _odd_before(some, c[0])
                    c[1] += int((before == 0).sum())
                    c[2] += int(before.sum())
        rows = [(*key, *c) for key, c in seen.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 5))],
            names=["file", "start", "odd", "even_starts", "odd_starts"])

    return lines.mapInArrow(count, "file string, start long, odd long, even_starts long, odd_starts long")


def range_starts(counts: DataFrame) -> DataFrame:
    """(file, start, odd, first, ends_odd): the parity at the start of each
    range, the number of the first record that starts in it, and the parity
    behind it."""
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    known = counts.withColumn("before", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    starts = F.when(F.col("before") == 0, F.col("even_starts")).otherwise(F.col("odd_starts"))
    return known.select("file", "start", F.col("before").alias("odd"), F.coalesce(F.sum(starts).over(before), F.lit(0)).alias("first"),
                        ((F.col("before") + F.col("odd")) % 2).alias("ends_odd"))


def _pieces(lines: DataFrame, known: dict) -> DataFrame:
    """Whole records and, marked as edges, what may be parts of one."""
    def cut(batches):
        at, odd, record, held = None, 0, 0, []  # the range, its parity, its open piece and that piece's record

        def piece(edge):
            return (*at, record, edge, "\n".join(held))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.string()), (2, pa.int64()), (1, pa.int64()),
                                                                      (3, pa.bool_()), (4, pa.string()))], names=PIECE.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for file, start, some in _by_range(batch):
                if at != (file, start):
                    if held:
                        out.append(piece(True))
                    if (file, start) not in known:
                        raise RuntimeError(f"the byte ranges of {file} changed between two scans; read it again")
                    at, held = (file, start), []
                    odd, first = known[at]
                    record, fresh = first - 1, True  # until a record starts, lines go on with the one before
                before, odd = _odd_before(some, odd)
                begins = np.flatnonzero(before == 0)
                values = some.to_pylist()
                head = int(begins[0]) if len(begins) else len(values)
                held += values[:head]
                for k, a in enumerate(begins.tolist()):
                    if held:
                        out.append(piece(fresh))  # the range's first piece may have begun before it
                    record, fresh = record + 1, False
                    held = values[a:int(begins[k + 1]) if k + 1 < len(begins) else len(values)]
            yield batch_of(out)
        if held:
            yield batch_of([piece(True)])

    return lines.mapInArrow(cut, PIECE)


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, record, text): the records of all files, numbered from 0 in each."""
    lines = _lines(spark, path)
    ranges = range_starts(range_counts(lines)).collect()  # one row per byte range
    last = {}
    for r in sorted(ranges, key=lambda r: r["start"]):
        last[r["file"]] = r["ends_odd"]
    if unclosed := [f for f, odd in last.items() if odd]:
        raise ValueError(f"{unclosed[0]} ends inside a quoted field")
    pieces = _pieces(lines, {(r["file"], r["start"]): (r["odd"], r["first"]) for r in ranges})
    joined = pieces.where("edge").groupBy("file", "record").agg(  # the pieces of one record
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "\n").alias("text"))
    return pieces.where("not edge").select("file", "record", "text").unionByName(joined)


def read_strings(spark: SparkSession, path: str | list[str], options: dict[str, str] | None = None) -> DataFrame:
    """All columns of the files as strings, named by their header."""
    settings = {"escape": QUOTE, "multiLine": "true", "nullValue": "", "emptyValue": "", **(options or {})}
    found = records(spark, path)
    text = F.when(F.col("text").endswith("\r"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    found = found.select("record", text.alias("text"))
    headers = {tuple(next(csv.reader([r["text"]], strict=True, skipinitialspace="ignoreLeadingWhiteSpace" in settings)))
               for r in found.where("record = 0").select("text").distinct().collect()}  # at most one per file
    if not headers:
        return spark.createDataFrame([], T.StructType([]))
    if len(headers) > 1:
        raise ValueError(f"files under {path} have different headers: {sorted(headers)[:2]}")
    names, = headers
    fields = found.where((F.col("record") > 0) & (F.col("text") != "")).select(
        F.from_csv("text", F.lit(", ".join(f"_c{k} string" for k in range(len(names)))), settings).alias("v"))
    return fields.select([F.col(f"v._c{k}").alias(name or f"_c{k}") for k, name in enumerate(names)])
