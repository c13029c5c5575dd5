"""The most frequent n-grams, exactly, without shuffling every n-gram.

1. Every task keeps Space-Saving counters: at most ``counters`` n-grams, each
   with an upper bound of its count and how much of it may be wrong.  An n-gram
   without a counter occurred at most ``floor`` times in the task, the largest
   bound that was ever given up.
2. The counters of all tasks are added up.  The ``n``-th largest sum of sure
   counts is a threshold that ``n`` n-grams reach; one whose bounds, with the
   floors of the tasks that do not list it, stay below cannot be among the first
   ``n``.  If even an n-gram that no task lists could reach it, the counters
   were too few and step 1 is repeated with ``MORE`` times as many, up to
   ``MOST_COUNTERS``.
3. If the bounds of the n-grams that are left are sure counts, as those of very
   frequent ones are, that is the result.  Otherwise a second pass counts them; where counts are so
   alike that more than ``BROADCAST_ROWS`` are left, all n-grams are counted.

A task looks at ``SLICE_TOKENS`` tokens at a time and the second pass at the
n-grams of wanted words only, so its memory depends on the counters and not on
how many n-grams a batch of rows holds.

Shuffled rows are ``counters`` a task and the candidates a task, whatever the
number of different n-grams.  Ties go by the n-gram.

Cases: null and empty token arrays have no n-grams; null tokens are skipped
together with the n-grams that would hold them; fewer than ``n`` different
n-grams give fewer rows; equal counts at the cut are ordered by n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = 20_000
MORE = 8
MOST_COUNTERS = 2_000_000
BROADCAST_ROWS = 1_000_000
#: tokens that a task looks at together, unless one row has more
SLICE_TOKENS = 1 << 18


class SpaceSaving:
    """Counters with upper bounds; batches of counts at a time.

    A batch may leave out n-grams that occurred in it at most ``cut`` times: the
    bounds of all that it does not list then rise by ``cut``.  ``lift`` is the sum
    of the cuts; what is stored is less by it."""

    def __init__(self, counters: int):
        self.counters, self.lift, self.low = counters, 0, 0
        self.stored: dict[str, int] = {}
        self.doubt: dict[str, int] = {}

    @property
    def floor(self) -> int:
        return self.low + self.lift

    @property
    def upper(self) -> dict[str, int]:
        return {g: b + self.lift for g, b in self.stored.items()}

    @property
    def wrong(self) -> dict[str, int]:
        return {g: w + self.lift for g, w in self.doubt.items()}

    def add(self, grams: Sequence[str], counts: Sequence[int], cut: int = 0) -> None:
        stored, doubt, low = self.stored, self.doubt, self.low - cut
        for gram, count in zip(grams, counts):
            if gram in stored:
                stored[gram] += count - cut
                doubt[gram] -= cut
            else:
                stored[gram] = low + count
                doubt[gram] = low
        self.lift += cut
        if len(stored) > 2 * self.counters:
            self.shrink()

    def shrink(self) -> None:
        if len(self.stored) <= self.counters:
            return
        bounds = np.fromiter(self.stored.values(), np.int64, len(self.stored))
        cut = int(np.partition(bounds, len(bounds) - self.counters)[len(bounds) - self.counters])
        keep, room = {}, self.counters - int((bounds > cut).sum())
        for gram, bound in self.stored.items():
            if bound > cut:
                keep[gram] = bound
            elif bound == cut and room:
                keep[gram] = bound
                room -= 1
        self.low = max(self.low, cut)
        self.stored, self.doubt = keep, {g: self.doubt[g] for g in keep}


def slices(tokens: pa.Array, most: int) -> Iterator[pa.Array]:
    """Consecutive rows with at most ``most`` tokens together, or one row."""
    ends = np.cumsum(pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(tokens):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield tokens.slice(start, stop - start)
        start = stop


def gram_counts(tokens: pa.Array, sizes: Sequence[int], most: int = 1 << 62,
                of: pa.Array | None = None) -> Iterator[tuple[list[str], list[int], int]]:
    """The different n-grams of a batch of token lists and their counts, by size.
    Where there are more than ``most``, only those that occur more often than the
    third value.  With ``of``, only the n-grams whose words are all in it."""
    lists = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    if of is not None:
        known = pc.is_in(coded.dictionary, of).to_numpy(zero_copy_only=False).astype(bool)
        code = np.where(np.append(known, False)[code], code, -1)
    for size in sizes:
        m = len(code) - size + 1
        if m <= 0:
            continue
        whole = owner[:m] == owner[size - 1:]
        for k in range(size):
            whole &= code[k:k + m] >= 0
        at = np.flatnonzero(whole)
        if not len(at):
            continue
        group = code[at]
        for k in range(1, size):  # numbers of different prefixes stay below the number of tokens
            _, group = np.unique(group * len(words) + code[at + k], return_inverse=True)
        _, first, counts = np.unique(group, return_index=True, return_counts=True)
        cut = 0
        if len(counts) > most:
            cut = int(np.partition(counts, len(counts) - most)[len(counts) - most])
            first, counts = first[counts > cut], counts[counts > cut]
        columns = [code[at[first] + k].tolist() for k in range(size)]
        yield [" ".join([words[c] for c in row]) for row in zip(*columns)], counts.tolist(), cut


def _summaries(tokens: DataFrame, sizes: Sequence[int], counters: int) -> DataFrame:
    def run(batches):
        kept = SpaceSaving(counters)
        for batch in batches:
            for some in slices(batch.column(0), SLICE_TOKENS):
                for counted in gram_counts(some, sizes, counters):
                    kept.add(*counted)
        kept.shrink()
        upper, wrong = kept.upper, kept.wrong
        names = [None, *upper]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([0, *upper.values()], pa.int64()),
             pa.array([0, *(b - wrong[g] for g, b in upper.items())], pa.int64()),
             pa.array([kept.floor] * len(names), pa.int64())], names=["gram", "upper", "sure", "floor"])

    return tokens.mapInArrow(run, "gram string, upper long, sure long, floor long")


def _all_counts(tokens: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Counts per slice of all n-grams."""
    def run(batches):
        for batch in batches:
            for some in slices(batch.column(0), SLICE_TOKENS):
                for grams, counts, _ in gram_counts(some, sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["gram", "n"])

    return tokens.mapInArrow(run, "gram string, n long")


def _counted(tokens: DataFrame, sizes: Sequence[int], wanted) -> DataFrame:
    """Counts per task of the n-grams in the broadcast set ``wanted``."""
    def run(batches):
        counts = dict.fromkeys(wanted.value, 0)
        words = pa.array(sorted({w for gram in counts for w in gram.split(" ")}), pa.string())
        for batch in batches:
            for part in slices(batch.column(0), SLICE_TOKENS):
                for grams, some, _ in gram_counts(part, sizes, of=words):
                    for gram, count in zip(grams, some):
                        if gram in counts:
                            counts[gram] += count
        rows = [(g, c) for g, c in counts.items() if c]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())],
                                         names=["gram", "n"])

    return tokens.mapInArrow(run, "gram string, n long")


def top_ngrams(df: DataFrame, tokens: Column | str, n: int, sizes: Sequence[int] = (1,), counters: int = COUNTERS) -> DataFrame:
    """(gram, count): the ``n`` most frequent n-grams of the given sizes, words
    joined by one space (so the tokens hold none)."""
    from ..session import checkpoint_root

    spark = df.sparkSession
    checkpoint_root(spark)
    lists = df.select((F.col(tokens) if isinstance(tokens, str) else tokens).alias("tokens"))
    while True:
        merged = _summaries(lists, sizes, counters).groupBy("gram").agg(
            F.sum("upper").alias("upper"), F.sum("sure").alias("sure"), F.sum("floor").alias("floor")).checkpoint(eager=True)
        floors = merged.where("gram IS NULL").agg(F.sum("floor")).first()[0] or 0
        listed = merged.where("gram IS NOT NULL")
        best = [r["sure"] for r in listed.orderBy(F.desc("sure")).limit(n).select("sure").collect()]
        threshold = best[-1] if len(best) == n else 0
        if floors == 0 or floors < threshold:
            break
        counters *= MORE
        if counters > MOST_COUNTERS:
            break
    if floors == 0:
        counted = listed.select("gram", F.col("upper").alias("count"))
    else:
        bound = F.col("upper") + floors - F.col("floor")
        left = listed.where(bound >= threshold)
        if floors < threshold and left.where(bound > F.col("sure")).isEmpty():  # the counts are sure already
            return left.select("gram", F.col("sure").alias("count")).orderBy(F.desc("count"), F.asc("gram")).limit(n)
        if floors >= threshold or left.count() > BROADCAST_ROWS:  # too many nearly equal counts to tell apart
            counts = _all_counts(lists, sizes)
        else:
            counts = _counted(lists, sizes, spark.sparkContext.broadcast({r["gram"] for r in left.collect()}))
        counted = counts.groupBy("gram").agg(F.sum("n").alias("count"))
    return counted.orderBy(F.desc("count"), F.asc("gram")).limit(n)
