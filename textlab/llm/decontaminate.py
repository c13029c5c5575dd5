"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is found in a document when at least ``THRESHOLD`` of the item's
distinct five-word shingles occur in the document (words are runs of ASCII
letters, digits and other than ASCII characters, A-Z taken as a-z).

Items are partitioned by the size of their shingle set, one partition per power
of two.  Each item is represented by a MinHash sketch: the smallest hash values
of its set.  The sketch length is set per partition from its largest size u as
``u - ceil(THRESHOLD * u) + 1``: an item contained to the threshold misses at
most that many shingles less one, so at least one sketch value is among the
document's shingles, however long the document is, and no pair is missed.  A
document's shingles look up the sketches of all partitions; the items they hit
are then verified by exact shingle containment in the same task.  An item of
fewer than five words is one shingle, its whole word sequence; it is looked up
among the documents' runs of as many words, for the lengths the benchmark holds.

Documents never shuffle.  Items are read as an index of at most
``INDEX_ITEMS`` items at a time, whose size is checked; a larger benchmark is
searched in as many passes over the documents as it has such parts.

Cases: null and empty items or documents match nothing; an item of one to four
words is found wherever its words stand consecutively; repeated items are separate items; a repeated document row is
reported per row; ties do not arise; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import NOT_ALNUM, shingle_sets
from .common import drop_kept

THRESHOLD = 80  # per cent
WIDTH = 5
INDEX_ITEMS = 200_000
INDEX_BYTES = 64 << 20


def needed(sizes: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Shingles that a set of each size must have in common with a document."""
    return -(-threshold * sizes // 100)


class ItemIndex:
    """Sketches and full sets of a bounded number of items."""

    def __init__(self, items: pa.Table, threshold: int = THRESHOLD):
        sets, length = [], []
        for _, s, n in shingle_sets(items.column(1), NOT_ALNUM, WIDTH):
            sets.append(s)
            length.append(n)
        keep = [i for i, s in enumerate(sets) if len(s)]
        length = np.array([length[i] for i in keep], np.int64)
        self.keys, self.sets = items.column(0).combine_chunks().take(pa.array(keep, pa.int64())), [sets[i] for i in keep]
        sizes = np.array([len(s) for s in self.sets], np.int64)
        self.needed = needed(sizes, threshold)
        largest = np.ones(0, np.int64) if not len(sizes) else 2 ** np.ceil(np.log2(sizes)).astype(np.int64)
        sketch = np.minimum(largest - needed(largest, threshold) + 1, sizes)
        pairs = [(s[:n], np.full(n, i)) for i, (s, n) in enumerate(zip(self.sets, sketch.tolist())) if length[i] >= WIDTH]
        #: by number of words, the short items' only shingles and their numbers
        self.short = {int(w): (np.concatenate([self.sets[i] for i in np.flatnonzero(length == w)]), np.flatnonzero(length == w))
                      for w in np.unique(length[length < WIDTH])}
        values = np.concatenate([v for v, _ in pairs]) if pairs else np.zeros(0, np.uint64)
        owner = np.concatenate([o for _, o in pairs]) if pairs else np.zeros(0, np.int64)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]
        self.coarse = np.zeros(1 << 20, bool)  # first look: the low bits of the sketch values
        self.coarse[(values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def search(self, shingles: np.ndarray) -> list[tuple[int, int]]:
        """(item, shingles in common) for the items contained in a sorted set."""
        maybe = shingles[self.coarse[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)]]
        if not len(maybe):
            return []
        a, b = np.searchsorted(self.values, maybe, "left"), np.searchsorted(self.values, maybe, "right")
        hit = [self.owner[x:y] for x, y in zip(a[b > a], b[b > a])]
        out = []
        for i in np.unique(np.concatenate(hit)) if hit else ():
            at = np.searchsorted(shingles, self.sets[i])
            at[at == len(shingles)] = 0
            common = int((shingles[at] == self.sets[i]).sum())
            if common >= self.needed[i]:
                out.append((int(i), common))
        return out


def found_in(index: ItemIndex, column) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each document of a text column: its row and the (item, shingles in
    common) that it contains."""
    short: dict[int, list[tuple[int, int]]] = {}
    for width, (values, owner) in index.short.items():
        for i, runs, n in shingle_sets(column, NOT_ALNUM, width):
            if n >= width:
                at = np.minimum(np.searchsorted(runs, values), len(runs) - 1)
                if len(hit := owner[runs[at] == values]):
                    short.setdefault(i, []).extend((x, 1) for x in hit.tolist())
    for i, shingles, _ in shingle_sets(column, NOT_ALNUM, WIDTH):
        yield i, index.search(shingles) + short.get(i, [])


def _parts(benchmark: DataFrame, key: str, text: str):
    """The benchmark's rows in parts of bounded size, by a hash of the row."""
    rows = benchmark.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("b")).first()
    n = max(1, -(-size["n"] // INDEX_ITEMS), -(-(size["b"] or 0) // INDEX_BYTES))
    for i in range(n):
        yield rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i) if n > 1 else rows


def contained_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                    item_key: str = "item_id", item_text: str = "text",
                    threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item, n_common): every item found in every document."""
    kinds = docs.schema[key].dataType, benchmark.schema[item_key].dataType
    schema = T.StructType([T.StructField("doc_id", kinds[0]), T.StructField("item_id", kinds[1]),
                           T.StructField("n_item", T.LongType()), T.StructField("n_common", T.LongType())])
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    found = None
    for part in _parts(benchmark, item_key, item_text):
        index = ItemIndex(part.toArrow(), threshold)  # bounded by _parts
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            drop_kept()
            index = shared.value
            for batch in batches:
                keys, out = batch.column(0), []
                for i, items in found_in(index, batch.column(1)):
                    out += [(i, item, len(index.sets[item]), common) for item, common in items]
                if out:
                    i, item, sizes, commons = (pa.array(c, pa.int64()) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays([keys.take(i), index.keys.take(item), sizes, commons],
                                                     names=schema.names)

        one = rows.mapInArrow(run, schema)
        found = one if found is None else found.unionAll(one)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
                    item_text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The documents that hold no item, each row decided in its own task."""
    df = docs
    at = [c.lower() for c in df.columns].index(text.lower())
    for part in _parts(benchmark, item_key, item_text):
        index = ItemIndex(part.toArrow(), threshold)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            drop_kept()
            index = shared.value
            for batch in batches:
                held = [bool(items) for _, items in found_in(index, batch.column(at))]
                yield batch.filter(pa.array([not h for h in held], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
