"""Exact top-k search over sparse vectors with an impact-ordered block index.

Spark lays the two vector tables out in tiles: pool documents are dealt to
shards and queries to chunks by hash, sized by their number of entries, and a
tile is one shard with one chunk (a co-group by both numbers).  A document's
entries travel once for each query chunk and a query's once for each shard, as
in a blocked matrix product; no (query, document) pair leaves a tile except a
tile's ``k`` best of a query.

Inside a tile the shard's postings are ordered by (term, weight descending) and
cut into blocks of ``BLOCK`` postings, each with its largest weight.  A query

1. opens the first blocks of its heaviest products and scores the documents
   that collect most there in full: the ``k``-th best is its threshold;
2. finds for each term a cut-off weight such that a document which has no entry
   above the cut-off of any term stays below the threshold.  The bound is the
   largest product of the query with a vector that is below the cut-offs and no
   longer than the longest document;
3. opens the blocks whose largest weight is above their term's cut-off, sums
   the products, and scores in full only the documents whose sum and remaining
   bound reach the threshold.

All other blocks are skipped, and nothing is left out: the bounds hold for
every document.  A query whose lists have at most ``WHOLE`` postings in the
shard opens them all, which costs less than to find what can be skipped.  So
does one whose documents left to score in full have more entries than there are
postings in its closed blocks.  Ties go to the smaller document id, at 9
decimals.

Cases: a query without a common term has no rows; empty tables give no rows;
null terms or weights are an error of the caller.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
SEED_BLOCKS = 8
WHOLE = 1 << 18
SHARD_ENTRIES = 1 << 21
CHUNK_ENTRIES = 1 << 18
MARGIN = 1e-8


class Shard:
    """The impact-ordered index of one shard's documents and their rows."""

    def __init__(self, size: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.n = len(size)
        self.row = np.concatenate([[0], np.cumsum(size)])
        self.terms, at = np.unique(term, return_inverse=True)
        self.term, self.weight = at, weight
        doc = np.repeat(np.arange(self.n), size)
        order = np.lexsort((-weight, at))
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.start = np.searchsorted(at[order], np.arange(len(self.terms) + 1))
        self.top = self.post_weight[self.start[:-1]] if len(order) else np.zeros(0)
        self.longest = float(np.sqrt(np.bincount(doc, weight * weight, self.n).max())) if len(doc) else 0.0

    def blocks_above(self, term: int, cut: float) -> int:
        """How many postings lie in blocks whose largest weight is above ``cut``."""
        a, b = self.start[term], self.start[term + 1]
        return min(BLOCK * int(np.searchsorted(-self.post_weight[a:b:BLOCK], -cut)), b - a)

    def open(self, term: np.ndarray, weight: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first ``count`` postings of each term: documents, products, weights."""
        spans = [slice(a, a + n) for a, n in zip(self.start[term].tolist(), count.tolist())]
        found = np.concatenate([self.post_weight[x] for x in spans])
        return np.concatenate([self.post_doc[x] for x in spans]), found * np.repeat(weight, count), found

    def whole(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``k`` best from all postings of the terms."""
        docs, products, _ = self.open(term, weight, np.diff(self.start)[term])
        if len(docs) * 8 < self.n:  # few postings: no sums for all documents of the shard
            some, docs = np.unique(docs, return_inverse=True)
            return *_best(some, np.bincount(docs, products), k, skip), len(docs)
        sums = np.bincount(docs, products, self.n)
        if skip >= 0:
            sums[skip] = 0
        least = sums.max() if k == 1 else np.partition(sums, -k)[-k] if k < self.n else 0.0
        some = np.flatnonzero(sums >= least - MARGIN)
        return *_best(some, sums[some], k, skip), len(docs)

    def score(self, docs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Full products of the documents with a query spread over all terms."""
        size = self.row[docs + 1] - self.row[docs]
        ends = np.cumsum(size)
        at = np.repeat(self.row[docs] - ends + size, size) + np.arange(ends[-1])
        return np.add.reduceat(dense[self.term[at]] * self.weight[at], ends - size)


def bound(weight: np.ndarray, cut: np.ndarray, longest: float) -> float:
    """Largest product of the query with a vector below ``cut`` and of at most
    ``longest``: entries are the cut-off or in proportion to the query's."""
    if cut @ cut <= longest * longest:
        return float(weight @ cut)
    order = np.argsort(cut / weight)  # the first ones stay at their cut-off
    w, c = weight[order], cut[order]
    square, rest = np.cumsum(c * c) - c * c, np.cumsum((w * w)[::-1])[::-1]
    scale = np.sqrt(np.maximum(longest * longest - square, 0) / rest)
    k = int(np.argmax(scale * w <= c))  # the first split at which no later entry passes its cut-off
    return float(w[:k] @ c[:k] + scale[k] * rest[k])


def cut_offs(weight: np.ndarray, top: np.ndarray, count: np.ndarray, threshold: float, longest: float) -> np.ndarray:
    """Cut-offs below which no document reaches ``threshold``: common terms and
    light ones get higher cut-offs.  The scale is found by bisection."""
    if bound(weight, top, longest) < threshold:
        return top
    shape = np.sqrt(count) / weight
    shape = shape / shape.max()
    low, high = 0.0, float((top / shape).max())
    for _ in range(20):
        middle = (low + high) / 2
        if bound(weight, np.minimum(top, middle * shape), longest) < threshold:
            low = middle
        else:
            high = middle
    return np.minimum(top, low * shape)


def search(shard: Shard, term: np.ndarray, weight: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, postings opened) of the ``k`` best; ``skip`` is a
    document to leave out, or -1."""
    at = np.searchsorted(shard.terms, term)
    known = at < len(shard.terms)
    known[known] = shard.terms[at[known]] == term[known]
    at, weight = at[known], weight[known]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0), 0
    count = np.diff(shard.start)[at]
    if count.sum() <= WHOLE:
        return shard.whole(at, weight, k, skip)
    dense, top = np.zeros(len(shard.terms)), shard.top[at]
    dense[at] = weight
    heavy = np.argsort(-weight * top)[:SEED_BLOCKS]
    docs, products, _ = shard.open(at[heavy], weight[heavy], np.minimum(count[heavy], BLOCK))
    opened = len(docs)
    some, place = np.unique(docs, return_inverse=True)
    sums = np.bincount(place, products)
    sums, some = sums[some != skip], some[some != skip]
    threshold = 0.0
    if len(some) >= k:
        first = some[np.argsort(-sums)[:4 * k]]
        opened += int((shard.row[first + 1] - shard.row[first]).sum())
        threshold = float(np.sort(shard.score(first, dense))[-k])
    cut = cut_offs(weight, top, count, threshold - MARGIN, shard.longest)
    length = np.array([shard.blocks_above(t, c) for t, c in zip(at.tolist(), cut.tolist())])
    docs, products, found = shard.open(at, weight, length)
    opened += len(docs)
    some, place = np.unique(docs, return_inverse=True)
    sums = np.bincount(place, products, len(some))
    left = np.sqrt(np.maximum(shard.longest ** 2 - np.bincount(place, found * found, len(some)), 0))
    # entries of opened postings are in the sum; the others are below the cut-offs
    rest = np.minimum(bound(weight, cut, shard.longest), left * float(np.sqrt(weight @ weight)))
    some = some[(sums + rest >= threshold - MARGIN) & (some != skip)]
    if not len(some):
        return some, np.zeros(0), opened
    entries = int((shard.row[some + 1] - shard.row[some]).sum())
    if entries > count.sum() - length.sum():  # the closed blocks hold less than these documents
        *best, read = shard.whole(at, weight, k, skip)
        return *best, opened - len(docs) + read
    opened += entries
    return *_best(some, shard.score(some, dense), k, skip), opened


def _best(docs: np.ndarray, scores: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    scores = np.where(docs == skip, 0, scores)
    best = np.lexsort((docs, -np.round(scores, 9)))[:k]
    best = best[scores[best] > 0]
    return docs[best], scores[best]


def _flat(table: pa.Table, name: str, kind) -> np.ndarray:
    return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)


def vectors(entries: DataFrame, key: str, term: str, weight: str, *extra: str) -> DataFrame:
    """One row per document: its terms and weights as arrays (no shuffle where
    the entries are clustered by ``key``)."""
    return entries.groupBy(key, *extra).agg(F.collect_list(F.struct(term, weight)).alias("_v")).select(
        key, *extra, F.col(f"_v.{term}").alias("_terms"), F.col(f"_v.{weight}").alias("_weights"))


def top_k(queries: DataFrame, pool: DataFrame, k: int, shard_entries: int = SHARD_ENTRIES,
          chunk_entries: int = CHUNK_ENTRIES, counts: bool = False) -> DataFrame:
    """The ``k`` best pool documents of each query in every tile.

    ``queries``: (q, self, terms, weights), ``self`` a pool id to leave out or
    null; ``pool``: (p, terms, weights); ids and terms are longs.  Returns (q,
    p, score); the caller takes the best ``k`` over the tiles.  ``counts`` adds
    ``opened``, the number of postings and row entries read for the query, on
    each of its rows."""
    def parts(df: DataFrame, entries: int) -> int:
        return max(1, -(-(df.agg(F.sum(F.size("terms"))).first()[0] or 0) // entries))

    shards, chunks = parts(pool, shard_entries), parts(queries, chunk_entries)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = pool.withColumn("shard", F.pmod(F.xxhash64("p"), F.lit(shards)).cast("int")).withColumn("chunk", every(chunks))
    q = queries.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int")).withColumn("shard", every(shards))
    names = ["q", "p", "score", "opened"][:3 + counts]

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()][:len(names)]
        out: list[list] = [[] for _ in names]
        if left.num_rows and right.num_rows:
            left = left.sort_by("p")  # places in the shard are in the order of the ids
            ids = left["p"].to_numpy()
            shard = Shard(left["terms"].combine_chunks().value_lengths().to_numpy(), _flat(left, "terms", np.int64),
                          _flat(left, "weights", float))
            ends = np.cumsum(right["terms"].combine_chunks().value_lengths().to_numpy())
            terms, weights = _flat(right, "terms", np.int64), _flat(right, "weights", float)
            own = right["self"].to_pylist()
            for n, (query, b) in enumerate(zip(right["q"].to_pylist(), ends.tolist())):
                a = int(ends[n - 1]) if n else 0
                skip = -1
                if own[n] is not None and (place := int(np.searchsorted(ids, own[n]))) < len(ids) and ids[place] == own[n]:
                    skip = place
                docs, scores, opened = search(shard, terms[a:b], weights[a:b], k, skip)
                for column, values in zip(out, ([query] * len(docs), ids[docs].tolist(), scores.tolist(), [opened] * len(docs))):
                    column += values
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], names=names)

    return p.groupBy("shard", "chunk").cogroup(q.groupBy("shard", "chunk")).applyInArrow(
        tile, "q long, p long, score double" + ", opened long" * counts)
