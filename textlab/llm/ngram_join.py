"""N-gram Jaccard join by a blocked sparse matrix product.

Documents are rows and five-word shingles columns of a sparse incidence
matrix; the product of the matrix with its transpose counts the shingles that
two documents share.  Two documents link when that count o reaches the bound
that their sizes give, ``100 * o >= 80 * (a + b - o)``.  The product is never
formed as a whole:

* Equal sets are one row of the matrix (``node``: a hash of the sorted set).
* Columns: a pair that links shares a shingle among the first
  ``n - ceil(0.8 n) + 1`` of each set in one common order, rarest first.  First
  come the shingles that only one set holds, as far as a filter of slots that
  two sets have hit can tell, then the others by how often tasks met them
  again, in 2**22 counters; both only rank shingles, so collisions cost work,
  not links.  The
  filter has one to two slots a word, from 2**20 to 2**28 (32 MB); beyond some
  250 million words it tells fewer apart.  Of the leading entries only those
  that another set may hold shuffle.
* Blocks: the documents of one such column are dealt to the block of the
  column's smallest node, the hub, so the many columns that a family of copies
  shares fall into the same block and each document enters it once.  A block
  whose rows or entries pass a bound is tiled: its documents are dealt into
  parts and every pair of parts is a tile of its own.
* A block's members that no other member is close to in size are discarded.
* Within a tile overlaps are counted by the product of row strips with the
  tile, as postings accumulated by ``bincount``, first over the leading columns
  only: what two rows share there and the size of the smaller rest bound their
  overlap, and rows for which no pair reaches its bound are discarded.
* The remaining rows are multiplied over all columns.  The first row joins most
  of a family; after that only rows outside the largest class of the moment are
  multiplied with the rest, until every row outside it has been: then no pair
  of two classes is left untested.  What leaves a tile is a spanning set of
  links, never all pairs.

Components then come from joins over the links (:mod:`.components`), and every
document gets the smallest doc_id that it reaches.

Cases: null or empty texts and texts without words have an empty set and link
with nothing; a text of fewer than five words is its whole sequence; repeated
rows are equal sets; a null doc_id never is a component's id unless there is
no other; an empty table gives an empty result; other columns are ignored.
Sets and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .arrays import WHITE, lists, shingle_sets
from .common import drop_kept, first_rows, materialise, materialise_table
from .components import components

WIDTH = 5
PERCENT = 80
SKETCH_LOG2 = 22
SKETCH_BLOCKS = 64
FILTER_LOG2 = (20, 28)  # least and most slots of the filter of shared shingles
BYTES_A_WORD = 6
ACTIVE_LOG2 = 23  # bits of the filter of nodes that have any candidate
TILE_ROWS = 4096
TILE_ENTRIES = 1 << 21
STRIP_PRODUCTS = 1 << 20  # products accumulated at once


def node_id(shingles: np.ndarray) -> int:
    """A 64-bit id of a sorted set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


# -- pass 1: the counters and the filter ---------------------------------------


class Shared:
    """Which slots the shingles of one and of two sets have hit, as bits, and
    counters of the later hits."""

    def __init__(self, log2: int):
        self.shift = np.uint64(64 - log2)
        self.once, self.twice = np.zeros(1 << log2 - 3, np.uint8), np.zeros(1 << log2 - 3, np.uint8)
        self.counts = np.zeros(1 << min(log2, SKETCH_LOG2), np.uint16)
        self.held, self.n = [], 0

    def add(self, shingles: np.ndarray) -> None:
        self.held.append(shingles >> self.shift)
        self.n += len(shingles)
        if self.n > 1 << 20:
            self.flush()

    def flush(self) -> None:
        if not self.n:
            return
        slots = np.sort(np.concatenate(self.held)).astype(np.int64)
        self.held, self.n = [], 0
        new = np.concatenate([[True], slots[1:] != slots[:-1]])
        again = slots[~new]
        slots = slots[new]
        again = np.concatenate([again, slots[hit(self.once, slots)]])
        again.sort()
        at, hits = np.unique(again & (len(self.counts) - 1), return_counts=True)
        self.counts[at] = np.minimum(self.counts[at] + hits, 0xFF)
        _mark(self.twice, again)
        _mark(self.once, slots)

    def merge(self, once: np.ndarray, twice: np.ndarray) -> None:
        self.twice |= twice | (self.once & once)
        self.once |= once


def hit(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def _mark(bits: np.ndarray, slots: np.ndarray) -> None:
    """Sets the bits of sorted slots."""
    if len(slots):
        at, value = slots >> 3, np.left_shift(1, slots & 7).astype(np.uint8)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        bits[at[first]] |= np.bitwise_or.reduceat(value, first)


def packed(bits: np.ndarray) -> bytes:
    """Set bits as the gaps between them, a byte for a gap below 255 and a byte
    more for every 255."""
    gaps = np.diff(np.flatnonzero(np.unpackbits(bits, bitorder="little")), prepend=0)
    more = gaps // 255
    out = np.full(len(gaps) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gaps % 255
    return out.tobytes()


def unpacked(raw: bytes, size: int) -> np.ndarray:
    """The ``size`` bytes of bits that :func:`packed` made."""
    gaps, bits = np.frombuffer(raw, np.uint8), np.zeros(size, np.uint8)
    _mark(bits, np.cumsum(gaps, dtype=np.int64)[gaps != 255])
    return bits


def filter_log2(docs: DataFrame) -> int:
    """Slots for the words of all texts and up to twice as many, within ``FILTER_LOG2``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(FILTER_LOG2[0], int(size // BYTES_A_WORD).bit_length()), FILTER_LOG2[1])


def _task_tables(docs: DataFrame, log2: int) -> DataFrame:
    """Per task, the blocks of its counters and of its filter."""

    def run(batches):
        drop_kept()
        shared, seen = Shared(log2), set()
        for batch in batches:
            for _, s, _ in shingle_sets(batch.column(0), WHITE, WIDTH):
                node = node_id(s) if len(s) else None
                if node is not None and node not in seen:  # copies within a task count once
                    seen.add(node)
                    shared.add(s)
        if seen:
            shared.flush()
            counts, once, twice = (x.reshape(SKETCH_BLOCKS, -1) for x in (shared.counts.astype(np.uint8), shared.once, shared.twice))
            for b in range(SKETCH_BLOCKS):
                parts = zlib.compress(counts[b].tobytes(), 1), packed(once[b]), packed(twice[b])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)],
                                                 names=["block", "counts", "once", "twice"])

    return docs.select("text").mapInArrow(run, "block int, counts binary, once binary, twice binary")


class Order:
    """The common order of shingles: those of one set, then by count."""

    def __init__(self, counts: np.ndarray, twice: np.ndarray):
        self.counts, self.twice = counts, twice
        self.shift = np.uint64(64 - (8 * len(twice)).bit_length() + 1)

    def shared(self, s: np.ndarray) -> np.ndarray:
        """Which shingles another set may hold."""
        return hit(self.twice, (s >> self.shift).astype(np.int64))

    def rank(self, s: np.ndarray) -> np.ndarray:
        slots = (s >> self.shift).astype(np.int64)
        return self.counts[slots & (len(self.counts) - 1)].astype(np.int64) + (hit(self.twice, slots).astype(np.int64) << 20)


def _order(docs: DataFrame) -> Order:
    """Sums of the tasks' tables, block by block: 2**22 counters and a bit a
    slot come to the driver."""
    log2 = filter_log2(docs)
    per, bits = (1 << min(log2, SKETCH_LOG2)) // SKETCH_BLOCKS, (1 << log2 - 3) // SKETCH_BLOCKS

    def add(batches):
        drop_kept()
        total, shared = {}, {}
        for batch in batches:
            for b, c, *seen in zip(*(column.to_pylist() for column in batch.columns)):
                if b not in total:
                    total[b], shared[b] = np.zeros(per, np.uint32), Shared(3)
                    shared[b].once, shared[b].twice = np.zeros(bits, np.uint8), np.zeros(bits, np.uint8)
                total[b] += np.frombuffer(zlib.decompress(c), np.uint8)
                shared[b].merge(*(unpacked(x, bits) for x in seen))
        for b, v in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([np.minimum(v, (1 << 16) - 1).astype(np.uint16).tobytes()], pa.binary()),
                 pa.array([shared[b].twice.tobytes()], pa.binary())], names=["block", "counts", "twice"])

    summed = _task_tables(docs, log2).repartition(SKETCH_BLOCKS, "block").mapInArrow(add, "block int, counts binary, twice binary")
    counts, twice = np.zeros((SKETCH_BLOCKS, per), np.uint16), np.zeros((SKETCH_BLOCKS, bits), np.uint8)
    for b, c, t in summed.collect():  # 64 rows
        counts[b], twice[b] = np.frombuffer(c, np.uint16), np.frombuffer(t, np.uint8)
    return Order(counts.ravel(), twice.ravel())


# -- pass 2: set sizes, set ids and the leading columns of each row -------------


def leading(s: np.ndarray, order: Order) -> tuple[np.ndarray, int]:
    """The leading shingles of a sorted set, in the common order and by hash on
    ties, and the rank of the last."""
    c = order.rank(s)
    first = np.argsort(c, kind="stable")[:prefix_length(len(s))]
    return s[first], int(c[first[-1]])


def _describe(docs: DataFrame, order: Order) -> DataFrame:
    """(doc_id, n, node, grams) of the documents: the size and the id of the
    set and, for the first of a task that has it, the leading shingles that
    another set may hold."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        drop_kept()
        order, seen = shared.value, set()
        for batch in batches:
            rows, grams, total = [], [], 0
            for i, s, _ in shingle_sets(batch.column(1), WHITE, WIDTH):
                node, first = node_id(s) if len(s) else None, s[:0]
                if node is not None and node not in seen:
                    seen.add(node)
                    first, _ = leading(s, order)
                    first = first[order.shared(first)] >> np.uint64(16)  # enough to meet by; a chance meeting costs work only
                rows.append((i, len(s), node))
                grams.append(first)
                total += len(first)
                if total > 1 << 18:
                    yield _flush(batch, rows, grams)
                    rows, grams, total = [], [], 0
            if rows:
                yield _flush(batch, rows, grams)

    def _flush(batch, rows, grams):
        i, n, node = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(i)), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
             lists(np.concatenate(grams).view(np.int64), np.array([len(g) for g in grams]), pa.int64())],
            names=["doc_id", "n", "node", "grams"])

    return docs.mapInArrow(run, f"doc_id {kind}, n long, node long, grams array<long>")


def _candidates(described: DataFrame) -> DataFrame:
    """(hub, hub_n, node, n): the members of each block, once each."""
    from pyspark.sql import Window

    column = Window.partitionBy("gram")
    leads = described.select(F.explode("grams").alias("gram"), "node", F.col("n").cast("int").alias("n"))
    pairs = (leads
            .withColumn("first", F.min(F.struct("node", "n")).over(column))
            .where((F.col("first.node") != F.col("node")) | (F.col("first.n") != F.col("n")))
            .select(F.col("first.node").alias("hub"), F.col("first.n").alias("hub_n"), "node", "n").distinct())
    members = pairs.withColumn("self", F.explode(F.array(F.lit(True), F.lit(False)))).select(
        "hub", "hub_n", F.when(F.col("self"), F.col("hub")).otherwise(F.col("node")).alias("node"),
        F.when(F.col("self"), F.col("hub_n")).otherwise(F.col("n")).alias("n")).distinct()
    # of a block's members in order of size, those whose nearest are too small and too large go
    by_size = Window.partitionBy("hub", "hub_n").orderBy("n")
    near = members.withColumns({"less": F.lag("n").over(by_size), "more": F.lead("n").over(by_size)})
    return near.where(f"100 * less >= {PERCENT} * n or 100 * n >= {PERCENT} * more").drop("less", "more")


# -- passes 3 and 4: the rows of the documents that have candidates ----------


def _active_bits(members: DataFrame) -> np.ndarray:
    """A filter of 2**23 bits over the nodes of blocks (1 MB)."""
    bit = F.col("node").bitwiseAND(F.lit((1 << ACTIVE_LOG2) - 1)) + 1
    made = members.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros((1 << ACTIVE_LOG2) // 8, np.uint8)
    for bucket, bits in made:
        out[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _rows(docs: DataFrame, active: np.ndarray, order: Order | None) -> DataFrame:
    """(node, n, last, grams) of the distinct sets that may be active: all their
    shingles, or with an order the leading ones and the last's rank."""
    sc = docs.sparkSession.sparkContext
    bits_, order_ = sc.broadcast(active), sc.broadcast(order)

    def run(batches):
        drop_kept()
        bits, order, seen = np.unpackbits(bits_.value, bitorder="little").view(bool), order_.value, set()
        for batch in batches:
            out, total = [], 0
            for _, s, _ in shingle_sets(batch.column(1), WHITE, WIDTH):
                node = node_id(s) if len(s) else None
                if node is None or node in seen or not bits[node & (len(bits) - 1)]:
                    continue
                seen.add(node)
                n, last = len(s), 0
                if order is not None:
                    s, last = leading(s, order)
                out.append((node, n, last, s))
                total += len(s)
                if total > 1 << 18:
                    yield _flush(out)
                    out, total = [], 0
            if out:
                yield _flush(out)

    def _flush(out):
        node, n, last, sets = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(last, pa.int32()),
             lists(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]), pa.int64())],
            names=["node", "n", "last", "grams"])

    made = docs.mapInArrow(run, "node long, n int, last int, grams array<long>")
    return made.groupBy("node", "n").agg(F.first("last").alias("last"), F.first("grams").alias("grams"))


# -- the product --------------------------------------------------------------


class Product:
    """The product of one tile's incidence matrix with its transpose, by strips
    of rows; ``grams`` holds the rows one after the other."""

    def __init__(self, sizes: np.ndarray, grams: np.ndarray):
        self.sizes, self.m = sizes, len(sizes)
        row_of = np.repeat(np.arange(self.m), sizes)
        order = np.argsort(grams, kind="stable")
        first = np.concatenate([[True], grams[order][1:] != grams[order][:-1]])
        self.code = np.empty(len(grams), np.int64)
        self.code[order] = np.cumsum(first) - 1
        self.posting, self.post_at = row_of[order], np.concatenate([np.flatnonzero(first), [len(grams)]])
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.cost = np.add.reduceat(self.post_at[self.code + 1] - self.post_at[self.code], self.begin[:-1])

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Shingles that each of ``rows`` shares with every row."""
        entries = np.concatenate([self.code[self.begin[r]:self.begin[r + 1]] for r in rows])
        strip = np.repeat(np.arange(len(rows)), self.sizes[rows])
        lengths = self.post_at[entries + 1] - self.post_at[entries]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.post_at[entries] - (ends - lengths), lengths)
        cells = np.repeat(strip, lengths) * self.m + self.posting[at]
        return np.bincount(cells, minlength=len(rows) * self.m).reshape(len(rows), self.m)

    def strip(self, rows: np.ndarray) -> int:
        """How many of ``rows`` to multiply at once."""
        n = int(np.searchsorted(np.cumsum(self.cost[rows]), STRIP_PRODUCTS, "right"))
        return max(1, min(n, STRIP_PRODUCTS // self.m))


def tile_links(sizes: np.ndarray, grams: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning set of the links among the rows of a tile."""
    product, m, links, up = Product(sizes, grams), len(sizes), [], np.arange(len(sizes))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return int(x)

    def tops() -> np.ndarray:
        while (up[up] != up).any():
            up[:] = up[up]
        return up.copy()

    def multiply(rows: np.ndarray) -> None:
        linked = (100 + percent) * product.counts(rows) >= percent * (sizes[rows][:, None] + sizes[None, :])
        classes = tops()
        linked &= classes[rows][:, None] != classes[None, :]
        r_at, c_at = np.nonzero(linked)
        _, once = np.unique(classes[rows[r_at]] * m + classes[c_at], return_index=True)  # one link for two classes
        for r, c in zip(rows[r_at[once]].tolist(), c_at[once].tolist()):
            x, y = top(r), top(c)
            if x != y:
                up[max(x, y)] = min(x, y)
                links.append((r, c))

    multiply(np.array([0]))
    done = np.arange(m) == 0
    while True:
        classes = tops()
        # rows of the largest class meet all others from the others' side; they
        # are looked at again as soon as another class is the largest
        left = np.flatnonzero(~done & (classes != np.bincount(classes, minlength=m).argmax()))
        if not len(left):
            return links
        rows = left[:product.strip(left)]
        multiply(rows)
        done[rows] = True


def tile_survivors(sizes: np.ndarray, leads: np.ndarray, last: np.ndarray, grams: np.ndarray,
                   percent: int = PERCENT) -> np.ndarray:
    """Which rows may link with some other row of a tile, by their leading
    shingles alone.  Of two rows, the one whose last leading shingle comes
    first in the common order can share, beyond what the leading parts share,
    at most its own rest."""
    product, m = Product(leads, grams), len(sizes)
    rank = np.empty(m, np.int64)
    rank[np.lexsort((grams[product.begin[1:] - 1].view(np.uint64), last))] = np.arange(m)
    rest, may = sizes - leads, np.zeros(m, bool)

    def multiply(rows: np.ndarray) -> None:
        counts = product.counts(rows)
        most = counts + np.where(rank[rows][:, None] <= rank[None, :], rest[rows][:, None], rest[None, :])
        most = np.minimum(most, np.minimum(sizes[rows][:, None], sizes[None, :]))
        ok = (counts > 0) & ((100 + percent) * most >= percent * (sizes[rows][:, None] + sizes[None, :]))
        ok[np.arange(len(rows)), rows] = False
        may[rows] |= ok.any(1)
        may[ok.any(0)] = True

    multiply(np.array([0]))
    left = np.arange(1, m)
    while len(left := left[~may[left]]):
        take = product.strip(left)
        multiply(left[:take])
        left = left[take:]
    return may


def _tiles(members: DataFrame, rows: DataFrame, share: float) -> DataFrame:
    """Members of the blocks with their rows, dealt to tiles; ``share`` of a
    set's size is how many entries its row has."""
    blocks = members.groupBy("hub", "hub_n").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("n") * share).alias("entries"),
        F.min("n").alias("least"), F.max("n").alias("most"))
    blocks = blocks.where(f"rows > 2 or rows = 2 and 100 * least >= {PERCENT} * most").select(
        "hub", "hub_n", "entries", F.greatest(F.ceil(F.col("rows") / TILE_ROWS), F.ceil(F.col("entries") / TILE_ENTRIES)).alias("parts"))
    blocks = materialise(blocks)
    total = blocks.agg(F.sum("entries")).first()[0] or 0
    deals = max(1, int(total // (TILE_ENTRIES // 4)))
    dealt = members.join(blocks.drop("entries"), ["hub", "hub_n"]).withColumn(
        "part", F.pmod(F.xxhash64("node", "n"), F.col("parts")))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        "hub", "hub_n", "node", "n", "parts", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return tiles.join(rows, ["node", "n"]).select(
        # small blocks share a task by a hash of the hub, tiles of a large one have their own
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("hub"), F.lit(deals))).otherwise(F.col("hub")).alias("deal"),
        (F.col("parts") > 1).alias("tiled"), "i", "j", "hub", "hub_n", "node", "n", "last", "grams")


def _each_tile(group: pa.Table):
    """(node, n, last, row sizes, row entries, hub, hub_n) of each tile of a group."""
    group = group.sort_by([("hub", "ascending"), ("hub_n", "ascending"), ("node", "ascending")]).combine_chunks()
    hub, hub_n, node, n, last = (group[c].to_numpy() for c in ("hub", "hub_n", "node", "n", "last"))
    flat = group["grams"].chunk(0)
    values, offsets = flat.values.to_numpy(), flat.offsets.to_numpy()
    cut = np.flatnonzero(np.concatenate([[True], (hub[1:] != hub[:-1]) | (hub_n[1:] != hub_n[:-1]), [True]]))
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a > 1:
            yield (node[a:b], n[a:b].astype(np.int64), last[a:b], np.diff(offsets[a:b + 1]).astype(np.int64),
                   values[offsets[a]:offsets[b]], int(hub[a]), int(hub_n[a]))


def _survivors(members: DataFrame, rows: DataFrame) -> DataFrame:
    """(hub, hub_n, node, n): the members that may link with another of their block."""

    def run(group: pa.Table) -> pa.Table:
        out = [np.zeros((4, 0), np.int64)]
        for node, n, last, leads, grams, hub, hub_n in _each_tile(group):
            may = tile_survivors(n, leads, last, grams)
            out.append(np.stack([np.full(may.sum(), hub), np.full(may.sum(), hub_n), node[may], n[may]]))
        cols = np.concatenate(out, 1)
        return pa.table([pa.array(c.astype(k)) for c, k in zip(cols, ("i8", "i4", "i8", "i4"))], names=["hub", "hub_n", "node", "n"])

    share = 1 - PERCENT / 100
    return _tiles(members, rows, share).groupBy("deal", "tiled", "i", "j").applyInArrow(
        run, "hub long, hub_n int, node long, n int").distinct()


def _links(members: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): spanning links of every block."""

    def run(group: pa.Table) -> pa.Table:
        out = [np.zeros((4, 0), np.int64)]
        for node, n, _, sizes, grams, *_ in _each_tile(group):
            links = np.array(tile_links(sizes, grams), np.int64).reshape(-1, 2).T
            out.append(np.stack([node[links[0]], n[links[0]], node[links[1]], n[links[1]]]))
        cols = np.concatenate(out, 1)
        return pa.table([pa.array(c.astype(k)) for c, k in zip(cols, ("i8", "i4", "i8", "i4"))], names=["a", "a_n", "b", "b_n"])

    return _tiles(members, rows, 1.0).groupBy("deal", "tiled", "i", "j").applyInArrow(run, "a long, a_n int, b long, b_n int")


# -- the operator -------------------------------------------------------------


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    order = _order(docs)
    described = materialise_table(_describe(docs, order), "ngram-sets")
    members = materialise(_candidates(described))
    members = materialise(_survivors(members, _rows(docs, _active_bits(members), order)))
    links = materialise(_links(members, _rows(docs, _active_bits(members), None)))
    # a set is known by its hash and its size
    linked = components(links.select(F.struct(F.col("a").alias("node"), F.col("a_n").alias("n")).alias("a"),
                                     F.struct(F.col("b").alias("node"), F.col("b_n").alias("n")).alias("b")), "a", "b")
    members = described.select("doc_id", "n", "node")
    sets = members.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("least"))
    labels = linked.select("node.node", F.col("node.n").cast("long").alias("n"), "label")
    labelled = labels.join(sets, ["node", "n"])
    reach = labelled.join(labelled.groupBy("label").agg(F.min("least").alias("reach")), "label").select("node", "n", "reach")
    known = sets.join(reach, ["node", "n"], "left").select(
        F.col("node").alias("set_node"), F.col("n").alias("set_n"), F.coalesce("reach", "least").alias("component"))
    return members.join(known, (F.col("node") == F.col("set_node")) & (F.col("n") == F.col("set_n")), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id")).alias("component_id"))


def one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: the one of smallest id, null ids last.  Rows
    are told apart by their id and a 64-bit hash of their text, and of rows equal
    in both one stays; rows without words all stay.  Only rows that a Bloom
    filter takes for dropped or repeated shuffle."""
    own = F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("id"), F.xxhash64(f"`{text}`").alias("text"))
    rows = docs.withColumn("__row", own)
    found = materialise(ngram_components(rows, "__row", text))
    gone = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id")
    left = bloom.drop_rows(rows, "__row", gone)
    again = materialise(found.where((F.col("component_id") == F.col("doc_id")) & (F.col("n_shingles") > 0))
                        .groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if not again.isEmpty():
        once = rows.join(again.select(F.col("doc_id").alias("__again")), F.col("__row") == F.col("__again"), "left_semi")
        left = bloom.drop_rows(left, "__row", again).unionAll(first_rows(once, F.col("__row"), F.col(f"`{text}`")))
    return left.drop("__row")
