"""Removal of repeated passages by suffix arrays.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else
in the table (the same document included) is removed; strings are judged on
the input.  All strings of that length are covered, in four steps that move
little more than the repeated parts:

1. *Anchors.*  The anchor of a string is its ``GRAM``-byte gram of least hash
   (leftmost on ties), so equal strings have equal anchors at equal places.
   Consecutive strings with the same anchor are one occurrence.  Anchors that
   occur once are dropped: a fixed-size bit filter first, exact counts after.
2. *Equal occurrences.*  Occurrences of an anchor whose whole bytes are equal
   (by hash) are repeated as they stand and need no sorting.
3. *Suffix arrays.*  Occurrences that differ although the anchor is the same
   are cut into slices of ``STEPS`` strings.  All strings of a slice contain
   its middle, so slices meet only where their middles are equal too, and the
   middle is a single symbol of the text that is sorted: a slice of 32
   strings of 200 bytes has 63 symbols, and a string is 32 of them.  The
   slices that meet are one text, and the suffix arrays of many texts are
   built at once (:mod:`.suffix_array`); neighbours in the order that share
   a string's symbols are repeats.
4. *Hot slices.*  Where more than ``HOT`` slices meet, their strings are keyed
   by the bytes around the middle, which is where the sort would have put
   equal strings together, and counted by Spark: no task holds such a group.

Then each document gets its removed runs; documents that a Bloom filter clears
of any do not shuffle.

Cases: null and empty texts and texts shorter than ``LENGTH`` lose nothing;
repeated rows repeat each other; equal rows (same id and text) have the same
result; an empty table gives an empty result; other columns are ignored.
Rows are told apart by a 64-bit hash of id and text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .arrays import SLICE, mix, prefix_sums, text_bytes, window_hashes
from .arrays import tables
from .common import materialise, materialise_table
from .suffix_array import suffix_arrays

LENGTH = 200
GRAM = 64
STEPS = 32
HOT = 4096
ANCHOR_LOG2 = 26  # bits of the filter of repeated anchors (8 MB)
OPEN_LOG2 = 24
SLICES_PER_TASK = 50_000
SYMBOLS_AT_ONCE = 1 << 19

SPREAD = LENGTH - GRAM + 1  # grams of a string
SIDE = STEPS - 1
_MULT = np.uint64(0xD6E8FEB86659FD93)


def least_grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of a document (of at most a piece): anchor hash, anchor
    position, first string and number of strings."""
    sums = prefix_sums(data)
    m = len(data) - GRAM + 1
    h = (sums[GRAM:] - sums[:m]) * tables()[2][:m] * _MULT
    low = np.uint64((1 << 21) - 1)
    ranked = (h & ~low) | np.arange(m, dtype=np.uint64)  # leftmost of the least
    blocks = -(-m // SPREAD)
    grid = np.full(blocks * SPREAD, np.uint64(2**64 - 1))
    grid[:m] = ranked
    grid = grid.reshape(blocks, SPREAD)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    n = m - SPREAD + 1
    at = (np.minimum(behind[:n], ahead[SPREAD - 1:SPREAD - 1 + n]) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return mix(h[at[first]]), at[first], first, np.diff(np.concatenate([first, [n]]))


def _pieces(data: np.ndarray, size: int):
    """A document in pieces of at most ``size`` strings (more than ``SPREAD``):
    the first string of each, its bytes and the occurrences of
    :func:`least_grams`.  The next piece begins with the occurrence that may
    cross the edge, so every occurrence is whole and in one piece only."""
    a, strings = 0, len(data) - LENGTH + 1
    while a < strings:
        piece = data[a:a + size + LENGTH - 1]
        found = least_grams(piece)
        if a + size >= strings:
            yield a, piece, found
            return
        edge = int(found[2][-1])
        yield a, piece, tuple(c[:-1] for c in found)
        a += edge


def _documents(batches, column: int = 1):
    """(row hash, bytes) of every document of the batches."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(column))
        rows = batch.column(0).to_numpy(zero_copy_only=False)
        for k in range(batch.num_rows):
            if offsets[k + 1] - offsets[k] >= LENGTH:
                yield rows[k], data[offsets[k]:offsets[k + 1]]


def _emit(columns: list[tuple[list, pa.DataType]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in columns], names=names)


def _repeated_anchors(docs: DataFrame, size: int) -> DataFrame:
    """(anchor): the anchors that occur at least twice."""

    def run(batches):
        held, total = [], 0
        for _, data in _documents(batches):
            for _, _, found in _pieces(data, size):
                held.append(found[0])
                total += len(held[-1])
            if total > 1 << 17:
                yield _flush(held)
                held, total = [], 0
        if held:
            yield _flush(held)

    def _flush(held):
        anchors, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(n.astype(np.int32))], names=["anchor", "n"])

    return docs.mapInArrow(run, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def _bits(df: DataFrame, column: str, log2: int) -> np.ndarray:
    """A packed filter of 2**log2 bits over a column of hashes."""
    bit = F.col(column).bitwiseAND(F.lit((1 << log2) - 1)) + 1
    made = df.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((1 << log2) // 8, np.uint8)
    for bucket, bits in made.toLocalIterator():  # at most 2**log2 / 32768 rows of 4 KB
        out[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _context(sums: np.ndarray, at: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of an occurrence's bytes and of its place around the anchor."""
    return mix(window_hashes(sums, first, first + n - 1 + LENGTH) + (at - first).astype(np.uint64))


def _occurrences(docs: DataFrame, bits: np.ndarray, size: int) -> DataFrame:
    """(anchor, context, row, first, n) of the occurrences of filtered anchors."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    names = ["anchor", "context", "row", "first", "n"]

    def run(batches):
        bits, held, total = shared.value, [[] for _ in names], 0
        for row, data in _documents(batches):
            for a, piece, (anchor, at, first, n) in _pieces(data, size):
                keep = _has(bits, anchor)
                if not keep.any():
                    continue
                anchor, at, first, n = anchor[keep], at[keep], first[keep], n[keep]
                context = _context(prefix_sums(piece), at, first, n)
                for h, c in zip(held, (anchor.view(np.int64), context.view(np.int64), np.full(len(n), row), first + a, n)):
                    h.append(c)
                total += len(n)
            if total > 1 << 16:
                yield _emit(list(zip(held, kinds)), names)
                held, total = [[] for _ in names], 0
        if total:
            yield _emit(list(zip(held, kinds)), names)

    return docs.mapInArrow(run, "anchor long, context long, row long, first long, n int")


def _around(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``SIDE`` bytes from each start; 0 outside the document."""
    at = start[:, None] + np.arange(SIDE)
    inside = (at >= 0) & (at < len(data))
    return np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8)


def _open_slices(docs: DataFrame, bits: np.ndarray, size: int) -> DataFrame:
    """(key, slice, row, base, left_out, right_out, sides) of the slices of
    occurrences of filtered anchors, of equal occurrences in a task only the
    first; ``base`` is the slice's first string, the sides are the bytes before
    and after its middle, left_out and right_out say how many of them lie
    outside the document, and ``slice`` hashes all of it."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    names = ["key", "slice", "row", "base", "left_out", "right_out", "sides"]

    def run(batches):
        bits, held, total, known = shared.value, [[] for _ in names], 0, set()
        for row, data in _documents(batches):
            for a, piece, (anchor, at, first, n) in _pieces(data, size):
                keep = _has(bits, anchor)
                if not keep.any():
                    continue
                anchor, at, first, n = anchor[keep], at[keep], first[keep], n[keep]
                sums = prefix_sums(piece)
                context = _context(sums, at, first, n).tolist()
                fresh = np.array([c not in known and not known.add(c) for c in context])
                if not fresh.any():
                    continue
                anchor, at, first, n = anchor[fresh], at[fresh], first[fresh], n[fresh]
                low, high = (at - first - n + 1) // STEPS, (at - first) // STEPS
                count = high - low + 1
                j = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                base = np.repeat(at, count) - STEPS * j - SIDE
                key = mix(window_hashes(sums, base + SIDE, base + LENGTH)
                          + np.repeat(anchor, count) * _MULT + j.astype(np.uint64))
                base += a
                sides = np.concatenate([_around(data, base), _around(data, base + LENGTH)], 1)
                left, right = np.maximum(0, -base), np.maximum(0, base + LENGTH + SIDE - len(data))
                whole = key + (left * (SIDE + 1) + right).astype(np.uint64)
                for c in range(2 * SIDE):
                    whole = whole * _MULT + sides[:, c]
                for h, c in zip(held, (key.view(np.int64), mix(whole).view(np.int64), np.full(len(base), row), base, left, right, sides)):
                    h.append(c)
                total += len(base)
            if total > 1 << 15:
                yield _flush(held)
                held, total = [[] for _ in names], 0
        if total:
            yield _flush(held)

    def _flush(held):
        key, whole, row, base, left, right, sides = (np.concatenate(h) for h in held)
        offsets = np.arange(len(sides) + 1, dtype=np.int32) * (2 * SIDE)
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(sides), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(sides))])
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(whole), pa.array(row, pa.int64()), pa.array(base), pa.array(left.astype(np.int32)),
             pa.array(right.astype(np.int32)), packed], names=names)

    return docs.mapInArrow(run, "key long, slice long, row long, base long, left_out int, right_out int, sides binary")


def repeated_in_texts(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For strings of ``2 * STEPS - 1`` symbols, grouped by ``owner`` (sorted):
    whether each of a string's ``STEPS`` runs of ``STEPS`` symbols also occurs
    elsewhere in its group."""
    n, width = symbols.shape
    dup = np.zeros((n, STEPS), bool)
    sizes = np.bincount(owner) * (width + 1)
    sizes = sizes[sizes > 0]
    order = np.argsort(sizes, kind="stable")  # texts of a batch are of like size
    begin = np.cumsum(sizes) - sizes
    text = np.concatenate([symbols + 1, np.ones((n, 1), symbols.dtype)], 1).ravel()  # 1 parts the strings
    text[begin + sizes - 1] = 0  # 0 ends a text
    cut = np.searchsorted(np.cumsum(sizes[order]), np.arange(0, sizes.sum() + SYMBOLS_AT_ONCE, SYMBOLS_AT_ONCE))
    flat = np.zeros(len(text), bool)
    for a, b in zip(cut[:-1], cut[1:] + 0):
        some = order[a:b] if b < len(order) else order[a:]
        if not len(some):
            continue
        where = np.repeat(begin[some] - (np.cumsum(sizes[some]) - sizes[some]), sizes[some]) + np.arange(sizes[some].sum())
        array = where[suffix_arrays(text[where], sizes[some])]
        x, y = array[:-1], array[1:]
        own = np.repeat(np.arange(len(some)), sizes[some])
        ok = (own[1:] == own[:-1]) & (x % (width + 1) < STEPS) & (y % (width + 1) < STEPS)
        x, y = x[ok], y[ok]
        for k in range(STEPS):
            same = text[x + k] == text[y + k]
            x, y = x[same], y[same]
        flat[x] = flat[y] = True
    dup[:] = flat.reshape(n, width + 1)[:, :STEPS]
    return dup


def _runs(row: np.ndarray, base: np.ndarray, dup: np.ndarray) -> pa.Table:
    """(row, begin, stop) of the bytes that the repeated strings cover."""
    padded = np.zeros((len(dup), STEPS + 2), np.int8)
    padded[:, 1:-1] = dup
    r, a = np.nonzero(np.diff(padded, axis=1) == 1)
    _, b = np.nonzero(np.diff(padded, axis=1) == -1)
    return pa.table({"row": pa.array(row[r], pa.int64()), "begin": pa.array(base[r] + a, pa.int64()),
                     "stop": pa.array(base[r] + b - 1 + LENGTH, pa.int64())})


def _symbols(sides: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Slices as symbols: 0 outside the document, a byte plus 1, the middle 300."""
    out = np.full((len(sides), 2 * STEPS - 1), 300, np.int32)
    k = np.arange(SIDE)
    out[:, :SIDE] = np.where(k[None, :] < left[:, None], 0, sides[:, :SIDE].astype(np.int32) + 1)
    out[:, STEPS:] = np.where(SIDE - k[None, :] <= right[:, None], 0, sides[:, SIDE:].astype(np.int32) + 1)
    return out


def _sides(column: pa.ChunkedArray) -> np.ndarray:
    return text_bytes(column)[0].reshape(-1, 2 * SIDE) if len(column) else np.zeros((0, 2 * SIDE), np.uint8)


def _sorted_repeats(group: pa.Table) -> pa.Table:
    """The repeats among slices that meet, by suffix arrays."""
    key, row, base = (group[c].to_numpy() for c in ("key", "row", "base"))
    left, right = group["left_out"].to_numpy(), group["right_out"].to_numpy()
    data, offsets = text_bytes(group["sides"])
    sides = data[offsets[0]:offsets[-1]].reshape(-1, 2 * SIDE)
    symbols = _symbols(sides, left, right)
    # equal slices are one string of the text
    view = np.ascontiguousarray(np.concatenate([key.view(np.uint8).reshape(-1, 8), symbols.astype(np.uint16).view(np.uint8)], 1))
    view = view.view([("", np.void, view.shape[1])]).ravel() if len(view) else view
    _, one, back, times = np.unique(view, return_index=True, return_inverse=True, return_counts=True)
    by = np.argsort(key[one], kind="stable")
    owner = np.unique(key[one][by], return_inverse=True)[1]
    meets = np.bincount(owner)[owner] > 1
    dup = np.zeros((len(one), STEPS), bool)
    if meets.any():
        some = by[meets]
        dup[some] = repeated_in_texts(symbols[one[some]], np.unique(owner[meets], return_inverse=True)[1])
    dup[times > 1] = True
    k = np.arange(STEPS)
    valid = (k[None, :] >= left[:, None]) & (k[None, :] <= SIDE - right[:, None])
    return _runs(row, base, dup[back.ravel()] & valid)


def _string_keys(batches):
    """(string, row, first): one row per string of a hot slice, keyed by the
    slice, the string's place in it and its bytes around the middle."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            key, row, base = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            left, right = part.column(3).to_numpy(), part.column(4).to_numpy()
            data, offsets = text_bytes(part.column(5))
            sides = data[offsets[0]:offsets[-1]].reshape(-1, 2 * SIDE)
            out = [[], [], []]
            for k in range(STEPS):
                ok = (k >= left) & (k <= SIDE - right)
                h = mix(key.view(np.uint64) + np.uint64((k + 1) * int(_MULT) % 2**64))
                for c in [*range(k, SIDE), *range(SIDE, SIDE + k)]:
                    h = h * _MULT + sides[:, c]
                out[0].append(mix(h[ok]).view(np.int64))
                out[1].append(row[ok])
                out[2].append(base[ok] + k)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out],
                                             names=["string", "row", "first"])


def repeated_spans(docs: DataFrame, size: int | None = None) -> DataFrame:
    """(row, begin, stop) of repeated bytes, overlaps included; ``docs`` has
    columns row and text.  Tasks take texts in pieces of ``size`` strings
    (``SLICE`` by default)."""
    size = size or SLICE  # read here: the workers have a module of their own
    anchors = _repeated_anchors(docs, size)
    seen = materialise_table(_occurrences(docs, _bits(anchors, "anchor", ANCHOR_LOG2), size), "occurrences")
    contexts = seen.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("times"))
    open_ = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("least")) \
        .where("kinds > 1 and least = 1").select("anchor")
    again = materialise(contexts.where("times > 1").select(F.col("context").alias("known")).distinct())
    whole = seen.select("context", "row", "first", "n").join(again, F.col("context") == F.col("known")).select(
        "row", F.col("first").alias("begin"), (F.col("first") + F.col("n") - 1 + LENGTH).alias("stop"))
    slices = materialise_table(_open_slices(docs, _bits(open_, "anchor", OPEN_LOG2), size), "slices")
    # slices that meet: all equal, or to be sorted, or too many for a task
    keys = materialise(slices.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("slice").alias("a"), F.max("slice").alias("b"))
                       .where("n > 1").select(F.col("key").alias("met"), F.when(F.col("a") == F.col("b"), 0).when(
                           F.col("n") <= HOT, 1).otherwise(2).alias("how")))
    tasks = max(1, -(-slices.count() // SLICES_PER_TASK))
    # equal slices need no sides; only those that may have to be sorted take them along
    same, differ = keys.where("how = 0").select("met"), keys.where("how > 0")
    equal = bloom.probe(slices.select("key", "row", "base", "left_out", "right_out"), "key", bloom.keys_filter(same, "met"), "maybe") \
        .where("maybe").join(same, F.col("key") == F.col("met")).select(
            "row", (F.col("base") + F.col("left_out")).alias("begin"),
            (F.col("base") + SIDE - F.col("right_out") + LENGTH).alias("stop"))
    met = bloom.probe(slices, "key", bloom.keys_filter(differ, "met"), "maybe").where("maybe").join(
        differ, F.col("key") == F.col("met"))
    columns = ["key", "row", "base", "left_out", "right_out", "sides"]
    runs = "row long, begin long, stop long"
    sorted_ = met.where("how = 1").select(F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("deal"), *columns) \
        .groupBy("deal").applyInArrow(_sorted_repeats, runs)
    strings = met.where("how = 2").select(*columns).mapInArrow(_string_keys, "string long, row long, first long")
    more = strings.groupBy(F.col("string").alias("known")).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    hot = strings.join(more, F.col("string") == F.col("known")).select(
        "row", F.col("first").alias("begin"), (F.col("first") + LENGTH).alias("stop"))
    return whole.unionAll(equal).unionAll(sorted_).unionAll(hot)


def merge(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_kept: bool = False,
                   size: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document,
    with the kept bytes themselves if asked for."""
    names = F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    rows = docs.select(*names).withColumn("row", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    spans = repeated_spans(rows.select("row", "text"), size)
    # runs of a document, merged as far as they go by when they are gathered
    by_row = materialise(spans.groupBy(F.col("row").alias("of")).agg(
        F.collect_list(F.struct("begin", "stop")).alias("spans")))
    none = F.array().cast("array<struct<begin:bigint,stop:bigint>>")
    flagged = bloom.probe(rows, "row", bloom.keys_filter(by_row.select("of"), "of"), "maybe")
    alone = flagged.where("not maybe").select("doc_id", "text", none.alias("spans"))
    again = flagged.where("maybe").join(by_row, F.col("row") == F.col("of"), "left").select(
        "doc_id", "text", F.coalesce("spans", none).alias("spans"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + \
        (", kept binary" if with_kept else "")

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out = []
            for k, spans in enumerate(batch.column(2).to_pylist()):
                a, b = int(offsets[k]), int(offsets[k + 1])
                cuts = merge([(s["begin"], s["stop"]) for s in spans])
                digest, at, parts = hashlib.sha256(), a, []
                for x, y in [*cuts, (b - a, b - a)]:
                    digest.update(data[at:a + x])
                    if with_kept:
                        parts.append(data[at:a + x].tobytes())
                    at = a + y
                out.append((b - a, sum(y - x for x, y in cuts), len(cuts), digest.hexdigest(), b"".join(parts)))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*out), kinds)][:5 if with_kept else 4]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:1 + len(cols)])

    return alone.unionAll(again).mapInArrow(run, schema)


def repeated_bytes(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs)
