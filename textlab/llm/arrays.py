"""Vectorised work on the UTF-8 bytes of an Arrow text column.

Tasks of several operators see their texts as one byte array with document
offsets and hash words, shingles or byte windows with NumPy; no Python string
is made.  Hashes are polynomials modulo 2**64 over a random byte table, read
off prefix sums, and then mixed.  Work arrays are limited by ``SLICE`` bytes of
text at a time, whatever the length of a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)
#: bytes of the white space that separates words: \x20 and \x09-\x0D
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
#: bytes that are not part of an alphanumeric word: ASCII other than 0-9 A-Z a-z
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = False
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x41:0x5B] = NOT_ALNUM[0x61:0x7B] = False


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, and powers of the base and of its inverse."""
    rng = np.random.default_rng(20240229)
    values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = 2 * SLICE + 2
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return values, np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def _lower_values() -> np.ndarray:
    values = tables()[0].copy()
    values[0x41:0x5B] = values[0x61:0x7B]
    return values


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    values, up, _ = tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:len(data)], out=sums[1:])
    return sums


def window_hashes(sums: np.ndarray, start, stop) -> np.ndarray:
    """Hash of the bytes from ``start`` to ``stop`` (arrays of positions)."""
    return mix((sums[stop] - sums[start]) * tables()[2][start])


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and its n + 1 document offsets (null: empty)."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = pc.fill_null(arr.cast(pa.large_binary()) if not pa.types.is_large_binary(arr.type) else arr, b"")
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64)[arr.offset:arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes each, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def words(data: np.ndarray, edges: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words; none crosses a document's edge."""
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    e = edges[edges < len(data)]
    first[e] = inside[e]
    e = edges[edges > 0] - 1
    last[e] = inside[e]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hash_words(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, up, down = tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_lower_values()[data] * up[:len(data)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start])


def _long_words(data: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Word hashes of one document of any length, slice by slice, cut after a
    separator.  A word that fills a whole slice is hashed piece by piece."""
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(at + SLICE, n)
        gaps = np.flatnonzero(separators[data[at:end]])
        if len(gaps) == 0 and end - at == SLICE:
            h, more = np.zeros(1, np.uint64), True
            while more and at < n:
                piece = data[at:at + SLICE]
                gaps = np.flatnonzero(separators[piece])
                more, piece = not len(gaps), piece[:gaps[0]] if len(gaps) else piece
                if len(piece):
                    h = mix(h * _SHINGLE + _hash_words(piece, np.array([0]), np.array([len(piece)])))
                at += len(piece)
            out.append(h)
            continue
        if end < n:
            end = at + int(gaps[-1]) + 1
        piece = data[at:end]
        out.append(_hash_words(piece, *words(piece, np.array([0]), separators)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges ``i, j`` of documents: the hashes of their words (A-Z taken as
    a-z) in order, and for each word its document, counted from ``i``."""
    for i, j in chunks(offsets):
        piece = data[offsets[i]:offsets[j]]
        if j - i == 1 and len(piece) >= SLICE:
            h = _long_words(piece, separators)
            yield i, j, h, np.zeros(len(h), np.int64)
            continue
        edges = offsets[i:j + 1] - offsets[i]
        start, stop = words(piece, edges, separators)
        yield i, j, _hash_words(piece, start, stop), np.searchsorted(edges, start, "right") - 1


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words within each document, the document of
    each, and the number of words per document.  A document of fewer words has
    one shingle: the whole sequence."""
    n_words = np.bincount(doc, minlength=n_docs)
    m = max(0, len(h) - width + 1)
    rolled = np.zeros(m, np.uint64)
    for k in range(width):
        rolled = rolled * _SHINGLE + h[k:k + m]
    whole = doc[:m] == doc[width - 1:width - 1 + m] if m else np.zeros(0, bool)
    out, of = mix(rolled[whole] + np.uint64(width)), doc[:m][whole]
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(n_words)[:-1]])
        extra = np.empty(len(short), np.uint64)
        for k, d in enumerate(short):
            v = np.zeros(1, np.uint64)
            for x in h[begin[d]:begin[d] + n_words[d]]:
                v = v * _SHINGLE + x
            extra[k] = mix(v + np.uint64(n_words[d]))[0]
        out, of = np.concatenate([out, extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of, n_words


def shingle_sets(column, separators: np.ndarray, width: int = 5) -> Iterator[tuple[int, np.ndarray, int]]:
    """For each document of a text column: its row, the sorted distinct
    shingle hashes and the number of words."""
    data, offsets = text_bytes(column)
    for i, j, h, doc in word_hashes(data, offsets, separators):
        s, of, n_words = shingles(h, doc, j - i, width)
        cut = np.searchsorted(of, np.arange(j - i + 1))
        for d in range(j - i):
            yield i + d, np.unique(s[cut[d]:cut[d + 1]]), int(n_words[d])


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
         for c, f in zip(columns, schema, strict=True)], schema=schema)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the sizes of its lists."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
