"""Byte-level BPE encoding and decoding with padded NumPy matrices.

A text is cut by the vocabulary's pattern, and each match (a *piece*) is encoded
by itself: a piece that is a token is that token; any other starts as its bytes
and merges, again and again, the leftmost of its adjacent pairs whose joined
bytes have the lowest rank, until no pair has one.

Distinct pieces are dealt to buckets by length.  A bucket is one matrix, a row a
piece, padded on the right, with a second matrix of the ranks of its adjacent
pairs.  Each round merges one pair in every row: ``argmin`` finds the leftmost
lowest rank, the column behind it is squeezed out, the two ranks beside the new
token are looked up, and rows without a mergeable pair leave the matrix.  Pairs
are looked up in an open hash table of token ids, built from every split of
every token into two tokens.  Pieces of more than ``LONGEST_ROW`` bytes would
need as many rounds as they have bytes; they merge in the same order through a
heap, so that a text without any space costs n log n.

Texts are first cut at spaces between two characters that are not white space,
where the pattern always starts a new piece; these words and the pieces that
they are split into are kept with their ids per worker, up to ``KEPT_STRINGS``
of each and ``KEPT_BYTES`` bytes, and then dropped.  Texts are taken ``CHUNK``
bytes at a time.  Nothing moves between rows: both operators are one pass without a
shuffle.

Cases: null and empty texts have no ids and decode to no bytes; null ids decode
as no ids; a null or unknown id in ``ids`` is an error; repeated rows are
encoded per row; an empty table gives an empty result; input columns named like
an output are replaced, others are kept.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Sequence
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import chunks, text_bytes
from .common import kept, without

CHUNK = 1 << 20
LONGEST_ROW = 512
KEPT_STRINGS = 300_000
KEPT_BYTES = 1 << 24
NONE = np.int32(np.iinfo(np.int32).max)
PAD = -1
#: bytes that UTF-8 never holds: where a text is cut into words, before a first word
CUT, SEPARATOR, FIRST = 0xFF, b"\xff", b"\xfe"
#: fixed values: white space of more than one byte, by first byte
WIDE_WHITE = {0xC2: [b"\xc2\x85", b"\xc2\xa0"], 0xE1: [b"\xe1\x9a\x80"],
              0xE2: [*(chr(c).encode() for c in range(0x2000, 0x200B)), "\u2028".encode(), "\u2029".encode(),
                     "\u202f".encode(), "\u205f".encode()],
              0xE3: ["\u3000".encode()]}

#: Ranges of letters and numbers newer than the Unicode tables of
#: the tokenizer library, which takes them as other characters.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F))
#: a character that is neither letter, number nor white space, now and later
OTHER = "\ue000"


class Vocabulary:
    """Token ids, the bytes of each, and the hash table of mergeable pairs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(n) for token, n in map(bytes.split, f)}
        n = max(self.rank.values()) + 1
        tokens = [b""] * n
        for token, i in self.rank.items():
            tokens[i] = token
        self.known = np.zeros(n, bool)
        self.known[list(self.rank.values())] = True
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_ids = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self._pairs()

    def _pairs(self) -> None:
        get, left, right, joined = self.rank.get, [], [], []
        for token, i in self.rank.items():
            for k in range(1, len(token)):
                a = get(token[:k])
                if a is not None and (b := get(token[k:])) is not None:
                    left.append(a)
                    right.append(b)
                    joined.append(i)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        self.bits = max(4, int(np.ceil(np.log2(3 * len(keys) + 1))))
        self.mask = (1 << self.bits) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # in every round, each free slot takes one of the keys that want it
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = keys[free]
            self.values[slot[free]] = np.array(joined, np.int32)[free]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, ``NONE`` where there is no such token or padding."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        out = np.full(keys.shape, NONE, np.int32)
        flat, found = keys.ravel(), out.ravel()
        todo = np.flatnonzero(((a >= 0) & (b >= 0)).ravel())
        slot = self._slot(flat[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == flat[todo]
            found[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return found.reshape(keys.shape)


def merge_matrix(vocabulary: Vocabulary, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """All merges of a padded matrix of token ids: (row numbers, their final
    matrix) for the rows that end in the same round."""
    out, at = [], np.arange(len(rows))
    ranks = vocabulary.pair_ranks(rows[:, :-1], rows[:, 1:])
    while rows.shape[1] > 1:
        width = rows.shape[1]
        best = ranks.argmin(1)
        low = ranks[np.arange(len(at)), best]
        live = low != NONE
        if not live.all():  # compaction: finished rows leave the matrix
            out.append((at[~live], rows[~live]))
            at, rows, ranks, best, low = at[live], rows[live], ranks[live], best[live], low[live]
        if not len(at):
            return out
        line = np.arange(len(at))
        rows[line, best] = low
        keep = np.ones(rows.shape, bool)
        keep[line, best + 1] = False
        rows = rows[keep].reshape(len(at), width - 1)
        keep = np.ones(ranks.shape, bool)
        keep[line, best] = False
        ranks = ranks[keep].reshape(len(at), width - 2)
        has = np.flatnonzero(best > 0)
        ranks[has, best[has] - 1] = vocabulary.pair_ranks(rows[has, best[has] - 1], rows[has, best[has]])
        has = np.flatnonzero(best < width - 2)
        ranks[has, best[has]] = vocabulary.pair_ranks(rows[has, best[has]], rows[has, best[has] + 1])
    return [*out, (at, rows)]


def merge_long(vocabulary: Vocabulary, piece: bytes) -> np.ndarray:
    """The same merges of one long piece, through a heap of (rank, place)."""
    ids = vocabulary.byte_ids[np.frombuffer(piece, np.uint8)]
    ranks = vocabulary.pair_ranks(ids[:-1], ids[1:])
    at = np.flatnonzero(ranks != NONE)
    heap = [(r, i) for r, i in zip(ranks[at].tolist(), at.tolist())]
    heapq.heapify(heap)
    token = [piece[i:i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
    get, n = vocabulary.rank.get, len(piece)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i] if token[i] else n
        if j >= n or get(token[i] + token[j]) != r:
            continue  # one side has merged since
        token[i] += token[j]
        token[j] = b""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get(token[i] + token[k])) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := get(token[h] + token[i])) is not None:
            heapq.heappush(heap, (r, h))
    return np.array([vocabulary.rank[t] for t in token if t], np.int32)


def gathered(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions ``start[k] .. start[k] + size[k] - 1`` for all k in turn."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)


def encode_pieces(vocabulary: Vocabulary, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces end to end, and the number of ids of each."""
    whole = np.fromiter((vocabulary.rank.get(p, PAD) for p in pieces), np.int32, len(pieces))
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    size = (whole != PAD).astype(np.int64)
    at = np.flatnonzero(whole != PAD)
    parts = [(at, size[at], whole[at])]
    rest = np.flatnonzero((whole == PAD) & (length > 0))
    for k in rest[length[rest] > LONGEST_ROW].tolist():
        ids = merge_long(vocabulary, pieces[k])
        parts.append((np.array([k]), np.array([len(ids)]), ids))
    rest = rest[length[rest] <= LONGEST_ROW]
    bits = np.log2(np.maximum(length[rest], 1)).astype(np.int64)
    step = 1 << np.maximum(0, bits - 2)  # rows of a bucket differ by under a quarter of its width
    bucket = -(-length[rest] // step) * step
    for width in np.unique(bucket).tolist():
        members, most = rest[bucket == width], max(1, CHUNK // (4 * width))
        for some in (members[a:a + most] for a in range(0, len(members), most)):
            inside = np.arange(width) < length[some, None]
            rows = np.full(inside.shape, PAD, np.int32)
            rows[inside] = vocabulary.byte_ids[np.frombuffer(b"".join([pieces[k] for k in some.tolist()]), np.uint8)]
            for done, ids in merge_matrix(vocabulary, rows):
                used = ids != PAD
                parts.append((some[done], used.sum(1), ids[used]))
    for members, sizes, _ in parts:
        size[members] = sizes
    start = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.int32)
    for members, sizes, ids in parts:
        flat[gathered(start[members], sizes)] = ids
    return flat, size


class Store:
    """A worker's encoded strings: a number for each, and their ids end to end."""

    def __init__(self, encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.number: dict = {}
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.held = 0

    def look_up(self, strings: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings end to end, and the number of ids of each."""
        if len(self.number) > KEPT_STRINGS or self.held > KEPT_BYTES:
            self.clear()
        number = list(map(self.number.get, strings))
        if None in number:
            new = list(dict.fromkeys(s for s, n in zip(strings, number) if n is None))
            ids, size = self.encode(new)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, ids])
            self.held += sum(map(len, new))
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            number = list(map(self.number.__getitem__, strings))
        at = np.array(number, np.int64)
        size = self.size[at]
        return self.ids[gathered(self.start[at], size)], size


class Splitter:
    """The vocabulary's pattern, with characters that the library does not know
    as letters or numbers taken as others."""

    def __init__(self, pattern: str):
        import regex

        self.pieces = regex.compile(pattern).findall
        ranges = "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER)
        self.newer = re.compile(f"[{ranges}]")

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self.newer.search(text):
            return self.pieces(text)
        ends = accumulate(map(len, self.pieces(self.newer.sub(OTHER, text))), initial=0)
        return [text[a:b] for a, b in pairwise(ends)]


def white_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a white-space character (of any length)."""
    white = (data == 0x20) | ((data >= 9) & (data <= 13))
    for lead in WIDE_WHITE:
        for char in WIDE_WHITE[lead]:
            n = len(char)
            first = np.flatnonzero(data[:len(data) - n + 1] == lead)
            for k in range(1, n):
                first = first[data[first + k] == char[k]]
            for k in range(n):
                white[first + k] = True
    return white


def words_of(data: np.ndarray) -> bytearray:
    """The bytes with ``CUT`` for each space between two characters that are
    not white space.  A piece starts at every such space: the pattern has a
    space only as a piece's first character, and longer runs of white space
    only by themselves."""
    out = bytearray(data)
    lone = np.flatnonzero(data == 0x20)
    lone = lone[(lone > 0) & (lone < len(data) - 1)]
    white = white_bytes(data)
    np.frombuffer(out, np.uint8)[lone[~(white[lone - 1] | white[lone + 1])]] = CUT
    return out


class Encoder:
    """Encodes texts with all that a worker keeps: words, which are looked up
    first, and pieces, into which a new word is split."""

    def __init__(self, ranks: str, pattern: str):
        self.vocabulary, self.split = Vocabulary(ranks), Splitter(pattern)
        self.pieces = Store(lambda pieces: encode_pieces(self.vocabulary, [p.encode() for p in pieces]))
        self.words = Store(self._words)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        every, counts = [], []
        for w in words:  # a text's first word is marked, any other has a space before it
            some = self.split(w[1:].decode() if w[:1] == FIRST else " " + w.decode())
            every += some
            counts.append(len(some))
        ids, size = self.pieces.look_up(every)
        return ids, _sums(size, counts)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie end to end in ``data``, and how many each has."""
        every, counts = [], []
        base = offsets[0]
        raw = words_of(data[base:offsets[-1]])
        for a, b in pairwise((offsets - base).tolist()):
            if b > a and raw[a] == CUT:  # this space has a text before it, but not its own
                raw[a] = 0x20
            if b > a and raw[b - 1] == CUT:
                raw[b - 1] = 0x20
            some = raw[a:b].split(SEPARATOR)
            every += map(bytes, some)
            every[-len(some)] = FIRST + every[-len(some)]
            counts.append(len(some))
        ids, size = self.words.look_up(every)
        return ids, _sums(size, counts)


def _sums(size: np.ndarray, counts: list[int]) -> np.ndarray:
    """Sums of ``counts[0]`` values, the next ``counts[1]`` and so on."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return np.diff(ends[np.cumsum([0, *counts])])


def _others(df: DataFrame, column: str, *outputs: str) -> tuple[DataFrame, int, list[int]]:
    df = without(df, *(o for o in outputs if o.lower() != column.lower()))
    at = [c.lower() for c in df.columns].index(column.lower())
    return df, at, [i for i in range(len(df.columns)) if i != at]


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` less the text, plus ``ids`` (array of int), ``n_tokens`` and
    ``ids_sha256``, the digest of the ids as little-endian 32-bit integers.
    ``ranks`` is the place of the rank file, on every machine."""
    df, at, others = _others(docs, text, "ids", "n_tokens", "ids_sha256")
    schema = T.StructType([*(df.schema.fields[i] for i in others), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType())])

    def run(batches):
        encoder = kept(f"byte-bpe {ranks} {pattern}", lambda: Encoder(ranks, pattern))
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            for i, j in chunks(offsets, CHUNK):
                ids, sizes = encoder(data, offsets[i:j + 1])
                ends = np.cumsum(np.concatenate([[0], sizes])).astype(np.int32)
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                digests = [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in others),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(sizes.astype(np.int64)),
                     pa.array(digests, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """``df`` less the ids, plus ``decoded``, the bytes of the tokens end to
    end.  Ids cut inside a character decode to bytes that are not UTF-8, so the
    result is binary; cast it to string where the ids are whole."""
    df, at, others = _others(df, ids, "decoded")
    schema = T.StructType([*(df.schema.fields[i] for i in others), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        vocabulary = kept(f"byte-bpe tokens {ranks}", lambda: Vocabulary(ranks))
        for batch in batches:
            column = batch.column(at)
            given = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(given)])
            flat = column.flatten()  # null lists have no values here
            if flat.null_count:
                raise ValueError("ids holds a null")
            flat = flat.to_numpy(zero_copy_only=False)
            if len(flat) and not (flat.min() >= 0 and flat.max() < len(vocabulary.known) and vocabulary.known[flat].all()):
                raise ValueError("ids holds an id that is not in the vocabulary")
            for i, j in chunks(edges, CHUNK):
                some = flat[edges[i]:edges[j]]
                size = vocabulary.sizes[some]
                out = vocabulary.bytes[gathered(vocabulary.starts[some], size)]
                ends = np.concatenate([[0], np.cumsum(size)])[edges[i:j + 1] - edges[i]]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in others),
                     pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.astype(np.int32).tobytes()),
                                                                pa.py_buffer(out.tobytes())])], names=schema.names)

    return df.mapInArrow(run, schema)
