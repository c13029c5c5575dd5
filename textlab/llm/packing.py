"""Packing documents into sequences by best-fit decreasing.

A document's ids are those of a public tokenizer plus one end id.  A document
longer than a window is first cut into full windows; the rest of every
document (shorter than a window) is packed by best-fit decreasing: the pieces
come longest first and each goes to the open window with the least remaining
room that still holds it, found by a segment tree over the remaining room.

Pieces are dealt by hash to independent groups of about ``GROUP_TOKENS``
tokens and at most about ``GROUP_PIECES`` pieces, so a task's work and memory
are bounded at every input size, and the loss against one global packing is at
most one window's padding a group.  Token ids are made in one pass over the
texts; only lengths, positions and checksums (or, when asked, the ids) go on.

Cases: null and empty texts are the end id alone; a repeated row is packed
once per row; a null doc_id stays null; an empty table gives no piece; ties in
length go by doc_id, start; other columns are ignored.  A sequence is meant to
be padded to the window except when its length is a power of two; padding is
not stored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, materialise

WINDOW = 4096
END_ID = 2
GROUP_TOKENS = 8 << 20
GROUP_PIECES = 200_000
CACHE_WORDS = 1_000_000  # of about 200 bytes each, in every worker
#: texts are split here before the tokenizer sees them: it drops white space
#: and none of its tokens, special ones included, holds any
_GAP = re.compile("[ \t\n\r]+")
#: marks that are one piece behind letters, whatever they are (an apostrophe may start an ending)
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: white space to Python, not to the tokenizer
_SEPARATORS = "\x1c\x1d\x1e\x1f"


class WordIds(dict):
    """Ids, as little-endian uint32 bytes, of stretches without white space.

    The tokenizer drops white space and never joins what white space parts, so
    a text's ids are those of its stretches in order.  Stretches not seen
    before are encoded many at a time; the table starts anew when it is full."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.word_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.word_end[i] = token.endswith("</w>")

    def learn(self, stretches: set[str]) -> None:
        if len(self) + len(stretches) > self.limit:
            self.clear()
        words, tailed, other = [], [], []
        for s in stretches:
            if s.isalpha():
                words.append(s)
            elif (core := s.rstrip(_TAIL)).isalpha() and self.ends_in_letter(core):
                tailed.append((s, core))
            else:
                other.append(s)
        # letters only: one word each, and so one word-end token each
        # (a set less self.keys() would walk through all keys)
        words = [w for w in {*words, *(core for _, core in tailed)} if w not in self and len(w) < 100]
        for at in range(0, len(words), 500):
            some = words[at:at + 500]
            flat = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.word_end[flat]) + 1
            if len(ends) == len(some) and ends[-1] == len(flat):
                raw, cuts = flat.tobytes(), [0, *(4 * ends).tolist()]
                self.update(zip(some, map(raw.__getitem__, map(slice, cuts[:-1], cuts[1:]))))
            else:  # letters that the tokenizer's normal form takes apart
                self.encode_each(some)
        self.encode_each([w for w in stretches if w not in self and w.isalpha()] + other
                         + [c for c in {core for _, core in tailed} if c not in self])
        tails = {s[len(core):] for s, core in tailed}
        self.encode_each([t for t in tails if t not in self])
        for s, core in tailed:
            self[s] = self[core] + self[s[len(core):]]

    def ends_in_letter(self, core: str) -> bool:
        """Whether the tokenizer's form of the letters (lower case, composed) ends
        in a letter; a mark at its end would be one stretch with the tail."""
        return core.isascii() or self.tokenizer.normalizer.normalize_str(core)[-1:].isalpha()

    def encode_each(self, stretches: list[str]) -> None:
        for at in range(0, len(stretches), 1000):
            some = stretches[at:at + 1000]
            for s, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)):
                self[s] = np.array(e.ids, "<u4").tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        split = [_GAP.split(t) if any(c in t for c in _SEPARATORS) else t.split() for t in texts]
        every = set().union(*split)
        new = {s for s in every if s not in self}
        if new:
            if len(self) + len(new) > self.limit:
                new = every
            self.learn(new)
        get = self.__getitem__
        return [b"".join(map(get, s)) for s in split]


def _word_ids(path: str) -> WordIds:
    """One table per worker process and tokenizer."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept(f"packing {path}", lambda: WordIds(path))


def _blocks(texts: pa.Array, limit: int = 4 << 20):
    """Runs of rows of about ``limit`` bytes."""
    from .arrays import chunks, text_bytes

    _, offsets = text_bytes(texts)
    return chunks(offsets, limit)


def tokenised_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                     window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The documents cut into full windows and a rest, in one pass over the texts."""
    kind = docs.schema[key].dataType.simpleString()
    out = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, deal long" + \
        (", ids array<int>" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        words, deal = _word_ids(tokenizer), 0
        for batch in batches:
            for i, j in _blocks(batch.column(1)):
                keys = batch.column(0).slice(i, j - i).to_pylist()
                rows = []
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                for k, ids in zip(keys, words.texts(texts)):
                    ids += end
                    n = len(ids) // 4
                    for a in range(0, n, window):
                        piece = ids[4 * a:4 * (a + window)]
                        rows.append((k, a, len(piece) // 4, zlib.crc32(piece), n, deal)
                                    + ((np.frombuffer(piece, "<u4").astype(np.int32),) if with_ids else ()))
                        deal += 1
                cols = list(zip(*rows))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal", "ids"][:len(cols)]
                key_type = batch.schema.field(0).type
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:6]),
                     *(pa.array(c, pa.list_(pa.int32())) for c in cols[6:])], names=names)

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(cut, out)


class OpenWindows:
    """Open windows by remaining room, under a segment tree: leaf r counts the
    windows with room r, and an inner node the windows below it."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, n: int) -> None:
        node = self.size + room
        while node:
            self.tree[node] += n
            node >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.at[room].append(sequence)
        self._add(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out a window with the least room of at least ``length``."""
        node, tree = self.size + length, self.tree
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):  # up until a right sibling has one
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return room, self.at[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; ``lengths`` fall from first to last."""
    open_, out, sequences = OpenWindows(window), [], 0
    for n in lengths:
        found = open_.tightest(n)
        if found is None:
            found = window, sequences
            sequences += 1
        room, sequence = found
        out.append((sequence, window - room))
        if room > n:
            open_.put(room - n, sequence)
    return out


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; see the module's text."""
    pieces = materialise(pieces)
    total = pieces.agg(F.sum("length").alias("t"), F.count(F.lit(1)).alias("n")).first()
    groups = max(1, -(-(total["t"] or 0) // GROUP_TOKENS), -(-total["n"] // GROUP_PIECES))
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "start", "deal"), F.lit(groups)))
    fields = [f for f in dealt.schema.fields if f.name != "deal"]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    def one_group(group: pa.Table) -> pa.Table:
        by = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]
        group = group.take(pc.sort_indices(group, sort_keys=by))
        base = group["deal"][0].as_py() << 32
        placed = best_fit_decreasing(group["length"].to_pylist(), window)
        return group.drop_columns(["deal"]) \
            .append_column("sequence_id", pa.array([base + s for s, _ in placed], pa.int64())) \
            .append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return dealt.groupBy("deal").applyInArrow(one_group, out)


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                   window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Packed pieces of all documents; ``with_ids`` adds each piece's ids."""
    return pack(tokenised_pieces(docs, tokenizer, key, text, window, end_id, with_ids), window)
