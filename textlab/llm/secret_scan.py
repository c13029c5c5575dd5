"""Secret scans: fixed patterns and a likelihood ratio of two Markov models.

Base kinds are patterns (``BASE``), each matched leftmost and non-overlapping
over the whole text, with matches under the kind's least length dropped.

The method adds the kind ``markov``: stretches of ``[A-Za-z0-9+/_=-]``, of any
length and outside the base spans (a stretch that one cuts is scored in parts),
whose first-order character model of random strings gives them a higher
log-likelihood than the model of ordinary identifiers, by at least ``PER_CHAR``
per character and ``EVIDENCE`` in all.  Both models are trained on labelled
samples from the table itself: the values of base matches are the random
strings, and stretches outside base spans of the same alphabet, of ``WORD`` to
``LEAST`` - 1 characters, are ordinary identifiers.  Pair frequencies are smoothed with the frequencies of
single characters.  Training counts character pairs over all
documents; what a task returns and what the driver sees is one table of pairs,
of fixed size.

Cases: null and empty texts have no span; without any labelled random string
the model of random strings is uniform; ties in start go by the order of
kinds; repeated rows are scanned per row; an empty table gives an empty
result; input columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import chunks, text_bytes, words
from .common import without

#: fixed values: kind, pattern, group whose length counts, least length
BASE = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
KINDS = [k for k, *_ in BASE] + ["markov"]
#: words one of which every ``assign`` match holds, for a quick look
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
LEAST = 16
WORD = 3
PER_CHAR = 1.0
EVIDENCE = 24.0
BACKOFF = 5.0  # weight of single characters in a pair's frequency, in counts
#: a run of its alphabet that reaches the least length; the same spans as the pattern with its least length
_ASSIGN = re.compile(BASE[0][1], re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(BASE[1][1])
_HEX = re.compile(r"[0-9a-f]{24,}")
CHARACTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
START = len(CHARACTERS)  # the mark before a stretch
SIZE = (START + 1) ** 2
_CODE = np.zeros(256, np.int64)
_CODE[list(CHARACTERS)] = np.arange(START)
_NOT_WORD = np.ones(256, bool)
_NOT_WORD[list(CHARACTERS)] = False


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base matches, sorted."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= BASE[0][3]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= BASE[1][3]]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def _secret_value(text: str, span: tuple[int, int, int]) -> str:
    start, end, kind = span
    return _ASSIGN.match(text, start).group(2) if kind == 0 else text[start:end]


def pairs(stretch: str) -> np.ndarray:
    """Codes of the character pairs, the first with the start mark."""
    c = _CODE[np.frombuffer(stretch.encode("ascii"), np.uint8)]
    return np.concatenate([[START], c[:-1]]) * (START + 1) + c


def _outside(column: pa.Array, i: int, j: int, offsets: np.ndarray, data: np.ndarray):
    """Texts ``i`` to ``j``, their base spans, and their bytes with those spans
    blanked, with the texts' edges."""
    texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
    base = [base_spans(t) for t in texts]
    edges = offsets[i:j + 1] - offsets[i]
    left = data[offsets[i]:offsets[j]].copy()
    for k, (t, spans) in enumerate(zip(texts, base)):
        if spans:
            ascii_only = edges[k + 1] - edges[k] == len(t)
            for a, b, _ in spans:
                if not ascii_only:
                    a, b = (len(t[:x].encode()) for x in (a, b))
                left[edges[k] + a:edges[k] + b] = 0x20
    return texts, base, left, edges


def _stretch_pairs(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the stretches of some texts and the pair codes of all."""
    start, stop = words(data, edges, _NOT_WORD)
    sizes = stop - start
    begin = np.cumsum(sizes) - sizes
    c = _CODE[data[np.repeat(start - begin, sizes) + np.arange(sizes.sum())]]
    before = np.concatenate([[START], c[:-1]]) if len(c) else c
    before[begin] = START
    return start, sizes, before * (START + 1) + c


def _ordinary(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Pair counts of the ordinary identifiers in the bytes of some texts."""
    _, sizes, codes = _stretch_pairs(data, edges)
    return np.bincount(codes[np.repeat((sizes >= WORD) & (sizes < LEAST), sizes)], minlength=SIZE)


def pair_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(model, pair, n): model 1 random strings, 0 ordinary identifiers."""

    def count(batches):
        total = np.zeros((2, SIZE), np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in chunks(offsets, 1 << 20):
                texts, base, left, edges = _outside(batch.column(0), i, j, offsets, data)
                total[0] += _ordinary(left, edges)
                for t, spans in zip(texts, base):
                    for span in spans:
                        value = re.sub(r"[^A-Za-z0-9+/_=-]", "", _secret_value(t, span))
                        if len(value) >= LEAST:
                            np.add.at(total[1], pairs(value), 1)
        for m in (0, 1):
            at = np.flatnonzero(total[m])
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), m, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[m][at])],
                    names=["model", "pair", "n"])

    return docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(count, "model int, pair int, n long") \
        .groupBy("model", "pair").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratio of each character pair, random against ordinary."""
    counts = np.zeros((2, SIZE))
    for m, pair, n in pair_counts(docs, text).collect():  # two fixed tables
        counts[m, pair] = n
    logs = []
    for table in counts.reshape(2, START + 1, START + 1)[:, :, :START]:
        single = table.sum(0) + 0.5
        table = table + BACKOFF * single / single.sum()
        logs.append(np.log(table / table.sum(1, keepdims=True)))
    ratio = np.zeros((START + 1, START + 1))
    ratio[:, :START] = logs[1] - logs[0]
    return ratio.ravel()


def _markov(left: np.ndarray, edges: np.ndarray, ratio: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) in bytes of the stretches that are more likely random."""
    start, sizes, codes = _stretch_pairs(left, edges)
    if not len(sizes):
        return []
    sums = np.add.reduceat(ratio[codes], np.cumsum(sizes) - sizes)
    at = np.flatnonzero((sums >= EVIDENCE) & (sums >= PER_CHAR * sizes))
    owner = np.searchsorted(edges, start[at], "right") - 1
    return list(zip(owner.tolist(), (start[at] - edges[owner]).tolist(), (start[at] + sizes[at] - edges[owner]).tolist()))


def markov_spans(text: str, base: list[tuple[int, int, int]], ratio: np.ndarray) -> list[tuple[int, int, int]]:
    """The added spans of one text, in code points."""
    raw = np.frombuffer(text.encode(), np.uint8).copy()
    for a, b, _ in base:
        raw[len(text[:a].encode()):len(text[:b].encode())] = 0x20
    return _in_code_points(text, [(a, b) for _, a, b in _markov(raw, np.array([0, len(raw)]), ratio)])


def _in_code_points(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    if text.isascii():
        return [(a, b, 3) for a, b in spans]
    raw = text.encode()
    return [(x := len(raw[:a].decode()), x + b - a, 3) for a, b in spans]  # a stretch is ASCII


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, text: str = "text", ratio: np.ndarray | None = None) -> DataFrame:
    """``docs`` less the text, plus counts, digest and spans; the models are
    trained on ``docs`` unless given."""
    df = without(docs, "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans")
    ratio = train(docs, text) if ratio is None else ratio
    at = [c.lower() for c in df.columns].index(text.lower())
    others = [i for i in range(len(df.columns)) if i != at]
    schema = T.StructType([*(df.schema.fields[i] for i in others),
                           *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    shared = df.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        ratio = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            for i, j in chunks(offsets, 1 << 20):
                rows, found = [], {}
                texts, bases, left, edges = _outside(batch.column(at), i, j, offsets, data)
                for k, a, b in _markov(left, edges, ratio):
                    found.setdefault(k, []).append((a, b))
                for k, (t, base) in enumerate(zip(texts, bases)):
                    every = sorted(base + _in_code_points(t, found.get(k, [])), key=lambda s: (s[0], s[2]))
                    n = [sum(k == x for _, _, k in every) for x in range(4)]
                    rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in others), *(pa.array(c, pa.int64()) for c in cols[:4]),
                     *(pa.array(c, pa.string()) for c in cols[4:])], names=schema.names)

    return df.mapInArrow(run, schema)
