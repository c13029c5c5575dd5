"""Language identification by segmentation-marginalised unigrams.

A language is a unigram distribution over the pieces of a fixed public
vocabulary.  The probability of a word is the sum, over every way to segment
it into pieces, of the product of the pieces' probabilities; a forward pass
over the word's characters gives it.  A text's likelihood is the product over
its words (no piece spans white space, so this is the sum over all
segmentations of the text), and the prediction is the language with the
largest posterior.

Training counts, per language, the pieces of the one segmentation that the
public tokenizer gives the words of all labelled texts (not expected counts over
all segmentations), smoothed with ``ALPHA`` per piece; characters outside the vocabulary share one rate.  Word counts
are summed before they shuffle, each word is segmented once per language, and
what reaches the driver is one table of languages by pieces (32,000 rows per
language), whatever the input size.

Cases: null texts and texts without a letter are ``und`` with score 0;
without any labelled text everything is ``und``; ties go to the language that
sorts first; labels that are null are not learnt; repeated rows count as often
as they occur in training; input columns named like an output are replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import chunks, mix, text_bytes
from .common import drop_kept, kept, without

ALPHA = 0.01
MARK = "▁"
UNKNOWN_RATE = 1e-7  # share of a language's probability for one unknown character
MAX_WORD = 32  # longer words are scored one by one, shorter ones side by side
BLOCK = 1 << 15  # characters of a long word whose pieces are looked up at once
CACHE_WORDS = 300_000
REJECT_BELOW = 0.5
_POWERS = np.multiply.accumulate(np.array([1] + [0x9E3779B97F4A7C15] * (2 * MAX_WORD), np.uint64))


def _texts(column: pa.Array, limit: int = 4 << 20):
    """Row ranges of about ``limit`` bytes with their texts (null: empty)."""
    _, offsets = text_bytes(column)
    for i, j in chunks(offsets, limit):
        yield i, j, [t or "" for t in column.slice(i, j - i).to_pylist()]


def piece_counts(labelled: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, piece, n) over the whole labelled table."""

    def words(batches):
        drop_kept()
        for batch in batches:
            for i, j, texts in _texts(batch.column(1)):
                counts: dict[str, Counter] = {}
                for k, t in zip(batch.column(0).slice(i, j - i).to_pylist(), texts):
                    counts.setdefault(k, Counter()).update(t.split())
                rows = [(k, w, n) for k, c in counts.items() for w, n in c.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))],
                        names=["lang", "word", "n"])

    def pieces(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        for batch in batches:
            counts: Counter = Counter()
            langs, ns = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            found = sp.encode(batch.column(1).to_pylist(), out_type=str, num_threads=1)
            for k, n, ps in zip(langs, ns, found):
                for p in ps:
                    counts[k, p] += n
            rows = [(k, p, n) for (k, p), n in counts.items()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))],
                    names=["lang", "piece", "n"])

    rows = labelled.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    by_word = rows.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")) \
        .mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return by_word.mapInArrow(pieces, "lang string, piece string, n long") \
        .groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Model:
    """Per-language piece probabilities; bounded by languages x vocabulary."""

    def __init__(self, counts: list[tuple[str, str, int]], vocabulary: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
                      if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.langs = sorted({k for k, _, _ in counts})
        self.version = uuid.uuid4().hex
        rows = {p: i for i, p in enumerate(self.names)}
        table = np.full((len(self.names), len(self.langs)), ALPHA)
        at = {k: i for i, k in enumerate(self.langs)}
        for k, p, n in counts:
            if p in rows:
                table[rows[p], at[k]] += n
        table *= (1 - UNKNOWN_RATE) / table.sum(0)
        self.table, self.longest = table, max(map(len, self.names))
        # pieces by hash, behind a first look at 20 of its bits
        hashes = np.array([_string_hashes(_code_points([p]))[0, -1] for p in self.names], np.uint64)
        self.row = np.argsort(mix(hashes))
        self.hashes = mix(hashes)[self.row]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashed strings are pieces, and their rows."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        hit = self.hashes[place] == hashes[at]
        return at[hit], self.row[place[hit]]

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probabilities of words per language: the forward algorithm, side
        by side over words of equal length, long words each by itself."""
        out = np.zeros((len(words), len(self.langs)))
        lengths = np.array([len(w) for w in words])
        for k in np.flatnonzero(lengths > MAX_WORD).tolist():
            out[k] = self._long(MARK + words[k])
        for n in np.unique(lengths[lengths <= MAX_WORD]):
            same = np.flatnonzero(lengths == n)
            for k in range(0, len(same), 20_000):
                some = same[k:k + 20_000]
                out[some] = self._forward([MARK + words[i] for i in some])
        return out

    def _forward(self, words: list[str]) -> np.ndarray:
        sums = _string_hashes(_code_points(words))
        n, forward = sums.shape[1] - 1, [np.ones((len(words), len(self.langs)))]
        for end in range(1, n + 1):
            total = np.zeros_like(forward[0])
            for begin in range(max(0, end - self.longest), end):
                hashes = mix(sums[:, end] - sums[:, begin] * _POWERS[end - begin])
                at, row = self.find(hashes)
                total[at] += forward[begin][at] * self.table[row]
                if end - begin == 1:
                    unknown = np.ones(len(words), bool)
                    unknown[at] = False
                    total[unknown] += forward[begin][unknown] * UNKNOWN_RATE
            forward.append(total)
        return np.log(np.maximum(forward[n], 1e-320))


    def _long(self, word: str) -> np.ndarray:
        """The same for one word of any length: the last ``longest`` columns are
        kept, and scaled for each language as they become small."""
        points, scale = _code_points([word])[0], np.zeros(len(self.langs))
        kept_columns = np.zeros((self.longest, len(self.langs)))
        kept_columns[-1] = 1
        for a in range(0, len(points), BLOCK):
            b, before = min(len(points), a + BLOCK), min(a, self.longest - 1)
            some = points[a - before:b]
            hashes, ends, begins, rows = np.zeros(len(some), np.uint64), [], [], []
            for d in range(1, min(self.longest, len(some)) + 1):  # strings of d characters
                hashes = hashes[:len(some) - d + 1] * _POWERS[1] + some[d - 1:] + np.uint64(1)
                at, row = self.find(mix(hashes))
                inside = at + d > before
                ends.append(at[inside] + d - before)
                begins.append(at[inside] - before + self.longest)
                rows.append(row[inside])
            ends, begins, rows = (np.concatenate(x) for x in (ends, begins, rows))
            order = np.argsort(ends, kind="stable")
            begins, rows = begins[order], rows[order]
            cut = np.searchsorted(ends[order], np.arange(1, b - a + 2))
            columns = np.concatenate([kept_columns, np.zeros((b - a, len(self.langs)))])  # column of place k: k + longest - 1
            for k in range(1, b - a + 1):
                from_, row = begins[cut[k - 1]:cut[k]] - 1, rows[cut[k - 1]:cut[k]]
                here = k + self.longest - 1
                total = (columns[from_] * self.table[row]).sum(0)
                if not (from_ == here - 1).any():
                    total += columns[here - 1] * UNKNOWN_RATE
                columns[here] = total
                if k % 8 == 0 or k == b - a:
                    factor = np.maximum(total, 1e-300)
                    columns[max(0, here - self.longest):here + 1] /= factor
                    scale += np.log(factor)
            kept_columns = columns[-self.longest:]
        return scale + np.log(np.maximum(kept_columns[-1], 1e-320))


def _code_points(words: list[str]) -> np.ndarray:
    """Words of equal length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def _string_hashes(points: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes, from the empty one on."""
    out = np.zeros((len(points), points.shape[1] + 1), np.uint64)
    for k in range(points.shape[1]):
        out[:, k + 1] = out[:, k] * _POWERS[1] + points[:, k] + np.uint64(1)
    return out


def train(labelled: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang") -> Model:
    """The fitted model.  What is collected is at most the vocabulary per language."""
    return Model([tuple(r) for r in piece_counts(labelled, vocabulary, text, lang).collect()], vocabulary)


class _Scorer:
    """Rows of word log-probabilities, filled as words are met."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((CACHE_WORDS, len(model.langs)))

    def learn(self, words: list[str]) -> None:
        new = list(set(words) - self.rows.keys())
        if len(self.rows) + len(new) > len(self.table):
            self.rows.clear()
            new = list(set(words))
            if len(new) > len(self.table):
                self.table = np.zeros((len(new), self.table.shape[1]))
        sums = self.model.words(new)
        self.table[len(self.rows):len(self.rows) + len(new)] = sums
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))

    def texts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.model.langs)))
        split = [t.split() for t in texts]
        sizes = np.array([len(s) for s in split])
        flat = [w for s in split for w in s]
        if flat:
            try:
                ids = np.fromiter(map(self.rows.__getitem__, flat), np.int64, len(flat))
            except KeyError:
                self.learn(flat)
                ids = np.fromiter(map(self.rows.__getitem__, flat), np.int64, len(flat))
            out[sizes > 0] = np.add.reduceat(self.table[ids], (np.cumsum(sizes) - sizes)[sizes > 0])
        return out


def _scorer(model: Model) -> _Scorer:
    """The scorer of a worker process, kept from task to task for one model."""
    return kept(f"language_id {model.version}", lambda: _Scorer(model))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) plus ``lang_pred`` and
    ``score`` (posterior, equal priors)."""
    df = without(docs, "lang_pred", "score")
    keep = [k for k, c in enumerate(df.columns) if keep is None or c in keep]
    schema = T.StructType([*(df.schema.fields[k] for k in keep), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    at = [c.lower() for c in df.columns].index(text.lower())
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x vocabulary

    def run(batches):
        m = shared.value
        scorer = _scorer(m) if m.langs else None
        for batch in batches:
            for i, j, texts in _texts(batch.column(at)):
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                if scorer:
                    ll = scorer.texts(texts)
                    best = ll.argmax(1)
                    post = 1.0 / np.exp(ll - ll[np.arange(len(ll)), best][:, None]).sum(1)
                    for k, t in enumerate(texts):
                        if has_letter(t):
                            langs[k], scores[k] = m.langs[best[k]], float(post[k])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, j - i) for k in keep), pa.array(langs, pa.string()),
                     pa.array(scores, pa.float64())], names=schema.names)

    return df.mapInArrow(run, schema)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(key):
    """True for the documents whose labels are never learnt from."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
             lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Train on the labelled documents outside the held-out third, predict all."""
    learn = docs.where(~F.coalesce(held_out(F.col(f"`{key}`")), F.lit(False)))
    return predict(docs, train(learn, vocabulary, text, lang), text, keep)


def accepted(identified: DataFrame) -> DataFrame:
    """The documents that language identification does not reject: those in a
    learnt language whose posterior is at least ``REJECT_BELOW``."""
    return identified.where((F.col("lang_pred") != "und") & (F.col("score") >= REJECT_BELOW))
