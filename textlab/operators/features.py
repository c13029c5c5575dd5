"""TF-IDF features as a long table ``(doc, term, weight)``.

Weights follow the smoothed definition: raw term count × (ln((1+n)/(1+df)) + 1),
L2-normalised per document.  The vocabulary keeps terms with
``df >= min_df`` (and ``df <= max_df·n`` if given), then the ``max_features``
terms with the highest corpus frequency (ties by term).

Plan shape: Spark extracts the tokens and hands them to the tasks in Arrow
batches, which count the terms of each document in arrays; a (document, term)
row for each occurrence is never formed or shuffled.

* The fit counts single words first.  With ``max_features`` words of a corpus
  frequency of at least T, a pair of words whose words do not both reach T and
  ``min_df`` cannot be in the vocabulary, as it is no more frequent than either;
  the second pass counts the other pairs only.  Shuffled are the terms of a
  batch with their sums, added up in the task before.
* The transform looks terms up in the broadcast vocabulary (bounded by
  ``max_features``) and normalises in the task: no shuffle.  A vocabulary that
  is not bounded is joined instead.

``key`` tells documents apart.  Rows with the same key are one document; only
if there are any, the tokens are grouped by key first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import vector_unigrams

BROADCAST_VOCAB_MAX = 2_000_000
#: tokens that a task looks at together, unless one document has more
SLICE_TOKENS = 1 << 20


@dataclass
class Vocabulary:
    """Fitted vocabulary: ``terms`` has (term, df, idf)."""
    terms: DataFrame
    n_docs: int
    bounded: bool


def token_lists(docs: DataFrame, key: str, text: str, unique: bool = False) -> tuple[DataFrame, int]:
    """(key, _u) with the token arrays of each document's texts, and the number
    of rows of ``docs``.  ``unique``: the caller knows that keys do not repeat."""
    tokens = docs.select(key, vector_unigrams(text).alias("_u"))
    if unique:
        return tokens.select(key, F.array("_u").alias("_u")), docs.count()
    n, most = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    if (most or 0) > 1:
        return tokens.groupBy(key).agg(F.collect_list("_u").alias("_u")), n
    return tokens.select(key, F.array("_u").alias("_u")), n or 0


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with at most ``most`` tokens together, or one row."""
    size = lambda x: np.cumsum(pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False))
    lists = batch.column(batch.schema.get_field_index("_u"))
    tokens = np.append(0, size(lists.flatten()))[size(lists)]  # up to the end of each row
    start = 0
    while start < batch.num_rows:
        done = tokens[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(tokens, done + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class _Terms:
    """The terms of some documents: for each kind (single words, pairs) the
    numbers of document and term, and the terms by number."""

    def __init__(self, lists: pa.Array):
        texts = lists.flatten()
        flat = texts.flatten()
        coded = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).dictionary_encode()
        self.n, self.words = len(lists), coded.dictionary
        self.code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        size = lambda x: pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.text = np.repeat(np.arange(len(texts)), size(texts))
        self.doc = np.repeat(np.arange(len(lists)), size(lists))[self.text]

    def single(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        at = self.code >= 0
        return self.doc[at], self.code[at], self.words

    def pairs(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Neighbours in one text that are both ``wanted`` (by word)."""
        fits = np.append(wanted, False)[self.code]  # -1, a null token, is the last one
        at = np.flatnonzero(fits[:-1] & fits[1:] & (self.text[:-1] == self.text[1:]))
        m = max(len(self.words), 1)
        both, number = np.unique(self.code[at] * m + self.code[at + 1], return_inverse=True)
        terms = pc.binary_join_element_wise(self.words.take(pa.array(both // m)), self.words.take(pa.array(both % m)), " ")
        return self.doc[at], number, terms

    def counts(self, doc: np.ndarray, number: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, occurrences), each pair once, by document."""
        m = max(len(terms), 1)
        pair, n = np.unique(doc * m + number, return_counts=True)
        return pair // m, pair % m, n


def _is_in(words: pa.Array, some: pa.Array | None) -> np.ndarray:
    if some is None:
        return np.ones(len(words), bool)
    return pc.is_in(words, some).to_numpy(zero_copy_only=False).astype(bool)


def _sums(tokens: DataFrame, pairs: bool, words: pa.Array | None = None, group: str | None = None) -> DataFrame:
    """Rows (term, df, ttf, _group) of the single words, or of the pairs of
    ``words``, to be added up by term; ``_group`` is the small whole number
    ``group`` beside the document, or 0."""
    def run(batches):
        for whole in batches:
            for batch in _slices(whole, SLICE_TOKENS):
                some = _Terms(batch.column(0))
                doc, number, terms = some.pairs(_is_in(some.words, words)) if pairs else some.single()
                doc, term, n = some.counts(doc, number, terms)
                kind = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[doc]
                m = max(len(terms), 1)
                cells, place, df = np.unique(kind * m + term, return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [terms.take(pa.array(cells % m)), pa.array(df, pa.int64()),
                     pa.array(np.bincount(place, n, len(cells)).astype(np.int64)), pa.array(cells // m, pa.int32())],
                    names=["term", "df", "ttf", "_group"])

    of = F.col(group) if group else F.lit(0)
    return tokens.select("_u", of.cast("int").alias("_group")).mapInArrow(run, "term string, df long, ttf long, _group int")


def _total(sums: DataFrame) -> DataFrame:
    return sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf"))


def _reached(stats: DataFrame, n_docs: int, min_df: int, max_df: float | None) -> DataFrame:
    stats = stats.where(F.col("df") >= min_df)
    return stats if max_df is None else stats.where(F.col("df") <= math.floor(max_df * n_docs))


def _frequent_words(stats: DataFrame, n_docs: int, min_df: int, max_df: float | None, max_features: int) -> pa.Array | None:
    """The words that a pair in the vocabulary can have; None: any."""
    best = _reached(stats, n_docs, min_df, max_df).orderBy(F.desc("ttf")).limit(max_features)
    n, least = best.agg(F.count(F.lit(1)), F.min("ttf")).first()
    able = stats.where((F.col("df") >= min_df) & (F.col("ttf") >= (least if n == max_features else 0))).select("term")
    rows = able.limit(BROADCAST_VOCAB_MAX + 1).collect()
    return pa.array([r["term"] for r in rows], pa.string()) if len(rows) <= BROADCAST_VOCAB_MAX else None


def fit_vocabulary(tokens: DataFrame, n_docs: int, ngram_max: int = 2, min_df: int = 1, max_df: float | None = None,
                   max_features: int | None = None) -> Vocabulary:
    """Document frequency, filters, top-``max_features`` by corpus frequency."""
    from ..session import checkpoint_root

    checkpoint_root(tokens.sparkSession)
    stats = _total(_sums(tokens, pairs=False))
    if ngram_max > 1:
        bounded = max_features is not None and max_features <= BROADCAST_VOCAB_MAX
        words = None
        if bounded:
            stats = stats.checkpoint(eager=True)
            words = _frequent_words(stats, n_docs, min_df, max_df, max_features)
        stats = stats.unionByName(_total(_sums(tokens, True, words)))
    stats = _reached(stats, n_docs, min_df, max_df)
    if max_features is not None:
        stats = stats.orderBy(F.desc("ttf"), F.asc("term")).limit(max_features)
    idf = F.log((F.lit(1.0) + n_docs) / (F.col("df") + 1.0)) + 1.0
    terms = stats.select("term", "df", idf.alias("idf"))
    bounded = max_features is not None and max_features <= BROADCAST_VOCAB_MAX
    if bounded:
        terms = terms.checkpoint(eager=True)  # read by every transform
    return Vocabulary(terms=terms, n_docs=n_docs, bounded=bounded)


def _vocabulary_entries(some: _Terms, terms: pa.Array, words: np.ndarray, pairs: bool):
    """(document, place in the vocabulary, occurrences) by document."""
    found = [some.counts(*some.single()) + (some.words,)]
    if pairs:
        pair = some.pairs(words)
        found.append(some.counts(*pair) + (pair[2],))
    out = []
    for doc, number, n, names in found:
        place = pc.index_in(names, terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(number):
            continue
        place = place[number]
        out.append((doc[place >= 0], place[place >= 0], n[place >= 0]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    doc, place, n = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((place, doc))
    return doc[order], place[order], n[order]


def _weighted(tokens: DataFrame, key: str, vocab: Vocabulary, ngram_max: int, arrays: bool) -> DataFrame:
    """Weights over a bounded vocabulary without a shuffle: (key, term, weight),
    or with ``arrays`` (key, _terms, _weights), terms numbered in their order."""
    rows = sorted((r["term"], r["idf"]) for r in vocab.terms.select("term", "idf").collect())
    names, idf = pa.array([r[0] for r in rows], pa.string()), np.array([r[1] for r in rows], float)
    inside = pa.array(sorted({w for t, _ in rows for w in t.split(" ") if " " in t}), pa.string())
    shared = tokens.sparkSession.sparkContext.broadcast((names, idf, inside))

    def run(batches):
        names, idf, inside = shared.value
        for whole in batches:
            for batch in _slices(whole, SLICE_TOKENS):
                some = _Terms(batch.column(1))
                doc, place, n = _vocabulary_entries(some, names, _is_in(some.words, inside), ngram_max > 1)
                w = n * idf[place]
                w = w / np.sqrt(np.bincount(doc, w * w, some.n))[doc]
                if arrays:
                    own, size = np.unique(doc, return_counts=True)
                    ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                    columns = [batch.column(0).take(pa.array(own)), pa.ListArray.from_arrays(ends, pa.array(place, pa.int64())),
                               pa.ListArray.from_arrays(ends, pa.array(w, pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "_terms", "_weights"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), names.take(pa.array(place)), pa.array(w, pa.float64())],
                                                     names=[key, "term", "weight"])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.mapInArrow(run, f"`{key}` {kind}, " + ("_terms array<long>, _weights array<double>" if arrays else "term string, weight double"))


def _term_counts(tokens: DataFrame, key: str, ngram_max: int) -> DataFrame:
    """(key, term, tf), each term of a document once."""
    def run(batches):
        for whole in batches:
            for batch in _slices(whole, SLICE_TOKENS):
                some = _Terms(batch.column(1))
                for found in [some.single()] + [some.pairs(_is_in(some.words, None))] * (ngram_max > 1):
                    doc, term, n = some.counts(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), found[2].take(pa.array(term)), pa.array(n, pa.int64())],
                                                     names=[key, "term", "tf"])

    return tokens.mapInArrow(run, f"`{key}` {tokens.schema[key].dataType.simpleString()}, term string, tf long")


def transform(tokens: DataFrame, vocab: Vocabulary, key: str, ngram_max: int = 2) -> DataFrame:
    """(key, term, weight): tf·idf over vocabulary terms, L2-normalised.

    A document without any vocabulary term yields no rows.
    """
    if vocab.bounded:
        return _weighted(tokens, key, vocab, ngram_max, arrays=False)
    tf = _term_counts(tokens, key, ngram_max)
    w = tf.join(vocab.terms.select("term", "idf"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return w.select(key, "term", (F.col("w") / norm).alias("weight"))


def vectors(tokens: DataFrame, vocab: Vocabulary, key: str, ngram_max: int = 2) -> DataFrame:
    """(key, _terms, _weights) over a bounded vocabulary: one row per document
    with a vocabulary term, terms numbered from 0 in their order."""
    return _weighted(tokens, key, vocab, ngram_max, arrays=True)


def tfidf(docs: DataFrame, key: str, text: str, ngram_max: int = 2, min_df: int = 1,
          max_df: float | None = None, max_features: int | None = None) -> tuple[DataFrame, Vocabulary]:
    """Fit on ``docs`` and transform them: returns (weights, vocabulary).

    ``n`` counts every document of ``docs`` (one scalar action).
    """
    tokens, n_docs = token_lists(docs, key, text)
    vocab = fit_vocabulary(tokens, n_docs, ngram_max, min_df, max_df, max_features)
    return transform(tokens, vocab, key, ngram_max), vocab


# ---------------------------------------------------------------------------
# Spark ML form (feeds the classifier)


def fit_without_each(tokens: DataFrame, group: str, sizes: dict[int, int], min_df: int, max_features: int) -> list[dict[str, float]]:
    """For each group, the vocabulary (term to idf) of the documents outside it.

    ``sizes``: the number of documents of each group, 0 to k-1.  The words of all
    documents are counted once; a sum outside a group is the total without it.
    Words and then pairs cost one pass each, whatever the number of groups."""
    from ..session import checkpoint_root

    checkpoint_root(tokens.sparkSession)
    k = len(sizes)

    def outside(sums: DataFrame) -> DataFrame:
        other = lambda c, g: F.sum(F.when(F.col("_group") != g, F.col(c)).otherwise(0))
        wide = sums.groupBy("term").agg(*[other(c, g).alias(f"{c}{g}") for g in range(k) for c in ("df", "ttf")])
        reached = F.greatest(*[F.col(f"df{g}") for g in range(k)], F.lit(0)) >= min_df
        return wide.where(reached).checkpoint(eager=True)

    def of(stats: DataFrame, g: int) -> DataFrame:
        return stats.select("term", F.col(f"df{g}").alias("df"), F.col(f"ttf{g}").alias("ttf"))

    single = outside(_sums(tokens, False, group=group))
    words = [_frequent_words(of(single, g), 0, min_df, None, max_features) for g in range(k)]
    words = None if any(w is None for w in words) else pa.array(sorted({w for some in words for w in some.to_pylist()}), pa.string())
    stats = single.unionByName(outside(_sums(tokens, True, words, group)))
    found = []
    for g in range(k):
        best = _reached(of(stats, g), 0, min_df, None).orderBy(F.desc("ttf"), F.asc("term")).limit(max_features).collect()
        n = sum(sizes.values()) - sizes[g]
        found.append({r["term"]: math.log((1.0 + n) / (1.0 + r["df"])) + 1.0 for r in best})
    return found


def term_counter(terms: list[str], terms_col: str, out_col: str):
    """The stage that counts the given terms: one vector entry for each."""
    from pyspark.ml.feature import CountVectorizerModel

    return CountVectorizerModel.from_vocabulary(terms, inputCol=terms_col, outputCol=out_col)


def weighting(terms: list[str], idf: dict[str, float], counts_col: str, features_col: str):
    """The stages that give counts over ``terms`` the weighting of :func:`tfidf`:
    tf·idf, 0 for a term outside the vocabulary ``idf``, L2-normalised."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    scale = Vectors.dense([idf.get(t, 0.0) for t in terms])  # bounded by the vocabularies' sizes
    return PipelineModel(stages=[ElementwiseProduct(scalingVec=scale, inputCol=counts_col, outputCol="_tfidf"),
                                 Normalizer(p=2.0, inputCol="_tfidf", outputCol=features_col)])
