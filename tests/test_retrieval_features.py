import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.operators import block_max, features, retrieval

POOL = [
    (1, "my package was not delivered yet"),
    (2, "refund for my order please"),
    (3, "the package arrived broken"),
    (4, "how do I reset my password"),
    (5, "password reset link does not work"),
    (6, "order order order status"),
    (7, "zzz"),
]
QUERIES = [(10, "package not delivered"), (11, "reset password"), (12, "order status please"),
           (13, "nothing shared here qqq")]


def py_terms(text):
    u = re.findall(r"\w{2,}", text.lower())
    return u + [f"{a} {b}" for a, b in zip(u, u[1:])]


def py_tfidf(docs, min_df=1, max_features=None):
    tfs = {k: Counter(py_terms(t)) for k, t in docs}
    df = Counter(t for c in tfs.values() for t in c)
    ttf = Counter()
    for c in tfs.values():
        ttf.update(c)
    vocab = [t for t in df if df[t] >= min_df]
    vocab.sort(key=lambda t: (-ttf[t], t))
    if max_features:
        vocab = vocab[:max_features]
    n = len(docs)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    return tfs, idf


def vec(counter, idf):
    w = {t: c * idf[t] for t, c in counter.items() if t in idf}
    norm = math.sqrt(sum(v * v for v in w.values()))
    return {t: v / norm for t, v in w.items()} if norm else {}


def brute_force(k, max_features=None, min_df=1):
    tfs, idf = py_tfidf(POOL, min_df, max_features)
    pv = {key: vec(c, idf) for key, c in tfs.items()}
    out = {}
    for qk, qt in QUERIES:
        qv = vec(Counter(py_terms(qt)), idf)
        scores = [(sum(w * pv[p].get(t, 0.0) for t, w in qv.items()), p) for p in pv]
        scores = [(s, p) for s, p in scores if s > 0]
        scores.sort(key=lambda x: (-round(x[0], 9), x[1]))
        out[qk] = [(p, s) for s, p in scores[:k]]
    return out


def spark_top(spark, k, strategy, common_df=None, queries=QUERIES, exclude_self=False):
    pool = spark.createDataFrame(POOL, "pid long, text string")
    q = spark.createDataFrame(queries, "qid long, text string")
    m = retrieval.retrieve(q, "qid", "text", pool, "pid", "text", k=k, max_features=None,
                           strategy=strategy, common_df=common_df, exclude_self=exclude_self)
    out = {}
    for r in m.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append((r["pid"], r["score"]))
    return out


def brute(k, queries=QUERIES, exclude_self=False):
    tfs, idf = py_tfidf(POOL)
    pv = {key: vec(c, idf) for key, c in tfs.items()}
    out = {}
    for qk, qt in queries:
        qv = vec(Counter(py_terms(qt)), idf)
        scores = [(sum(w * pv[p].get(t, 0.0) for t, w in qv.items()), p) for p in pv
                  if not (exclude_self and p == qk)]
        scores = sorted([(sc, p) for sc, p in scores if sc > 0], key=lambda x: (-round(x[0], 9), x[1]))
        if scores:
            out[qk] = [(p, sc) for sc, p in scores[:k]]
    return out


STRATEGIES = [("blocks", None), ("broadcast", None), ("salted", None), ("tiered", 1), ("tiered", 2), ("tiered", 100)]


@pytest.mark.parametrize("strategy,common_df", STRATEGIES)
def test_retrieval_equals_brute_force(spark, strategy, common_df, monkeypatch):
    # salted: hot_df=1 salts every term into 3 buckets
    orig = retrieval.score_candidates
    monkeypatch.setattr(retrieval, "score_candidates",
                        lambda *a, **kw: orig(*a, **{**kw, "hot_df": 1, "salts": 3}))
    for k in (1, 3):
        want = brute(k)
        got = spark_top(spark, k, strategy, common_df)
        assert set(got) == set(want)
        for qk, lst in want.items():
            assert [p for p, _ in got[qk]] == [p for p, _ in lst]
            assert [sc for _, sc in got[qk]] == pytest.approx([sc for _, sc in lst], abs=1e-12)


@pytest.mark.parametrize("strategy,common_df", STRATEGIES)
def test_retrieval_all_pairs_exclude_self(spark, strategy, common_df):
    qs = [(k, t) for k, t in POOL]
    want = brute(2, qs, exclude_self=True)
    got = spark_top(spark, 2, strategy, common_df, qs, exclude_self=True)
    assert {q: [p for p, _ in v] for q, v in got.items()} == {q: [p for p, _ in v] for q, v in want.items()}


def test_tfidf_vocabulary_cut_and_weights(spark):
    docs = spark.createDataFrame(POOL, "pid long, text string")
    w, vocab = features.tfidf(docs, "pid", "text", min_df=2, max_features=5)
    tfs, idf = py_tfidf(POOL, min_df=2, max_features=5)
    assert sorted(r["term"] for r in vocab.terms.collect()) == sorted(idf)
    got = {(r["pid"], r["term"]): r["weight"] for r in w.collect()}
    want = {(p, t): v for p, c in tfs.items() for t, v in vec(c, idf).items()}
    assert set(got) == set(want)
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-12)


def random_docs(seed, n, words):
    r = random.Random(seed)
    return [(i, " ".join(f"w{min(int(r.expovariate(8 / words)), words - 1):03d}" for _ in range(r.randint(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("slice_tokens,ngram_max,max_features", [(1 << 20, 2, 40), (7, 2, 40), (50, 2, 500), (50, 1, 20), (50, 2, None)])
def test_tfidf_forms_no_row_for_each_occurrence(spark, monkeypatch, slice_tokens, ngram_max, max_features):
    monkeypatch.setattr(features, "SLICE_TOKENS", slice_tokens)
    docs = random_docs(3, 200, 90) + [(900, None), (901, ""), (902, "a"), (903, "new new new words")]
    df = spark.createDataFrame(docs, "pid long, text string").repartition(3)
    w, vocab = features.tfidf(df, "pid", "text", ngram_max, min_df=2, max_features=max_features)
    tfs = {}
    for p, t in docs:
        u = re.findall(r"\w\w+", (t or "").lower())
        tfs[p] = Counter(u + [f"{a} {b}" for a, b in zip(u, u[1:])] * (ngram_max == 2))
    dfs, ttf = Counter(t for c in tfs.values() for t in c), sum(tfs.values(), Counter())
    kept = sorted((t for t in dfs if dfs[t] >= 2), key=lambda t: (-ttf[t], t))[:max_features]
    idf = {t: math.log((1 + len(docs)) / (1 + dfs[t])) + 1 for t in kept}
    assert {r["term"]: r["df"] for r in vocab.terms.collect()} == {t: dfs[t] for t in kept}
    want = {(p, t): v for p, c in tfs.items() for t, v in vec(c, idf).items()}
    got = {(r["pid"], r["term"]): r["weight"] for r in w.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    if max_features:  # neither texts nor occurrences are dealt out by key
        assert "hashpartitioning" not in w._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_key_are_one_document(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa cc"), (1, "cc bb")], "pid long, text string").repartition(3)
    w, vocab = features.tfidf(docs, "pid", "text")
    assert {r["term"]: r["df"] for r in vocab.terms.collect()} == {"aa": 2, "bb": 1, "cc": 2, "aa bb": 1, "aa cc": 1, "cc bb": 1}
    weights = {r["term"]: r["weight"] for r in w.where("pid = 1").collect()}
    assert set(weights) == {"aa", "bb", "cc", "aa bb", "cc bb"} and weights["bb"] > weights["aa bb"]


def test_fallback_first(spark):
    pool = spark.createDataFrame(POOL, "pid long, text string")
    q = spark.createDataFrame(QUERIES, "qid long, text string")
    m = retrieval.retrieve(q, "qid", "text", pool, "pid", "text", k=1)
    fb = {r["qid"]: r["pid"] for r in retrieval.with_fallback(m, q, "qid", pool, "pid", "first").collect()}
    assert fb[13] == 1


# -- block index ---------------------------------------------------------------


def sparse_rows(seed, n, terms=60, most=12):
    """Unit vectors with a few very common terms, some equal vectors and some empty."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        if i > 3 and r.random() < 0.1:
            out.append((i, *out[r.randrange(i)][1:]))
            continue
        t = sorted({min(int(r.expovariate(0.15)), terms - 1) for _ in range(r.randint(0, most))})
        w = [r.random() + 0.01 for _ in t]
        norm = math.sqrt(sum(x * x for x in w)) or 1.0
        out.append((i, t, [x / norm for x in w]))
    return out


def plain_top(query, pool, k, skip):
    mine = dict(zip(query[1], query[2]))
    found = [(-round(s, 9), p) for p, t, w in pool if p != skip
             and (s := sum(mine.get(a, 0.0) * b for a, b in zip(t, w))) > 0]
    return [p for _, p in sorted(found)[:k]]


@pytest.mark.parametrize("whole,block", [(1 << 15, 64), (0, 64), (0, 1), (0, 3)])
def test_block_search_equals_brute_force(whole, block, monkeypatch):
    monkeypatch.setattr(block_max, "WHOLE", whole)
    monkeypatch.setattr(block_max, "BLOCK", block)
    for seed in range(4):
        pool = sparse_rows(seed, 300)
        size = np.array([len(t) for _, t, _ in pool])
        shard = block_max.Shard(size, np.array([x for _, t, _ in pool for x in t]), np.array([x for _, _, w in pool for x in w]))
        for query in pool[::5] + [(-1, [3, 10_000], [0.6, 0.8]), (-1, [10_000], [1.0])]:
            for k in (1, 4):
                docs, scores, _ = block_max.search(shard, np.array(query[1], np.int64), np.array(query[2]), k, query[0])
                assert docs.tolist() == plain_top(query, pool, k, query[0])
                assert list(np.round(scores, 9)) == sorted(np.round(scores, 9), reverse=True)


def test_blocks_are_skipped(monkeypatch):
    monkeypatch.setattr(block_max, "WHOLE", 0)
    r = random.Random(4)
    pool = []
    for i in range(20_000):  # one term in every document, two rare ones in each
        w = np.array([0.05 + 0.2 * r.random(), r.random() + 0.5, r.random() + 0.5])
        pool.append((i, [0, 1 + i % 400, 401 + (i * 7) % 997], w / np.sqrt(w @ w)))
    shard = block_max.Shard(np.full(len(pool), 3), np.array([x for _, t, _ in pool for x in t]),
                            np.concatenate([w for _, _, w in pool]))
    for query in pool[::2500]:
        docs, _, opened = block_max.search(shard, np.array(query[1]), query[2], 2, query[0])
        assert docs.tolist() == plain_top(query, pool, 2, query[0])
        assert opened < 2_000  # of more than 20,000 postings


def test_no_more_is_read_than_all_postings_hold(monkeypatch):
    monkeypatch.setattr(block_max, "WHOLE", 0)
    r = random.Random(8)
    pool = []
    for i in range(3000):  # long documents of common terms: many bounds reach the threshold
        t = sorted({min(int(r.expovariate(0.05)), 99) for _ in range(25)})
        w = np.array([r.random() + 0.2 for _ in t])
        pool.append((i, t, (w / np.sqrt(w @ w)).tolist()))
    size = np.array([len(t) for _, t, _ in pool])
    shard = block_max.Shard(size, np.array([x for _, t, _ in pool for x in t]), np.array([x for _, _, w in pool for x in w]))
    for query in pool[::150]:
        term = np.array(query[1])
        for k in (1, 3):
            docs, _, opened = block_max.search(shard, term, np.array(query[2]), k, query[0])
            assert docs.tolist() == plain_top(query, pool, k, query[0])
            seeds = block_max.SEED_BLOCKS * block_max.BLOCK + 4 * k * size.max()
            assert opened <= 2 * np.diff(shard.start)[np.searchsorted(shard.terms, term)].sum() + seeds


def test_bound_holds_for_every_vector_below_the_cut_offs():
    r = np.random.default_rng(5)
    for _ in range(300):
        w, cut = r.random(6) + 0.01, r.random(6) * r.choice([0.2, 1.0])
        top = block_max.bound(w, cut, 1.0)
        for _ in range(50):
            x = r.random(6) * cut
            x = x / max(1.0, np.sqrt(x @ x))
            assert w @ x <= top + 1e-12
        best = np.minimum(cut, w * 1e3)
        assert top <= w @ best + 1e-12


def test_tiles_of_any_size_give_the_same_rows(spark):
    rows = sparse_rows(9, 120)
    p = spark.createDataFrame(rows, "p long, terms array<long>, weights array<double>").where("size(terms) > 0")
    q = p.select(F.col("p").alias("q"), F.when(F.col("p") % 2 == 0, F.col("p")).alias("self"), "terms", "weights")
    for shard, chunk in ((1 << 20, 1 << 20), (100, 1 << 20), (90, 70)):
        found = block_max.top_k(q, p, 2, shard_entries=shard, chunk_entries=chunk, counts=True)
        got = {}
        for r in retrieval.top_k(found, "q", "p", 2).orderBy("q", "rank").collect():
            assert r.opened > 0
            got.setdefault(r.q, []).append(r.p)
        want = {x[0]: plain_top(x, rows, 2, x[0] if x[0] % 2 == 0 else None) for x in rows}
        assert got == {k: v for k, v in want.items() if v}
    assert block_max.top_k(q.limit(0), p, 2).count() == block_max.top_k(q, p.limit(0), 2).count() == 0
