"""Exact dedup, n-gram join and repeated passages against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.llm import components, exact_dedup, ngram_join, suffix_array, suffix_dedup

from conftest import rows
from .conftest import SCHEMA, ascii_lower, prose, texts_of


def brute_exact(texts):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[ascii_lower(t)].append(i)
    return sorted((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest())
                  for t, g in groups.items() for i in g)


@pytest.mark.parametrize("name", ["awkward", "small", "empty"])
def test_exact_dedup(name, request):
    df = request.getfixturevalue(name)
    out = exact_dedup.exact_dedup(exact_dedup.with_digest(df))
    assert rows(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(texts_of(df))


def test_exact_dedup_clashing_columns_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", 9, "z"), (1, "a", 9, "z"), (None, "A", 8, "y"), (2, None, 7, "x")],
                               "doc_id long, text string, KEEP_ID int, Kept string")
    out = exact_dedup.exact_dedup(exact_dedup.with_digest(df))
    got = sorted(((r.doc_id, r.text, r.keep_id, r.group_size, r.kept) for r in out.collect()), key=str)
    assert got == sorted([(1, "a", 1, 3, True), (1, "a", 1, 3, True), (None, "A", 1, 3, False), (2, None, 2, 1, True)], key=str)


def test_exact_dedup_has_no_python(small):
    plan = exact_dedup.exact_dedup(exact_dedup.with_digest(small))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def shingle_set(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", ascii_lower(text)) if x]
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_join(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    of = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            of[g].add(i)
    for i, s in sets.items():
        for j, common in Counter(j for g in s for j in of[g]).items():
            if 100 * common >= 80 * (len(s) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return sorted((i, len(s), top(i)) for i, s in sets.items())


@pytest.mark.parametrize("name", ["awkward", "small", "empty"])
def test_ngram_components(name, request):
    df = request.getfixturevalue(name)
    assert rows(ngram_join.ngram_components(df), "doc_id", "n_shingles", "component_id") == brute_join(texts_of(df))


def test_ngram_components_in_small_tiles_and_strips(awkward, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 7)
    monkeypatch.setattr(ngram_join, "STRIP_PRODUCTS", 300)
    assert rows(ngram_join.ngram_components(awkward), "doc_id", "n_shingles", "component_id") == brute_join(texts_of(awkward))


def test_ngram_components_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "q r s t u v"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (None, 2, None), (None, 0, None)], key=str)


def test_tile_links_span_the_same_classes():
    r = np.random.default_rng(3)
    for trial in range(20):
        common = r.choice(10_000, 60, replace=False)
        sets = [np.unique(np.where(r.random(60) < r.choice([.03, .08, .15]), r.integers(0, 10_000, 60), common)) for _ in range(30)]
        links = ngram_join.tile_links(np.array([len(s) for s in sets]), np.concatenate(sets))
        up = list(range(30))

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            o = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o)
            up[max(top(a), top(b))] = min(top(a), top(b))
        for a in range(30):
            for b in range(a):
                o = len(np.intersect1d(sets[a], sets[b]))
                assert top(a) == top(b) or 100 * o < 80 * (len(sets[a]) + len(sets[b]) - o)


@pytest.mark.parametrize("strip", [1, 2, 3])
def test_tile_links_of_chains_when_the_largest_class_changes(strip, monkeypatch):
    """Versions of which only neighbours link, in strips of a few rows."""
    monkeypatch.setattr(ngram_join.Product, "strip", lambda self, rows: strip)
    step, size = 100, 1000  # 900 of 1100 shingles in common with the next version, 800 of 1200 with the one after

    def classes(versions):
        sets = [np.arange(v * step, v * step + size) for v in versions]
        up = list(range(len(sets)))

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in ngram_join.tile_links(np.full(len(sets), size), np.concatenate(sets)):
            assert abs(versions[a] - versions[b]) <= 1
            up[max(top(a), top(b))] = min(top(a), top(b))
        return len({top(x) for x in up})

    assert classes([0, 3, 1, 2, 2]) == 1
    r = np.random.default_rng(11)
    for _ in range(200):
        versions = r.integers(0, 9, r.integers(2, 14)).tolist()
        known = sorted(set(versions))
        assert classes(versions) == 1 + sum(b - a > 1 for a, b in zip(known, known[1:]))


def test_survivors_hold_every_linked_row():
    r = np.random.default_rng(5)
    order = ngram_join.Order(r.integers(1, 9, 1 << 10).astype(np.uint16), r.integers(0, 256, 1 << 10).astype(np.uint8))
    hashes = r.integers(0, 1 << 63, 10_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for trial in range(30):
        common = r.choice(10_000, 60, replace=False).astype(np.uint64)
        noise = lambda: r.choice([.02, .1, .3, .9])
        sets = [np.unique(np.where(r.random(60) < noise(), r.integers(0, 10_000, 60).astype(np.uint64), common))[:r.integers(40, 61)]
                for _ in range(30)]
        sets = [np.sort(hashes[s.astype(np.int64)]) for s in sets]
        lead = [ngram_join.leading(s, order) for s in sets]
        may = ngram_join.tile_survivors(np.array([len(s) for s in sets]), np.array([len(s) for s, _ in lead]),
                                        np.array([c for _, c in lead]), np.concatenate([s for s, _ in lead]).view(np.int64))
        for a in range(30):
            for b in range(a):
                o = len(np.intersect1d(sets[a], sets[b]))
                assert 100 * o < 80 * (len(sets[a]) + len(sets[b]) - o) or may[a] and may[b]


@pytest.mark.parametrize("log2", [12, 20])
def test_filter_knows_every_shingle_of_two_sets(log2):
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)) for _ in range(40)]
    sets += [np.unique(np.concatenate([sets[k][:50], r.integers(0, 1 << 63, 300, dtype=np.uint64)])) for k in range(20)]
    whole, parts = ngram_join.Shared(log2), [ngram_join.Shared(log2) for _ in range(3)]
    for k, s in enumerate(sets):
        parts[k % 3].add(s)
        if k % 7 == 0:
            parts[k % 3].flush()
    for p in parts:
        p.flush()
        whole.merge(p.once, p.twice)
    order = ngram_join.Order(np.ones(1 << 10, np.uint16), whole.twice)
    values, times = np.unique(np.concatenate(sets), return_counts=True)
    assert order.shared(values[times > 1]).all()
    if log2 == 20:
        assert order.shared(values[times == 1]).mean() < 0.05


def test_packed_bits_come_back():
    r = np.random.default_rng(8)
    for share in (0.0, 0.0005, 0.01, 0.4, 1.0):
        bits = np.packbits(r.random(1 << 14) < share, bitorder="little")
        for ends in ((0, 0), (1, 128)):  # the first and the last bit
            bits[0], bits[-1] = bits[0] | ends[0], bits[-1] | ends[1]
            raw = ngram_join.packed(bits)
            assert (ngram_join.unpacked(raw, len(bits)) == bits).all()
    assert len(ngram_join.packed(np.packbits(np.arange(1 << 14) % 1000 == 5, bitorder="little"))) < 80


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000)]
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(rows(components.components(df, "a", "b")))
    assert got == {**{k: 0 for k in range(61)}, **{k: 1000 for k in range(1000, 1100)}}


def test_one_per_component_keeps_columns(awkward):
    kept = {i for i, _, c in brute_join(texts_of(awkward)) if i == c}
    out = ngram_join.one_per_component(awkward)
    assert out.columns == awkward.columns
    assert {r.doc_id for r in out.collect()} == kept


def test_dedup_stages_keep_one_row_of_a_group(spark):
    """Rows repeated whole, ids on two texts and near copies without ids."""
    import corpus_pipeline

    a, b, c, d = prose(80, 60), prose(81, 60), prose(82, 60), prose(83, 60)
    data = [(1, a), (1, a), (1, a.upper()), (2, a), (2, a), (None, b), (None, b), (5, c), (6, c + " x"), (6, d), (None, b + " y"), (None, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    exact = corpus_pipeline.without_exact_copies(spark, df, "")
    left = [(2, a), (None, b), (5, c), (6, c + " x"), (6, d), (None, b + " y"), (None, "")]
    assert sorted(map(tuple, exact.collect()), key=str) == sorted(left, key=str)
    for docs, a_id in ((exact, 2), (df, 1)):
        got = [tuple(r) for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()]
        assert sorted((i, t) for i, t in got if i) == sorted([(a_id, next(t for i, t in got if i == a_id)), (5, c), (6, d)])
        assert len([t for i, t in got if i is None and t in (b, b + " y")]) == 1 and (None, "") in got and len(got) == 5


def test_suffix_arrays_equal_sorting():
    r = np.random.default_rng(1)
    for _ in range(150):
        texts = []
        for _ in range(r.integers(1, 8)):
            n = int(r.integers(0, 60))
            w = r.integers(1, r.integers(2, 6), n).tolist()
            texts.append(((w[:r.integers(1, 4)] * 60)[:n] if r.random() < .4 and n > 4 else w) + [0])
        got, at = suffix_array.suffix_arrays(np.concatenate(texts), np.array([len(t) for t in texts])), 0
        for t in texts:
            assert (got[at:at + len(t)] - at).tolist() == sorted(range(len(t)), key=lambda k: t[k:])
            at += len(t)


def brute_repeats(texts, length=200):
    data = {i: (t or "").encode() for i, t in texts.items()}
    count = Counter(b[k:k + length] for b in data.values() for k in range(len(b) - length + 1))
    out = []
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = int(np.diff(np.concatenate([[False], gone, [False]]).astype(int)).clip(0).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("name", ["awkward", "small", "empty"])
@pytest.mark.parametrize("hot", [512, 3])
def test_repeated_bytes(name, hot, request, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    df = request.getfixturevalue(name)
    assert rows(suffix_dedup.repeated_bytes(df), *COLUMNS) == brute_repeats(texts_of(df))


def test_repeated_bytes_at_slice_edges_and_periods(spark, monkeypatch):
    a = prose(1, 400)
    texts = {1: a, 2: "é" + a[300:900] + "ß" * 3, 3: a[1000:1199], 4: a[1000:1200], 5: ("abc" * 200) + "x" + ("abc" * 70), 6: "q" * 200,
             7: "q" * 201, 8: a[150:349] + "#" + a[151:351]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "SLICE", 500)
    assert rows(suffix_dedup.repeated_bytes(df), *COLUMNS) == brute_repeats(texts)


@pytest.mark.parametrize("hot", [512, 1])
def test_unique_texts_of_many_pieces_lose_nothing(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = {1: prose(70, 300_000), 2: prose(71, 900)}  # the first is over 1 MB
    assert len(texts[1]) > 1 << 20
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    whole = [(i, len(t), 0, 0, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()]
    assert rows(suffix_dedup.repeated_bytes(df), *COLUMNS) == whole
    assert rows(suffix_dedup.remove_repeats(df.where("doc_id = 2"), size=138), *COLUMNS) == whole[1:]


@pytest.mark.parametrize("size", [138, 500, 777])
def test_repeated_bytes_in_small_pieces(awkward, size):
    assert rows(suffix_dedup.remove_repeats(awkward, size=size), *COLUMNS) == brute_repeats(texts_of(awkward))


def test_repeated_rows_repeat_each_other(spark):
    t = prose(9, 60)
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df, with_kept=True).collect()), key=str)
    n = len(t)
    assert got == sorted([(1, n, 1), (1, n, 1), (None, n, 1), (2, 0, 0)], key=str)


def test_schema_is_kept_over_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ngram_join.one_per_component(df).columns == df.columns
    assert df.select(F.count(F.lit(1))).first()[0] == 0
