"""Exact quantiles, most frequent n-grams and the t distribution against plain Python."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlab.operators import agreement, heavy_hitters, quantiles

PS = [0.0, 0.01, 0.25, 0.5, 0.77, 0.999, 1.0]


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_equal_numpy(spark, accuracy):
    r = random.Random(1)
    groups = {"a": [r.gauss(0, 10) for _ in range(3000)], "b": [float(r.randrange(4)) for _ in range(500)], "one": [7.5],
              None: [r.random() for _ in range(40)] + [1.0] * 60, "two": [1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {x.g: x.quantiles for x in quantiles.exact_quantiles(df, "v", PS, ["g"], accuracy).collect()}
    assert got.pop("nulls") == [None] * len(PS)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.quantile(vs, PS).tolist(), abs=1e-9)
    whole = quantiles.exact_quantiles(df, "v", PS, accuracy=accuracy).first().quantiles
    assert whole == pytest.approx(np.quantile([v for vs in groups.values() for v in vs], PS).tolist(), abs=1e-9)


def test_quantiles_of_nothing_and_of_a_wrong_sketch(spark, monkeypatch):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles.exact_quantiles(df, "v", [0.5], ["g"]).count() == 0
    assert [r.quantiles for r in quantiles.exact_quantiles(df, "v", [0.5]).collect()] == [[None]]
    # brackets that miss are widened until they hold the rank
    original = quantiles._brackets
    tries = []

    def shifted(src, groups, ps, accuracy, margin):
        tries.append(margin)
        if margin < 0.01:
            return original(src.withColumn("_v", F.col("_v") + 500), groups, ps, accuracy, margin)
        return original(src, groups, ps, accuracy, margin)

    monkeypatch.setattr(quantiles, "_brackets", shifted)
    values = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert quantiles.exact_quantiles(values, "v", [0.3]).first().quantiles == pytest.approx([299.7])
    assert len(tries) > 1


def words(seed, n, kinds):
    r = random.Random(seed)
    return [f"w{min(int(r.expovariate(6 / kinds)), kinds)}" for _ in range(n)]


def plain_top(lists, sizes, n):
    counts = Counter(" ".join(ws[i:i + k]) for ws in lists for k in sizes for i in range(len(ws or []) - k + 1)
                     if all(w is not None for w in ws[i:i + k]))
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]


@pytest.mark.parametrize("most", [1 << 62, 10, 3])
def test_space_saving_bounds_hold(most):
    r = random.Random(5)
    for counters in (3, 20, 500):
        kept, truth = heavy_hitters.SpaceSaving(counters), Counter()
        for _ in range(60):
            batch = words(r.random(), 80, 300)
            truth.update(batch)
            for counted in heavy_hitters.gram_counts(pa.array([batch]), (1,), most):
                kept.add(*counted)
        kept.shrink()
        assert len(kept.upper) <= counters
        for gram, count in truth.items():
            if gram in kept.upper:
                assert kept.upper[gram] - kept.wrong[gram] <= count <= kept.upper[gram]
            else:
                assert count <= kept.floor


@pytest.mark.parametrize("counters,broadcast", [(20_000, 10), (30, 1_000_000), (30, 5), (2, 1_000_000)])
def test_top_ngrams_equal_a_full_count(spark, monkeypatch, counters, broadcast):
    monkeypatch.setattr(heavy_hitters, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(heavy_hitters, "MOST_COUNTERS", 4000)
    lists = [words(s, 60, 200) for s in range(80)] + [[], None, ["x"], ["a", None, "b", "a"], [None]]
    df = spark.createDataFrame([(x,) for x in lists], "t array<string>").repartition(6)
    for sizes in ((1,), (2,), (1, 2, 3)):
        got = [tuple(r) for r in heavy_hitters.top_ngrams(df, "t", 12, sizes, counters).collect()]
        assert got == plain_top([x for x in lists if x], sizes, 12)
    assert heavy_hitters.top_ngrams(df.limit(0), "t", 3).count() == 0


def test_equal_counts_everywhere(spark):
    df = spark.createDataFrame([([f"w{i:04d}" for i in range(1000)],)] * 3, "t array<string>").repartition(3)
    got = heavy_hitters.top_ngrams(df, "t", 5, (1,), counters=10).collect()
    assert [tuple(r) for r in got] == [(f"w{i:04d}", 3) for i in range(5)]


def test_gram_counts_stay_inside_a_row():
    lists = pa.array([["a", "b"], [], None, ["b", "a", "b"]], pa.list_(pa.string()))
    assert {g: c for gs, cs, _ in heavy_hitters.gram_counts(lists, (2,)) for g, c in zip(gs, cs)} == {"a b": 2, "b a": 1}


def test_a_batch_is_looked_at_in_slices(spark, monkeypatch):
    lists = [words(s, 60, 200)[:s % 30] for s in range(200)] + [[], None, words(7, 60, 900)]
    tokens = pa.array(lists, pa.list_(pa.string()))
    parts = list(heavy_hitters.slices(tokens, 100))
    assert [x for p in parts for x in p.to_pylist()] == lists
    assert all(len(p.flatten()) <= 100 or len(p) == 1 for p in parts) and len(parts) < 120
    monkeypatch.setattr(heavy_hitters, "SLICE_TOKENS", 100)
    df = spark.createDataFrame([(x,) for x in lists], "t array<string>").repartition(3)
    for counters in (20, 20_000):
        got = [tuple(r) for r in heavy_hitters.top_ngrams(df, "t", 15, (1, 2, 3), counters).collect()]
        assert got == plain_top([x for x in lists if x], (1, 2, 3), 15)


def test_the_second_pass_forms_only_ngrams_of_wanted_words():
    lists = pa.array([["a", "b", "c", "a", "b"], [None, "a", "b"], ["b"], []], pa.list_(pa.string()))
    got = {g: n for gs, ns, _ in heavy_hitters.gram_counts(lists, (1, 2, 3), of=pa.array(["a", "b"])) for g, n in zip(gs, ns)}
    assert got == {"a": 3, "b": 4, "a b": 3}


def test_t_p_values(spark):
    # (t, degrees of freedom, two-sided p) from tables of Student's t distribution
    known = [(12.706, 1, 0.05), (2.571, 5, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.812, 10, 0.10), (2.750, 30, 0.01),
             (1.980, 120, 0.05), (1.960, 100_000, 0.05), (2.576, 10_000_000, 0.01), (0.0, 7, 1.0), (0.677, 120, 0.50)]
    df = spark.createDataFrame([(float(t), n, p) for t, n, p in known], "t double, n long, p double")
    for r in df.withColumn("got", agreement.t_p_value(F.col("t"), F.col("n"))).collect():
        assert r.got == pytest.approx(r.p, rel=2e-3, abs=1e-12)
    one = spark.createDataFrame([(0.140, 20)], "rho double, n long")
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    assert one.select(F.round(agreement.t_p_value(t, F.col("n") - 2), 3)).first()[0] == 0.556
    assert spark.range(1).select(agreement.t_p_value(F.lit(1.0), F.lit(0))).first()[0] is None


def test_rank_agreement_p_value_of_perfect_and_constant_scores(spark):
    same = spark.createDataFrame([(float(i), float(i)) for i in range(5)], "a double, b double")
    assert agreement.rank_agreement(same, "a", "b").first().p_value == 0.0
    flat = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, b double")
    assert agreement.rank_agreement(flat, "a", "b").first().p_value is None
