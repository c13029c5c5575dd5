import math

import pytest

from textlab.functions import patterns as P
from textlab.operators import agreement, metrics

# confusion matrix of the reference's hybrid agent (rows = truth, columns = prediction)
CM = [
    [12, 4, 0, 1, 2, 0, 2, 0, 4],
    [3, 8, 1, 0, 2, 1, 5, 1, 1],
    [1, 0, 5, 0, 3, 0, 3, 3, 2],
    [1, 0, 1, 11, 1, 2, 1, 0, 0],
    [2, 4, 1, 0, 6, 0, 0, 2, 3],
    [1, 0, 0, 2, 0, 3, 1, 1, 0],
    [12, 9, 4, 2, 2, 4, 22, 2, 8],
    [2, 1, 2, 1, 1, 0, 1, 5, 2],
    [1, 1, 0, 1, 1, 0, 3, 1, 7],
]


def expand(spark, cm, labels, pred_override=None):
    data = []
    for i, row in enumerate(cm):
        for j, n in enumerate(row):
            data += [(labels[i], pred_override or labels[j])] * n
    return spark.createDataFrame(data, "t string, p string")


def test_golden_confusion_matrix_metrics(spark):
    df = expand(spark, CM, P.INTENTS)
    s = metrics.summary(metrics.pair_counts(df, "t", "p"), P.INTENTS).first()
    assert s["n"] == 202
    assert s["accuracy"] == pytest.approx(0.3910891089108911, abs=1e-15)
    assert s["macro_f1"] == pytest.approx(0.38202227614781864, abs=1e-12)
    assert s["weighted_f1"] == pytest.approx(0.3949847310929345, abs=1e-12)
    pc = {r["label"]: r for r in metrics.per_class(metrics.pair_counts(df, "t", "p"), P.INTENTS).collect()}
    assert pc["complaint"]["precision"] == pytest.approx(0.5789473684210527, abs=1e-15)
    assert pc["complaint"]["recall"] == pytest.approx(0.3384615384615385, abs=1e-15)
    assert pc["complaint"]["f1"] == pytest.approx(0.42718446601941745, abs=1e-12)
    assert pc["order_status"]["support"] == 25


def test_confusion_matrix_round_trip(spark):
    df = expand(spark, CM, P.INTENTS)
    cm = metrics.confusion_matrix(metrics.pair_counts(df, "t", "p"), P.INTENTS)
    got = sorted((r["label_order"], [r[c] for c in P.INTENTS]) for r in cm.collect())
    assert [g[1] for g in got] == CM


def test_trivial_baseline_metrics(spark):
    df = expand(spark, CM, P.INTENTS, pred_override="complaint")
    s = metrics.summary(metrics.pair_counts(df, "t", "p"), P.INTENTS).first()
    assert s["accuracy"] == pytest.approx(0.3217821782178218, abs=1e-15)
    assert s["macro_f1"] == pytest.approx(0.05409904286308781, abs=1e-12)
    assert s["weighted_f1"] == pytest.approx(0.15667297066785332, abs=1e-12)


def test_escalation_two_by_two(spark):
    # TP 66, FN 69, FP 19, TN 48 with positive = escalate
    data = ([("escalate", "escalate")] * 66 + [("escalate", "auto_handle")] * 69
            + [("auto_handle", "escalate")] * 19 + [("auto_handle", "auto_handle")] * 48)
    df = spark.createDataFrame(data, "t string, p string")
    s = metrics.summary(metrics.pair_counts(df, "t", "p"), P.ESCALATIONS).first()
    assert s["accuracy"] == pytest.approx(0.5643564356435643, abs=1e-15)
    assert s["macro_f1"] == pytest.approx(0.5608695652173913, abs=1e-12)


def test_null_prediction_filled_before_scoring(spark):
    df = spark.createDataFrame([("other", None), ("order_status", "order_status")], "t string, p string")
    s = metrics.summary(metrics.pair_counts(df, "t", "p", fill_pred="other"), P.INTENTS).first()
    assert s["accuracy"] == 1.0


def test_reason_agreement_null_when_no_prediction(spark):
    df = spark.createDataFrame([("low_risk", ""), ("high_emotion", None)], "t string, p string")
    assert metrics.masked_agreement(df, "t", "p").first()["agreement"] is None
    df2 = spark.createDataFrame([("low_risk", "low_risk"), (None, "low_risk"), ("x", "")], "t string, p string")
    assert metrics.masked_agreement(df2, "t", "p").first()["agreement"] == 0.5


def test_eval_document_shape(spark):
    df = spark.createDataFrame([
        (1, "complaint", "escalate", "high_emotion", "complaint", "escalate", "high_emotion"),
        (2, "other", "auto_handle", "low_risk", None, None, ""),
    ], "id long, intent string, escalation_ground_truth string, escalation_reason string, "
       "predicted_intent string, predicted_escalation string, predicted_reason string")
    doc = metrics.eval_document("t", df, P.INTENTS, P.ESCALATIONS).first()
    assert doc["n_evaluated"] == 2
    assert doc["intent"]["accuracy"] == 1.0          # null -> 'other'
    assert doc["reason_agreement"] == 1.0
    assert set(doc["per_intent"].keys()) == set(P.INTENTS)


def kappa_py(a, b):
    n = len(a)
    labels = sorted(set(a) | set(b))
    po = sum(x == y for x, y in zip(a, b)) / n
    pe = sum((a.count(l) / n) * (b.count(l) / n) for l in labels)
    return (po - pe) / (1 - pe)


def test_cohen_kappa(spark):
    a = ["x", "x", "y", "y", "z", "x", "y", "z", "z", "x"]
    b = ["x", "y", "y", "y", "z", "x", "x", "z", "y", "x"]
    df = spark.createDataFrame(list(zip(a, b)), "a string, b string")
    assert agreement.cohen_kappa(df, "a", "b").first()["kappa"] == pytest.approx(kappa_py(a, b), abs=1e-12)
    same = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert agreement.cohen_kappa(same, "a", "b").first()["kappa"] is None


def avg_ranks(v):
    order = sorted(range(len(v)), key=lambda i: v[i])
    r = [0.0] * len(v)
    i = 0
    while i < len(v):
        j = i
        while j + 1 < len(v) and v[order[j + 1]] == v[order[i]]:
            j += 1
        for t in range(i, j + 1):
            r[order[t]] = (i + j) / 2 + 1
        i = j + 1
    return r


def pearson(x, y):
    n = len(x)
    mx, my = sum(x) / n, sum(y) / n
    cov = sum((a - mx) * (b - my) for a, b in zip(x, y))
    return cov / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))


def test_rank_agreement_matches_average_rank_spearman(spark):
    judge = [3.2, 4.0, 4.0, 2.5, 3.8, 4.4, 3.2, 2.0, 4.0, 3.6]
    human = [3.0, 4.0, 3.0, 2.0, 3.0, 5.0, 2.0, 1.0, 4.0, 3.0]
    df = spark.createDataFrame(list(zip(judge, human)), "j double, h double")
    r = agreement.rank_agreement(df, "j", "h").first()
    assert r["rho"] == pytest.approx(pearson(avg_ranks(judge), avg_ranks(human)), abs=1e-12)
    assert r["mae"] == pytest.approx(sum(abs(a - b) for a, b in zip(judge, human)) / 10, abs=1e-12)
    assert r["exact"] == pytest.approx(0.2)
    assert r["within1"] == pytest.approx(sum(abs(a - b) <= 1 for a, b in zip(judge, human)) / 10)
    assert r["bias"] == "generous"


def test_rank_agreement_constant_input_gives_null(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "j double, h double")
    r = agreement.rank_agreement(df, "j", "h").first()
    assert r["rho"] is None and r["band"] is None


def test_running_total_across_partitions(spark):
    df = spark.range(0, 1000).selectExpr("id AS v", "1 AS n")
    out = agreement.running_total(df, "v", "n", "before", partitions=7)
    assert all(r["before"] == r["v"] for r in out.collect())


def test_kappa_of_marginals_beyond_a_long(spark, monkeypatch):
    from textlab.operators import agreement

    counts = spark.createDataFrame([("x", "x", 4_000_000_000), ("y", "y", 4_000_000_000), ("x", "y", 1_000_000_000)],
                                   "a string, b string, n long")
    monkeypatch.setattr(agreement, "joint_counts", lambda df, a, b: counts)
    k = agreement.cohen_kappa(counts, "a", "b").first()
    n, chance = 9e9, 5e9 * 4e9 + 4e9 * 5e9
    assert k["n"] == 9_000_000_000
    assert abs(k["kappa"] - (8e9 * n - chance) / (n * n - chance)) < 1e-12
