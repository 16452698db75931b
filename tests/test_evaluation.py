import numpy as np
import pytest

from threatloom.operators import evaluation as E


def pairs(spark, rows):
    return E.pair_counts(spark.createDataFrame(rows, "truth string, predicted string"))


ROWS = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "z")] + [("c", "a")]


def test_matrix_has_every_cell(spark):
    got = {(r["truth"], r["predicted"]): r["n"] for r in E.confusion_matrix(pairs(spark, ROWS)).collect()}
    assert len(got) == 16 and got[("a", "b")] == 2 and got[("z", "z")] == 0
    only = E.confusion_matrix(pairs(spark, ROWS), truth_only=True).collect()
    assert len(only) == 9 and sum(r["n"] for r in only) == 11


def test_report(spark):
    got = {r["label"]: r for r in E.classification_report(pairs(spark, ROWS)).collect()}
    assert got["a"]["precision"] == pytest.approx(5 / 6) and got["a"]["recall"] == pytest.approx(5 / 7)
    assert got["z"]["recall"] == 0.0 and got["z"]["support"] == 0 and got["c"]["f1"] == 0.0
    assert got["macro avg"]["precision"] == pytest.approx((5 / 6 + 3 / 5 + 0 + 0) / 4)
    assert got["weighted avg"]["recall"] == pytest.approx((5 + 3) / 12) and got["macro avg"]["support"] == 12
    row = E.overall_scores(pairs(spark, ROWS)).first()
    assert row["accuracy"] == pytest.approx(8 / 12) and row["weighted_recall"] == pytest.approx(8 / 12)


def test_severity(spark):
    got = {r["label"]: r for r in E.severity_scores(pairs(spark, ROWS)).collect()}
    # The prediction "z" is no true class: it is no false negative of "b" here.
    assert (got["b"]["tp"], got["b"]["fn"], got["b"]["fp"]) == (3, 0, 2)
    assert got["a"]["class_severity"] == pytest.approx(1 / 7 * (5 - 4 - 1))
    total = E.severity_score(pairs(spark, ROWS)).first()["severity_score"]
    assert total == pytest.approx(sum(r["class_severity"] for r in got.values()))


def test_roc(spark):
    rng = np.random.default_rng(5)
    truth = rng.integers(0, 2, 500)
    score = np.round(rng.random(500) + truth * 0.3, 1)
    frame = spark.createDataFrame([(int(t), float(s)) for t, s in zip(truth, score)], "truth int, score double")
    better = (score[truth == 1][:, None] > score[truth == 0][None, :]).mean()
    equal = (score[truth == 1][:, None] == score[truth == 0][None, :]).mean()
    assert E.roc_auc(frame).first()["auc"] == pytest.approx(better + equal / 2)
    curve = E.roc_curve(frame).orderBy("fpr", "tpr").collect()
    assert (curve[0]["fpr"], curve[0]["tpr"]) == (0.0, 0.0) and (curve[-1]["fpr"], curve[-1]["tpr"]) == (1.0, 1.0)
    assert len(curve) == len(set(score)) + 1


def test_latency(spark):
    rows = [("m", float(v)) for v in [1, 2, 3, 4, 100]]
    got = E.latency_statistics(spark.createDataFrame(rows, "model string, ms double")).first()
    assert got["p95_ms"] == pytest.approx(np.percentile([1, 2, 3, 4, 100], 95)) and got["max_ms"] == 100
    assert got["throughput_per_sec"] == pytest.approx(5 / 0.110) and got["avg_ms"] == 22
