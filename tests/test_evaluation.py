import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from hunkwise.operators import evaluation as ev


def pairs(spark, rows):
    """(label, prob) rows with their prediction."""
    df = spark.createDataFrame([(i, l, float(p)) for i, (l, p) in enumerate(rows)], "id int, label int, prob double")
    return ev.with_prediction(df)


SAMPLE = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.7), (1, 0.6), (0, 0.1), (0, 0.2), (1, 0.51)]


def test_prediction_is_strict(spark):
    assert [r.pred for r in pairs(spark, SAMPLE).orderBy("id").collect()] == [1, 0, 0, 1, 1, 0, 0, 1]


def test_confusion_and_metrics(spark):
    df = pairs(spark, SAMPLE)
    assert ev.confusion_counts(df).first().asDict() == {"tn": 3, "fp": 1, "fn": 1, "tp": 3}
    row = ev.binary_metrics(df).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.75, 0.75, 0.75, 0.75)


@pytest.mark.parametrize("rows", [[], [(0, 0.1)], [(1, 0.1)], [(0, 0.9)]])
def test_zero_division_is_zero(spark, rows):
    row = ev.binary_metrics(pairs(spark, rows)).first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)
    assert ev.classification_report(pairs(spark, rows)).count() == 5


def test_report(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.2), round(rng.random(), 2)) for _ in range(500)]
    got = {r["class"]: r for r in ev.classification_report(pairs(spark, rows)).collect()}

    def prf(cls):
        tp = sum(l == cls and (p > 0.5) == cls for l, p in rows)
        predicted = sum((p > 0.5) == cls for _, p in rows)
        support = sum(l == cls for l, _ in rows)
        precision, recall = tp / predicted, tp / support
        return precision, recall, 2 * precision * recall / (precision + recall), support

    clean, bad = prf(0), prf(1)
    for name, want in (("Clean", clean), ("Vulnerable", bad)):
        row = got[name]
        assert (row.precision, row.recall, row.f1) == tuple(round(v, 4) for v in want[:3]) and row.support == want[3]
    for i, name in enumerate(("precision", "recall", "f1")):
        assert got["macro avg"][name] == pytest.approx((clean[i] + bad[i]) / 2, abs=6e-5)
        assert got["weighted avg"][name] == pytest.approx((clean[i] * clean[3] + bad[i] * bad[3]) / 500, abs=6e-5)
    accuracy = sum(l == (p > 0.5) for l, p in rows) / 500
    assert got["accuracy"].f1 == round(accuracy, 4) and got["accuracy"].precision is None and got["accuracy"].support == 500


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_auc_by_brute_force_and_evaluator(spark, digits):
    rng = random.Random(digits)
    rows = [(l, round(min(1, max(0, rng.gauss(0.4 + 0.2 * l, 0.3))), digits)) for l in (0, 1) for _ in range(120)]
    df = pairs(spark, rows)
    wins = sum((a > b) + (a == b) / 2 for l, a in rows if l for m, b in rows if not m)
    got = ev.roc_auc(df).first().roc_auc
    assert got == pytest.approx(wins / 120**2, abs=1e-12)
    library = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="label", numBins=0).evaluate(
        df.withColumn("label", F.col("label").cast("double"))
    )
    assert got == pytest.approx(library, abs=1e-9)


def test_auc_needs_both_classes(spark):
    assert ev.roc_auc(pairs(spark, [(1, 0.5), (1, 0.7)])).first().roc_auc is None
    assert ev.roc_auc(pairs(spark, [])).first().roc_auc is None


def test_log_loss(spark):
    rows = [(1, 0.9), (0, 0.2), (1, 0.0), (0, 1.0)]
    eps = 1e-7
    want = -sum(math.log(min(max(p if l else 1 - p, eps), 1 - eps)) for l, p in rows) / 4
    assert ev.log_loss(pairs(spark, rows)).first().log_loss == pytest.approx(want, rel=1e-6)


def test_parity(spark):
    left = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.1), (3, 0.2)], "id int, p double")
    close = spark.createDataFrame([(1, 0.50005), (2, 0.5), (4, 0.9)], "id int, p double")
    row = ev.score_parity(left, close, "id", "p").first()
    assert (row.compared, row.unmatched, row.passed) == (2, 2, True) and row.max_diff == pytest.approx(5e-5)
    copies = spark.createDataFrame([(3, 0.15), (3, 0.3)], "id int, p double")
    row = ev.score_parity(left, copies, "id", "p").first()
    assert row.max_diff == pytest.approx(0.2) and not row.passed
    assert ev.score_parity(left, left.limit(0), "id", "p").first().passed is False


def test_labels_meet_by_key(spark):
    predictions = spark.createDataFrame([("b", 1), ("a", 0)], "id string, pred int")
    labels = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "id string, label int")
    got = sorted(tuple(r) for r in ev.pair_with_labels(predictions, labels, "id").select("id", "pred", "label").collect())
    assert got == [("a", 0, 0), ("b", 1, 1)]
