import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from creditgrain.operators import metrics


def scored(spark, rows):
    return spark.createDataFrame(rows, "p double, label int").repartition(3)


def brute_points(rows):
    """Precision and recall per distinct threshold, highest first."""
    total = sum(y for _, y in rows)
    out = []
    for t in sorted({p for p, _ in rows}, reverse=True):
        taken = [y for p, y in rows if p >= t]
        out.append((t, sum(taken) / len(taken), sum(taken) / total))
    return out


def test_golden(spark):
    df = scored(spark, [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)])
    assert metrics.roc_auc(df).first()[0] == pytest.approx(0.75)
    assert metrics.pr_auc(df).first()[0] == pytest.approx(0.7916667)


def test_against_brute_force_with_ties(spark):
    draw = random.Random(2)
    rows = []
    for _ in range(600):
        y = int(draw.random() < 0.3)
        rows.append((float(round(min(max(draw.gauss(0.4 + 0.2 * y, 0.2), 0), 1), 2)), y))
    df = scored(spark, rows)
    points = brute_points(rows)
    curve = {r.threshold: (r.precision, r.recall) for r in metrics.pr_curve(df).collect()}
    assert curve.pop(None) == (1.0, 0.0)
    assert set(curve) == {t for t, _, _ in points}
    for t, precision, recall in points:
        assert curve[t] == pytest.approx((precision, recall))
    area, before = 0.0, (1.0, 0.0)
    for _, precision, recall in points:
        area += (recall - before[1]) * (precision + before[0]) / 2
        before = (precision, recall)
    assert metrics.pr_auc(df).first()[0] == pytest.approx(area)
    spark_auc = BinaryClassificationEvaluator(rawPredictionCol="p", numBins=0).evaluate(df)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(spark_auc)


def test_single_class(spark):
    assert metrics.roc_auc(scored(spark, [(0.2, 1), (0.3, 1)])).first()[0] is None
    none = scored(spark, [(0.2, 0), (0.3, 0)])
    assert metrics.roc_auc(none).first()[0] is None
    assert {r.recall for r in metrics.pr_curve(none).collect() if r.threshold} == {1.0}


def test_report_and_confusion(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (0, 0)], "label int, prediction int")
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert (report["0"].precision, report["0"].recall, report["0"].support) == (0.75, 0.75, 4)
    assert (report["1"].precision, report["1"].recall, report["1"].f1) == (0.5, 0.5, 0.5)
    assert report["accuracy"].f1 == pytest.approx(4 / 6) and report["accuracy"].support == 6
    assert report["macro avg"].f1 == pytest.approx(0.625)
    assert report["weighted avg"].precision == pytest.approx((0.75 * 4 + 0.5 * 2) / 6)
    cells = {r.actual: (r.predicted_0, r.predicted_1) for r in metrics.confusion_matrix(df).collect()}
    assert cells == {0: (3, 1), 1: (1, 1)}
    never = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    one = {r["class"]: r for r in metrics.classification_report(never).collect()}["1"]
    assert (one.precision, one.recall, one.f1, one.support) == (0.0, 0.0, 0.0, 1)


def test_all_labels_count_and_missing_ones_do_not(spark):
    rows = [(0, 0), (1, 1), (2, 1), (2, 2), (None, 1)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert set(report) == {"0", "1", "2", "accuracy", "macro avg", "weighted avg"}
    assert (report["1"].precision, report["2"].recall, report["2"].support) == (0.5, 0.5, 2)
    assert report["accuracy"].f1 == 0.75 and report["accuracy"].support == 4
    assert report["weighted avg"].precision == pytest.approx((1 + 0.5 + 2) / 4)
    cells = {r.actual: (r.predicted_0, r.predicted_1, r.predicted_2) for r in metrics.confusion_matrix(df).collect()}
    assert cells == {0: (1, 0, 0), 1: (0, 1, 0), 2: (0, 1, 1)}
    assert metrics.classification_report(df.limit(0)).collect() == []
