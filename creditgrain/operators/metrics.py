"""Evaluation of a binary classifier as aggregations over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running_sums


def _threshold_counts(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score, the positives and negatives there, above, and overall.

    Curves and areas are of two classes: rows of other labels than 0 and 1 are left out.
    """
    counts = (
        scored.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(score).alias("threshold"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )
    # true of every group; keeps both counts in each use of the table
    counts = counts.where("pos + neg > 0")
    ranked = running_sums(counts, "threshold", ["pos", "neg"])
    return ranked.withColumns(
        {
            "tp": F.col("pos_total") - F.col("pos_below"),
            "fp": F.col("neg_total") - F.col("neg_below"),
        }
    )


def roc_auc(scored: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """Area under the ROC curve; NULL unless both classes are present."""
    t = _threshold_counts(scored, label, score)
    above = F.col("tp") - F.col("pos")
    area = F.sum(F.col("neg").cast("double") * (above + F.col("pos") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return t.agg(F.try_divide(area, pairs).alias("roc_auc"))


def _precision(tp, fp):
    return F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(1.0))


def _recall(tp):
    # without positives recall counts as 1 everywhere
    return F.coalesce(F.try_divide(tp.cast("double"), F.col("pos_total")), F.lit(1.0))


def pr_curve(scored: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """Precision and recall at each distinct score, and the end point
    (no threshold, precision 1, recall 0)."""
    t = _threshold_counts(scored, label, score)
    points = t.select(
        "threshold",
        _precision(F.col("tp"), F.col("fp")).alias("precision"),
        _recall(F.col("tp")).alias("recall"),
    )
    end = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def pr_auc(scored: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """Trapezoid area under the precision-recall curve."""
    t = _threshold_counts(scored, label, score)
    tp, fp = F.col("tp"), F.col("fp")
    # the next higher threshold is what remains without this score's own rows
    tp_next, fp_next = tp - F.col("pos"), fp - F.col("neg")
    is_last = (tp_next + fp_next) == 0
    recall_next = F.when(is_last, 0.0).otherwise(_recall(tp_next))
    height = (_precision(tp, fp) + _precision(tp_next, fp_next)) / 2
    return t.agg(F.sum((_recall(tp) - recall_next) * height).alias("pr_auc"))


def _cells(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows per (actual, predicted) class; rows without a label count nowhere."""
    kind = scored.schema[label].dataType
    return (
        scored.where(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("actual"), F.col(prediction).cast(kind).alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confusion_matrix(
    scored: DataFrame, label: str = "label", prediction: str = "prediction", classes: Sequence | None = None
) -> DataFrame:
    """One row per actual class with the number of rows predicted as each class.

    The classes are all that occur as a label or prediction, and each is a column
    of the result, so their names come to the driver; ``classes`` names them instead.
    """
    cells = _cells(scored, label, prediction)
    if classes is None:
        both = F.explode(F.array("actual", "predicted")).alias("c")
        classes = sorted(r.c for r in cells.select(both).where("c is not null").distinct().collect())
    kind = scored.schema[label].dataType.simpleString()
    listed = scored.sparkSession.createDataFrame([(c,) for c in classes], f"actual {kind}")
    counts = cells.groupBy("actual").agg(
        *[F.sum(F.when(F.col("predicted") == c, F.col("n"))).alias(f"predicted_{c}") for c in classes]
    )
    return listed.join(counts, "actual", "left").na.fill(0, [f"predicted_{c}" for c in classes])


def classification_report(
    scored: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs as a label or
    prediction, then accuracy and the macro and weighted averages.

    A ratio without rows is 0, rows without a label are left out, and without any
    row there is no line.
    """
    none = F.lit(0).cast("bigint")

    def part(of: str, support, hit, predicted):
        return F.struct(
            F.col(of).alias("c"), support.alias("support"), hit.alias("hit"), predicted.alias("predicted")
        )

    n = F.col("n")
    hit = F.when(F.col("actual") == F.col("predicted"), n).otherwise(none)
    parts = F.explode(F.array(part("actual", n, hit, none), part("predicted", none, none, n))).alias("r")
    sums = (
        _cells(scored, label, prediction)
        .select(parts)
        .where("r.c is not null")
        .groupBy(F.col("r.c").alias("c"))
        .agg(*[F.sum(f"r.{x}").alias(x) for x in ("support", "hit", "predicted")])
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    support, hits = F.col("support"), F.col("hit")
    lines = sums.select(
        "c",
        "support",
        "hit",
        ratio(hits, F.col("predicted")).alias("precision"),
        ratio(hits, support).alias("recall"),
        ratio(2 * hits, F.col("predicted") + support).alias("f1"),
    )
    every = Window.partitionBy()  # of one row per class
    rows = F.sum("support").over(every)
    measures = ("precision", "recall", "f1")

    def line(name, values, support):
        return F.struct(name.alias("class"), *[v.alias(m) for m, v in zip(measures, values, strict=True)], support.alias("support"))

    own = line(F.col("c").cast("string"), [F.col(m) for m in measures], support)
    nothing = F.lit(None).cast("double")
    accuracy = ratio(F.sum("hit").over(every), rows)
    averages = [
        line(F.lit("accuracy"), [nothing, nothing, accuracy], rows),
        line(F.lit("macro avg"), [F.avg(m).over(every) for m in measures], rows),
        line(F.lit("weighted avg"), [ratio(F.sum(F.col(m) * support).over(every), rows) for m in measures], rows),
    ]
    first = F.row_number().over(Window.orderBy("c")) == 1
    found = lines.select(F.when(first, F.array(own, *averages)).otherwise(F.array(own)).alias("r"))
    return found.select(F.explode("r").alias("r")).select("r.*")
