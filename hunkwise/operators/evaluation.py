"""Classification metrics as aggregations over (label, pred, prob) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hunkwise.functions.model import THRESHOLD
from hunkwise.functions.order import order_bin

# Class names of a report, and the largest score difference that passes.
CLASS_NAMES = ("Clean", "Vulnerable")
PARITY_TOLERANCE = 1e-4

_EPSILON = 1e-7


def with_prediction(scored: DataFrame, prob: str = "prob") -> DataFrame:
    return scored.withColumn("pred", (F.col(prob) > THRESHOLD).cast("int"))


def pair_with_labels(predictions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Predictions and labels of the same key side by side."""
    return predictions.join(labels, key)


def confusion_counts(pairs: DataFrame, *by: str) -> DataFrame:
    def cell(label: int, pred: int) -> Column:
        return F.count_if((F.col("label") == label) & (F.col("pred") == pred))

    return pairs.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def _ratio(part: Column, whole: Column) -> Column:
    """0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)


def binary_metrics(pairs: DataFrame, *by: str) -> DataFrame:
    """Accuracy, and precision, recall and F1 of the positive class."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall, f1 = _prf(tp, fp, fn)
    return confusion_counts(pairs, *by).select(
        *by,
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        f1.alias("f1"),
        precision.alias("precision"),
        recall.alias("recall"),
    )


def classification_report(pairs: DataFrame, digits: int = 4) -> DataFrame:
    """Per-class rows, then accuracy and the macro and weighted means."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def scores(counts: tuple[Column, Column, Column], support: Column) -> Column:
        precision, recall, f1 = _prf(*counts)
        return F.struct(
            precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), support.alias("support")
        )

    classes = confusion_counts(pairs).select(
        "*", scores((tn, fn, fp), tn + fp).alias("c0"), scores((tp, fp, fn), tp + fn).alias("c1")
    )
    total = tn + fp + fn + tp

    def line(name: str, precision, recall, f1, support) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *(F.round(value, digits).alias(n) for n, value in (("precision", precision), ("recall", recall), ("f1", f1))),
            support.alias("support"),
        )

    def of_class(index: int) -> Column:
        c = f"c{index}"
        return line(CLASS_NAMES[index], *(F.col(f"{c}.{n}") for n in ("precision", "recall", "f1", "support")))

    def mean(name: str, weight0: Column, weight1: Column) -> Column:
        values = (
            _ratio(
                F.col(f"c0.{n}") * weight0 + F.col(f"c1.{n}") * weight1, weight0 + weight1
            )
            for n in ("precision", "recall", "f1")
        )
        return line(name, *values, total)

    one = F.lit(1)
    none = F.lit(None).cast("double")
    lines = F.array(
        of_class(0),
        of_class(1),
        line("accuracy", none, none, _ratio(tn + tp, total), total),
        mean("macro avg", one, one),
        mean("weighted avg", F.col("c0.support"), F.col("c1.support")),
    )
    return classes.select(F.inline(lines))


def roc_auc(pairs: DataFrame, score: str = "prob") -> DataFrame:
    """Area under the ROC curve; equal scores count half.

    Rows are first reduced to one per score. Scores are then ordered inside bins
    in parallel, and only one row per bin reaches the final running sum. The
    scorers give 32-bit scores, of which a bin has few; 64-bit ones give the same
    result, but a bin then holds as many rows as it has different scores.
    """
    per_score = pairs.groupBy(score).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    binned = per_score.withColumn("bin", order_bin(F.col(score)))
    lower = Window.partitionBy("bin").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(lower), F.lit(0))
    per_bin = (
        binned.withColumn("won", F.col("pos").cast("double") * (below + F.col("neg") / 2))
        .groupBy("bin")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won"))
    )
    # The bins are few whatever the data, see order_bin.
    lower_bins = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("won") + F.col("pos").cast("double") * F.coalesce(F.sum("neg").over(lower_bins), F.lit(0))
    totals = per_bin.select("pos", "neg", won.alias("won")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won")
    )
    return totals.select(
        F.try_divide(F.col("won"), F.col("pos").cast("double") * F.col("neg")).alias("roc_auc")
    )


def log_loss(pairs: DataFrame, *by: str, prob: str = "prob") -> DataFrame:
    """Mean cross-entropy, with probabilities kept off 0 and 1."""
    p = F.least(F.greatest(F.col(prob).cast("double"), F.lit(_EPSILON)), F.lit(1 - _EPSILON))
    loss = -F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p))
    return pairs.groupBy(*by).agg(F.avg(loss).alias("log_loss"))


def score_parity(
    left: DataFrame, right: DataFrame, key: str, score: str, tolerance: float = PARITY_TOLERANCE
) -> DataFrame:
    """Largest score difference between rows of the same key.

    Both sides are reduced to their range per key in one aggregation; copies of a
    key are combined before the shuffle and never paired with each other.
    """
    value = F.col(score).cast("double")
    sides = left.select(key, value.alias("a"), F.lit(None).cast("double").alias("b")).unionByName(
        right.select(key, F.lit(None).cast("double").alias("a"), value.alias("b"))
    )
    ranges = sides.groupBy(key).agg(
        F.max("a").alias("max_a"), F.min("a").alias("min_a"), F.max("b").alias("max_b"), F.min("b").alias("min_b")
    )
    both = F.col("max_a").isNotNull() & F.col("max_b").isNotNull()
    gap = F.greatest(F.col("max_a") - F.col("min_b"), F.col("max_b") - F.col("min_a"))
    return ranges.agg(
        F.count_if(both).alias("compared"),
        F.count_if(~both).alias("unmatched"),
        F.max(F.when(both, gap)).alias("max_diff"),
    ).withColumn("passed", F.coalesce(F.col("max_diff") < tolerance, F.lit(False)))
