"""Column expressions of the two-class risk model."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

VULNERABLE, CLEAN = "vulnerable", "clean"
# Fixed value: a probability must exceed this to count as vulnerable.
THRESHOLD = 0.5


def vulnerable_probability(logit0: Column, logit1: Column) -> Column:
    """Second component of the two-class softmax, shifted by the larger logit."""
    top = F.greatest(logit0, logit1)
    e0, e1 = F.exp(logit0 - top), F.exp(logit1 - top)
    return e1 / (e0 + e1)


def is_vulnerable(confidence: Column) -> Column:
    # Spark ranks NaN above all numbers; an undefined or missing score is not vulnerable.
    return F.coalesce((confidence > THRESHOLD) & ~F.isnan(confidence), F.lit(False))


def label_of(confidence: Column) -> Column:
    return F.when(is_vulnerable(confidence), VULNERABLE).otherwise(CLEAN)
