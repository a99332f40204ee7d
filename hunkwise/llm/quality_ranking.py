"""Quality scores from preferences: a Bradley-Terry model.

Every labelled good document is preferred to labelled bad ones. Logistic loss on
the feature differences of such pairs gives a linear strength; a quantile of the
strengths is the threshold, and the score is 1/2 there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from hunkwise.llm.common import is_held_out, learn_sample, learnable, map_batches, materialize, raw_texts
from hunkwise.operators.latency import select_ranks, value_counts

# Bounds: labelled rows of either class that are learnt from, and opponents of each.
LEARN_ROWS = 4_000
OPPONENTS = 8
# The sample is small, and every step of the fit is a job over its partitions.
FIT_PARTITIONS = 4

_MARKS = b"!|#*$%&<>?\",;:()[]{}=/\\_~^@+-"


def features(raw: bytes) -> np.ndarray:
    """Shape of a text, without its words themselves: lengths, repetition, case and punctuation."""
    words = raw.split()
    n = len(words)
    size = max(len(raw), 1)
    b = np.frombuffer(raw, np.uint8)
    counts = np.bincount(b, minlength=256)
    letters = counts[65:91].sum() + counts[97:123].sum()
    upper = counts[65:91].sum() / max(letters, 1)
    marks = counts[list(_MARKS)] / size
    stops = counts[list(b".!?")].sum()
    lines = raw.split(b"\n")
    lengths = np.fromiter(map(len, words), np.float64, n)
    repeats = sum(map(bytes.__eq__, words[:-1], words[1:])) / max(n - 1, 1)
    distinct = len(set(words)) / max(n, 1)
    shares = [upper, repeats, 1 - distinct, 1 - len(set(lines)) / len(lines), *marks, counts[48:58].sum() / size, (b >= 128).sum() / size]
    plain = [
        np.log1p(n),
        1.0 if n == 0 else 0.0,
        min(lengths.mean(), 50.0) / 10 if n else 0.0,
        min(lengths.std(), 50.0) / 10 if n else 0.0,
        np.log1p(n / (stops + 1)),
        np.log1p(n / len(lines)),
        distinct * np.log1p(n),
    ]
    return np.concatenate([np.sqrt(shares), np.minimum(np.array(shares) * 10, 3.0), plain])


N_FEATURES = len(features(b"a"))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    threshold: float

    def score(self, strength: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(strength - self.threshold, -700, 700)))


def strengths(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    return np.array([features(raw) for raw in raw_texts(texts)]).reshape(-1, N_FEATURES) @ weights


def _with_features(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep columns, features) of (keep columns, text)."""

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(raw) for raw in raw_texts(batch.column("text"))]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "features"]
        )

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]
    return map_batches(docs.select(*keep, "text"), compute, ", ".join([*kinds, "features array<double>"]))


def preference_pairs(rows: DataFrame) -> DataFrame:
    """(label, features) of pair differences, from (doc_id, label, features) of the bounded sample.

    Each good document meets ``OPPONENTS`` bad ones, chosen by hash, and each pair
    is put in both ways round, so that the fit needs no intercept. The ranks are
    taken over the bounded sample only.
    """
    bad = rows.filter("label = 0").select(
        (F.row_number().over(Window.orderBy("doc_id")) - 1).alias("rank"), F.col("features").alias("worse")
    )
    n_bad = bad.agg(F.count(F.lit(1))).scalar()
    drawn = F.explode(F.sequence(F.lit(1), F.lit(OPPONENTS)))
    good = rows.filter("label = 1").select("doc_id", F.col("features").alias("better"), drawn.alias("draw"))
    pairs = good.withColumn("rank", F.pmod(F.xxhash64("doc_id", "draw"), F.greatest(n_bad, F.lit(1))).cast("int")).join(bad, "rank")
    ways = F.explode(F.array(F.lit(1.0), F.lit(0.0))).alias("label")
    sign = F.when(F.col("label") == 1.0, 1.0).otherwise(-1.0)
    difference = F.zip_with("better", "worse", lambda x, y: x - y)
    return pairs.select(ways, difference.alias("difference")).select(
        "label", F.transform("difference", lambda x: x * sign).alias("features")
    )


def threshold(docs: DataFrame, labels: DataFrame, label: str, weights: np.ndarray) -> float:
    """Quantile, at the share of label 0, of the strengths of all documents that may be learnt from.

    The value of the 1-based rank ``floor(share (n - 1)) + 1``, or its mean with the
    next one by the rest of the product. Strengths are taken where the texts are read,
    so the join with the labels moves two numbers a row and no text. They are counted
    by value and found through bins, so no task holds them all; equal ones are one value,
    and a document at the threshold scores 1/2.
    """
    rows = docs.filter(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(strengths(batch.column("text"), weights))], names=["doc_id", "strength"])

    strong = map_batches(rows, measure, f"doc_id {kind}, strength double")
    measured = materialize(strong.join(learnable(labels, label), "doc_id").select("label", "strength"), "ranking-strengths")
    sizes = {r["label"]: r["rows"] for r in measured.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).collect()}
    total = sizes[0] + sizes[1]
    # share (total - 1), in whole numbers and a rest.
    below, rest = divmod(sizes[0] * (total - 1), total)
    ranks = {"low": lambda n: F.lit(below + 1), "high": lambda n: F.least(F.lit(below + 2), n)}
    found = select_ranks(value_counts(measured, [], "strength"), [], "strength", ranks).first()
    return float(found["low"] + (found["high"] - found["low"]) * (rest / total))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Model from at most ``LEARN_ROWS`` labelled rows of either class; held-out rows are never among them.

    The fit is bounded, the ``threshold`` is taken over all rows that may be learnt
    from. Without both classes all scores are 1/2.
    """
    sample = materialize(learn_sample(labels, label, LEARN_ROWS, salt=1), "ranking-sample")
    # Twice LEARN_ROWS ids at most: small at every size.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    rows = materialize(_with_features(chosen, "doc_id", "label"), "ranking-features")
    sizes = {r["label"]: r["rows"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(N_FEATURES), 0.0)
    pairs = preference_pairs(rows).select("label", array_to_vector("features").alias("features")).coalesce(FIT_PARTITIONS)
    weights = LogisticRegression(maxIter=60, regParam=1e-3, fitIntercept=False).fit(pairs).coefficients.toArray()
    return Model(weights, threshold(docs, labels, label, weights))


def rank(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all rows.

    A NULL or empty text has the features of an empty text and a score like any
    other; a NULL id is not held out; repeated rows are scored alike; an empty
    table gives no rows; other columns are not looked at.
    """

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = model.score(strengths(batch.column("text"), model.weights))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    scored = map_batches(rows, score, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
