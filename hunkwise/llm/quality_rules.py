"""Quality rules: fixed text rules, then a calibrated n-gram classifier.

The classifier is a logistic regression on hashed word and character n-grams,
fitted on labelled rows; its probability is calibrated on other labelled rows
and compared with a fixed threshold. Texts are scored in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from hunkwise.llm.common import is_held_out, learn_sample, map_batches, materialize, raw_texts

# Bounds of the labelled samples, per class: for the fit and for the calibration.
FIT_ROWS, CALIBRATION_ROWS = 2_000, 1_000
# The sample is small, and every step of the fit is a job over its partitions.
FIT_PARTITIONS = 4
# Fixed thresholds of the rules.
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
KEEP_PROBABILITY = 0.5
REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"

# Hashed features: words and word pairs, then 3- and 4-byte character n-grams.
_BITS = 14
_SIDE = 1 << _BITS
FEATURES = 2 * _SIDE
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - _BITS)
_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_STARTS_CHARACTER = (np.arange(256) & 0xC0) != 0x80


def _window_keys(ids: np.ndarray, distinct: int) -> np.ndarray:
    """An exact number for every ``REPEAT_WINDOW`` consecutive ids."""
    n = len(ids) - REPEAT_WINDOW + 1
    key, size = ids[:n], distinct
    for k in range(1, REPEAT_WINDOW):
        if size * distinct >= 1 << 62:
            found, key = np.unique(key, return_inverse=True)
            size = len(found)
        key, size = key * distinct + ids[k : k + n], size * distinct
    return key


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside a window of five that is found twice or more, its first place included."""
    if len(ids) <= REPEAT_WINDOW:
        return 0
    _, inverse, counts = np.unique(_window_keys(ids, distinct), return_inverse=True, return_counts=True)
    inside = np.zeros(len(ids) + 1, np.int64)
    places = np.flatnonzero(counts[inverse] > 1)
    inside[places] += 1
    inside[places + REPEAT_WINDOW] -= 1
    return int((np.cumsum(inside)[:-1] > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    again = 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return again


def n_gram_buckets(raw: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the word n-grams (n = 1, 2; from word hashes) and of the character n-grams (n = 3, 4)."""
    pairs = hashes[:-1] * np.uint64(31) + hashes[1:] + np.uint64(7)
    words = (np.concatenate([hashes, pairs]) * _MIX) >> _SHIFT
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    three = b[:-2] + (b[1:-1] << np.uint64(8)) + (b[2:] << np.uint64(16))
    four = three[:-1] + (b[3:] << np.uint64(24)) + np.uint64(1 << 40)
    chars = (np.concatenate([three, four]) * _MIX) >> _SHIFT
    return words.astype(np.int64), chars.astype(np.int64) + _SIDE


def number_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of a text, counted from 0, and a hash for each id."""
    words = raw.split()
    ids: dict[bytes, int] = {}
    numbered = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    return numbered, np.fromiter((zlib.crc32(w) for w in ids), np.uint64, len(ids))


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a text: the share of each bucket among the n-grams of its kind."""
    ids, hashes = number_words(raw)
    found, shares = [], []
    for buckets in n_gram_buckets(raw, hashes[ids]):
        index, counts = np.unique(buckets, return_counts=True)
        found.append(index)
        shares.append(counts / max(len(buckets), 1))
    return np.concatenate(found), np.concatenate(shares)


@dataclass(frozen=True)
class Model:
    """Weights of the n-gram shares, and the line that calibrates their sum."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, raw: bytes, hashes: np.ndarray) -> float:
        total = self.intercept
        for buckets in n_gram_buckets(raw, hashes):
            if len(buckets):
                total += float(self.weights[buckets].mean())
        return total

    def probability(self, margin: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -700, 700))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Model of label 1, from at most ``FIT_ROWS`` + ``CALIBRATION_ROWS`` rows of either class.

    The calibration rows are none of the fitted ones and are weighted by the
    shares of the classes among all rows that may be learnt from. Without both
    classes the probability is 1 everywhere.
    """
    sample = materialize(learn_sample(labels, label, FIT_ROWS + CALIBRATION_ROWS, salt=10), "quality-sample")
    rank = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FIT_ROWS + CALIBRATION_ROWS))
    chosen = (
        docs.select("doc_id", "text")
        .join(sample, "doc_id")
        .select("label", (rank < FIT_ROWS).alias("fitted"), F.coalesce("text", F.lit("")).alias("text"))
    )

    def sparse(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(raw) for raw in raw_texts(batch.column("text"))]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("label"),
                batch.column("fitted"),
                pa.array([i.astype(np.int32) for i, _ in rows], pa.list_(pa.int32())),
                pa.array([v for _, v in rows], pa.list_(pa.float64())),
            ],
            names=["label", "fitted", "at", "shares"],
        )

    rows = materialize(
        map_batches(chosen, sparse, "label int, fitted boolean, at array<int>, shares array<double>"), "quality-features"
    ).coalesce(FIT_PARTITIONS)
    to_vector = F.udf(lambda at, shares: Vectors.sparse(FEATURES, at, shares), VectorUDT())
    vectors = rows.select(F.col("label").cast("double").alias("label"), "fitted", to_vector("at", "shares").alias("features"))
    kinds = {(r["fitted"], r["label"]): r["rows"] for r in rows.groupBy("fitted", "label").agg(F.count(F.lit(1)).alias("rows")).collect()}
    if not (kinds.get((True, 0)) and kinds.get((True, 1))):
        return Model(np.zeros(FEATURES, np.float32), 0.0, 0.0, 700.0)
    fitted = LogisticRegression(maxIter=20, regParam=0.003).fit(vectors.filter("fitted"))
    model = Model(fitted.coefficients.toArray(), float(fitted.intercept))
    if not (kinds.get((False, 0)) and kinds.get((False, 1))):
        return model
    return _calibrated(model, fitted, vectors.filter(~F.col("fitted")), labels, label, kinds)


def _calibrated(model, fitted, held, labels, label, kinds) -> Model:
    """Two-parameter logistic fit of the margin, with the class shares of all learnable labels."""
    usable = labels.filter(F.col(label).isin(0, 1) & ~is_held_out(F.col("doc_id")))
    whole = {r[label]: r["rows"] for r in usable.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).collect()}
    first = F.udf(lambda v: Vectors.dense([float(v[1])]), VectorUDT())
    weight = F.when(F.col("label") == 1, whole[1] / kinds[(False, 1)]).otherwise(whole[0] / kinds[(False, 0)])
    margins = fitted.transform(held).select("label", first("rawPrediction").alias("features"), weight.alias("weight"))
    line = LogisticRegression(maxIter=50, regParam=1e-4, weightCol="weight", standardization=False).fit(margins)
    return Model(model.weights.astype(np.float32), model.intercept, float(line.coefficients[0]), float(line.intercept))


def judge(docs: DataFrame, model: Model, carry: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """(``carry``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, probability, base_failed, kept).

    Words are runs of anything but ASCII white space. A NULL or empty text has no
    words and fails; every row is judged on its own, repeated or not; an empty
    table gives no rows. Only the columns of ``carry`` are kept, and their names
    must differ from the new ones.
    """
    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*carry, "text"])))
    counted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(len(counted) + 1)]
        for raw in raw_texts(batch.column("text")):
            b = np.frombuffer(raw, np.uint8)
            ids, hashes = number_words(raw)
            columns[0].append(len(ids))
            columns[1].append(int((_STARTS_CHARACTER[b] & ~_WHITE[b]).sum()))
            columns[2].append(int(_SYMBOL[b].sum()))
            columns[3].append(duplicate_lines(raw))
            columns[4].append(repeated_words(ids, len(hashes)))
            columns[5].append(model.probability(model.margin(raw, hashes[ids])))
        return pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.float64())],
            names=[*batch.schema.names, *counted, "probability"],
        )

    schema = StructType([*rows.schema.fields, *(StructField(c, LongType()) for c in counted), StructField("probability", DoubleType())])
    scored = map_batches(rows, score, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    judged = scored.withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= KEEP_PROBABILITY))
