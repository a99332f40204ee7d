"""Labelled dataset to splits, fitted models and their history."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame, functions as F

from hunkwise.functions import text
from hunkwise.functions.model import vulnerable_probability
from hunkwise.operators import evaluation
from hunkwise.operators.scoring import MAX_LENGTH, most_frequent, pipeline_logits

# Share of training rows that becomes validation, and its seed.
VALIDATION_TENTHS = 1
SEED = 42

TRAIN, VALIDATION, TEST = "train", "validation", "test"
DROPPED = ("id", "project", "commit_id")
N_FEATURES = 1 << 16


def prepare(raw: DataFrame) -> DataFrame:
    """Model columns only: ``code`` and ``label`` (and what else the caller keeps)."""
    return raw.withColumnRenamed("func", "code").withColumnRenamed("target", "label").drop(*DROPPED)


def with_validation(dataset: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Moves a tenth of the training rows to validation unless there is one already.

    The row's own hash decides, so the result does not depend on partitioning.
    """
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8)
    tenth = F.conv(digits, 16, 10).cast("bigint") % 10
    existing = dataset.agg(F.count_if(F.col("split") == VALIDATION)).scalar()
    moved = (F.col("split") == TRAIN) & (tenth < VALIDATION_TENTHS) & (existing == 0)
    return dataset.withColumn("split", F.when(moved, VALIDATION).otherwise(F.col("split")))


def split_counts(dataset: DataFrame) -> DataFrame:
    return dataset.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def label_distribution(dataset: DataFrame) -> DataFrame:
    positive = F.count_if(F.col("label") == 1)
    return dataset.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"),
        positive.alias("vulnerable"),
        (F.count(F.lit(1)) - positive).alias("clean"),
    )


def dataset_stats(dataset: DataFrame, model_name: str, max_length: int = MAX_LENGTH) -> DataFrame:
    """One row: model name, input length and the size of each split."""

    def rows(split: str):
        return F.count_if(F.col("split") == split).alias(split)

    return dataset.agg(
        F.lit(model_name).alias("model_name"),
        F.lit(max_length).alias("max_length"),
        *(rows(split) for split in (TRAIN, VALIDATION, TEST)),
    ).select("model_name", "max_length", F.struct(TRAIN, VALIDATION, TEST).alias("splits"))


def token_weights(labelled: DataFrame, size: int | None = None, scale: int = 1024) -> DataFrame:
    """Closed-form two-class weights (token, w0, w1) from token counts per label.

    Smoothed log-likelihoods of all tokens, or of the ``size`` most frequent ones,
    rounded to multiples of ``1/scale``; with a power of two, sums are exact in any
    order.
    """
    counts = (
        labelled.select("label", F.explode_outer(text.tokens(F.col("code"))).alias("token"))
        .filter(F.col("token").isNotNull())
        .groupBy("token")
        .agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    )
    used = counts if size is None else most_frequent(counts.withColumn("n", F.col("n0") + F.col("n1")), "n", size)

    terms = F.count(F.lit(1))
    masses = used.agg(F.struct((F.sum("n0") + terms).alias("n0"), (F.sum("n1") + terms).alias("n1"))).scalar()

    def weight(name: str):
        return F.round(F.ln((F.col(name) + 1) / masses[name]) * scale) / scale

    return used.select("token", weight("n0").alias("w0"), weight("n1").alias("w1"))


def featurizer(n_features: int = N_FEATURES) -> Pipeline:
    """Hashed token counts weighted by inverse document frequency."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="code", outputCol="terms", pattern=r"\W+", toLowercase=False),
            HashingTF(inputCol="terms", outputCol="counts", numFeatures=n_features),
            IDF(inputCol="counts", outputCol="features"),
        ]
    )


def classifier(max_iter: int, reg_param: float = 0.01) -> LogisticRegression:
    return LogisticRegression(labelCol="label", featuresCol="features", maxIter=max_iter, regParam=reg_param)


def fit(dataset: DataFrame, max_iter: int, reg_param: float = 0.01) -> PipelineModel:
    rows = dataset.filter(F.col("split") == TRAIN)
    return Pipeline(stages=[*featurizer().getStages(), classifier(max_iter, reg_param)]).fit(rows)


def predict(rows: DataFrame, fitted: Transformer) -> DataFrame:
    """(split, label, prob, pred) of rows that carry the model's input column."""
    logits = pipeline_logits(rows, fitted)
    prob = vulnerable_probability(F.col("logit0"), F.col("logit1"))
    return evaluation.with_prediction(logits.select("split", "label", prob.alias("prob")))


def _epoch_row(scored: DataFrame, epoch: int) -> DataFrame:
    metrics = evaluation.binary_metrics(scored, "split").join(evaluation.log_loss(scored, "split"), "split")

    def of(split: str, value):
        return F.max(F.when(F.col("split") == split, value))

    numbers = F.struct("accuracy", "f1", "precision", "recall")
    return metrics.agg(
        F.lit(epoch).alias("epoch"),
        of(TRAIN, F.col("log_loss")).alias("train_loss"),
        of(VALIDATION, F.col("log_loss")).alias("val_loss"),
        of(TRAIN, numbers).alias("train"),
        of(VALIDATION, numbers).alias("val"),
    )


def train(dataset: DataFrame, epochs: Iterable[int], features_path: str) -> tuple[DataFrame, dict[int, PipelineModel]]:
    """A model per number of passes, and the history of their metrics.

    Features are computed once and written to ``features_path``, a folder all
    executors reach; every pass and every metric reads that table. The history
    has one row per pass.
    """
    used = dataset.filter(F.col("split").isin(TRAIN, VALIDATION)).select("code", "label", "split")
    prepared = featurizer().fit(used.filter(F.col("split") == TRAIN))
    features = prepared.transform(used).select("split", "label", "features")
    features.write.mode("overwrite").partitionBy("split").parquet(features_path)
    table = dataset.sparkSession.read.parquet(features_path)
    models, history = {}, None
    for epoch in epochs:
        fitted = classifier(epoch).fit(table.filter(F.col("split") == TRAIN))
        models[epoch] = PipelineModel(stages=[*prepared.stages, fitted])
        row = _epoch_row(predict(table, fitted), epoch)
        history = row if history is None else history.unionByName(row)
    if history is None:
        raise ValueError("no epochs given")
    return history, models


def best_epoch(history: DataFrame) -> DataFrame:
    """The first row with the highest validation F1 above zero."""
    return history.filter(F.col("val.f1") > 0).orderBy(F.desc("val.f1"), "epoch").limit(1)
