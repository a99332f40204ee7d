import hashlib
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hunkwise.functions import model
from hunkwise.operators import evaluation, scoring, training
from hunkwise.schemas import HISTORY
from hunkwise.sources import tables


def dataset(spark, n=300):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.4
        words = ["gets", "strcpy", "free"] if bad else ["return", "size", "check"]
        code = " ".join(rng.choice(words + ["int", "char"]) for _ in range(12))
        rows.append((i, f"id{i}", code, int(bad), "p", "c", "test" if i % 5 == 0 else "train"))
    return spark.createDataFrame(rows, "key int, id string, func string, target int, project string, commit_id string, split string")


def test_prepare(spark):
    assert training.prepare(dataset(spark, 3)).columns == ["key", "code", "label", "split"]


def test_split_by_hash(spark):
    prepared = training.prepare(dataset(spark))
    got = {r.key: r.split for r in training.with_validation(prepared, "key").collect()}

    def tenth(key):
        return int(hashlib.md5(f"42:{key}".encode()).hexdigest()[:8], 16) % 10

    want = {k: "test" if k % 5 == 0 else "validation" if tenth(k) == 0 else "train" for k in got}
    assert got == want and "validation" in got.values()
    again = {r.key: r.split for r in training.with_validation(prepared.repartition(7), "key").collect()}
    assert again == got


def test_existing_validation_is_kept(spark):
    prepared = training.prepare(dataset(spark)).withColumn(
        "split", F.when(F.col("key") == 1, "validation").otherwise(F.col("split"))
    )
    assert training.with_validation(prepared, "key").exceptAll(prepared).count() == 0


def test_counts_and_stats_file(spark, tmp_path):
    split = training.with_validation(training.prepare(dataset(spark)), "key")
    counts = {r.split: r["rows"] for r in training.split_counts(split).collect()}
    assert sum(counts.values()) == 300
    for r in training.label_distribution(split).collect():
        assert r.samples == counts[r.split] == r.vulnerable + r.clean
    path = str(tmp_path / "stats")
    tables.write_json(training.dataset_stats(split, "m"), path)
    (text,) = [p.read_text() for p in (tmp_path / "stats").glob("part-*") if p.stat().st_size]
    assert json.loads(text) == {"model_name": "m", "max_length": 512, "splits": counts}
    tables.write_dataset(split, str(tmp_path / "data"))
    stored = tables.read_dataset(spark, str(tmp_path / "data"))
    assert stored.select(split.columns).exceptAll(split).count() == 0
    assert "PartitionFilters: [isnotnull(split" in stored.filter("split = 'test'")._jdf.queryExecution().executedPlan().toString()


def test_token_weights(spark):
    df = spark.createDataFrame([("a b b", 0), ("b c", 1), ("c c c", 1)], "code string, label int")
    got = {r.token: (r.w0, r.w1) for r in training.token_weights(df, 3).collect()}
    n = {0: Counter("abb"), 1: Counter("bcccc")}
    for t in "abc":
        want = [round(math.log((n[y][t] + 1) / (sum(n[y].values()) + 3)) * 1024) / 1024 for y in (0, 1)]
        assert got[t] == pytest.approx(want, abs=1e-9)
    assert {r.token for r in training.token_weights(df, 2).collect()} == {"b", "c"}


def test_token_weights_separate_the_classes(spark):
    data = training.prepare(dataset(spark))
    weights = training.token_weights(data.filter("split = 'train'"), 100)
    scored = scoring.linear_logits(data.filter("split = 'test'"), weights)
    prob = model.vulnerable_probability(F.col("logit0"), F.col("logit1"))
    metrics = evaluation.binary_metrics(evaluation.with_prediction(scored.withColumn("prob", prob))).first()
    assert metrics.accuracy > 0.95


def test_training_history(spark, tmp_path):
    split = training.with_validation(training.prepare(dataset(spark)), "key")
    history, models = training.train(split, (1, 4), str(tmp_path / "features"))
    rows = {r.epoch: r for r in history.collect()}
    assert set(rows) == set(models) == {1, 4}
    assert rows[4].train_loss < rows[1].train_loss
    base_rate = 1 - split.agg(F.avg("label")).first()[0]
    assert rows[4].train.accuracy > base_rate and rows[4].val.f1 > 0.9
    path = str(tmp_path / "history")
    tables.write_json(history, path)
    assert {r.epoch: r for r in tables.read_history(spark, path).collect()} == rows
    # A whole pipeline, from code to label, comes with each row.
    test = training.predict(split.filter("split = 'test'"), models[4])
    assert evaluation.binary_metrics(test).first().accuracy > 0.9
    assert training.fit(split, 2).transform(split.limit(2)).count() == 2


def history(spark, *f1):
    rows = [(i + 1, 0.0, 0.0, (0.0, 0.0, 0.0, 0.0), (0.0, v, 0.0, 0.0)) for i, v in enumerate(f1)]
    return spark.createDataFrame(rows, HISTORY)


@pytest.mark.parametrize("f1, want", [((0.1, 0.5, 0.5, 0.4), [2]), ((0.0, 0.0), []), ((0.3,), [1])])
def test_best_epoch(spark, f1, want):
    assert [r.epoch for r in training.best_epoch(history(spark, *f1)).collect()] == want


def test_words_of_the_pipeline(spark):
    assert re.split(r"\W+", "int f(a)")[:3] == ["int", "f", "a"]
    with pytest.raises(ValueError):
        training.train(training.prepare(dataset(spark, 20)), (), "/tmp/hunkwise-unused")
