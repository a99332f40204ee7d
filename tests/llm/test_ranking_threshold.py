"""The threshold of the ranking covers every row that may be learnt from, however small the fitted sample."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hunkwise.llm import quality_ranking

from .cases import frame, vocabulary


@pytest.mark.parametrize("n", [30, 700])
def test_quantile_of_all_learnable_rows(spark, monkeypatch, n):
    monkeypatch.setattr(quality_ranking, "LEARN_ROWS", 8)
    r, words = random.Random(n), vocabulary(200)
    noise = lambda good: "".join(r.choice(" !#|" if not good else "  .,") for _ in range(r.randint(0, 30)))
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 60))) + noise(i % 3)) for i in range(n)]
    rows += rows[:5] + [(10_000, "no label"), (None, "no id")]
    docs = frame(spark, rows)
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.signum(F.col("id") % 3).cast("int").alias("quality"))
    labels = labels.unionByName(labels.limit(3)).unionByName(spark.createDataFrame([(20_000, 0), (None, 1)], "doc_id bigint, quality int"))
    model = quality_ranking.fit(docs, labels)
    learnt = [(i, t) for i, t in rows if i is not None and i < n and zlib.crc32(str(i).encode()) % 3 != 1]
    strength = [float(quality_ranking.features(t.encode()) @ model.weights) for _, t in learnt]
    share = sum(i % 3 == 0 for i, _ in learnt) / len(learnt)
    assert abs(model.threshold - np.quantile(strength, share)) < 1e-9
