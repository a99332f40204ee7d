import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hunkwise.llm import common, quality_ranking, quality_rules

from .cases import awkward, frame

WHITE = " \t\n\x0b\x0c\r"


def split(text):
    for c in WHITE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def base(text):
    text = text or ""
    words = split(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = text.split("\n")
    again = sum(bool(split(line)) and line in lines[:i] for i, line in enumerate(lines))
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside), failed


def test_rules_by_brute_force(spark):
    rows = awkward() + [(900, "a b c d e " * 3 + "x y z " * 40), (901, "r\nr\n r\nr\n\n\n\t\n\t\n" + "q w e r t y " * 9), (902, "#*$%&|<> {} " * 5)]
    model = quality_rules.Model(quality_rules.np.zeros(quality_rules.FEATURES), 3.0)
    found = quality_rules.judge(frame(spark, rows), model).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found), key=repr)
    assert got == sorted(((i, *base(t)) for i, t, *_ in rows), key=repr)
    assert all(r.kept != r.base_failed for r in found)
    assert quality_rules.judge(frame(spark, rows).limit(0), model).collect() == []


def test_window_keys_without_packing():
    ids = quality_rules.np.array([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 9, 1, 2], quality_rules.np.int64)
    assert quality_rules.repeated_words(ids, 10) == quality_rules.repeated_words(ids, 1 << 40) == 10


@pytest.fixture(scope="module")
def data(spark):
    d = "/root/testdata/sf0.1"
    return common.read(spark, d, "documents"), common.read(spark, d, "labels")


def held_out_accuracy(scored, labels, value):
    held = scored.filter(common.is_held_out(F.col("doc_id"))).join(labels.select("doc_id", "quality"), "doc_id")
    return held.groupBy("quality").agg(F.avg((F.col(value).cast("int") == F.col("quality")).cast("int")).alias("right")).collect()


def test_verdict_on_held_out_rows(data):
    """The verdict as a whole: the rules catch repetition, which n-gram shares do not show, the classifier the rest."""
    docs, labels = data
    judged = quality_rules.judge(docs, quality_rules.fit(docs, labels))
    right = {r.quality: r.right for r in held_out_accuracy(judged, labels, "kept")}
    assert right[0] > 0.95, right
    passed = held_out_accuracy(judged.filter("NOT base_failed"), labels, "kept")
    assert {r.quality: r.right for r in passed}[1] > 0.98


def test_ranking_on_held_out_rows(data):
    docs, labels = data
    ranked = quality_ranking.rank(docs, quality_ranking.fit(docs, labels))
    right = {r.quality: r.right for r in held_out_accuracy(ranked, labels, "predicted")}
    assert right[1] > 0.97 and right[0] > 0.8, right
    for r in ranked.limit(200).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_held_out_labels_and_ids_do_not_matter(spark):
    docs = frame(spark, [(i, f"good words in a row {i} " * (i % 5 + 1) if i % 2 else "BAD!! " * (i % 7 + 2)) for i in range(300)])
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    flipped = labels.withColumn("quality", F.when(common.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality_ranking.fit(docs, x) for x in (labels, flipped))
    assert abs(one.weights - two.weights).max() < 1e-6 and abs(one.threshold - two.threshold) < 1e-6
    model = quality_rules.fit(docs, labels)
    assert abs(model.weights - quality_rules.fit(docs, flipped).weights).max() < 1e-6


def test_awkward_rows_and_missing_classes(spark):
    docs = frame(spark, awkward())
    labels = spark.createDataFrame([(1, 1), (5, 1), (None, 0), (6, None)], "doc_id bigint, quality int")
    ranked = quality_ranking.rank(docs, quality_ranking.fit(docs, labels)).collect()
    assert len(ranked) == len(awkward()) and {r.score for r in ranked} == {0.5}
    kept = quality_rules.judge(docs, quality_rules.fit(docs, labels)).collect()
    assert all(r.kept != r.base_failed for r in kept)
    assert quality_ranking.rank(docs.limit(0), quality_ranking.fit(docs.limit(0), labels)).collect() == []
