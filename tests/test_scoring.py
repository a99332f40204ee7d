import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from hunkwise.functions import model
from hunkwise.operators import ranking, scoring

CODES = ["int f(int a) { return a; }", "", "the the the", "unknown words", "x = é_1 + 名前", "f(f(f()))", "int f(int a) { return a; }"]
WEIGHTS = [("int", 0.5, -0.25), ("f", 1.0, 2.0), ("(", 0.125, 0.25), ("the", -1.0, 3.0), ("é_1", 4.0, 0.0), ("名前", 0.0, 8.0)]


def snippets(spark, codes=CODES):
    rows = [(code, "r", "abcdef1234", f"f{i}.c", i, i, 7) for i, code in enumerate(codes)]
    return spark.createDataFrame(
        rows, "code string, repo string, commit_sha string, file_path string, start_line int, end_line int, timestamp bigint"
    )


def weights(spark, rows=WEIGHTS):
    return spark.createDataFrame(rows, "token string, w0 double, w1 double")


def words(code):
    return re.findall(r"\w+|[^\w\s]", code)


def expected_logits(codes=CODES, rows=WEIGHTS, bias=(0.0, 0.0)):
    table = {t: (a, b) for t, a, b in rows}
    out = []
    for code in codes:
        hits = [table.get(t, (0.0, 0.0)) for t in words(code)]
        out.append((bias[0] + sum(h[0] for h in hits), bias[1] + sum(h[1] for h in hits)))
    return out


def logits(df):
    return [(r.logit0, r.logit1) for r in df.orderBy("start_line").collect()]


def test_linear_logits(spark):
    scored = scoring.linear_logits(snippets(spark), weights(spark), (0.5, -0.5))
    assert logits(scored) == expected_logits(bias=(0.5, -0.5))


def test_missing_code_has_no_tokens(spark):
    rows = snippets(spark).withColumn("code", F.lit(None).cast("string")).limit(1)
    out = scoring.with_label(scoring.linear_logits(rows, weights(spark), (0.0, 1.0))).first()
    assert (out.logit0, out.logit1, out.is_anomalous, out.label) == (0.0, 1.0, True, "vulnerable")


def test_weights_and_vocabulary_of_any_size(spark):
    many = spark.range(200_000).select(F.concat(F.lit("t"), F.col("id")).alias("token"), F.lit(1.0).alias("w0"), F.lit(-1.0).alias("w1"))
    rows = snippets(spark, ["t1 t199999 t1 other", "x"])
    assert logits(scoring.linear_logits(rows, many)) == [(3.0, -3.0), (0.0, 0.0)]
    vocabulary = many.select("token", (F.substring("token", 2, 9).cast("int") + 2).alias("token_id"))
    ids = [list(r.input_ids) for r in scoring.encode(rows, vocabulary, max_length=4).orderBy("start_line").collect()]
    assert ids == [[3, 200_001, 3, 1], [1, 0, 0, 0]]


def test_repeated_weights_add_up(spark):
    got = logits(scoring.linear_logits(snippets(spark), weights(spark, WEIGHTS + [("f", 1.0, 1.0)])))
    assert got[5] == (3 * 2.0 + 3 * 0.125, 3 * 3.0 + 3 * 0.25)


def test_empty_weights(spark):
    assert set(logits(scoring.linear_logits(snippets(spark), weights(spark, [])))) == {(0.0, 0.0)}


def test_frequent_tokens_tie_together(spark):
    df = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 1), ("e", 1), ("f", 1)], "token string, n bigint")
    got = [sorted(r.token for r in scoring.frequent_tokens(df, most).collect()) for most in (0, 1, 2, 3, 5, 6, 100)]
    assert got == [[], ["a"], ["a"], ["a", "b", "c"], ["a", "b", "c"], [*"abcdef"], [*"abcdef"]]
    assert scoring.frequent_tokens(df.limit(0), 5).collect() == []


MIXED = [*CODES, None, "rare1 rare2 f rare1", "f", "zz zz", "f f f f f f ( ( ( ("]


@pytest.mark.parametrize("most", [0, 1, 3, 1 << 17])
def test_frequent_and_rare_tokens_add_up(spark, monkeypatch, most):
    monkeypatch.setattr(scoring, "FREQUENT_TOKENS", most, raising=False)
    rows = [*WEIGHTS, ("rare1", 16.0, 32.0), ("rare1", 64.0, 128.0), (" 1", 1.0, 1.0), ("zz", None, 7.0), (None, 5.0, 5.0)]
    hits = {t: (sum(a or 0 for k, a, _ in rows if k == t), sum(b for k, _, b in rows if k == t)) for t, *_ in rows if t}
    want = [tuple(sum(hits.get(t, (0.0, 0.0))[i] for t in words(code or "")) for i in (0, 1)) for code in MIXED]
    assert logits(scoring.linear_logits(snippets(spark, MIXED), weights(spark, rows))) == want


def no_broadcast_by_size(spark, run):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_frequent_tokens_meet_their_weights_before_a_shuffle(spark):
    plan = no_broadcast_by_size(spark, lambda: plan_of(scoring.linear_logits(snippets(spark), weights(spark)))).split("Initial Plan")[0]
    assert "BroadcastHashJoin" in plan
    # 16 bytes identify a text in the shuffles, not 64 digits.
    assert re.search(r"code_key#\d+", plan) and "code_hash" not in plan


def test_labels(spark):
    rows = [(0.0, 0.0), (0.0, 1e-3), (1e-3, 0.0), (-1000.0, 1000.0), (1000.0, -1000.0), (710.0, 709.0), (0.0, 1e-12)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, logit0 double, logit1 double")
    out = scoring.with_label(df).orderBy("i").collect()
    for (a, b), row in zip(rows, out):
        top = max(a, b)
        p = np.float32(math.exp(b - top) / (math.exp(a - top) + math.exp(b - top)))
        assert row.confidence == pytest.approx(float(p), rel=1e-6)
        assert row.is_anomalous == bool(p > 0.5)
        assert row.label == ("vulnerable" if p > 0.5 else "clean")
    assert out[0].label == "clean" and out[6].label == "clean"


def test_vocabulary_and_encoding(spark):
    df = snippets(spark, ["b a a", "a b c ( (", "", " ".join("a" for _ in range(600))])
    vocabulary = scoring.token_vocabulary(df, 3)
    assert [(r.token, r.n, r.token_id) for r in vocabulary.orderBy("token_id").collect()] == [
        ("a", 603, 2), ("(", 2, 3), ("b", 2, 4),
    ]
    rows = scoring.encode(df, vocabulary, max_length=8).orderBy("start_line").collect()
    assert [list(r.input_ids) for r in rows] == [
        [4, 2, 2, 0, 0, 0, 0, 0], [2, 4, 1, 3, 3, 0, 0, 0], [0] * 8, [2] * 8,
    ]
    assert [list(r.attention_mask) for r in rows] == [[1] * 3 + [0] * 5, [1] * 5 + [0] * 3, [0] * 8, [1] * 8]
    assert [r.n_tokens for r in rows] == [3, 5, 0, 600]


@pytest.mark.parametrize("most", [0, 2, 1 << 17])
def test_encoding_of_frequent_and_rare_tokens(spark, monkeypatch, most):
    monkeypatch.setattr(scoring, "FREQUENT_TOKENS", most, raising=False)
    df = snippets(spark, ["b a a", "b a a", None, "a b c ( (", "zz yy", "", "c zz a b"])
    vocabulary = spark.createDataFrame([("a", 2), ("(", 3), ("b", 4), ("c", 5)], "token string, token_id int")
    rows = scoring.encode(df, vocabulary, max_length=4).orderBy("start_line").collect()
    assert [list(r.input_ids) for r in rows] == [
        [4, 2, 2, 0], [4, 2, 2, 0], [0] * 4, [2, 4, 5, 3], [1, 1, 0, 0], [0] * 4, [5, 1, 2, 4],
    ]
    assert [r.n_tokens for r in rows] == [3, 3, 0, 5, 2, 0, 4]


def test_frequent_tokens_are_encoded_before_a_shuffle(spark):
    vocabulary = spark.createDataFrame([("a", 2), ("(", 3)], "token string, token_id int")
    out = scoring.encode(snippets(spark), vocabulary).select("start_line", "n_tokens", "input_ids")
    plan = no_broadcast_by_size(spark, lambda: plan_of(out)).split("Initial Plan")[0]
    assert plan.count("BroadcastHashJoin") >= 2 and "code_hash" not in plan


def test_undefined_score_is_clean(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), float("inf"))], "logit0 double, logit1 double")
    assert [r.label for r in scoring.with_label(df).collect()] == ["clean", "clean"]


@pytest.mark.parametrize("size", [1, 5, 37, 400, 5000])
def test_most_frequent(spark, size):
    rng = np.random.default_rng(size)
    rows = [(f"t{i:04d}", int(n)) for i, n in enumerate(rng.zipf(1.4, 900).clip(0, 10**9))]
    df = spark.createDataFrame(rows, "token string, n bigint")
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[:size]
    assert [tuple(r) for r in scoring.most_frequent(df, "n", size).collect()] == want


def test_vocabulary_counts_once(spark, tmp_path):
    path = str(tmp_path / "codes")
    snippets(spark).write.parquet(path)
    out = scoring.token_vocabulary(spark.read.parquet(path), 5)
    plan = plan_of(out).split("Initial Plan")[0]
    assert plan.count("ReusedExchange") >= 1


def test_vocabulary_of_all_tokens(spark):
    rng = np.random.default_rng(3)
    codes = [" ".join(f"t{i}" for i in rng.zipf(1.3, 400).clip(0, 10**6)) for _ in range(20)]
    # Half of all tokens occur once, so ranges of equal counts span several partitions.
    codes += [" ".join(f"once{i}x{k}" for k in range(300)) for i in range(8)]
    counts = Counter(token for code in codes for token in code.split())
    want = [(t, n, i) for i, (t, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])), scoring.FIRST_TERM_ID)]
    vocabulary = scoring.token_vocabulary(snippets(spark, codes))
    assert [tuple(r) for r in vocabulary.orderBy("token_id").collect()] == want
    assert "Window" not in plan_of(vocabulary)
    encoded = scoring.encode(snippets(spark, codes), vocabulary, max_length=4).orderBy("start_line").collect()
    ids = {t: i for t, _, i in want}
    assert [list(r.input_ids) for r in encoded] == [[ids[t] for t in code.split()[:4]] for code in codes]


def test_vocabulary_of_nothing(spark):
    assert scoring.token_vocabulary(snippets(spark, [])).collect() == []
    assert scoring.token_vocabulary(snippets(spark, ["", ""])).collect() == []


def test_rank_of_hot_counts(spark):
    rows = spark.range(50_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7).alias("n"))
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranking.with_rank(rows, [F.desc("n"), F.asc("k")])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    assert len({f.rsplit("/", 1)[1].split("-")[1] for f in got.inputFiles()}) > 1
    want = sorted(((k, 1 if k % 3 == 0 else k % 7) for k in range(50_000)), key=lambda r: (-r[1], r[0]))
    assert [(r.k, r.n, r.rank) for r in got.orderBy("rank").collect()] == [(k, n, i) for i, (k, n) in enumerate(want, 1)]


def loader(bad="BAD"):
    def load():
        def predict(codes):
            if any(bad in c for c in codes):
                raise ValueError("cannot score")
            return np.array([[0.0, float(len(c))] for c in codes])

        return predict

    return load


def test_batch_scorer(spark):
    rows = scoring.batch_logits(snippets(spark), loader()).orderBy("start_line").collect()
    assert [(r.logit0, r.logit1) for r in rows] == [(0.0, float(len(c))) for c in CODES]
    assert all(r.error is None and r.latency_ms >= 0 for r in rows)
    assert [r.file_path for r in rows] == [f"f{i}.c" for i in range(len(CODES))]


def test_batch_scorer_equals_linear_scorer(spark):
    table = {t: (a, b) for t, a, b in WEIGHTS}

    def load():
        import re as r

        def predict(codes):
            found = [[table.get(t, (0.0, 0.0)) for t in r.findall(r"\w+|[^\w\s]", c)] for c in codes]
            return np.array([[sum(h[0] for h in f), sum(h[1] for h in f)] for f in found])

        return predict

    assert logits(scoring.batch_logits(snippets(spark), load)) == expected_logits()


def test_failing_batch(spark):
    df = snippets(spark, ["ok", "BAD one", "fine"])
    with pytest.raises(Exception, match="cannot score"):
        scoring.batch_logits(df, loader()).collect()
    good, bad = scoring.split_failures(scoring.batch_logits(df, loader(), on_error="quarantine"))
    assert sorted((r.code, r.logit1) for r in good.collect()) == [("fine", 4.0), ("ok", 2.0)]
    assert [(r.code, r.error) for r in bad.collect()] == [("BAD one", "cannot score")]
    with pytest.raises(ValueError):
        scoring.batch_logits(df, loader(), on_error="ignore")


def test_wrong_shape_fails(spark):
    def load():
        return lambda codes: np.zeros((len(codes), 3))

    with pytest.raises(Exception, match="expected shape"):
        scoring.batch_logits(snippets(spark), load).collect()


def test_results_keep_the_snippet(spark):
    scored = scoring.with_label(scoring.linear_logits(snippets(spark), weights(spark)))
    rows = scoring.as_results(scored, F.lit(99)).orderBy("start_line").collect()
    assert rows[3].id.startswith("r/abcdef12/f3.c#L3@") and rows[3].code == CODES[3] and rows[3].timestamp == 99
    assert rows[0].latency_ms is None
    timed = scoring.as_results(scoring.with_label(scoring.batch_logits(snippets(spark), loader())))
    assert all(r.latency_ms is not None and r.timestamp == 7 for r in timed.collect())


def test_scored_once_per_row(spark):
    """Codes are cut into tokens once in the plan, although three columns depend on it."""
    scored = scoring.as_results(scoring.with_label(scoring.linear_logits(snippets(spark), weights(spark))))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
