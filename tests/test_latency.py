import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from hunkwise.functions.order import order_bin
from hunkwise.operators import latency


def rows(spark, *pairs):
    return spark.createDataFrame([(t, float(v)) for t, v in pairs], "timestamp bigint, latency_ms float")


def f32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def test_percentiles_of_100(spark):
    values = [v * 1.5 for v in range(1, 101)]
    random.Random(1).shuffle(values)
    row = latency.latency_percentiles(rows(spark, *((0, v) for v in values))).first()
    ordered = sorted(values)
    assert (row.p50, row.p95, row.p99) == (ordered[49], ordered[94], ordered[98])


SIZES = [1, 2, 3, 7, 50, 99, 100, 101, 199, 200, 201, 300, 700, 1000]


def test_ranks_by_brute_force(spark):
    rng = random.Random(7)
    groups = {g: [f32(rng.choice([rng.expovariate(0.1), 0.0, 5.0, -1.5, rng.uniform(0, 1e-30)])) for _ in range(n)] for g, n in enumerate(SIZES)}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v float")
    counts = latency.value_counts(df, ["g"], "v")
    ranks = {"p50": latency.nearest_rank(0.5), "p95": latency.nearest_rank(0.95), "p99": latency.nearest_rank(0.99), "f99": latency.floor_index(0.99)}
    got = {r.g: r for r in latency.select_ranks(counts, ["g"], "v", ranks).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        s, n = sorted(values), len(values)
        for name, q in (("p50", 50), ("p95", 95), ("p99", 99)):
            assert got[g][name] == s[max(math.ceil(n * q / 100), 1) - 1], (n, name)
        assert got[g]["f99"] == s[n * 99 // 100], n


def test_rank_rules_differ_at_whole_numbers(spark):
    df = rows(spark, *((0, v) for v in range(200)))
    assert latency.latency_percentiles(df).first().p99 == 197.0
    assert latency.latency_buckets(df).first().p99 == 198.0


def test_buckets(spark):
    df = rows(spark, (9_999, 1), (10_000, 2), (19_999, 4), (-1, 8), (20_000, 3))
    got = {r.bucket_ms: (r.samples, r.latency, r.p99) for r in latency.latency_buckets(df).collect()}
    assert got == {0: (1, 1.0, 1.0), 10_000: (2, 3.0, 4.0), -10_000: (1, 8.0, 8.0), 20_000: (1, 3.0, 3.0)}


def test_unknown_latencies_do_not_count(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "timestamp bigint, latency_ms float")
    assert [tuple(r) for r in latency.latency_buckets(df).collect()] == [(0, 1, 2.0, 2.0)]
    assert latency.latency_buckets(df.limit(0)).collect() == []
    assert latency.latency_percentiles(df.limit(0)).first().p50 is None


def test_last_buckets(spark):
    df = rows(spark, *((b * 10_000 + i, b + i) for b in range(50) for i in range(3)))
    got = sorted((r.bucket_ms, r.p99) for r in latency.last_buckets(df).collect())
    assert got == [(b * 10_000, b + 2.0) for b in range(20, 50)]


def test_bins_keep_the_order(spark):
    rng = random.Random(3)
    values = sorted({f32(rng.choice([1, -1]) * 10 ** rng.uniform(-44, 38)) for _ in range(5000)} | {0.0, 3.4e38, -3.4e38, 1e-45})
    df = spark.createDataFrame([(f32(v),) for v in values], "v float").select("v", order_bin(F.col("v")).alias("bin"))
    bins = [r["bin"] for r in df.orderBy("v").collect()]
    assert bins == sorted(bins)
    assert max(bins) - min(bins) < 4 * (1 << 20)


@pytest.mark.parametrize("spread", [1, 4000])
def test_hot_bucket(spark, spread):
    """A third of all rows in one bucket."""
    n = 30_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") * 100).cast("bigint").alias("timestamp"),
        ((F.col("id") * 7919) % spread + 1).cast("float").alias("latency_ms"),
    )
    groups = {}
    for i in range(n):
        groups.setdefault(0 if i % 3 == 0 else i * 100 // 10_000 * 10_000, []).append(float((i * 7919) % spread + 1))
    got = {r.bucket_ms: r for r in latency.latency_buckets(df).collect()}
    assert set(got) == set(groups)
    for bucket, values in groups.items():
        row = got[bucket]
        assert (row.samples, row.p99) == (len(values), sorted(values)[len(values) * 99 // 100])
        assert row.latency == pytest.approx(sum(values) / len(values))


def test_hot_bucket_is_never_sorted_whole(spark, tmp_path):
    path = str(tmp_path / "r")
    rows(spark, *((i * 100, i % 50) for i in range(2000))).write.parquet(path)
    counts = latency.value_counts(spark.read.parquet(path).withColumn("g", F.lit(1)), ["g"], "latency_ms")
    out = latency.buckets_from_counts(counts, "g")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 2


def test_numbers_without_a_logarithm(spark):
    inf, nan = float("inf"), float("nan")
    values = [nan, inf, -inf, 0.0, -1.0, 1e300, 5e-324, 2.0]
    df = spark.createDataFrame([(0, v) for v in values], "timestamp bigint, latency_ms double")
    ordered = df.withColumn("bin", order_bin(F.col("latency_ms"))).orderBy("latency_ms").collect()
    assert [r["bin"] for r in ordered] == sorted(r["bin"] for r in ordered)
    row = latency.latency_percentiles(df).first()
    assert row.p50 == 5e-324 and row.p99 == inf  # NaN is no measurement
    assert latency.latency_buckets(df.filter("NOT isnan(latency_ms) AND latency_ms >= 0")).first().p99 == inf
