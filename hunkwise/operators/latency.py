"""Exact latency percentiles that hold up when one group has most of the rows.

Rows of a large group are reduced to (group, value, count) on the map side. The
rank of a percentile is then found in two steps, first among the bins of a group
and then among the values of one bin, so no task sorts or holds the group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from hunkwise.functions.order import order_bin

# Width of a latency bucket, and how many a chart shows.
BUCKET_MS = 10_000
CHART_BUCKETS = 30


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """1-based rank ``ceil(n q)``."""
    return lambda n: F.greatest(F.ceil(n * F.lit(str(q)).cast("decimal(9,6)")), F.lit(1)).cast("bigint")


def floor_index(q: float) -> Callable[[Column], Column]:
    """1-based rank of the 0-based index ``floor(n q)``."""
    return lambda n: (F.floor(n * F.lit(str(q)).cast("decimal(9,6)")) + 1).cast("bigint")


def value_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(group, value, n), the mergeable form of a latency series."""
    known = rows.dropna(subset=[*by, value])
    return known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def select_ranks(
    counts: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """One row per group with the value at each rank, from ``value_counts`` rows."""
    binned = counts.withColumn("bin", order_bin(F.col(value)))
    bins = binned.groupBy(*by, "bin").agg(F.sum("n").alias("in_bin"))
    group = Window.partitionBy(*by)
    through = F.sum("in_bin").over(group.orderBy("bin"))
    targets = F.array(
        *(F.struct(F.lit(name).alias("name"), rank(F.col("total")).alias("rank")) for name, rank in ranks.items())
    )
    # Exactly one bin of a group holds each rank.
    chosen = (
        bins.withColumn("through", through)
        .withColumn("total", F.sum("in_bin").over(group))
        .withColumn("below", F.col("through") - F.col("in_bin"))
        .withColumn("target", F.explode(targets))
        .filter((F.col("below") < F.col("target.rank")) & (F.col("target.rank") <= F.col("through")))
        .select(*by, "bin", F.col("target.name").alias("name"), (F.col("target.rank") - F.col("below")).alias("left_over"))
    )
    if not by:
        chosen = F.broadcast(chosen)  # one row per rank asked for
    in_bin = Window.partitionBy(*by, "bin", "name").orderBy(value)
    picked = (
        binned.join(chosen, [*by, "bin"])
        .withColumn("reached", F.sum("n").over(in_bin))
        .filter((F.col("reached") >= F.col("left_over")) & (F.col("reached") - F.col("n") < F.col("left_over")))
    )
    return picked.groupBy(*by).agg(
        *(F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in ranks)
    )


def latency_percentiles(results: DataFrame, value: str = "latency_ms") -> DataFrame:
    """p50, p95 and p99 by nearest rank over all rows."""
    counts = value_counts(results, [], value)
    return select_ranks(
        counts, [], value, {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95), "p99": nearest_rank(0.99)}
    )


def bucket_start(timestamp: Column, width_ms: int = BUCKET_MS) -> Column:
    return timestamp - F.pmod(timestamp, F.lit(width_ms))


def buckets_from_counts(counts: DataFrame, bucket: str = "bucket_ms", value: str = "latency_ms") -> DataFrame:
    """Mean and p99 of each bucket, from its value counts."""
    means = counts.groupBy(bucket).agg(
        F.sum("n").alias("samples"),
        (F.sum(F.col(value).cast("double") * F.col("n")) / F.sum("n")).alias("latency"),
    )
    return means.join(select_ranks(counts, [bucket], value, {"p99": floor_index(0.99)}), bucket)


def latency_buckets(results: DataFrame, width_ms: int = BUCKET_MS, value: str = "latency_ms") -> DataFrame:
    """Mean and p99 of each bucket, however many rows it has."""
    rows = results.select(bucket_start(F.col("timestamp"), width_ms).alias("bucket_ms"), value)
    return buckets_from_counts(value_counts(rows, ["bucket_ms"], value), value=value)


def last_buckets(
    results: DataFrame, width_ms: int = BUCKET_MS, limit: int = CHART_BUCKETS, value: str = "latency_ms"
) -> DataFrame:
    """The newest buckets.

    Their starts are found first, and only rows of those few buckets are counted.
    """
    rows = results.select(bucket_start(F.col("timestamp"), width_ms).alias("bucket_ms"), value)
    newest = rows.filter(F.col(value).isNotNull()).select("bucket_ms").distinct().orderBy(F.desc("bucket_ms")).limit(limit)
    recent = rows.join(newest, "bucket_ms", "left_semi")
    return buckets_from_counts(value_counts(recent, ["bucket_ms"], value), value=value)
