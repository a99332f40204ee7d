"""Live aggregates over the result stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from hunkwise.operators import latency, results as reads
from hunkwise.streaming.feed import _slot, _start

WIDTH = f"{latency.BUCKET_MS // 1000} seconds"
LATENESS = "10 minutes"


def latency_windows(results: DataFrame, width: str = WIDTH, lateness: str = LATENESS) -> DataFrame:
    """(window start, latency, n) of a result stream.

    State is one counter per different latency of a window, spread by its hash;
    no state row grows with the stream. Mean and p99 come from these counts when
    they are read, with ``read_latency_windows``.
    """
    timed = results.withColumn("at", F.timestamp_millis("timestamp")).withWatermark("at", lateness)
    counted = timed.groupBy(F.window("at", width).alias("span"), "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.unix_millis("span.start").alias("bucket_ms"), "latency_ms", "n")


def write_latency_windows(
    results: DataFrame,
    path: str,
    checkpoint: str,
    width: str = WIDTH,
    lateness: str = LATENESS,
    available_now: bool = False,
) -> StreamingQuery:
    """The counters that a batch changed, in a folder of its own; open windows are included."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    windows = latency_windows(results, width, lateness)
    return _start(windows.writeStream.outputMode("update").foreachBatch(write), checkpoint, available_now)


def late_rows(query: StreamingQuery) -> int:
    """Rows beyond ``lateness`` that were left out, in the batches that the query still reports."""
    return sum(state.numRowsDroppedByWatermark for progress in query.recentProgress for state in progress.stateOperators)


def read_latency_windows(spark: SparkSession, path: str) -> DataFrame:
    """Series so far. A counter only grows, so its largest value is the last one."""
    counters = spark.read.parquet(path).groupBy("bucket_ms", "latency_ms").agg(F.max("n").alias("n"))
    return latency.buckets_from_counts(counters)


def running_stats(results: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Totals since the start; the state is one row."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(_slot(path, batch_id))

    totals = reads.store_stats(results)
    return _start(totals.writeStream.outputMode("complete").foreachBatch(write), checkpoint, available_now)


def read_running_stats(spark: SparkSession, path: str) -> DataFrame:
    versions = spark.read.parquet(path)
    return versions.filter(F.col("version") == versions.agg(F.max("version")).scalar()).drop("version", "slot")
