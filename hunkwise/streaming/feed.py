"""Bus to scored results, continuously.

The transformations are the batch ones. The position in the source lives in the
checkpoint; every batch writes folders of its own, so a repeated batch replaces
its earlier output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from hunkwise.operators import enrich, results as reads, scoring
from hunkwise.schemas import RESULT_COLUMNS
from hunkwise.sources import bus, tables

Scorer = Callable[[DataFrame], DataFrame]
ResultHandler = Callable[[DataFrame, int], None]


def score_messages(messages: DataFrame, scorer: Scorer) -> DataFrame:
    """Decode, drop what cannot be scored, score. Works on batches and streams."""
    snippets = enrich.scorable(bus.decode(messages))
    return scoring.as_results(scoring.with_label(scorer(snippets)))


def enrich_messages(messages: DataFrame, stored_snippets: DataFrame) -> DataFrame:
    """Placeholders of a stream joined to the stored snippets of their commits."""
    return enrich.enrich(bus.decode(messages), stored_snippets)


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def write_results(
    messages: DataFrame, path: str, checkpoint: str, scorer: Scorer | None = None, available_now: bool = False
) -> StreamingQuery:
    """Scored messages, appended to a results folder.

    Scoring happens inside the batch, so a scorer may join and aggregate; without
    one, ``messages`` are results. A repeated batch replaces its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = score_messages(batch, scorer) if scorer else batch
        tables.stored_form(scored).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch_id={batch_id}")

    return _start(messages.writeStream.foreachBatch(write), checkpoint, available_now)


def _slot(path: str, batch_id: int) -> str:
    return f"{path}/slot={batch_id % 2}"


def fan_out(
    results: DataFrame,
    results_path: str,
    feed_path: str,
    checkpoint: str,
    on_result: ResultHandler | None = None,
    limit: int = reads.FEED_LIMIT,
    scorer: Scorer | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """With ``scorer``, ``results`` are messages that are scored in their batch. Each result to the results table, to the rolling feed and to a callback.

    A batch is scored once, on its way to the table; the feed and the callback
    read it back from there. The feed alternates between two folders: a batch
    merges the other folder's rows with its own and keeps the newest. A new
    checkpoint counts batches from zero, so it needs new folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = f"{results_path}/batch_id={batch_id}"
        scored = score_messages(batch, scorer) if scorer else batch
        tables.stored_form(scored).write.mode("overwrite").partitionBy("day").parquet(own)
        stored = tables.read_results(spark, own).select(RESULT_COLUMNS)
        merged = stored
        if batch_id > 0:
            merged = spark.read.parquet(_slot(feed_path, batch_id - 1)).select(RESULT_COLUMNS).unionByName(stored)
        newest = merged.orderBy(F.desc("timestamp"), "id").limit(limit)
        newest.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(_slot(feed_path, batch_id))
        if on_result:
            on_result(stored, batch_id)

    return _start(results.writeStream.foreachBatch(write), checkpoint, available_now)


def counted(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a stream that are counted as they pass, under ``name`` in the query's progress."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"))


def counted_rows(query: StreamingQuery, name: str) -> int:
    """Rows counted under ``name`` in the batches that the query still reports."""
    return sum(progress.observedMetrics[name].rows for progress in query.recentProgress if name in progress.observedMetrics)


def read_fanned_results(spark: SparkSession, results_path: str) -> DataFrame:
    return tables.read_results(spark, results_path).select(*RESULT_COLUMNS, "batch_id")


def read_feed(spark: SparkSession, feed_path: str) -> DataFrame:
    """The feed as of the last batch."""
    versions = spark.read.parquet(feed_path)
    return versions.filter(F.col("version") == versions.agg(F.max("version")).scalar()).select(RESULT_COLUMNS)
