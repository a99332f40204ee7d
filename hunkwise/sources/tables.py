"""Landing folders, the results table and the dataset on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hunkwise.schemas import DELIVERY, DIFF, HISTORY, RESULT_COLUMNS, STORED_RESULT

# What Spark reads as one split by default.
SPLIT_BYTES = 128 << 20


def read_deliveries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DELIVERY).parquet(path)


def stream_deliveries(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(DELIVERY).parquet(path)


def write_deliveries(deliveries: DataFrame, path: str) -> None:
    deliveries.select(DELIVERY.fieldNames()).write.mode("append").parquet(path)


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DIFF).parquet(path)


def read_spread(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """A Parquet table for CPU-bound work.

    A table too small to give every core a split is repartitioned by ``keys``, a
    shuffle of little data; a larger one is read as it lies.
    """
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    stored = sizes.agg(F.sum("length")).first()[0] or 0
    return table.repartition(cores, *keys) if stored < cores * SPLIT_BYTES else table


def with_day(results: DataFrame) -> DataFrame:
    """UTC day of the result, the partition column."""
    days = F.floor(F.col("timestamp") / 86_400_000).cast("int")
    return results.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), days))


def stored_form(results: DataFrame, arrival: int | None = None) -> DataFrame:
    """Results with their ``day`` and ``arrival``, a number that grows from write to write.

    Without one it is the time of the write in milliseconds. The rebalance hint
    sizes the files and lets AQE split a day that has most of the rows; a plain
    repartition would send that day to one task.
    """
    at = F.unix_millis(F.current_timestamp()) if arrival is None else F.lit(arrival).cast("bigint")
    return with_day(results.select(RESULT_COLUMNS).withColumn("arrival", at)).hint("rebalance", "day")


def append_results(results: DataFrame, path: str, arrival: int | None = None) -> None:
    """Appends to the results table, partitioned by day."""
    stored_form(results, arrival).write.mode("append").partitionBy("day").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED_RESULT).parquet(path)


def save_bucketed(table: DataFrame, name: str, keys: list[str], buckets: int) -> None:
    """Catalog table bucketed on a join key; joins of two such tables need no shuffle."""
    table.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def write_dataset(dataset: DataFrame, path: str) -> None:
    dataset.write.mode("overwrite").partitionBy("split").parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A small report (dataset stats, training history) as JSON lines."""
    rows.write.mode("overwrite").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).json(path)
