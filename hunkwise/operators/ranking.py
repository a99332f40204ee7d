"""Ranks over whole tables."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from hunkwise.session import run_dir

_PART, _AT = "_part", "_at"
# ``monotonically_increasing_id`` keeps the place within a partition in its low bits.
_PLACE_BITS = 33


def with_rank(rows: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """``rows`` with their 1-based ``rank`` (bigint) in ``order``, however many there are.

    The rows are dealt into ranges of the order, sorted within them and written to the
    shared folder; the rank is the place within a range plus the sizes of the ranges
    before it. So no task sees more than its range, and the driver one number per range.
    ``order`` should tell all rows apart: rows that are equal in it share one range and
    take its ranks in any order. An empty table stays empty.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_AT, F.monotonically_increasing_id())
    path = run_dir(spark, "ranked")
    placed.write.parquet(path)
    part = F.shiftright(_AT, _PLACE_BITS).alias(_PART)
    stored = spark.read.schema(placed.schema).parquet(path).select("*", part)
    sizes = sorted((r[_PART], r["rows"]) for r in stored.groupBy(_PART).agg(F.count(F.lit(1)).alias("rows")).collect())
    before = accumulate((rows for _, rows in sizes), initial=0)
    starts = spark.createDataFrame([(p, start) for (p, _), start in zip(sizes, before)], f"{_PART} bigint, start bigint")
    # One row per range, as many as the job before had tasks.
    place = F.col(_AT).bitwiseAND((1 << _PLACE_BITS) - 1)
    return stored.join(F.broadcast(starts), _PART).select(*rows.columns, (F.col("start") + place + 1).alias(rank))
