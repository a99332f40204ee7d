"""Compaction of the results that streams leave in one folder per batch and day.

``compact`` rewrites the days that new batches touched, and a manifest says which
version of each day counts and up to which batch the days are complete. Readers take
those days and the batches beyond. The manifest is written last and whole, so a reader
before, during and after a compaction finds the same last write of every id.
"""

from __future__ import annotations

import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hunkwise.schemas import STORED_RESULT

_DAY = T.StructField("day", T.DateType())
_LOOSE = T.StructType([*STORED_RESULT.fields, _DAY, T.StructField("batch_id", T.LongType())])
_COMPACT = T.StructType([*STORED_RESULT.fields, _DAY])
_MANIFEST = "through bigint, day date, written int"
# Fixed value: how Spark names the folder of a NULL partition value.
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"

# Ids are looked up one by one: files hold ranges of them, row groups a bloom filter.
# Nearly all ids differ, so a dictionary of them would be as large as the column.
_BY_ID = {
    "parquet.enable.dictionary#id": "false",
    "parquet.bloom.filter.enabled#id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}


class Manifest(NamedTuple):
    """``days`` maps each day to the version that holds it; one entry a day, whatever the number of rows."""

    version: int
    through: int
    days: dict[datetime.date | None, int]


NOTHING = Manifest(0, -1, {})


def _folder(spark: SparkSession, path: str):
    """File system and path object, for what DataFrames cannot do: look whether a folder is there, list and delete."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def _names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    files, folder = _folder(spark, path)
    found = [status.getPath().getName() for status in files.listStatus(folder)] if files.exists(folder) else []
    return [name for name in found if name.startswith(prefix)]


def manifest(spark: SparkSession, compact_path: str) -> Manifest:
    """The newest manifest that is complete."""
    path = f"{compact_path}/manifest"
    files, _ = _folder(spark, path)
    versions = sorted((int(name.split("=")[1]) for name in _names(spark, path, "version=")), reverse=True)
    for version in versions:
        if files.exists(_folder(spark, f"{path}/version={version}/_SUCCESS")[1]):
            rows = spark.read.schema(_MANIFEST).parquet(f"{path}/version={version}").collect()
            return Manifest(version, rows[0].through, {row.day: row.written for row in rows})
    return NOTHING


def _loose(spark: SparkSession, results_path: str, after: int) -> DataFrame:
    return spark.read.schema(_LOOSE).parquet(results_path).filter(F.col("batch_id") > after)


def _day_folder(version: int, day: datetime.date | None) -> str:
    return f"version={version}/day={_NO_DAY if day is None else day}"


def _compacted(spark: SparkSession, compact_path: str, days: dict[datetime.date | None, int]) -> DataFrame:
    if not days:
        return spark.createDataFrame([], _COMPACT)
    rows = f"{compact_path}/rows"
    folders = [f"{rows}/{_day_folder(version, day)}" for day, version in days.items()]
    return spark.read.schema(_COMPACT).option("basePath", rows).parquet(*folders).select(_COMPACT.fieldNames())


def compact(spark: SparkSession, results_path: str, compact_path: str, through: int | None = None) -> Manifest:
    """Rewrites the days of all batches up to ``through``; without it all but the newest, which a restart may repeat.

    Of each day the last arrival of an id is kept, and rows that are equal in all columns
    once; rows without an id are kept apart. Days that no new batch touched stay as they
    are. Rows are spread and sorted by day and id, so a day with most of the rows has many
    files, a small day one, and each file holds a range of ids. One compaction runs at a time;
    one that failed left no manifest, and the next replaces its files.
    """
    state = manifest(spark, compact_path)
    loose = _loose(spark, results_path, state.through)
    if through is None:
        newest = loose.agg(F.max("batch_id")).first()[0]
        through = -1 if newest is None else newest - 1
    fresh = loose.filter(F.col("batch_id") <= through).drop("batch_id")
    touched = [row.day for row in fresh.select("day").distinct().collect()]
    if not touched:
        return state
    old = _compacted(spark, compact_path, {day: state.days[day] for day in touched if day in state.days})
    row = F.struct(*_COMPACT.fieldNames())
    apart = F.when(F.col("id").isNull(), F.xxhash64(*_COMPACT.fieldNames())).alias("apart")
    last = old.unionByName(fresh).groupBy("day", "id", apart).agg(F.max_by(row, F.struct("arrival", row)).alias("row"))
    order = ["day", "id"]
    version = state.version + 1
    (
        last.select("row.*")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.options(**_BY_ID)
        .mode("overwrite")
        .partitionBy("day")
        .parquet(f"{compact_path}/rows/version={version}")
    )
    days = state.days | dict.fromkeys(touched, version)
    listed = spark.createDataFrame([(through, day, written) for day, written in days.items()], _MANIFEST)
    listed.coalesce(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").mode("overwrite").parquet(
        f"{compact_path}/manifest/version={version}"
    )
    return Manifest(version, through, days)


def read_compacted(spark: SparkSession, results_path: str, compact_path: str) -> DataFrame:
    """Compacted days and the batches beyond them, with ``day``.

    An id may have one row a day and more in the new batches; its last ``arrival`` counts,
    as in ``get_by_id`` and ``get_by_ids``.
    """
    state = manifest(spark, compact_path)
    loose = _loose(spark, results_path, state.through).select(_COMPACT.fieldNames())
    return _compacted(spark, compact_path, state.days).unionByName(loose)


def drop_superseded(spark: SparkSession, results_path: str, compact_path: str) -> int:
    """Deletes what the newest manifest has replaced; the number of folders.

    These are batches it holds, older versions of its days and older manifests. Readers
    that took an older manifest must have ended. Afterwards there are the files of
    each day once and the batches since.
    """
    state = manifest(spark, compact_path)
    kept = {_day_folder(version, day) for day, version in state.days.items()}
    gone = [f"{results_path}/{name}" for name in _names(spark, results_path, "batch_id=") if int(name.split("=")[1]) <= state.through]
    for name in _names(spark, f"{compact_path}/rows", "version="):
        if int(name.split("=")[1]) <= state.version:
            days = _names(spark, f"{compact_path}/rows/{name}", "day=")
            gone += [f"{compact_path}/rows/{name}/{day}" for day in days if f"{name}/{day}" not in kept]
    older = _names(spark, f"{compact_path}/manifest", "version=")
    gone += [f"{compact_path}/manifest/{name}" for name in older if int(name.split("=")[1]) < state.version]
    for path in gone:
        files, folder = _folder(spark, path)
        files.delete(folder, True)
    return len(gone)
