"""Compaction of streamed results: the same rows for readers, few files, lookups that skip row groups."""

import pytest
from test_results import result, table

from hunkwise.operators import results as reads
from hunkwise.sources import compaction, tables

DAY = 86_400_000


@pytest.fixture
def paths(tmp_path):
    return str(tmp_path / "results"), str(tmp_path / "compacted")


def put(spark, path, batch_id, *rows):
    stored = tables.stored_form(table(spark, *rows), arrival=batch_id)
    stored.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch_id={batch_id}")


def batch(batch_id, n=40):
    """Half of the ids of the batch before again, over three days."""
    return [result(batch_id * n // 2 + i, timestamp=(i % 3) * DAY + i, latency_ms=float(batch_id)) for i in range(n)]


def last_writes(df):
    wanted = df.select("id").distinct()
    return sorted((r.id, r.latency_ms, r.arrival, str(r.day)) for r in reads.get_by_ids(df, wanted, "arrival").collect())


def test_readers_see_the_same(spark, paths, tmp_path):
    for i in range(4):
        put(spark, paths[0], i, *batch(i))
    before = compaction.read_compacted(spark, *paths)
    want = last_writes(before)
    assert len(want) == 40 + 3 * 20
    first = compaction.compact(spark, *paths)
    assert (first.version, first.through, len(first.days)) == (1, 2, 3)
    # The plan from before the compaction still reads the batches.
    assert last_writes(before) == want == last_writes(compaction.read_compacted(spark, *paths))
    # A compaction that ended before its manifest changes nothing.
    spark.range(3).write.parquet(f"{paths[1]}/rows/version=2/day=1970-01-01")
    spark.range(3).selectExpr("id AS through").write.parquet(f"{paths[1]}/manifest/version=2")
    (tmp_path / "compacted/manifest/version=2/_SUCCESS").unlink()
    assert last_writes(compaction.read_compacted(spark, *paths)) == want
    second = compaction.compact(spark, *paths, through=3)
    assert (second.version, second.through) == (2, 3)
    assert compaction.drop_superseded(spark, *paths) == 4 + 3 + 1
    assert last_writes(compaction.read_compacted(spark, *paths)) == want
    assert len(list((tmp_path / "compacted/rows").rglob("*.parquet"))) == 3
    assert not list((tmp_path / "results").rglob("*.parquet"))
    # Nothing new: nothing is written.
    assert compaction.compact(spark, *paths) == second


def test_only_touched_days_are_rewritten(spark, paths):
    put(spark, paths[0], 0, result(1, timestamp=5), result(2, timestamp=DAY))
    put(spark, paths[0], 1, result(1, timestamp=6, label="later"), result(0, id=None, timestamp=7), result(0, id=None, timestamp=8))
    put(spark, paths[0], 2, result(9, timestamp=None))
    compaction.compact(spark, *paths, through=0)
    state = compaction.compact(spark, *paths, through=2)
    assert {str(day): version for day, version in state.days.items()} == {"1970-01-01": 2, "1970-01-02": 1, "None": 2}
    rows = compaction.read_compacted(spark, *paths).collect()
    assert sorted((str(r.id), r.timestamp or 0) for r in rows) == [
        ("None", 7), ("None", 8), ("anomaly-1", 6), ("anomaly-2", DAY), ("anomaly-9", 0),
    ]


def scanned(df):
    """Rows that the scans of a plan without a shuffle put out."""
    list(df.toLocalIterator())
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_lookups_skip_row_groups(spark, paths):
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        put(spark, paths[0], 0, *(result(i, timestamp=i % 2 * DAY + 1) for i in range(1000, 2000)))
        compaction.compact(spark, *paths, through=0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    compaction.drop_superseded(spark, *paths)
    stored = compaction.read_compacted(spark, *paths)
    (row,) = reads.get_by_id(stored, "anomaly-1500", "arrival").collect()
    assert row.timestamp == 1
    # Files hold ranges of ids of one day: one row group of several is read.
    assert 0 < scanned(stored.filter("id = 'anomaly-1500'")) < 400
    # Within every range, but in no bloom filter.
    assert scanned(stored.filter("id = 'anomaly-1500b'")) == 0
