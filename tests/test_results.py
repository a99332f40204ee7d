import json

import pytest
from pyspark.sql import functions as F

from hunkwise.operators import results as reads
from hunkwise.schemas import RESULT
from hunkwise.sources import tables


def result(i, **fields):
    row = dict(
        id=f"anomaly-{i}", repo="o/r", commit_sha="9c41d07be25f6a83", file_path="src/main.c", start_line=1, end_line=4,
        code="int f();", is_anomalous=i % 3 == 0, confidence=i / 200, label="vulnerable" if i % 3 == 0 else "clean",
        latency_ms=float(i), timestamp=i,
    )
    row.update(fields)
    return tuple(row[c] for c in RESULT.fieldNames())


def table(spark, *rows):
    return spark.createDataFrame(list(rows), RESULT)


def test_latest_100_of_105(spark):
    df = table(spark, *(result(i) for i in range(1, 106)))
    rows = reads.latest(df).orderBy("rank").collect()
    assert [r.timestamp for r in rows] == list(range(105, 5, -1))
    assert [r["rank"] for r in rows] == list(range(1, 101))
    assert {r.total for r in rows} == {105}
    assert reads.latest(table(spark)).collect() == []


def test_ties_go_by_id(spark):
    df = table(spark, *(result(i, timestamp=5, id=f"x{i}") for i in (3, 1, 2)))
    assert [r.id for r in reads.latest(df, 2).orderBy("rank").collect()] == ["x1", "x2"]


def test_defaults(spark):
    df = table(
        spark, result(1), result(2, id="", timestamp=0, file_path="a.c"), result(3, id=None, timestamp=None, commit_sha="ab")
    )
    rows = reads.with_defaults(df, 777).collect()
    assert [(r.id, r.timestamp) for r in rows] == [
        ("anomaly-1", 1), ("anomaly-o/r/9c41d07b/a.c#L1", 777), ("anomaly-o/r/ab/src/main.c#L1", 777),
    ]


def test_get_by_id(spark):
    df = table(spark, result(1), result(2, id="x", timestamp=5, label="old"), result(3, id="x", timestamp=9, label="new"))
    assert [r.label for r in reads.get_by_id(df, "x").collect()] == ["new"]
    assert reads.get_by_id(df, "missing").collect() == []
    wanted = spark.createDataFrame([("x",), ("anomaly-1",), ("nothing",), ("x",)], "id string")
    assert sorted((r.id, r.timestamp) for r in reads.get_by_ids(df, wanted).collect()) == [("anomaly-1", 1), ("x", 9)]


def test_stats(spark):
    df = table(spark, *(result(i) for i in range(1, 8)))
    row = reads.store_stats(df).first()
    assert (row.total_analyzed, row.anomalies_found, row.clean) == (7, 2, 5)
    assert row.anomaly_rate == pytest.approx(2 / 7) and row.avg_latency_ms == pytest.approx(4.0)
    empty = reads.store_stats(table(spark)).first()
    assert tuple(empty) == (0, 0, 0, 0.0, 0.0)
    assert tuple(reads.feed_counts(df).first()) == (7, 2, 5)
    assert tuple(reads.feed_counts(table(spark)).first()) == (0, 0, 0)
    assert tuple(reads.scorer_stats(table(spark), "m").first()) == ("m", 0, 0.0)
    grouped = reads.store_stats(df.withColumn("repo", F.concat("repo", (F.col("timestamp") % 2).cast("string"))), "repo")
    assert sorted((r.repo, r.total_analyzed) for r in grouped.collect()) == [("o/r0", 3), ("o/r1", 4)]


def test_filter(spark):
    df = table(spark, *(result(i) for i in range(6)))
    assert reads.filter_status(df).count() == 6
    assert reads.filter_status(df, "vulnerable").count() == 2
    assert reads.filter_status(df, "clean").count() == 4
    with pytest.raises(ValueError):
        reads.filter_status(df, "odd")


def test_search_is_plain_text(spark):
    df = table(
        spark, result(1, file_path="a_b%C.c"), result(2, file_path="axbyc.c", repo="Deep/Repo"),
        result(3, file_path="z", commit_sha=None, label=None), result(4, file_path="z", commit_sha="FEED", label="Clean"),
    )

    def hits(query):
        return sorted(r.timestamp for r in reads.search(df, query).collect())

    assert hits("  ") == hits("") == [1, 2, 3, 4]
    assert hits("A_B%c") == [1]
    assert hits("%") == [1]
    assert hits(" deep/repo ") == [2]
    assert hits("feed") == [4]
    assert hits("clean") == [1, 2, 4]
    assert hits("missing") == []


def test_sort_modes(spark):
    df = table(
        spark, result(1, timestamp=3, confidence=0.5, latency_ms=1.0), result(2, timestamp=1, confidence=0.9, latency_ms=9.0),
        result(3, timestamp=2, confidence=0.1, latency_ms=5.0),
    )

    def order(mode):
        return [r.id[-1] for r in reads.feed(df, sort=mode).orderBy("rank").collect()]

    assert order("newest") == ["1", "3", "2"]
    assert order("highest-risk") == ["2", "1", "3"]
    assert order("lowest-risk") == ["3", "1", "2"]
    assert order("latency") == ["2", "3", "1"]
    with pytest.raises(ValueError):
        reads.feed(df, sort="odd")


def test_rolling_feed(spark):
    df = table(spark, *(result(i) for i in range(700)))
    assert sorted(r.timestamp for r in reads.rolling_feed(df).collect()) == list(range(200, 700))


def test_display(spark):
    df = table(spark, result(1, confidence=0.125, latency_ms=12.25, timestamp=86_400_000 + 3_661_999, commit_sha="abc"))
    row = reads.display(df).first()
    assert (row.short_sha, row.confidence_text, row.latency_text) == ("abc", "12.5%", "12.3ms")
    assert (row.line_range, row.time_text) == ("L1–L4", "01:01:01")


def test_report(spark, tmp_path):
    df = table(spark, *(result(i) for i in range(1, 10)))
    tables_path = str(tmp_path / "report")
    reads.write_report(df, tables_path, "2024-01-01T00:00:00.000Z", status="vulnerable")
    header = spark.read.json(tables_path + "/header").first().asDict()
    assert header == {
        "generated_at": "2024-01-01T00:00:00.000Z", "total_count": 3, "vulnerable_count": 3,
        "filter_applied": "vulnerable", "search_query": "none",
    }
    files = sorted((tmp_path / "report" / "anomalies").glob("part-*.json"))
    lines = [json.loads(line) for f in files for line in f.read_text().splitlines()]
    assert [line["timestamp"] for line in lines] == [9, 6, 3]
    searched = reads.report_header(df, "t", query="MAIN.c").first()
    assert (searched.total_count, searched.search_query) == (9, "MAIN.c")


def test_results_table_by_day(spark, tmp_path):
    day = 86_400_000
    path = str(tmp_path / "results")
    tables.append_results(table(spark, *(result(i, timestamp=i * day + 1) for i in range(3))), path)
    tables.append_results(table(spark, result(9, timestamp=day + 2)), path)
    stored = tables.read_results(spark, path)
    assert sorted(str(r.day) for r in stored.select("day").collect()) == ["1970-01-01", "1970-01-02", "1970-01-02", "1970-01-03"]
    one = stored.filter("day = '1970-01-02'")
    assert one.count() == 2
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    # The newest day has one row, the two newest three: the oldest day is left out, and the total still counts it.
    newest = reads.latest(stored, 2, day="day")
    assert [(r.id, r.total) for r in newest.orderBy("rank").collect()] == [("anomaly-2", 4), ("anomaly-9", 4)]
    assert sorted(str(r.day) for r in reads.newest_days(stored, 2, "day").select("day").collect()) == ["1970-01-02", "1970-01-02", "1970-01-03"]
    assert reads.newest_days(stored, 50, "day").count() == 4


def test_last_arrival_counts(spark, tmp_path):
    path = str(tmp_path / "results")
    tables.append_results(table(spark, result(1, timestamp=5, label="clean")), path, arrival=2)
    tables.append_results(table(spark, result(1, timestamp=5, label="vulnerable")), path, arrival=1)
    stored = tables.read_results(spark, path)
    (row,) = reads.get_by_id(stored, stored.first().id, "arrival").collect()
    assert row.label == "clean"


def test_top_reads_keep_a_bounded_heap(spark, tmp_path):
    path = str(tmp_path / "r")
    table(spark, *(result(i) for i in range(5))).write.parquet(path)
    out = reads.latest(tables.read_results(spark, path)).select("id", "rank", "total")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = reads.get_by_id(tables.read_results(spark, path), "anomaly-1")
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,anomaly-1)]" in got._jdf.queryExecution().executedPlan().toString()
