"""Reads over the results table: list, get, statistics, feed and report.

Top-k reads sort with a limit, which Spark runs as one bounded heap per task.
Ties are broken by ``id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hunkwise.functions import text

# Rows of a list read and of the rolling feed.
LIST_LIMIT = 100
FEED_LIMIT = 500

ALL, VULNERABLE, CLEAN = "all", "vulnerable", "clean"
# Fixed value: what a report shows for a blank search.
NO_QUERY = "none"

NEWEST, HIGHEST_RISK, LOWEST_RISK, LATENCY = "newest", "highest-risk", "lowest-risk", "latency"


def _order(mode: str) -> list[Column]:
    first = {
        NEWEST: F.desc("timestamp"),
        HIGHEST_RISK: F.desc("confidence"),
        LOWEST_RISK: F.asc("confidence"),
        LATENCY: F.desc("latency_ms"),
    }
    if mode not in first:
        raise ValueError(f"unknown sort mode {mode!r}")
    return [first[mode], F.asc("id")]


def _ranked(limited: DataFrame, order: list[Column]) -> DataFrame:
    """Position of each row; only for rows that are already limited."""
    return limited.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def with_defaults(results: DataFrame, now_ms: int) -> DataFrame:
    """Fills a blank id and a zero timestamp."""
    made_up = F.concat(
        F.lit("anomaly-"),
        text.snippet_id(F.col("repo"), F.col("commit_sha"), F.col("file_path"), F.col("start_line")),
    )
    blank = F.coalesce(F.col("id") == "", F.lit(True))
    unset = F.coalesce(F.col("timestamp") == 0, F.lit(True))
    return results.withColumn("id", F.when(blank, made_up).otherwise(F.col("id"))).withColumn(
        "timestamp", F.when(unset, F.lit(now_ms)).otherwise(F.col("timestamp"))
    )


def newest_days(results: DataFrame, limit: int, day: str) -> DataFrame:
    """The rows of the newest days that hold at least ``limit`` rows together.

    ``day`` is the partition column of a stored table: its row counts per day come
    from the file footers, and of the older days nothing else is read.
    """
    counts = results.groupBy(day).agg(F.count(F.lit(1)).alias("rows"))
    reached = F.sum("rows").over(Window.orderBy(F.desc(day)))
    floor = counts.withColumn("reached", reached).filter(F.col("reached") >= limit).agg(F.max(day)).scalar()
    lowest = F.coalesce(floor, F.lit("0001-01-01").cast("date"))
    # Rows without a time are the oldest; they only count when the dated ones are too few.
    return results.filter((F.col(day) >= lowest) | (floor.isNull() & F.col(day).isNull()))


def latest(results: DataFrame, limit: int = LIST_LIMIT, day: str | None = None) -> DataFrame:
    """The newest rows with their ``rank`` and the ``total`` of the same snapshot.

    The total is a scalar subquery over no columns, so it reads row counts only.
    ``day`` names the partition column of a stored table, to leave old days unread.
    """
    order = _order(NEWEST)
    total = results.agg(F.count(F.lit(1))).scalar()
    recent = newest_days(results, limit, day) if day else results
    return _ranked(recent.orderBy(*order).limit(limit), order).withColumn("total", total)


def _last_write(results: DataFrame, arrival: str) -> DataFrame:
    columns = results.columns
    row = F.struct(*columns)
    # Of writes that arrived at the same time the one with the largest values counts, whatever the order of the rows.
    newest = results.groupBy("id").agg(F.max_by(row, F.struct(F.col(arrival), row)).alias("row"))
    return newest.select("row.*")


def get_by_id(results: DataFrame, wanted: str, arrival: str = "timestamp") -> DataFrame:
    """The last write of one id, or no row; the filter reaches the scan."""
    return _last_write(results.filter(F.col("id") == wanted), arrival)


def get_by_ids(results: DataFrame, wanted: DataFrame, arrival: str = "timestamp") -> DataFrame:
    """The last write of each wanted id. Copies of an id combine before the shuffle."""
    return _last_write(results.join(wanted.select("id"), "id", "left_semi"), arrival)


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def store_stats(results: DataFrame, *by: str) -> DataFrame:
    """Totals, share of vulnerable rows and mean latency; ``by`` groups them."""
    total = F.count(F.lit(1))
    found = F.count_if(F.col("is_anomalous"))
    return results.groupBy(*by).agg(
        total.alias("total_analyzed"),
        found.alias("anomalies_found"),
        (total - found).alias("clean"),
        _share(found, total).alias("anomaly_rate"),
        _share(F.coalesce(F.sum(F.col("latency_ms").cast("double")), F.lit(0.0)), total).alias("avg_latency_ms"),
    )


def feed_counts(results: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    found = F.count_if(F.col("is_anomalous"))
    return results.agg(total.alias("total"), found.alias("vulnerable"), (total - found).alias("clean"))


def scorer_stats(results: DataFrame, model_name: str) -> DataFrame:
    return results.agg(
        F.lit(model_name).alias("model_name"),
        F.count(F.lit(1)).alias("total_predictions"),
        F.coalesce(F.avg(F.col("latency_ms").cast("double")), F.lit(0.0)).alias("avg_latency_ms"),
    )


def filter_status(results: DataFrame, status: str = ALL) -> DataFrame:
    if status == ALL:
        return results
    if status == VULNERABLE:
        return results.filter(F.col("is_anomalous"))
    if status == CLEAN:
        return results.filter(~F.col("is_anomalous"))
    raise ValueError(f"unknown status {status!r}")


def search(results: DataFrame, query: str = "") -> DataFrame:
    """Rows whose path, repository, commit or label contains the query as plain text."""
    wanted = query.lower().strip()
    if not wanted:
        return results
    hit = F.lit(False)
    for name in ("file_path", "repo", "commit_sha", "label"):
        hit = hit | F.coalesce(F.contains(F.lower(F.col(name)), F.lit(wanted)), F.lit(False))
    return results.filter(hit)


def ranked(results: DataFrame, status: str = ALL, query: str = "", sort: str = NEWEST, limit: int | None = None) -> DataFrame:
    """The filtered rows in their order: all of them without a ``rank``, or the first ``limit`` with one."""
    order = _order(sort)
    chosen = search(filter_status(results, status), query).orderBy(*order)
    return chosen if limit is None else _ranked(chosen.limit(limit), order)


def rolling_feed(results: DataFrame, limit: int = FEED_LIMIT) -> DataFrame:
    """The newest results, with a ``rank``."""
    return ranked(results, limit=limit)


def feed(
    results: DataFrame, status: str = ALL, query: str = "", sort: str = NEWEST, window: int = FEED_LIMIT
) -> DataFrame:
    """What a feed shows: the newest ``window`` results, then filtered and sorted, with a ``rank``."""
    newest = results.orderBy(*_order(NEWEST)).limit(window)
    return _ranked(search(filter_status(newest, status), query), _order(sort))


def display(results: DataFrame) -> DataFrame:
    """Texts of a feed entry."""
    return results.select(
        "id",
        "repo",
        "file_path",
        "label",
        text.short_sha(F.col("commit_sha")).alias("short_sha"),
        F.format_string("%.1f%%", F.col("confidence").cast("double") * 100).alias("confidence_text"),
        F.format_string("%.1fms", F.col("latency_ms").cast("double")).alias("latency_text"),
        F.concat(
            F.lit("L"), F.col("start_line").cast("string"), F.lit("–L"), F.col("end_line").cast("string")
        ).alias("line_range"),
        text.clock_text(F.col("timestamp")).alias("time_text"),
    )


def report_header(results: DataFrame, generated_at: str, status: str = ALL, query: str = "") -> DataFrame:
    chosen = search(filter_status(results, status), query)
    return chosen.agg(
        F.lit(generated_at).alias("generated_at"),
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("is_anomalous")).alias("vulnerable_count"),
        F.lit(status).alias("filter_applied"),
        F.lit(query or NO_QUERY).alias("search_query"),
    )


def write_report(
    results: DataFrame, path: str, generated_at: str, status: str = ALL, query: str = "", sort: str = NEWEST
) -> None:
    """Report as a header file and the whole filtered feed, in order, as JSON lines."""
    report_header(results, generated_at, status, query).write.mode("overwrite").json(f"{path}/header")
    body = search(filter_status(results, status), query).orderBy(*_order(sort))
    body.write.mode("overwrite").json(f"{path}/anomalies")
