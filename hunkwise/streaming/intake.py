"""Deliveries and diffs as they arrive: each delivery once, and code for announcements that come before or after it."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from hunkwise.operators import enrich
from hunkwise.schemas import DELIVERY, SNIPPET, SNIPPET_COLUMNS
from hunkwise.sources.compaction import _folder
from hunkwise.streaming.feed import _slot, _start

# How long a sender may come back with a delivery, and how long code and its announcement wait for each other.
REDELIVERY = "3 days"
WAIT = "1 hour"
LATENESS = "10 minutes"

_AT, _IDENTITY = "_at", "_identity"

# Rows that wait for their counterpart: snippets, and announcements, which have no code.
_WAITING = T.StructType([*SNIPPET.fields, T.StructField("announced", T.BooleanType())])
_ENRICHED = T.StructType([*SNIPPET.fields, T.StructField("matched", T.BooleanType())])


def _identity() -> Column:
    """The delivery's id; without one, what was sent."""
    sent = F.sha2(F.concat_ws("\n", "event_type", "signature", F.hex("body")), 256)
    return F.when(F.coalesce("delivery_id", F.lit("")) != "", F.concat(F.lit("id "), "delivery_id")).otherwise(sent)


def once(deliveries: DataFrame, remembered: str = REDELIVERY) -> DataFrame:
    """Each delivery of a stream once, the first that arrives.

    A sender that gets no answer in time, or a bus that delivers at least once, brings
    the same id again. Ids are kept for ``remembered`` after their first arrival, so the
    state is bounded by that span and spread by the hash of the id. ``received_at`` is
    set on arrival and so never runs far behind; a row that does so by more than
    ``remembered`` could not be told apart and is left out.
    """
    timed = deliveries.withColumns({_AT: F.timestamp_millis("received_at"), _IDENTITY: _identity()})
    return timed.withWatermark(_AT, remembered).dropDuplicatesWithinWatermark([_IDENTITY]).select(deliveries.columns)


def write_once(
    deliveries: DataFrame, path: str, checkpoint: str, remembered: str = REDELIVERY, available_now: bool = False
) -> StreamingQuery:
    """``once``, stored; a repeated batch replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(once(deliveries, remembered).writeStream.foreachBatch(write), checkpoint, available_now)


def read_once(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DELIVERY).parquet(path)


def _millis(spark: SparkSession, span: str) -> int:
    epoch = F.timestamp_millis(F.lit(0).cast("bigint"))
    return spark.range(1).select(F.unix_millis(epoch + F.expr(f"INTERVAL {span}"))).first()[0]


class _Part(NamedTuple):
    """The rows of one batch that wait: the last times of both kinds, and the watermark after the batch of this log."""

    batch: int
    announced_to: int | None
    offered_to: int | None
    needed: bool
    watermark: int


_LOG = "batch bigint, announced_to bigint, offered_to bigint, needed boolean, watermark bigint"


def _met(announced: DataFrame, offered: DataFrame, wait: int, path: str) -> DataFrame:
    """Snippets of announcements that lie at most ``wait`` apart.

    The announcements meet the keys of the files first, so code passes one join, with the announced files only.
    These are stored in ``path``: Spark then knows their size and broadcasts a few instead of shuffling all code.
    """
    asked = enrich._announced(announced).select(
        *enrich.COMMIT_KEY, enrich._WANTED, F.col("file_path").alias("a_file_path"), F.col("timestamp").alias("a_timestamp")
    )
    files = enrich._offered(offered.select(enrich.FILE_KEY).distinct()).join(asked, [*enrich.COMMIT_KEY, enrich._WANTED])
    found = files.select(*(F.col(c).alias(f"a_{c}") for c in enrich.COMMIT_KEY), F.col("file_path").alias("f_file_path"), "a_file_path", "a_timestamp")
    found.write.mode("overwrite").parquet(path)
    found = found.sparkSession.read.schema(found.schema).parquet(path)
    # A snippet without a path is still one of its commit.
    same = [*(F.col(c) == F.col(f"a_{c}") for c in enrich.COMMIT_KEY), F.col("file_path").eqNullSafe(F.col("f_file_path"))]
    near = F.abs(F.col("timestamp") - F.col("a_timestamp")) <= wait
    return offered.join(found, [*same, near]).select(
        F.coalesce("code", F.lit("")).alias("code"),
        *enrich.COMMIT_KEY,
        F.coalesce("file_path", "a_file_path").alias("file_path"),
        F.coalesce("start_line", F.lit(0)).cast("bigint").alias("start_line"),
        F.coalesce("end_line", F.lit(0)).cast("bigint").alias("end_line"),
        F.col("a_timestamp").alias("timestamp"),
    )


def _unmet(announced: DataFrame, offered: DataFrame, wait: int) -> DataFrame:
    """Announcements that no snippet lies at most ``wait`` apart from, without code."""
    key = [*enrich.COMMIT_KEY, enrich._WANTED]
    offers = enrich._offered(offered.select(*enrich.FILE_KEY, "timestamp"))
    offers = offers.select(*(F.col(c).alias(f"o_{c}") for c in key), F.col("timestamp").alias("o_timestamp")).distinct()
    near = F.abs(F.col("timestamp") - F.col("o_timestamp")) <= wait
    alone = enrich._announced(announced).join(offers, [*(F.col(c) == F.col(f"o_{c}") for c in key), near], "left_anti")
    zero = F.lit(0).cast("bigint")
    return alone.select(F.lit("").alias("code"), *enrich.FILE_KEY, zero.alias("start_line"), zero.alias("end_line"), "timestamp")


def write_enriched(
    placeholders: DataFrame,
    snippets: DataFrame,
    path: str,
    checkpoint: str,
    wait: str = WAIT,
    lateness: str = LATENESS,
    available_now: bool = False,
) -> StreamingQuery:
    """Announcements and snippets of two streams, joined whichever comes first and stored by whether code was found.

    Announcements and code that lie at most ``wait`` apart meet, and each pair comes out
    as soon as both are there. An announcement that no code has met when the watermark
    has passed ``wait`` comes out once, without code and with ``matched`` false. The
    watermark lies ``lateness`` behind the slower stream; rows behind it meet nothing.

    Rows wait as Parquet files in a folder per batch under the checkpoint, code once. A
    batch joins its own rows with each other and with those that wait, and what expires
    with those that wait. Files whose last code is more than twice ``wait`` behind the
    watermark, and whose announcements have all come out, are deleted, so as much is kept
    as arrives in that span. A repeated batch replaces its own folders; two logs, used in
    turn, name the parts that are needed.
    """
    wait_ms, lateness_ms = (_millis(placeholders.sparkSession, span) for span in (wait, lateness))
    kinds = {field.name: field.dataType for field in SNIPPET.fields}

    def typed(rows: DataFrame, names: Iterable[str], announced: bool) -> DataFrame:
        return rows.select(*(F.col(c).cast(kinds[c]).alias(c) for c in names), F.lit(announced).alias("announced"))

    arriving = typed(placeholders, [*enrich.FILE_KEY, "timestamp"], True).unionByName(
        typed(snippets, SNIPPET_COLUMNS, False), allowMissingColumns=True
    )

    def folder(batch_id: int) -> str:
        return f"{checkpoint}/waiting/rows/batch_id={batch_id}"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def waiting(parts: Iterable[_Part], announced: bool, since: int | None = None) -> DataFrame:
            rows = spark.read.schema(_WAITING).parquet(*(folder(part.batch) for part in parts))
            kind = rows.filter(F.col("announced") == announced).drop("announced")
            return kind if since is None else kind.filter(F.col("timestamp") >= since)

        before: list[_Part] = []
        if batch_id > 0:
            log = spark.read.schema(_LOG).parquet(_slot(f"{checkpoint}/waiting/log", batch_id - 1))
            before = [_Part(*row) for row in log.collect()]
        for part in before:
            if not part.needed:
                files, gone = _folder(spark, folder(part.batch))
                files.delete(gone, True)
        late = max((part.watermark for part in before), default=0)
        # A row without a time meets nothing and does not expire.
        in_time = F.coalesce(F.col("timestamp") > late, F.lit(True))
        batch.filter(in_time).write.mode("overwrite").parquet(folder(batch_id))
        stored = spark.read.schema(_WAITING).parquet(folder(batch_id))
        last = (F.max(F.when(kind, F.col("timestamp"))) for kind in (F.col("announced"), ~F.col("announced")))
        own = _Part(batch_id, *stored.agg(*last).first(), True, late)

        parts = [*(part for part in before if part.needed), own]
        asking = [part for part in parts if part.announced_to is not None]
        offering = [part for part in parts if part.offered_to is not None]
        watermark = late
        if asking and offering:
            slower = min(max(part.announced_to for part in asking), max(part.offered_to for part in offering))
            watermark = max(late, slower - lateness_ms)

        # What is new lies behind no ``late``, so it meets nothing older than ``late`` less the wait.
        met = unmet = spark.createDataFrame([], SNIPPET)
        since = late - wait_ms
        if own in asking and offering:
            met = met.unionByName(_met(waiting([own], True), waiting(offering, False, since), wait_ms, f"{checkpoint}/waiting/found/new"))
        if own in offering and asking != [own] and asking:
            met = met.unionByName(_met(waiting([p for p in asking if p != own], True, since), waiting([own], False), wait_ms, f"{checkpoint}/waiting/found/old"))
        if watermark > late and asking:
            expired = waiting(asking, True, since).filter(F.col("timestamp") < watermark - wait_ms)
            unmet = _unmet(expired, waiting(offering, False, since - wait_ms), wait_ms)
        for matched, rows in ((True, met), (False, unmet)):
            rows.select(SNIPPET_COLUMNS).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}/matched={str(matched).lower()}")

        def needed(part: _Part) -> bool:
            ends = [end + spans * wait_ms for end, spans in ((part.announced_to, 1), (part.offered_to, 2)) if end is not None]
            return any(end >= watermark for end in ends)

        log = [part._replace(needed=needed(part), watermark=watermark) for part in parts]
        spark.createDataFrame(log, _LOG).coalesce(1).write.mode("overwrite").parquet(_slot(f"{checkpoint}/waiting/log", batch_id))

    return _start(arriving.writeStream.foreachBatch(write), checkpoint, available_now)


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    """Snippets of announcements (``matched``) and announcements without code."""
    return spark.read.schema(_ENRICHED).parquet(path).select(*SNIPPET_COLUMNS, "matched")
