"""Webhook deliveries to placeholder snippets: one narrow stage.

Checks run in a fixed order: size, signature, event type, body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from hunkwise.functions import signature as sig, text
from hunkwise.schemas import PULL_REQUEST_EVENT, PUSH_EVENT, SNIPPET_COLUMNS

# Fixed value: largest accepted body, in bytes.
MAX_BODY_BYTES = 26_214_400
# Pull-request actions that are analysed.
PULL_REQUEST_ACTIONS = ("opened", "synchronize")

PUSH, PULL_REQUEST, PING = "push", "pull_request", "ping"
_CORRUPT = "_corrupt"

FILE = T.ArrayType(T.StructType([T.StructField("commit_sha", T.StringType()), T.StructField("file_path", T.StringType())]))


def _parsed(body: Column, schema: T.StructType) -> Column:
    with_corrupt = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    return F.from_json(body, with_corrupt, {"columnNameOfCorruptRecord": _CORRUPT})


def _broken(parsed: Column) -> Column:
    return parsed.isNull() | parsed[_CORRUPT].isNotNull()


def _push_files(push: Column) -> Column:
    """Code files of every commit, modified ones before added ones; removed ones do not count."""
    none = F.array().cast("array<string>")

    def files(commit: Column) -> Column:
        paths = F.concat(F.coalesce(commit["modified"], none), F.coalesce(commit["added"], none))
        return F.transform(
            F.filter(paths, text.is_code_file),
            lambda path: F.struct(F.coalesce(commit["id"], F.lit("")).alias("commit_sha"), path.alias("file_path")),
        )

    return F.coalesce(F.flatten(F.transform(push["commits"], files)), F.array().cast(FILE))


def _pull_request_marker(event: Column) -> Column:
    request = event["pull_request"]
    marker = F.struct(
        F.coalesce(request["head"]["sha"], F.lit("")).alias("commit_sha"),
        F.concat(F.lit("PR#"), F.coalesce(request["number"], F.lit(0)).cast("string")).alias("file_path"),
    )
    return F.when(event["action"].isin(*PULL_REQUEST_ACTIONS), F.array(marker)).otherwise(F.array().cast(FILE))


def checked(deliveries: DataFrame, secret: str = "", max_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Adds ``signature_ok``, ``status``, ``outcome``, ``repo`` and ``files``.

    ``files`` holds the (commit_sha, file_path) pairs that the delivery announces.
    Bodies are parsed only when the earlier checks passed and the type needs it.
    """
    event = F.col("event_type")
    present = F.coalesce("body", F.lit(b""))  # no body is an empty one
    fits = F.octet_length(present) <= max_bytes
    signed = F.coalesce(sig.signature_ok(present, F.col("signature"), secret), F.lit(False))
    gated = deliveries.withColumn("signature_ok", F.when(fits, signed))
    accepted = fits & F.col("signature_ok")
    body = present.cast("string")
    parsed = gated.withColumn(
        "push", F.when(accepted & (event == PUSH), _parsed(body, PUSH_EVENT))
    ).withColumn("pull", F.when(accepted & (event == PULL_REQUEST), _parsed(body, PULL_REQUEST_EVENT)))
    broken = ((event == PUSH) & _broken(F.col("push"))) | (
        (event == PULL_REQUEST) & _broken(F.col("pull"))
    )
    outcome = (
        F.when(~fits, "too_large")
        .when(~F.col("signature_ok"), "unauthorized")
        .when(event == PING, "pong")
        .when(F.coalesce(~event.isin(PUSH, PULL_REQUEST), F.lit(True)), "ignored")
        .when(broken, "unparsable")
        .otherwise("ok")
    )
    files = F.when(F.col("outcome") != "ok", F.array().cast(FILE)).when(
        event == PUSH, _push_files(F.col("push"))
    ).otherwise(_pull_request_marker(F.col("pull")))
    repo = F.coalesce(F.col("push.repository.full_name"), F.col("pull.repository.full_name"), F.lit(""))
    return (
        parsed.withColumn("outcome", outcome)
        .withColumn("status", status_code(F.col("outcome")))
        .withColumn("files", files)
        .withColumn("repo", repo)
        .drop("push", "pull")
    )


def status_code(outcome: Column) -> Column:
    return (
        F.when(outcome == "too_large", 413)
        .when(outcome == "unauthorized", 401)
        .when(outcome == "unparsable", 500)
        .otherwise(200)
    )


def delivery_status(deliveries: DataFrame, secret: str = "", max_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    return checked(deliveries, secret, max_bytes).select("delivery_id", "event_type", "status", "outcome")


def rejected(deliveries: DataFrame, secret: str = "", max_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Deliveries that must not go on, with the reason."""
    return delivery_status(deliveries, secret, max_bytes).filter(F.col("status") != 200)


def routing_counts(deliveries: DataFrame, secret: str = "") -> DataFrame:
    return checked(deliveries, secret).groupBy("event_type", "outcome").agg(F.count(F.lit(1)).alias("deliveries"))


def delivery_summary(deliveries: DataFrame, secret: str = "") -> DataFrame:
    """Reply of every delivery; the snippet count comes from the row itself, without a join."""
    return checked(deliveries, secret).select(
        "delivery_id",
        "status",
        "outcome",
        F.size("files").alias("snippets"),
    )


def placeholders(deliveries: DataFrame, secret: str = "") -> DataFrame:
    """Snippets without code, one per announced file or pull request."""
    return _announced(checked(deliveries, secret))


def push_placeholders(deliveries: DataFrame, secret: str = "") -> DataFrame:
    """Of pushes only; the type filter runs before any body is parsed."""
    return placeholders(deliveries.filter(F.col("event_type") == PUSH), secret)


def pull_request_placeholders(deliveries: DataFrame, secret: str = "") -> DataFrame:
    return placeholders(deliveries.filter(F.col("event_type") == PULL_REQUEST), secret)


def _announced(rows: DataFrame) -> DataFrame:
    # An outer explode: a plain one makes Spark infer a filter on the array and
    # push it down, which repeats signature check and parsing below the projection.
    files = rows.select("repo", F.explode_outer("files").alias("file"), F.col("received_at").alias("timestamp"))
    return files.filter(F.col("file").isNotNull()).select(
        F.lit("").alias("code"),
        "repo",
        F.col("file.commit_sha").alias("commit_sha"),
        F.col("file.file_path").alias("file_path"),
        F.lit(0).alias("start_line"),
        F.lit(0).alias("end_line"),
        "timestamp",
    ).select(SNIPPET_COLUMNS)


def code_files(paths: DataFrame, column: str = "file_path") -> DataFrame:
    return paths.filter(text.is_code_file(F.col(column)))
