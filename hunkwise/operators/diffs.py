"""Diffs to function-level snippets: a chain of generators without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hunkwise.functions import text, unified_diff as ud
from hunkwise.schemas import SNIPPET_COLUMNS


def diff_files(diffs: DataFrame) -> DataFrame:
    """One row per file part that names a target path; an empty diff has none."""
    parts = diffs.select(
        "repo", "commit_sha", F.posexplode(ud.file_chunks(F.col("diff"))).alias("file_seq", "chunk")
    )
    return parts.withColumn("file_path", ud.chunk_path(F.col("chunk"))).filter(F.col("file_path") != "")


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """One row per hunk that adds at least one line."""
    segments = diff_files(diffs).select(
        "repo",
        "commit_sha",
        "file_path",
        "file_seq",
        F.posexplode(ud.hunk_segments(F.col("chunk"))).alias("hunk_seq", "segment"),
    )
    return segments.filter(ud.is_hunk(F.col("segment")) & ud.adds_lines(F.col("segment"))).select(
        "repo",
        "commit_sha",
        "file_path",
        "file_seq",
        "hunk_seq",
        ud.hunk_start(F.col("segment")).alias("start_line"),
        ud.added_lines(F.col("segment")).alias("added"),
    )


def function_snippets(diffs: DataFrame, timestamp: Column | int) -> DataFrame:
    """Bus-shaped snippets of every diff; ``timestamp`` stamps them in epoch milliseconds."""
    stamp = timestamp if isinstance(timestamp, Column) else F.lit(timestamp)
    return (
        diff_hunks(diffs)
        .select(
            "repo",
            "commit_sha",
            "file_path",
            F.explode(ud.hunk_snippets(F.col("added"), F.col("start_line"))).alias("s"),
        )
        .select(
            F.col("s.code").alias("code"),
            "repo",
            "commit_sha",
            "file_path",
            F.col("s.start_line").alias("start_line"),
            F.col("s.end_line").alias("end_line"),
            stamp.cast("bigint").alias("timestamp"),
        )
        .select(SNIPPET_COLUMNS)
    )


def with_snippet_id(snippets: DataFrame) -> DataFrame:
    return snippets.withColumn(
        "id",
        text.snippet_id(F.col("repo"), F.col("commit_sha"), F.col("file_path"), F.col("start_line")),
    )


def snippet_lines(snippets: DataFrame) -> DataFrame:
    """Numbered lines of each snippet; an empty snippet has none."""
    return (
        snippets.filter(F.col("code") != "")
        .select("*", F.posexplode(F.split("code", "\n", -1)).alias("line_offset", "content"))
        .withColumn("line_number", F.col("start_line") + F.col("line_offset"))
        .drop("line_offset")
    )
