"""Placeholders to snippets with code.

Equi-joins on (repo, commit[, path]). Nothing is forced: Spark broadcasts a side
only below its size threshold, and AQE splits a skewed key of a sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hunkwise.functions import text
from hunkwise.schemas import SNIPPET_COLUMNS

FILE_KEY = ["repo", "commit_sha", "file_path"]
COMMIT_KEY = ["repo", "commit_sha"]

# Join column of a placeholder; no path starts with a line break.
_WANTED = "wanted"
_WHOLE_COMMIT = "\n"

# A pushed file of this name has no code suffix, so it never becomes a placeholder.
_PR_MARKER = r"\APR#-?\d+\z"


def is_pull_request_marker(placeholders: DataFrame) -> DataFrame:
    return placeholders.filter(F.col("file_path").rlike(_PR_MARKER))


def is_file_placeholder(placeholders: DataFrame) -> DataFrame:
    return placeholders.filter(~F.col("file_path").rlike(_PR_MARKER))


def enrich_files(placeholders: DataFrame, snippets: DataFrame) -> DataFrame:
    """Snippets of the announced files, stamped with the announcement's time.

    Announced paths are code files, so other snippets are dropped before the
    shuffle.
    """
    announced = is_file_placeholder(placeholders).select(*FILE_KEY, "timestamp")
    extracted = snippets.filter(text.is_code_file(F.col("file_path"))).drop("timestamp")
    return extracted.join(announced, FILE_KEY).select(SNIPPET_COLUMNS)


def enrich_pull_requests(placeholders: DataFrame, snippets: DataFrame) -> DataFrame:
    """All snippets of a pull request's head commit."""
    announced = is_pull_request_marker(placeholders).select(*COMMIT_KEY, "timestamp")
    return snippets.drop("timestamp").join(announced, COMMIT_KEY).select(SNIPPET_COLUMNS)


def _announced(placeholders: DataFrame) -> DataFrame:
    """Placeholders with the path they ask for; a pull request asks for a whole commit."""
    marker = F.col("file_path").rlike(_PR_MARKER)
    return placeholders.withColumn(_WANTED, F.when(marker, _WHOLE_COMMIT).otherwise(F.col("file_path")))


def _offered(rows: DataFrame) -> DataFrame:
    """Each row under its whole commit and, for a code file, under its own path."""
    path = F.col("file_path")
    keys = F.when(text.is_code_file(path), F.array(F.lit(_WHOLE_COMMIT), path)).otherwise(
        F.array(F.lit(_WHOLE_COMMIT))
    )
    return rows.withColumn(_WANTED, F.explode(keys))


def enrich(placeholders: DataFrame, snippets: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Snippets of all announced files and pull requests.

    The announcements meet the keys of the files first, without code; code then
    passes one join, with the announced files only. ``files`` has the keys of
    ``snippets`` where they come cheaper, such as the rows of ``diff_hunks``.
    """
    announced = _announced(placeholders).select(*COMMIT_KEY, _WANTED, "timestamp")
    keys = _offered((snippets if files is None else files).select(FILE_KEY).distinct())
    matched = keys.join(announced, [*COMMIT_KEY, _WANTED]).select(*FILE_KEY, "timestamp")
    return snippets.drop("timestamp").join(matched, FILE_KEY).select(SNIPPET_COLUMNS)


def announced_diffs(diffs: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Diffs of announced commits, for a small batch of deliveries against a long history.

    Spark broadcasts the commits if they are few, and the history is then read
    without a shuffle. When most diffs are announced, leave it out.
    """
    return diffs.join(placeholders.select(COMMIT_KEY).distinct(), COMMIT_KEY, "left_semi")


def unenriched(placeholders: DataFrame, snippets: DataFrame) -> DataFrame:
    """Placeholders that no snippet matches.

    Only the keys of ``snippets`` count. Every hunk gives a snippet, so the rows
    of ``diff_hunks`` serve as well and save the cut into functions. Each key is
    kept once, combined before the shuffle, so a commit of many hunks is no hot key.
    """
    offered = _offered(snippets.select(FILE_KEY)).select(*COMMIT_KEY, _WANTED).distinct()
    return _announced(placeholders).join(offered, [*COMMIT_KEY, _WANTED], "left_anti").select(placeholders.columns)


def scorable(snippets: DataFrame) -> DataFrame:
    return snippets.filter(F.col("code") != "")


def unscorable(snippets: DataFrame) -> DataFrame:
    """Snippets the scorer refuses, with the reason."""
    return snippets.filter(F.coalesce(F.col("code") == "", F.lit(True))).withColumn("reason", F.lit("empty code"))
