"""End-to-end compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hunkwise.operators import diffs as diff_ops, enrich, ingest, results as reads, scoring


def score_snippets(snippets: DataFrame, weights: DataFrame) -> DataFrame:
    """Snippets to result rows with a weights table."""
    return scoring.as_results(scoring.with_label(scoring.linear_logits(enrich.scorable(snippets), weights)))


def deliveries_to_results(
    deliveries: DataFrame,
    diffs: DataFrame,
    weights: DataFrame,
    secret: str,
    timestamp: int,
    small_batch: bool = False,
) -> DataFrame:
    """Webhook deliveries and the diffs of their commits to scored results.

    ``small_batch`` drops the diffs of other commits before they are cut up.
    """
    asked = ingest.placeholders(deliveries, secret)
    if small_batch:
        diffs = enrich.announced_diffs(diffs, asked)
    snippets = diff_ops.function_snippets(diffs, timestamp)
    return score_snippets(enrich.enrich(asked, snippets, diff_ops.diff_hunks(diffs)), weights)


def repo_risk(diffs: DataFrame, weights: DataFrame, timestamp: int) -> DataFrame:
    """Share of vulnerable functions per repository: diff to snippets to scores to totals."""
    scored = score_snippets(diff_ops.function_snippets(diffs, timestamp), weights)
    return reads.store_stats(scored, "repo")

