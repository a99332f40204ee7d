"""The registered queries and, for each, the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from hunkwise.functions import text
from hunkwise.operators import (
    diffs as diff_ops,
    enrich,
    evaluation,
    ingest,
    latency,
    results as reads,
    scoring,
    training,
)
from hunkwise.plans import adapters as a, flows
from hunkwise.schemas import RESULT, SNIPPET, SNIPPET_COLUMNS
from hunkwise.session import run_dir
from hunkwise.sources import bus, compaction, tables
from hunkwise.streaming import feed, intake, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, *ctes: str):
    """Registers a query under ``name`` with its SQL, if there is one."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = a.sql(oracle, *ctes)
        return function

    return register


def _rounded(rows: DataFrame, digits: int, *columns: str) -> DataFrame:
    for name in columns:
        rows = rows.withColumn(name, F.round(F.col(name).cast("double"), digits))
    return rows


# --- sources and sinks --------------------------------------------------------


@query(
    "scan_deliveries",
    "SELECT event_type, count(*) AS deliveries, cast(sum(strlen(body)) AS bigint) AS body_bytes, "
    "count(signature) AS signed FROM a_signatures GROUP BY event_type",
    "a_signatures",
)
def scan_deliveries(spark, sf_dir):
    landing = run_dir(spark, "deliveries")
    tables.write_deliveries(a.deliveries(spark, sf_dir), landing)
    return (
        tables.read_deliveries(spark, landing)
        .groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("deliveries"),
            F.sum(F.octet_length("body")).alias("body_bytes"),
            F.count("signature").alias("signed"),
        )
    )


_SNIPPET_SQL = "code, repo, commit_sha, file_path, start_line, end_line, timestamp"


@query("snippet_bus_roundtrip", f"SELECT {_SNIPPET_SQL} FROM a_snippets", "a_snippets")
def snippet_bus_roundtrip(spark, sf_dir):
    topic = run_dir(spark, "topic")
    bus.publish_files(bus.encode(diff_ops.function_snippets(a.diffs(spark, sf_dir), a.STAMP_MS)), topic)
    return bus.decode(spark.read.schema(bus.MESSAGE).parquet(topic))


@query(
    "bus_malformed_quarantine",
    "SELECT 'decoded' AS kind, file_path, start_line, '' AS value FROM a_messages WHERE NOT malformed UNION ALL "
    "SELECT 'malformed', '', 0, concat('{\"code\":\"', replace(code, chr(10), '\\n'), '\",\"repo\":\"', repo, '\",\"commit_sha\":\"', commit_sha, "
    "'\",\"file_path\":\"', file_path, '\"', CASE WHEN event_id % 17 = 0 THEN '' ELSE concat(',\"start_line\":', start_line, "
    "',\"end_line\":', end_line, ',\"timestamp\":', timestamp) END) FROM a_messages WHERE malformed",
    "a_messages",
)
def bus_malformed_quarantine(spark, sf_dir):
    incoming = a.messages(spark, sf_dir)
    good = bus.decode(incoming).select(F.lit("decoded").alias("kind"), "file_path", "start_line", F.lit("").alias("value"))
    bad = bus.malformed(incoming).select(
        F.lit("malformed").alias("kind"), F.lit("").alias("file_path"), F.lit(0).cast("bigint").alias("start_line"), "value"
    )
    return good.unionByName(bad)


@query(
    "result_defaults",
    "SELECT CASE WHEN event_id % 10 = 0 THEN concat('anomaly-', repo, '/', substr(commit_sha, 1, 8), '/', file_path, '#L', start_line) "
    "ELSE id END AS id, repo, file_path, CASE WHEN event_id % 15 = 0 THEN 1700000000000 ELSE timestamp END AS timestamp FROM a_results",
    "a_results",
)
def result_defaults(spark, sf_dir):
    filled = reads.with_defaults(a.raw_results(spark, sf_dir), a.STAMP_MS)
    return filled.select("id", "repo", "file_path", "timestamp")


_REPORT = {"generated_at": "2024-02-01T00:00:00.000Z", "status": "vulnerable", "query": " App4 "}


@query(
    "incident_report_header",
    "SELECT '2024-02-01T00:00:00.000Z' AS generated_at, count(*) AS total_count, "
    "count(*) FILTER (WHERE is_anomalous) AS vulnerable_count, 'vulnerable' AS filter_applied, ' App4 ' AS search_query "
    "FROM a_results WHERE is_anomalous AND (contains(lower(file_path), 'app4') OR contains(lower(repo), 'app4') "
    "OR contains(lower(commit_sha), 'app4') OR contains(lower(label), 'app4'))",
    "a_results",
)
def incident_report_header(spark, sf_dir):
    return reads.report_header(a.results(spark, sf_dir), **_REPORT)


_STORED_COLUMNS = ("id", "file_path", "timestamp", "confidence", "latency_ms")


@query(
    "incident_report_rows",
    "SELECT id, file_path, timestamp, round(cast(confidence AS double), 5) AS confidence, round(cast(latency_ms AS double), 4) AS latency_ms "
    "FROM a_results WHERE is_anomalous AND (contains(lower(file_path), 'app4') OR contains(lower(repo), 'app4') "
    "OR contains(lower(commit_sha), 'app4') OR contains(lower(label), 'app4'))",
    "a_results",
)
def incident_report_rows(spark, sf_dir):
    """The body of a written report, read back."""
    folder = run_dir(spark, "report")
    reads.write_report(a.results(spark, sf_dir), folder, **_REPORT)
    rows = spark.read.schema(RESULT).json(f"{folder}/anomalies")
    return _rounded(_rounded(rows, 5, "confidence"), 4, "latency_ms").select(*_STORED_COLUMNS)


@query(
    "append_results",
    "SELECT id, file_path, timestamp, round(CASE WHEN event_id % 5 = 0 THEN 1 - cast(confidence AS double) ELSE cast(confidence AS double) END, 5) AS confidence, "
    "round(cast(latency_ms AS double), 4) AS latency_ms FROM a_results",
    "a_results",
)
def append_results(spark, sf_dir):
    """Every fifth result is appended again, with the same time and another score: the later arrival counts."""
    folder = run_dir(spark, "results")
    first = a.results(spark, sf_dir)
    again = first.filter(F.substring("id", -1, 1).isin("0", "5")).withColumn(
        "confidence", (1 - F.col("confidence").cast("double")).cast("float")
    )
    tables.append_results(first, folder, arrival=1)
    tables.append_results(again, folder, arrival=2)
    rows = reads.get_by_ids(tables.read_results(spark, folder), first.select("id"), "arrival")
    return _rounded(_rounded(rows, 5, "confidence"), 4, "latency_ms").select(*_STORED_COLUMNS)


# --- ingest -------------------------------------------------------------------


@query(
    "delivery_signature",
    f"SELECT concat('dlv-', o_orderkey) AS delivery_id, coalesce(starts_with(signature, 'sha256=') "
    f"AND lower(substr(signature, 8)) = {a._hmac_sql('encode(body)')}, false) AS signature_ok FROM a_signatures",
    "a_signatures",
)
def delivery_signature(spark, sf_dir):
    return ingest.checked(a.deliveries(spark, sf_dir), a.SECRET).select("delivery_id", "signature_ok")


# A small limit, so that the size check has something to refuse.
_SMALL_BODY = 400


@query(
    "delivery_status",
    f"SELECT concat('dlv-', o_orderkey) AS delivery_id, event_type, cast(CASE outcome WHEN 'too_large' THEN 413 "
    "WHEN 'unauthorized' THEN 401 WHEN 'unparsable' THEN 500 ELSE 200 END AS int) AS status, outcome FROM ("
    f"SELECT o.o_orderkey, o.event_type, CASE WHEN strlen(b.body) > {_SMALL_BODY} THEN 'too_large' ELSE o.outcome END AS outcome "
    "FROM a_outcomes o JOIN a_bodies b USING (o_orderkey))",
    "a_outcomes",
    "a_bodies",
)
def delivery_status(spark, sf_dir):
    return ingest.delivery_status(a.deliveries(spark, sf_dir), a.SECRET, _SMALL_BODY)


@query(
    "delivery_routing_counts",
    "SELECT event_type, outcome, count(*) AS deliveries FROM a_outcomes GROUP BY ALL",
    "a_outcomes",
)
def delivery_routing_counts(spark, sf_dir):
    return ingest.routing_counts(a.deliveries(spark, sf_dir), a.SECRET)


@query(
    "delivery_summary",
    "SELECT concat('dlv-', o.o_orderkey) AS delivery_id, cast(CASE outcome WHEN 'unauthorized' THEN 401 WHEN 'unparsable' THEN 500 "
    "ELSE 200 END AS int) AS status, outcome, cast(CASE WHEN outcome = 'ok' THEN coalesce(n, 0) ELSE 0 END AS int) AS snippets FROM a_outcomes o "
    "LEFT JOIN (SELECT o_orderkey, count(*) AS n FROM (SELECT o_orderkey FROM a_push_files UNION ALL SELECT o_orderkey FROM a_pr_markers) "
    "GROUP BY 1) f ON f.o_orderkey = o.o_orderkey",
    "a_push_files",
    "a_pr_markers",
)
def delivery_summary(spark, sf_dir):
    return ingest.delivery_summary(a.deliveries(spark, sf_dir), a.SECRET)


_PLACEHOLDER_SQL = (
    "SELECT '' AS code, repo, commit_sha, file_path, cast(0 AS bigint) AS start_line, cast(0 AS bigint) AS end_line, "
    f"o_orderkey * 1000 + {a.FIRST_DELIVERY_MS} AS timestamp FROM "
)


@query("push_files", _PLACEHOLDER_SQL + "a_push_files", "a_push_files")
def push_files(spark, sf_dir):
    return ingest.push_placeholders(a.deliveries(spark, sf_dir), a.SECRET)


@query("pull_request_markers", _PLACEHOLDER_SQL + "a_pr_markers", "a_pr_markers")
def pull_request_markers(spark, sf_dir):
    return ingest.pull_request_placeholders(a.deliveries(spark, sf_dir), a.SECRET)


@query(
    "placeholders_all",
    _PLACEHOLDER_SQL + "a_push_files UNION ALL " + _PLACEHOLDER_SQL + "a_pr_markers",
    "a_push_files",
    "a_pr_markers",
)
def placeholders_all(spark, sf_dir):
    return ingest.placeholders(a.deliveries(spark, sf_dir), a.SECRET)


@query(
    "code_file_filter",
    "SELECT path AS file_path, count(*) AS files FROM a_paths "
    r"WHERE regexp_matches(lower(path), '\.(c|cpp|cc|h|hpp|go|rs|py|js|ts|jsx|tsx|java)$') GROUP BY 1",
    "a_paths",
)
def code_file_filter(spark, sf_dir):
    paths = a.table(spark, sf_dir, "lineitem").select(F.expr(a._LINE_PATH).alias("file_path"))
    return ingest.code_files(paths).groupBy("file_path").agg(F.count(F.lit(1)).alias("files"))


# --- diffs --------------------------------------------------------------------

_REPO_SHA = "concat('org/repo', doc_id % 20) AS repo, md5(concat('d', doc_id)) AS commit_sha"


@query(
    "diff_files",
    f"SELECT {_REPO_SHA}, cast(0 AS int) AS file_seq, concat('src/d', doc_id, '.c') AS file_path FROM documents "
    f"UNION ALL SELECT {_REPO_SHA}, cast(1 AS int), 'README.md' FROM documents",
)
def diff_files(spark, sf_dir):
    return diff_ops.diff_files(a.diffs(spark, sf_dir)).select("repo", "commit_sha", "file_seq", "file_path")


@query(
    "diff_hunks",
    f"SELECT {_REPO_SHA}, file_path, cast(hunk_seq AS int) AS hunk_seq, cast(start_line AS bigint) AS start_line, "
    "cast(added_lines AS int) AS added_lines FROM ("
    "SELECT doc_id, concat('src/d', doc_id, '.c') AS file_path, 1 AS hunk_seq, doc_id % 50 + 1 AS start_line, "
    "count(*) FILTER (WHERE NOT starts_with(l, '++')) + count(*) FILTER (WHERE doc_id % 7 <> 0 AND i % 4 = 0) AS added_lines "
    "FROM a_lines GROUP BY doc_id "
    "UNION ALL SELECT doc_id, concat('src/d', doc_id, '.c'), 2, doc_id % 50 + 901, 1 FROM documents "
    "UNION ALL SELECT doc_id, 'README.md', 1, 1, 1 FROM documents) WHERE added_lines > 0",
    "a_lines",
)
def diff_hunks(spark, sf_dir):
    return diff_ops.diff_hunks(a.diffs(spark, sf_dir)).select(
        "repo", "commit_sha", "file_path", "hunk_seq", "start_line", F.size("added").alias("added_lines")
    )


@query("function_snippets", f"SELECT {_SNIPPET_SQL} FROM a_snippets", "a_snippets")
def function_snippets(spark, sf_dir):
    return diff_ops.function_snippets(a.diffs(spark, sf_dir), a.STAMP_MS)


def _snippets(spark, sf_dir):
    return diff_ops.function_snippets(a.diffs(spark, sf_dir), a.STAMP_MS)


@query(
    "snippet_id",
    "SELECT concat(repo, '/', substr(commit_sha, 1, 8), '/', file_path, '#L', start_line) AS id, end_line FROM a_snippets",
    "a_snippets",
)
def snippet_id(spark, sf_dir):
    return diff_ops.with_snippet_id(_snippets(spark, sf_dir)).select("id", "end_line")


@query(
    "snippet_lines",
    "SELECT repo, commit_sha, file_path, start_line, cast(start_line + i - 1 AS bigint) AS line_number, content FROM ("
    "SELECT *, unnest(string_split(code, chr(10))) AS content, generate_subscripts(string_split(code, chr(10)), 1) AS i "
    "FROM a_snippets WHERE code <> '')",
    "a_snippets",
)
def snippet_lines(spark, sf_dir):
    return diff_ops.snippet_lines(_snippets(spark, sf_dir)).select(
        "repo", "commit_sha", "file_path", "start_line", "line_number", "content"
    )


@query(
    "scorable_snippets",
    "SELECT CASE WHEN code = '' THEN 'empty code' ELSE '' END AS reason, file_path, start_line, code FROM a_messages WHERE NOT malformed",
    "a_messages",
)
def scorable_snippets(spark, sf_dir):
    snippets = bus.decode(a.messages(spark, sf_dir))
    good = enrich.scorable(snippets).withColumn("reason", F.lit(""))
    return good.unionByName(enrich.unscorable(snippets)).select("reason", "file_path", "start_line", "code")


# --- joins --------------------------------------------------------------------


@query(
    "enriched_snippets",
    "SELECT s.code, s.repo, s.commit_sha, s.file_path, s.start_line, s.end_line, "
    f"p.o_orderkey * 1000 + {a.FIRST_DELIVERY_MS} AS timestamp FROM a_snippets s JOIN a_push_files p "
    "ON p.repo = s.repo AND p.commit_sha = s.commit_sha AND p.file_path = s.file_path",
    "a_snippets",
    "a_push_files",
)
def enriched_snippets(spark, sf_dir):
    return enrich.enrich_files(push_files(spark, sf_dir), _snippets(spark, sf_dir))


@query(
    "enriched_pr_snippets",
    "SELECT s.code, s.repo, s.commit_sha, s.file_path, s.start_line, s.end_line, "
    f"p.o_orderkey * 1000 + {a.FIRST_DELIVERY_MS} AS timestamp FROM a_snippets s JOIN a_pr_markers p "
    "ON p.repo = s.repo AND p.commit_sha = s.commit_sha",
    "a_snippets",
    "a_pr_markers",
)
def enriched_pr_snippets(spark, sf_dir):
    return enrich.enrich_pull_requests(pull_request_markers(spark, sf_dir), _snippets(spark, sf_dir))


@query(
    "unenriched_placeholders",
    "SELECT repo, commit_sha, file_path FROM a_push_files p WHERE NOT EXISTS (SELECT 1 FROM a_snippets s "
    "WHERE s.repo = p.repo AND s.commit_sha = p.commit_sha AND s.file_path = p.file_path) "
    "UNION ALL SELECT repo, commit_sha, file_path FROM a_pr_markers p WHERE NOT EXISTS (SELECT 1 FROM a_snippets s "
    "WHERE s.repo = p.repo AND s.commit_sha = p.commit_sha)",
    "a_snippets",
    "a_push_files",
    "a_pr_markers",
)
def unenriched_placeholders(spark, sf_dir):
    hunks = diff_ops.diff_hunks(a.diffs(spark, sf_dir))
    missing = enrich.unenriched(placeholders_all(spark, sf_dir), hunks)
    return missing.select("repo", "commit_sha", "file_path")


# --- scoring ------------------------------------------------------------------


@query(
    "token_vocab",
    f"SELECT token, n, cast(row_number() OVER (ORDER BY n DESC, token) + 1 AS int) AS token_id FROM (SELECT token, count(*) AS n FROM ("
    f"SELECT unnest(regexp_extract_all(code, {a.TOKEN_SQL})) AS token FROM a_snippets) GROUP BY token ORDER BY n DESC, token "
    f"LIMIT {a.VOCABULARY_TERMS})",
    "a_snippets",
)
def token_vocab(spark, sf_dir):
    return scoring.token_vocabulary(_snippets(spark, sf_dir), a.VOCABULARY_TERMS)


_VOCAB_ALL_SQL = (
    "SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id FROM ("
    f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(code, {a.TOKEN_SQL})) AS token FROM a_snippets) GROUP BY token)"
)


@query("token_vocab_all", _VOCAB_ALL_SQL, "a_snippets")
def token_vocab_all(spark, sf_dir):
    return scoring.token_vocabulary(_snippets(spark, sf_dir))


def _encode_sql(limit: str = "") -> str:
    """Fixed-length ids of all texts by the vocabulary of all or of the first terms."""
    return (
        f"WITH tok AS (SELECT doc_id, t, i FROM (SELECT doc_id, unnest(regexp_extract_all(text, {a.TOKEN_SQL})) AS t, "
        f"generate_subscripts(regexp_extract_all(text, {a.TOKEN_SQL}), 1) AS i FROM documents)), "
        f"vocab AS (SELECT t, row_number() OVER (ORDER BY n DESC, t) + 1 AS id FROM (SELECT t, count(*) AS n FROM tok GROUP BY t{limit})), "
        f"ids AS (SELECT doc_id, count(*) AS n, string_agg(coalesce(id, 1), ',' ORDER BY i) FILTER (WHERE i <= {scoring.MAX_LENGTH}) AS ids "
        "FROM tok LEFT JOIN vocab USING (t) GROUP BY doc_id) "
        "SELECT doc_id, cast(coalesce(n, 0) AS int) AS n_tokens, concat(coalesce(ids, ''), CASE WHEN n IS NULL THEN substr(repeat(',0', 512), 2) "
        "ELSE repeat(',0', cast(greatest(512 - n, 0) AS int)) END) AS input_ids, "
        "substr(concat(repeat(',1', cast(least(coalesce(n, 0), 512) AS int)), repeat(',0', cast(greatest(512 - coalesce(n, 0), 0) AS int))), 2) AS attention_mask "
        "FROM documents LEFT JOIN ids USING (doc_id)"
    )


def _encoded(spark, sf_dir, size):
    texts = a.documents(spark, sf_dir).select("doc_id", F.col("text").alias("code"))
    return scoring.encode(texts, scoring.token_vocabulary(texts, size)).select(
        "doc_id",
        "n_tokens",
        F.array_join("input_ids", ",").alias("input_ids"),
        F.array_join("attention_mask", ",").alias("attention_mask"),
    )


@query("encode_pad", _encode_sql(f" ORDER BY n DESC, t LIMIT {a.VOCABULARY_TERMS}"))
def encode_pad(spark, sf_dir):
    return _encoded(spark, sf_dir, a.VOCABULARY_TERMS)


@query("encode_all", _encode_sql())
def encode_all(spark, sf_dir):
    return _encoded(spark, sf_dir, None)


def _weights(spark, sf_dir):
    """Of all tokens of the training rows."""
    split = training.with_validation(training.prepare(a.labelled(spark, sf_dir)), "doc_id")
    return training.token_weights(split.filter(F.col("split") == training.TRAIN))


@query("linear_weights", "SELECT token, round(w0, 6) AS w0, round(w1, 6) AS w1 FROM a_weights", "a_weights")
def linear_weights(spark, sf_dir):
    return _rounded(_weights(spark, sf_dir), 6, "w0", "w1")


def _logits_sql(source: str, key: str) -> str:
    """Logits per row of ``source``; rows without a known token keep zero."""
    return (
        f"SELECT s.*, coalesce(l0, 0) AS logit0, coalesce(l1, 0) AS logit1 FROM {source} s LEFT JOIN ("
        f"SELECT code AS {key}, sum(w0) AS l0, sum(w1) AS l1 FROM (SELECT code, unnest(regexp_extract_all(code, {a.TOKEN_SQL})) AS token "
        f"FROM (SELECT DISTINCT code FROM {source})) JOIN a_weights USING (token) GROUP BY code) w ON w.{key} = s.code"
    )


_P_SQL = "exp(logit1 - greatest(logit0, logit1)) / (exp(logit0 - greatest(logit0, logit1)) + exp(logit1 - greatest(logit0, logit1)))"
_LABELLED_SQL = (
    f"SELECT *, round(cast(confidence32 AS double), 5) AS confidence, confidence32 > 0.5 AS is_anomalous, "
    f"CASE WHEN confidence32 > 0.5 THEN 'vulnerable' ELSE 'clean' END AS label FROM (SELECT *, cast({_P_SQL} AS float) AS confidence32 FROM scored)"
)


@query(
    "score_linear",
    f"WITH scored AS ({_logits_sql('a_snippets', 'k')}) SELECT repo, commit_sha, file_path, start_line, "
    "round(logit0, 6) AS logit0, round(logit1, 6) AS logit1 FROM scored",
    "a_snippets",
    "a_weights",
)
def score_linear(spark, sf_dir):
    scored = scoring.linear_logits(_snippets(spark, sf_dir), _weights(spark, sf_dir))
    return _rounded(scored, 6, "logit0", "logit1").select(
        "repo", "commit_sha", "file_path", "start_line", "logit0", "logit1"
    )


@query("score_linear_join", ORACLES["score_linear"])
def score_linear_join(spark, sf_dir):
    """The same with weights that come in two parts, which add up."""
    whole = _weights(spark, sf_dir)
    parts = whole.withColumn("w0", F.col("w0") - 1).unionByName(whole.withColumns({"w0": F.lit(1.0), "w1": F.lit(0.0)}))
    scored = scoring.linear_logits(_snippets(spark, sf_dir), parts)
    return _rounded(scored, 6, "logit0", "logit1").select(
        "repo", "commit_sha", "file_path", "start_line", "logit0", "logit1"
    )


@query(
    "score_label",
    f"WITH scored AS (SELECT event_id, value / 40 AS logit0, cast(event_id % 13 AS double) - 6 AS logit1 FROM events), "
    f"labelled AS ({_LABELLED_SQL}) SELECT event_id, confidence, is_anomalous, label FROM labelled",
)
def score_label(spark, sf_dir):
    logits = a.table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("value") / 40).alias("logit0"),
        ((F.col("event_id") % 13).cast("double") - 6).alias("logit1"),
    )
    labelled = scoring.with_label(logits)
    return _rounded(labelled, 5, "confidence").select("event_id", "confidence", "is_anomalous", "label")


_RESULT_OUT = "id, repo, commit_sha, file_path, start_line, end_line, code, is_anomalous, confidence, label"
_WITH_ID = (
    "*, concat(repo, '/', substr(commit_sha, 1, 8), '/', file_path, '#L', start_line, '@', "
    "md5(concat_ws(chr(10), repo, commit_sha, file_path, start_line, end_line, timestamp, code))) AS id"
)
_OUT_COLUMNS = _RESULT_OUT.split(", ")
_ANNOUNCED_AT = f"p.o_orderkey * 1000 + {a.FIRST_DELIVERY_MS} AS timestamp"


@query(
    "scored_snippets",
    f"WITH announced AS (SELECT s.* REPLACE ({_ANNOUNCED_AT}) FROM a_snippets s JOIN a_push_files p ON p.repo = s.repo AND p.commit_sha = s.commit_sha "
    f"AND p.file_path = s.file_path UNION ALL SELECT s.* REPLACE ({_ANNOUNCED_AT}) FROM a_snippets s JOIN a_pr_markers p ON p.repo = s.repo AND p.commit_sha = s.commit_sha), "
    f"scored AS ({_logits_sql('announced', 'k')}), labelled AS ({_LABELLED_SQL}) SELECT {_RESULT_OUT} FROM (SELECT {_WITH_ID} FROM labelled)",
    "a_snippets",
    "a_push_files",
    "a_pr_markers",
    "a_weights",
)
def scored_snippets(spark, sf_dir):
    scored = flows.deliveries_to_results(
        a.deliveries(spark, sf_dir), a.diffs(spark, sf_dir), _weights(spark, sf_dir), a.SECRET, a.STAMP_MS
    )
    return _rounded(scored, 5, "confidence").select(_OUT_COLUMNS)


@query(
    "repo_risk",
    f"WITH scored AS ({_logits_sql('a_snippets', 'k')}), labelled AS ({_LABELLED_SQL}) SELECT repo, count(*) AS total_analyzed, "
    "count(*) FILTER (WHERE is_anomalous) AS anomalies_found, count(*) FILTER (WHERE NOT is_anomalous) AS clean, "
    "round(count(*) FILTER (WHERE is_anomalous) / count(*), 6) AS anomaly_rate FROM labelled GROUP BY repo",
    "a_snippets",
    "a_weights",
)
def repo_risk(spark, sf_dir):
    risk = flows.repo_risk(a.diffs(spark, sf_dir), _weights(spark, sf_dir), a.STAMP_MS)
    return _rounded(risk, 6, "anomaly_rate").select(
        "repo", "total_analyzed", "anomalies_found", "clean", "anomaly_rate"
    )


def _length_model(refused: str | None = None):
    """Loader of a small model over code length and parentheses, for the Arrow scorer.

    Nested functions travel to the workers by value. A batch with a text that
    contains ``refused`` fails.
    """

    def load():
        def predict(codes):
            if refused and any(refused in code for code in codes):
                raise ValueError("not code")
            lengths = np.array([len(code) for code in codes], dtype="float64")
            calls = np.array([code.count("(") for code in codes], dtype="float64")
            return np.stack([lengths / 256, calls], axis=1)

        return predict

    return load


@query(
    "score_batch",
    "SELECT repo, commit_sha, file_path, start_line, round(length(code) / 256, 6) AS logit0, "
    "cast(length(code) - length(replace(code, '(', '')) AS double) AS logit1 FROM a_snippets",
    "a_snippets",
)
def score_batch(spark, sf_dir):
    scored, _ = scoring.split_failures(scoring.batch_logits(_snippets(spark, sf_dir), _length_model()))
    return _rounded(scored, 6, "logit0", "logit1").select(
        "repo", "commit_sha", "file_path", "start_line", "logit0", "logit1"
    )


@query(
    "score_quarantine",
    "SELECT repo, commit_sha, file_path, start_line, CASE WHEN contains(code, 'new text') THEN 'not code' ELSE '' END AS error FROM a_snippets",
    "a_snippets",
)
def score_quarantine(spark, sf_dir):
    scored = scoring.batch_logits(_snippets(spark, sf_dir), _length_model("new text"), on_error="quarantine")
    good, bad = scoring.split_failures(scored)
    columns = ["repo", "commit_sha", "file_path", "start_line"]
    return good.select(*columns, F.lit("").alias("error")).unionByName(bad.select(*columns, "error"))


@query("score_ml")
def score_ml(spark, sf_dir):
    """Snippets scored by a fitted ``pyspark.ml`` pipeline."""
    fitted = training.fit(_dataset(spark, sf_dir), max_iter=5)
    scored = scoring.with_label(scoring.pipeline_logits(_snippets(spark, sf_dir), fitted))
    return scoring.as_results(scored)


# --- reads over results -------------------------------------------------------


@query(
    "latest_anomalies",
    f"SELECT id, timestamp, confidence_r AS confidence, cast(rank AS int) AS rank, total FROM (SELECT id, timestamp, round(cast(confidence AS double), 5) AS confidence_r, "
    "row_number() OVER (ORDER BY timestamp DESC, id) AS rank, count(*) OVER () AS total FROM a_results) WHERE rank <= 100",
    "a_results",
)
def latest_anomalies(spark, sf_dir):
    return _rounded(reads.latest(a.results(spark, sf_dir)), 5, "confidence").select(
        "id", "timestamp", "confidence", "rank", "total"
    )


@query("latest_stored", ORACLES["latest_anomalies"])
def latest_stored(spark, sf_dir):
    """The same from the stored table, of which only the newest days are read."""
    folder = run_dir(spark, "results")
    tables.append_results(a.results(spark, sf_dir), folder)
    newest = reads.latest(tables.read_results(spark, folder), day="day")
    return _rounded(newest, 5, "confidence").select("id", "timestamp", "confidence", "rank", "total")


_LAST_SQL = (
    "SELECT id, timestamp, round(cast(confidence AS double), 5) AS confidence, label FROM "
    "(SELECT *, row_number() OVER (PARTITION BY id ORDER BY timestamp DESC) AS age FROM a_result_log) WHERE age = 1"
)


def _errors(spark, sf_dir):
    errors = a.table(spark, sf_dir, "events").filter("event_type = 'error'")
    return errors.select(F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("id"))


@query("get_by_id", f"{_LAST_SQL} AND id = 'evt-20'", "a_result_log")
def get_by_id(spark, sf_dir):
    row = reads.get_by_id(a.result_log(spark, sf_dir), "evt-20")
    return _rounded(row, 5, "confidence").select("id", "timestamp", "confidence", "label")


@query("get_by_ids", f"{_LAST_SQL} AND event_id IN (SELECT event_id FROM events WHERE event_type = 'error')", "a_result_log")
def get_by_ids(spark, sf_dir):
    rows = reads.get_by_ids(a.result_log(spark, sf_dir), _errors(spark, sf_dir))
    return _rounded(rows, 5, "confidence").select("id", "timestamp", "confidence", "label")


@query("get_by_ids_compacted", ORACLES["get_by_ids"])
def get_by_ids_compacted(spark, sf_dir):
    """The same from a stream's folders that are compacted twice, the newest batch left as it is."""
    batches, compacted = run_dir(spark, "results"), run_dir(spark, "compacted")
    rows, again = a.result_waves(spark, sf_dir)
    odd = F.col("event_id") % 2 == 1
    for batch_id, wave in enumerate((rows, again.filter(odd), again.filter(~odd))):
        stored = tables.stored_form(wave, arrival=batch_id)
        stored.write.partitionBy("day").parquet(f"{batches}/batch_id={batch_id}")
        compaction.compact(spark, batches, compacted)
    stored = compaction.read_compacted(spark, batches, compacted)
    found = reads.get_by_ids(stored, _errors(spark, sf_dir), "arrival")
    return _rounded(found, 5, "confidence").select("id", "timestamp", "confidence", "label")


@query(
    "anomaly_stats",
    "SELECT count(*) AS total_analyzed, count(*) FILTER (WHERE is_anomalous) AS anomalies_found, "
    "count(*) FILTER (WHERE NOT is_anomalous) AS clean, round(count(*) FILTER (WHERE is_anomalous) / greatest(count(*), 1), 6) AS anomaly_rate, "
    "round(coalesce(avg(cast(latency_ms AS double)), 0), 6) AS avg_latency_ms FROM a_results",
    "a_results",
)
def anomaly_stats(spark, sf_dir):
    return _rounded(reads.store_stats(a.results(spark, sf_dir)), 6, "anomaly_rate", "avg_latency_ms")


@query(
    "feed_counts",
    "SELECT count(*) AS total, count(*) FILTER (WHERE is_anomalous) AS vulnerable, count(*) FILTER (WHERE NOT is_anomalous) AS clean FROM a_results",
    "a_results",
)
def feed_counts(spark, sf_dir):
    return reads.feed_counts(a.results(spark, sf_dir))


@query(
    "scorer_stats",
    "SELECT 'token-weights' AS model_name, count(*) AS total_predictions, round(coalesce(avg(cast(latency_ms AS double)), 0), 6) AS avg_latency_ms FROM a_results",
    "a_results",
)
def scorer_stats(spark, sf_dir):
    return _rounded(reads.scorer_stats(a.results(spark, sf_dir), "token-weights"), 6, "avg_latency_ms")


@query("feed_filter", "SELECT id, file_path FROM a_results WHERE NOT is_anomalous", "a_results")
def feed_filter(spark, sf_dir):
    return reads.filter_status(a.results(spark, sf_dir), reads.CLEAN).select("id", "file_path")


@query(
    "feed_search",
    "SELECT id, file_path, repo FROM a_results WHERE contains(lower(file_path), 'f1') OR contains(lower(repo), 'f1') "
    "OR contains(commit_sha, 'f1') OR contains(label, 'f1')",
    "a_results",
)
def feed_search(spark, sf_dir):
    return reads.search(a.results(spark, sf_dir), "  F1 ").select("id", "file_path", "repo")


def _register_feed(name: str, mode: str, order: str) -> None:
    oracle = (
        "SELECT id, cast(rank AS int) AS rank FROM (SELECT id, row_number() OVER (ORDER BY "
        f"{order}, id) AS rank FROM (SELECT * FROM a_results ORDER BY timestamp DESC, id LIMIT {reads.FEED_LIMIT}) WHERE is_anomalous)"
    )

    @query(name, oracle, "a_results")
    def feed_top(spark, sf_dir):
        return reads.feed(a.results(spark, sf_dir), status=reads.VULNERABLE, sort=mode).select("id", "rank")


_register_feed("feed_top_newest", reads.NEWEST, "timestamp DESC")
_register_feed("feed_top_high_risk", reads.HIGHEST_RISK, "confidence DESC")
_register_feed("feed_top_low_risk", reads.LOWEST_RISK, "confidence")
_register_feed("feed_top_latency", reads.LATENCY, "latency_ms DESC")


@query(
    "rolling_feed",
    "SELECT id, timestamp, cast(rank AS int) AS rank FROM (SELECT id, timestamp, row_number() OVER (ORDER BY timestamp DESC, id) AS rank "
    "FROM a_results) WHERE rank <= 500",
    "a_results",
)
def rolling_feed(spark, sf_dir):
    return reads.rolling_feed(a.results(spark, sf_dir)).select("id", "timestamp", "rank")


@query(
    "feed_display",
    "SELECT id, repo, file_path, label, substr(commit_sha, 1, 8) AS short_sha, "
    "concat(cast(round(cast(cast(confidence AS double) * 100 AS decimal(30, 10)), 1) AS decimal(20, 1)), '%') AS confidence_text, "
    "concat(cast(round(cast(cast(latency_ms AS double) AS decimal(30, 10)), 1) AS decimal(20, 1)), 'ms') AS latency_text, "
    "concat('L', start_line, '–L', end_line) AS line_range, strftime(make_timestamp(timestamp * 1000), '%H:%M:%S') AS time_text FROM a_results",
    "a_results",
)
def feed_display(spark, sf_dir):
    return reads.display(a.results(spark, sf_dir))


# --- latency ------------------------------------------------------------------


@query(
    "latency_percentiles",
    "SELECT round(cast(quantile_disc(latency_ms, 0.5) AS double), 4) AS p50, round(cast(quantile_disc(latency_ms, 0.95) AS double), 4) AS p95, "
    "round(cast(quantile_disc(latency_ms, 0.99) AS double), 4) AS p99 FROM a_results",
    "a_results",
)
def latency_percentiles(spark, sf_dir):
    return _rounded(latency.latency_percentiles(a.results(spark, sf_dir)), 4, "p50", "p95", "p99")


def _bucket_sql(width: int, tail: str = "") -> str:
    return (
        "SELECT bucket_ms, count(*) AS samples, round(avg(cast(latency_ms AS double)), 6) AS latency, "
        "round(cast(max(latency_ms) FILTER (WHERE r = cast(floor(n * 99 / 100) AS bigint) + 1) AS double), 4) AS p99 FROM ("
        "SELECT *, row_number() OVER (PARTITION BY bucket_ms ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY bucket_ms) AS n "
        f"FROM (SELECT timestamp // {width} * {width} AS bucket_ms, latency_ms FROM a_results)) GROUP BY bucket_ms {tail}"
    )


def _shown(buckets: DataFrame) -> DataFrame:
    return _rounded(_rounded(buckets, 6, "latency"), 4, "p99").select("bucket_ms", "samples", "latency", "p99")


DAY_MS = 86_400_000


@query("latency_buckets", _bucket_sql(latency.BUCKET_MS), "a_results")
def latency_buckets(spark, sf_dir):
    return _shown(latency.latency_buckets(a.results(spark, sf_dir)))


@query("latency_buckets_daily", _bucket_sql(DAY_MS), "a_results")
def latency_buckets_daily(spark, sf_dir):
    return _shown(latency.latency_buckets(a.results(spark, sf_dir), DAY_MS))


@query("latency_buckets_last30", _bucket_sql(latency.BUCKET_MS, "ORDER BY bucket_ms DESC LIMIT 30"), "a_results")
def latency_buckets_last30(spark, sf_dir):
    return _shown(latency.last_buckets(a.results(spark, sf_dir)))


# --- evaluation ---------------------------------------------------------------


def _pairs(spark, sf_dir):
    predicted = evaluation.with_prediction(a.predictions(spark, sf_dir))
    return evaluation.pair_with_labels(predicted, a.true_labels(spark, sf_dir), "doc_id")


@query("predictions_vs_labels", "SELECT doc_id, label, pred, prob FROM a_pairs", "a_pairs")
def predictions_vs_labels(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", "label", "pred", "prob")


@query(
    "score_parity",
    "SELECT count(b) AS compared, count(*) - count(b) AS unmatched, round(max(abs(a - b)), 8) AS max_diff, max(abs(a - b)) < 0.0001 AS passed "
    "FROM (SELECT prob AS a, CASE WHEN doc_id % 100 <> 99 THEN prob + CASE WHEN doc_id % 9 = 0 THEN 0.00005 ELSE 0 END END AS b FROM a_pairs)",
    "a_pairs",
)
def score_parity(spark, sf_dir):
    parity = evaluation.score_parity(
        a.predictions(spark, sf_dir), a.other_predictions(spark, sf_dir), "doc_id", "prob"
    )
    return _rounded(parity, 8, "max_diff")


_CELLS = (
    "count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp, "
    "count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp FROM a_pairs"
)


@query("confusion_matrix", f"SELECT {_CELLS}", "a_pairs")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_counts(_pairs(spark, sf_dir))


@query(
    "binary_metrics",
    f"WITH c AS (SELECT {_CELLS}) SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, "
    "round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c",
    "a_pairs",
)
def binary_metrics(spark, sf_dir):
    return _rounded(evaluation.binary_metrics(_pairs(spark, sf_dir)), 6, "accuracy", "f1", "precision", "recall")


@query(
    "classification_report",
    f"WITH c AS (SELECT {_CELLS}), r AS (SELECT 'Clean' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, 2 * tn / (2 * tn + fn + fp) AS f, tn + fp AS s FROM c "
    "UNION ALL SELECT 'Vulnerable', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM c) "
    "SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, s AS support FROM r "
    "UNION ALL SELECT 'accuracy', NULL, NULL, round((tp + tn) / (tp + tn + fp + fn), 4), tp + tn + fp + fn FROM c "
    "UNION ALL SELECT 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), cast(sum(s) AS bigint) FROM r "
    "UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 4), round(sum(r * s) / sum(s), 4), round(sum(f * s) / sum(s), 4), cast(sum(s) AS bigint) FROM r",
    "a_pairs",
)
def classification_report(spark, sf_dir):
    return evaluation.classification_report(_pairs(spark, sf_dir))


@query(
    "roc_auc",
    "WITH s AS (SELECT prob, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM a_pairs GROUP BY prob), "
    "w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s) "
    "SELECT round(cast(sum(pos * (below + neg / 2)) AS double) / cast(sum(pos) * sum(neg) AS double), 6) AS roc_auc FROM w",
    "a_pairs",
)
def roc_auc(spark, sf_dir):
    return _rounded(evaluation.roc_auc(_pairs(spark, sf_dir)), 6, "roc_auc")


@query(
    "log_loss",
    "SELECT round(avg(-CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM "
    "(SELECT label, least(greatest(prob, 0.0000001), 0.9999999) AS p FROM a_pairs)",
    "a_pairs",
)
def log_loss(spark, sf_dir):
    return _rounded(evaluation.log_loss(_pairs(spark, sf_dir)), 6, "log_loss")


# --- dataset and training -----------------------------------------------------


def _dataset(spark, sf_dir):
    return training.with_validation(training.prepare(a.labelled(spark, sf_dir)), "doc_id")


@query("dataset_split", "SELECT doc_id, code, label, split FROM a_labelled", "a_labelled")
def dataset_split(spark, sf_dir):
    folder = run_dir(spark, "dataset")
    tables.write_dataset(_dataset(spark, sf_dir), folder)
    return tables.read_dataset(spark, folder).select("doc_id", "code", "label", "split")


@query(
    "dataset_split_counts",
    "SELECT 'token-weights' AS model_name, cast(512 AS int) AS max_length, count(*) FILTER (WHERE split = 'train') AS train, "
    "count(*) FILTER (WHERE split = 'validation') AS validation, count(*) FILTER (WHERE split = 'test') AS test FROM a_labelled",
    "a_labelled",
)
def dataset_split_counts(spark, sf_dir):
    stats = training.dataset_stats(_dataset(spark, sf_dir), "token-weights")
    return stats.select("model_name", "max_length", "splits.*")


@query(
    "dataset_label_distribution",
    "SELECT split, count(*) AS samples, count(*) FILTER (WHERE label = 1) AS vulnerable, count(*) FILTER (WHERE label <> 1) AS clean "
    "FROM a_labelled GROUP BY split",
    "a_labelled",
)
def dataset_label_distribution(spark, sf_dir):
    return training.label_distribution(_dataset(spark, sf_dir))


@query("training_history")
def training_history(spark, sf_dir):
    history, _ = training.train(_dataset(spark, sf_dir), (1, 3, 5), run_dir(spark, "features"))
    return history


@query(
    "best_epoch",
    "WITH h AS (SELECT epoch, tp, fp, fn, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM ("
    "SELECT epoch, count(*) FILTER (WHERE label = 1 AND prob > epoch / 10) AS tp, count(*) FILTER (WHERE label = 0 AND prob > epoch / 10) AS fp, "
    "count(*) FILTER (WHERE label = 1 AND prob <= epoch / 10) AS fn FROM a_pairs, (SELECT unnest(range(1, 10)) AS epoch) GROUP BY epoch)) "
    "SELECT cast(epoch AS int) AS epoch, round(f1, 6) AS f1 FROM h WHERE f1 > 0 ORDER BY f1 DESC, epoch LIMIT 1",
    "a_pairs",
)
def best_epoch(spark, sf_dir):
    """Best of nine candidates that differ in their threshold."""
    pairs = evaluation.pair_with_labels(a.predictions(spark, sf_dir), a.true_labels(spark, sf_dir), "doc_id")
    candidates = pairs.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn(
        "pred", (F.col("prob") > F.col("epoch") / 10).cast("int")
    )
    history = evaluation.binary_metrics(candidates, "epoch").select("epoch", F.struct("f1").alias("val"))
    best = training.best_epoch(history).select("epoch", F.col("val.f1").alias("f1"))
    return _rounded(best, 6, "f1")


# --- streaming ----------------------------------------------------------------


def _published(spark, sf_dir) -> str:
    topic = run_dir(spark, "topic")
    bus.publish_files(a.messages(spark, sf_dir), topic)
    return topic


def _messages_and_scorer(spark, sf_dir):
    weights = run_dir(spark, "weights")
    _weights(spark, sf_dir).write.parquet(weights)
    stored = spark.read.parquet(weights)
    return bus.consume_files(spark, _published(spark, sf_dir)), lambda rows: scoring.linear_logits(rows, stored)


_STREAM_SCORED = (
    "scorable AS (SELECT * FROM a_messages WHERE NOT malformed AND code <> ''), "
    f"scored AS ({_logits_sql('scorable', 'k')}), labelled AS ({_LABELLED_SQL})"
)


@query(
    "stream_scored_feed",
    f"WITH {_STREAM_SCORED} SELECT {_RESULT_OUT} FROM (SELECT {_WITH_ID} FROM labelled)",
    "a_messages",
    "a_weights",
)
def stream_scored_feed(spark, sf_dir):
    out, checkpoint = run_dir(spark, "results"), run_dir(spark, "checkpoint")
    messages, scorer = _messages_and_scorer(spark, sf_dir)
    feed.write_results(messages, out, checkpoint, scorer, available_now=True).awaitTermination()
    return _rounded(tables.read_results(spark, out), 5, "confidence").select(_OUT_COLUMNS)


@query(
    "stream_fanout_counts",
    "WITH scorable AS (SELECT * FROM a_messages WHERE NOT malformed AND code <> '') "
    "SELECT count(*) AS results, least(count(*), 500) AS feed_rows, max(timestamp) AS newest, "
    "(SELECT min(timestamp) FROM (SELECT timestamp FROM scorable ORDER BY timestamp DESC LIMIT 500)) AS oldest_in_feed FROM scorable",
    "a_messages",
)
def stream_fanout_counts(spark, sf_dir):
    out, shown, checkpoint = (run_dir(spark, name) for name in ("results", "feed", "checkpoint"))
    messages, scorer = _messages_and_scorer(spark, sf_dir)
    feed.fan_out(messages, out, shown, checkpoint, scorer=scorer, available_now=True).awaitTermination()
    stored = feed.read_fanned_results(spark, out)
    latest = feed.read_feed(spark, shown)
    return stored.agg(F.count(F.lit(1)).alias("results"), F.max("timestamp").alias("newest")).select(
        "results",
        latest.agg(F.count(F.lit(1))).scalar().alias("feed_rows"),
        "newest",
        latest.agg(F.min("timestamp")).scalar().alias("oldest_in_feed"),
    )


@query("stream_latency_windows", ORACLES["latency_buckets"])
def stream_latency_windows(spark, sf_dir):
    out, checkpoint = run_dir(spark, "windows"), run_dir(spark, "checkpoint")
    stream = a.stream_results(spark, sf_dir)
    live.write_latency_windows(stream, out, checkpoint, available_now=True).awaitTermination()
    return _shown(live.read_latency_windows(spark, out))


@query("stream_running_stats", ORACLES["anomaly_stats"])
def stream_running_stats(spark, sf_dir):
    out, checkpoint = run_dir(spark, "stats"), run_dir(spark, "checkpoint")
    live.running_stats(a.stream_results(spark, sf_dir), out, checkpoint, available_now=True).awaitTermination()
    return _rounded(live.read_running_stats(spark, out), 6, "anomaly_rate", "avg_latency_ms")


@query("stream_redeliveries", ORACLES["delivery_status"])
def stream_redeliveries(spark, sf_dir):
    """Later deliveries with repeats of earlier ones, over three runs of one checkpoint."""
    landed, out, checkpoint = (run_dir(spark, name) for name in ("landed", "once", "checkpoint"))
    first, again = a.redelivered(spark, sf_dir)
    for wave in (*first, again):
        tables.write_deliveries(wave, landed)
        stream = tables.stream_deliveries(spark, landed)
        intake.write_once(stream, out, checkpoint, "3650 days", available_now=True).awaitTermination()
    return ingest.delivery_status(intake.read_once(spark, out), a.SECRET, _SMALL_BODY)


_ENRICHED_SQL = "SELECT s.code, s.repo, s.commit_sha, s.file_path, s.start_line, s.end_line, "
_BARE_SQL = "SELECT '' AS code, repo, commit_sha, file_path, 0 AS start_line, 0 AS end_line, "
_ANNOUNCED_SQL = f"p.o_orderkey * 1000 + {a.FIRST_DELIVERY_MS} AS timestamp, "
_SAME_COMMIT = "s.repo = p.repo AND s.commit_sha = p.commit_sha"


@query(
    "stream_enriched",
    f"{_ENRICHED_SQL}{_ANNOUNCED_SQL}true AS matched FROM a_snippets s JOIN a_push_files p ON {_SAME_COMMIT} AND s.file_path = p.file_path "
    f"UNION ALL {_ENRICHED_SQL}{_ANNOUNCED_SQL}true FROM a_snippets s JOIN a_pr_markers p ON {_SAME_COMMIT} "
    f"UNION ALL {_BARE_SQL}{_ANNOUNCED_SQL}false FROM a_push_files p "
    f"WHERE NOT EXISTS (SELECT 1 FROM a_snippets s WHERE {_SAME_COMMIT} AND s.file_path = p.file_path) "
    f"UNION ALL {_BARE_SQL}{_ANNOUNCED_SQL}false FROM a_pr_markers p WHERE NOT EXISTS (SELECT 1 FROM a_snippets s WHERE {_SAME_COMMIT})",
    "a_snippets",
    "a_push_files",
    "a_pr_markers",
)
def stream_enriched(spark, sf_dir):
    """Announcements first, then the code, then a sign of life from both sides that ends the wait."""
    topics = {"announced": placeholders_all(spark, sf_dir), "offered": _snippets(spark, sf_dir)}
    paths = {name: run_dir(spark, name) for name in topics}
    out, checkpoint = run_dir(spark, "enriched"), run_dir(spark, "checkpoint")
    alive = spark.createDataFrame([("", "", "", "", 0, 0, a.FIRST_DELIVERY_MS + 10_000 * 86_400_000)], SNIPPET)
    for waves in ({"announced": topics["announced"]}, {"offered": topics["offered"]}, dict.fromkeys(topics, alive)):
        for name, rows in waves.items():
            rows.select(SNIPPET_COLUMNS).write.mode("append").parquet(paths[name])
        for path in paths.values():
            spark.createDataFrame([], SNIPPET).write.mode("append").parquet(path)
        streams = [spark.readStream.schema(SNIPPET).parquet(path) for path in paths.values()]
        intake.write_enriched(*streams, out, checkpoint, "3650 days", available_now=True).awaitTermination()
    return intake.read_enriched(spark, out).filter("repo <> ''")
