"""The library's record types, made from the tables at hand.

Each adapter has a Spark form (a function of session and folder) and a DuckDB
form (a common table expression in ``CTES``), so that a check can rebuild the
expected rows without going through the Spark operators.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hunkwise.functions.signature import hmac_sha256_hex
from hunkwise.functions.text import TOKEN_PATTERN, WHITE_SPACE
from hunkwise.sources.tables import read_spread

SECRET = "between-two-services"
FIRST_DELIVERY_MS = 1_700_000_000_000
STAMP_MS = 1_700_000_000_000
VOCABULARY_TERMS = 5_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, spread over the cores when their file alone would not be."""
    return read_spread(spark, f"{sf_dir}/documents.parquet", "doc_id")


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a zone-less timestamp, whatever the session time zone."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    millis = F.floor(F.expr("1000") * F.extract(F.lit("SECOND"), ts)).cast("bigint")
    return day * 86_400_000 + seconds.cast("bigint") * 1000 + millis


# --- results ---------------------------------------------------------------

# The same text in both dialects.
_RESULT_EXPRESSIONS = {
    "id": "concat('evt-', event_id)",
    "repo": "concat('org', user_id % 7, '/app', user_id % 50)",
    "commit_sha": "md5(concat('c', event_id))",
    "file_path": (
        "concat('src/', event_type, '/F', event_id % 97, case event_id % 6 when 0 then '.c' "
        "when 1 then '.go' when 2 then '.py' when 3 then '.TS' when 4 then '.md' else '.java' end)"
    ),
    "start_line": "cast(event_id % 200 + 1 as bigint)",
    "end_line": "cast(event_id % 200 + 3 as bigint)",
    "code": (
        "concat('int f', event_id, '(int a) {', chr(10), '  return ', event_id % 9, '; // ', event_type, chr(10), '}')"
    ),
    "is_anomalous": "(event_id * 7919) % 1000 > 500",
    "confidence": "cast(cast((event_id * 7919) % 1000 as double) / 1000 as float)",
    "label": "case when (event_id * 7919) % 1000 > 500 then 'vulnerable' else 'clean' end",
    "latency_ms": "cast(value as float)",
}


def _result_select(events: DataFrame, *extra: str) -> DataFrame:
    # An own name for the time, so that a stream can use the same select.
    timed = events.withColumn("timestamp", epoch_ms(F.col("ts")))
    columns = [f"{text} as {name}" for name, text in _RESULT_EXPRESSIONS.items()]
    return timed.selectExpr(*columns, "timestamp", *extra)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result_select(table(spark, sf_dir, "events"))


def stream_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return _result_select(events)


def result_waves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results, and every fifth of them a second time, later and with another score."""
    rows = _result_select(table(spark, sf_dir, "events"), "event_id")
    again = (
        rows.filter(F.col("event_id") % 5 == 0)
        .withColumn("timestamp", F.col("timestamp") + 1)
        .withColumn("confidence", (1 - F.col("confidence").cast("double")).cast("float"))
    )
    return rows, again


def result_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both writes of the results."""
    rows, again = result_waves(spark, sf_dir)
    return rows.unionByName(again).drop("event_id")


def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of which some have no id or no time."""
    rows = _result_select(table(spark, sf_dir, "events"), "event_id")
    return (
        rows.withColumn("id", F.when(F.col("event_id") % 10 == 0, "").otherwise(F.col("id")))
        .withColumn("timestamp", F.when(F.col("event_id") % 15 == 0, F.lit(0)).otherwise(F.col("timestamp")))
        .drop("event_id")
    )


# --- deliveries --------------------------------------------------------------

_LINE_PATH = (
    "concat('src/m', l_suppkey % 10, '/p', l_partkey, case l_linenumber % 5 when 0 then '.c' "
    "when 1 then '.PY' when 2 then '.md' when 3 then '.tsx' else '.yaml' end)"
)
# File k of an order: its path and whether the commit added, modified or removed it.
_N_FILES = "o_orderkey % 9 + 1"
_FILE_PATH = (
    "concat('src/m', (o_orderkey * 7 + k) % 10, '/p', (o_orderkey * 13 + k * 31) % 2000, "
    "case (o_orderkey + k) % 5 when 0 then '.c' when 1 then '.PY' when 2 then '.md' when 3 then '.tsx' else '.yaml' end)"
)
_FILE_KIND = "case (o_orderkey * 3 + k * k) % 7 % 3 when 0 then 'added' when 1 then 'modified' else 'removed' end"
_EVENT_TYPE = (
    "case when o_orderkey % 10 < 6 then 'push' when o_orderkey % 10 < 8 then 'pull_request' "
    "when o_orderkey % 10 = 8 then 'ping' else 'issues' end"
)
_REPO = "concat('org/repo', o_orderkey % 20)"
_SHA = "md5(concat('d', o_orderkey))"
_ACTION = "case o_orderkey % 3 when 0 then 'opened' when 1 then 'synchronize' else 'closed' end"
_BODY = f"""concat(case {_EVENT_TYPE}
 when 'push' then concat('{{"ref":"refs/heads/main","repository":{{"full_name":"', {_REPO}, '"}},"commits":[{{"id":"', {_SHA},
  '","message":"m","added":[', added, '],"removed":[', removed, '],"modified":["src/d', o_orderkey, '.c"',
  case when modified = '' then '' else ',' end, modified, ']}}',
  case when o_orderkey % 4 = 0 then concat(',{{"id":"', md5(concat('e', o_orderkey)), '","modified":["docs/readme.md","lib/q', o_orderkey, '.Go"]}}') else '' end,
  ']}}')
 when 'pull_request' then concat('{{"action":"', {_ACTION}, '","pull_request":{{"number":', o_orderkey % 1000,
  ',"title":"t","head":{{"sha":"', {_SHA}, '"}}}},"repository":{{"full_name":"', {_REPO}, '"}}}}')
 when 'ping' then '{{"hook":"alive"}}' else '{{}}' end)"""


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivery per order, with one to nine changed files."""

    def paths(kind: str) -> str:
        chosen = f"filter(sequence(1, {_N_FILES}), k -> {_FILE_KIND} = '{kind}')"
        return f"array_join(transform({chosen}, k -> concat('\"', {_FILE_PATH}, '\"')), ',') as {kind}"

    joined = read_spread(spark, f"{sf_dir}/orders.parquet", "o_orderkey").selectExpr(
        "o_orderkey", paths("added"), paths("removed"), paths("modified")
    )
    body = _break_body(F.expr(_BODY))
    rows = joined.select(
        "o_orderkey",
        F.concat(F.lit("dlv-"), F.col("o_orderkey").cast("string")).alias("delivery_id"),
        F.expr(_EVENT_TYPE).alias("event_type"),
        F.encode(body, "UTF-8").alias("body"),
        (F.col("o_orderkey") * 1000 + FIRST_DELIVERY_MS).alias("received_at"),
    )
    key = F.col("o_orderkey")
    digest = hmac_sha256_hex(F.col("body"), SECRET)
    signature = (
        F.when(key % 31 == 0, "sha256=" + "0" * 64)
        .when(key % 37 == 0, F.lit(None).cast("string"))
        .when(key % 41 == 0, F.concat(F.lit("sha1="), digest))
        .when(key % 43 == 0, "sha256=zz")
        .when(key % 4 == 0, F.concat(F.lit("sha256="), F.upper(digest)))
        .otherwise(F.concat(F.lit("sha256="), digest))
    )
    return rows.select("delivery_id", "event_type", signature.alias("signature"), "body", "received_at")


def redelivered(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], DataFrame]:
    """Deliveries in two waves by time, the second with repeats of the first, and more repeats of both."""
    rows = deliveries(spark, sf_dir)
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    number = F.substring("delivery_id", 5, 20).cast("bigint")
    late = F.lit(FIRST_DELIVERY_MS + 1000 * last)

    def repeats(n: int, wave: int) -> DataFrame:
        return rows.filter(number % n == 0).withColumn("received_at", late + wave)

    early = number <= last // 2
    second = rows.filter(~early).unionByName(repeats(3, 1).filter(early)).unionByName(repeats(5, 2))
    return [rows.filter(early), second], repeats(2, 3).unionByName(repeats(6, 4))


def _break_body(body: Column) -> Column:
    """Every 53rd body loses its first character."""
    return F.when(F.col("o_orderkey") % 53 == 0, F.substring(body, 2, 1 << 30)).otherwise(body)


# --- diffs and snippets ------------------------------------------------------


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per document.

    Its first file adds the document's lines, with a function header before every
    fourth one (every seventh document has none), and a second hunk without a
    function; its second file is no source code.
    """
    doc = F.col("doc_id")
    key = doc.cast("string")
    header = F.concat(F.lit("+int f"), key, F.lit("_"))

    def added(line: Column, i: Column) -> Column:
        title = F.concat(header, F.floor(i / 4).cast("string"), F.lit("(int a) {\n"))
        return F.concat(F.when((doc % 7 != 0) & (i % 4 == 0), title).otherwise(""), F.lit("+"), line)

    path = F.concat(F.lit("src/d"), key, F.lit(".c"))
    body = F.array_join(F.transform(F.split("text", "\n", -1), added), "\n")
    pieces = [
        "diff --git a/", path, " b/", path, "\n--- a/", path, "\n+++ b/", path,
        "\n@@ -1,3 +", (doc % 50 + 1).cast("string"), ",40 @@ int ctx(void)\n int ctx(int a) {\n-int gone(int a) {\n",
        body,
        "\n@@ -900 +", (doc % 50 + 901).cast("string"), ",2 @@\n keep\n+  x = ", key, ";\n",
        "diff --git a/README.md b/README.md\n--- a/README.md\n+++ b/README.md\n@@ -1 +1 @@\n-old\n+++ lost\n+new text ",
        key, "\n",
    ]
    diff = F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in pieces))
    return documents(spark, sf_dir).select(
        F.concat(F.lit("org/repo"), (doc % 20).cast("string")).alias("repo"),
        F.md5(F.concat(F.lit("d"), key)).alias("commit_sha"),
        diff.alias("diff"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bus messages of the events: some malformed, some without code, some with fields missing."""
    value = F.expr(
        "concat('{\"code\":\"', case when event_id % 13 = 0 then '' else concat('int f', event_id, "
        "'(int a) {\\\\n  return ', event_type, '; // ', case event_id % 4 when 0 then 'the' when 1 then 'de' "
        "when 2 then 'und' else 'la' end, '\\\\n}') end, '\",\"repo\":\"org/app', user_id % 50, "
        "'\",\"commit_sha\":\"', md5(concat('c', event_id)), '\",\"file_path\":\"src/f', event_id, '.c\"', "
        "case when event_id % 17 = 0 then '' else concat(',\"start_line\":', event_id % 200 + 1, "
        "',\"end_line\":', event_id % 200 + 3, ',\"timestamp\":', event_id + 1) end, "
        "case when event_id % 11 = 0 then '' else '}' end)"
    )
    return table(spark, sf_dir, "events").select(value.alias("value"))


# --- labelled data -----------------------------------------------------------


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw dataset rows; every fifth one is a test row."""
    rows = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        "doc_id",
        F.col("doc_id").alias("id"),
        F.col("text").alias("func"),
        F.col("toxic").cast("int").alias("target"),
        F.col("source").alias("project"),
        F.md5(F.col("doc_id").cast("string")).alias("commit_id"),
        F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"),
    )


_PROB = "cast((doc_id * 7919) % 70 + 30 * toxic as double) / 100"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr("doc_id", f"{_PROB} as prob")


def other_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a second model, a little apart, for all but every hundredth document."""
    return (
        table(spark, sf_dir, "labels")
        .filter("doc_id % 100 <> 99")
        .selectExpr("doc_id", f"{_PROB} + case when doc_id % 9 = 0 then 0.00005D else 0.0D end as prob")
    )


def true_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr("doc_id", "cast(toxic as int) as label")


# --- DuckDB forms ------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TOKEN_SQL = _quoted(TOKEN_PATTERN)
WHITE_SPACE_SQL = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)


def _hmac_sql(body: str) -> str:
    key = SECRET.encode()
    assert len(key) <= hashlib.sha256().block_size
    key = key.ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in key).hex()
    outer = bytes(b ^ 0x5C for b in key).hex()
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || {body})))"


_RESULT_SQL = ", ".join(f"{text} AS {name}" for name, text in _RESULT_EXPRESSIONS.items())

CTES = {
    "a_results": f"SELECT event_id, {_RESULT_SQL}, epoch_us(ts) // 1000 AS timestamp FROM events",
    "a_result_log": (
        "SELECT * FROM a_results UNION ALL SELECT * REPLACE (timestamp + 1 AS timestamp, "
        "cast(1 - cast(confidence AS double) AS float) AS confidence) FROM a_results WHERE event_id % 5 = 0"
    ),
    "a_paths": f"SELECT {_LINE_PATH} AS path FROM lineitem",
    "a_files": (
        f"SELECT o_orderkey, k, {_FILE_PATH} AS path, {_FILE_KIND} AS kind "
        f"FROM (SELECT o_orderkey, unnest(range(1, {_N_FILES} + 1)) AS k FROM orders)"
    ),
    "a_order_files": (
        "SELECT o_orderkey, "
        + ", ".join(
            f"coalesce(string_agg('\"' || path || '\"', ',' ORDER BY k) FILTER (WHERE kind = '{kind}'), '') AS {kind}"
            for kind in ("added", "removed", "modified")
        )
        + " FROM a_files GROUP BY o_orderkey"
    ),
    "a_bodies": (
        f"SELECT o_orderkey, {_EVENT_TYPE} AS event_type, "
        f"CASE WHEN o_orderkey % 53 = 0 THEN substr({_BODY}, 2) ELSE {_BODY} END AS body "
        "FROM a_order_files"
    ),
    "a_signatures": (
        "SELECT *, CASE WHEN o_orderkey % 31 = 0 THEN 'sha256=' || repeat('0', 64) WHEN o_orderkey % 37 = 0 THEN NULL "
        "WHEN o_orderkey % 41 = 0 THEN 'sha1=' || digest WHEN o_orderkey % 43 = 0 THEN 'sha256=zz' "
        "WHEN o_orderkey % 4 = 0 THEN 'sha256=' || upper(digest) ELSE 'sha256=' || digest END AS signature "
        f"FROM (SELECT *, {_hmac_sql('encode(body)')} AS digest FROM a_bodies)"
    ),
    # Outcome from the rules of the generator: which signatures and bodies it spoils.
    "a_outcomes": (
        f"SELECT o_orderkey, {_EVENT_TYPE} AS event_type, CASE WHEN o_orderkey % 31 = 0 OR o_orderkey % 37 = 0 "
        "OR o_orderkey % 41 = 0 OR o_orderkey % 43 = 0 THEN 'unauthorized' WHEN o_orderkey % 10 = 8 THEN 'pong' "
        "WHEN o_orderkey % 10 = 9 THEN 'ignored' WHEN o_orderkey % 53 = 0 THEN 'unparsable' ELSE 'ok' END AS outcome FROM orders"
    ),
    "a_push_files": (
        f"SELECT o.o_orderkey, {_REPO.replace('o_orderkey', 'o.o_orderkey')} AS repo, f.commit_sha, f.path AS file_path "
        "FROM (SELECT * FROM a_outcomes WHERE outcome = 'ok' AND event_type = 'push') o JOIN ("
        "SELECT o_orderkey AS owner, md5(concat('d', o_orderkey)) AS commit_sha, path FROM a_files "
        "WHERE kind <> 'removed' AND (path LIKE '%.c' OR path LIKE '%.PY' OR path LIKE '%.tsx') "
        "UNION ALL SELECT o_orderkey, md5(concat('d', o_orderkey)), concat('src/d', o_orderkey, '.c') FROM orders "
        "UNION ALL SELECT o_orderkey, md5(concat('e', o_orderkey)), concat('lib/q', o_orderkey, '.Go') FROM orders "
        "WHERE o_orderkey % 4 = 0) f ON f.owner = o.o_orderkey"
    ),
    "a_pr_markers": (
        f"SELECT o_orderkey, {_REPO} AS repo, {_SHA} AS commit_sha, concat('PR#', o_orderkey % 1000) AS file_path "
        "FROM a_outcomes WHERE outcome = 'ok' AND event_type = 'pull_request' AND o_orderkey % 3 < 2"
    ),
    "a_lines": (
        "SELECT doc_id, i - 1 AS i, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, "
        "generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"
    ),
    # A line that starts "++" shows up as "+++" in the diff and does not count.
    "a_kept": "SELECT * FROM a_lines WHERE NOT starts_with(l, '++')",
    "a_groups": (
        "SELECT h.doc_id, h.g, concat('int f', h.doc_id, '_', h.g, '(int a) {') AS title, h.g + coalesce(b.n, 0) AS pos, k.lines "
        "FROM (SELECT DISTINCT doc_id, i // 4 AS g FROM a_lines WHERE doc_id % 7 <> 0) h "
        "LEFT JOIN (SELECT doc_id, i // 4 AS g, string_agg(l, chr(10) ORDER BY i) AS lines FROM a_kept GROUP BY ALL) k "
        "ON k.doc_id = h.doc_id AND k.g = h.g "
        "LEFT JOIN (SELECT doc_id, g, cast(sum(n) OVER (PARTITION BY doc_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bigint) AS n "
        "FROM (SELECT doc_id, i // 4 AS g, count(*) FILTER (WHERE NOT starts_with(l, '++')) AS n FROM a_lines GROUP BY ALL)) b "
        "ON b.doc_id = h.doc_id AND b.g = h.g"
    ),
    "a_snippets": (
        "SELECT code, concat('org/repo', doc_id % 20) AS repo, md5(concat('d', doc_id)) AS commit_sha, file_path, "
        "cast(start_line AS bigint) AS start_line, cast(start_line + length(code) - length(replace(code, chr(10), '')) AS bigint) AS end_line, "
        f"cast({STAMP_MS} AS bigint) AS timestamp FROM ("
        f"SELECT doc_id, rtrim(concat(title, chr(10), coalesce(lines, '')), {WHITE_SPACE_SQL}) AS code, "
        "concat('src/d', doc_id, '.c') AS file_path, doc_id % 50 + 1 + pos AS start_line FROM a_groups "
        "UNION ALL SELECT doc_id, string_agg(l, chr(10) ORDER BY i), concat('src/d', doc_id, '.c'), doc_id % 50 + 1 "
        "FROM a_kept WHERE doc_id % 7 = 0 GROUP BY doc_id "
        "UNION ALL SELECT doc_id, concat('  x = ', doc_id, ';'), concat('src/d', doc_id, '.c'), doc_id % 50 + 901 FROM documents "
        "UNION ALL SELECT doc_id, concat('new text ', doc_id), 'README.md', 1 FROM documents)"
    ),
    "a_messages": (
        "SELECT event_id, event_id % 11 = 0 AS malformed, CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('int f', event_id, '(int a) {', chr(10), "
        "'  return ', event_type, '; // ', CASE event_id % 4 WHEN 0 THEN 'the' WHEN 1 THEN 'de' WHEN 2 THEN 'und' ELSE 'la' END, chr(10), '}') END AS code, "
        "concat('org/app', user_id % 50) AS repo, md5(concat('c', event_id)) AS commit_sha, concat('src/f', event_id, '.c') AS file_path, "
        "cast(CASE WHEN event_id % 17 = 0 THEN 0 ELSE event_id % 200 + 1 END AS bigint) AS start_line, "
        "cast(CASE WHEN event_id % 17 = 0 THEN 0 ELSE event_id % 200 + 3 END AS bigint) AS end_line, "
        "CASE WHEN event_id % 17 = 0 THEN 0 ELSE event_id + 1 END AS timestamp FROM events"
    ),
    "a_labelled": (
        "SELECT doc_id, text AS code, cast(toxic AS int) AS label, "
        "CASE WHEN doc_id % 5 = 0 THEN 'test' "
        "WHEN cast('0x' || substr(md5(concat('42:', doc_id)), 1, 8) AS bigint) % 10 = 0 THEN 'validation' ELSE 'train' END AS split "
        "FROM documents JOIN labels USING (doc_id)"
    ),
    "a_weights": (
        "SELECT token, round(ln((n0 + 1) / (sum(n0) OVER () + count(*) OVER ())) * 1024) / 1024 AS w0, "
        "round(ln((n1 + 1) / (sum(n1) OVER () + count(*) OVER ())) * 1024) / 1024 AS w1 FROM ("
        "SELECT token, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM ("
        f"SELECT label, unnest(regexp_extract_all(code, {TOKEN_SQL})) AS token FROM a_labelled WHERE split = 'train') "
        "GROUP BY token)"
    ),
    "a_pairs": (
        f"SELECT doc_id, {_PROB} AS prob, cast(toxic AS int) AS label, cast({_PROB} > 0.5 AS int) AS pred FROM labels"
    ),
}

NEEDS = {
    "a_result_log": ["a_results"],
    "a_order_files": ["a_files"],
    "a_bodies": ["a_order_files"],
    "a_signatures": ["a_bodies"],
    "a_push_files": ["a_outcomes", "a_files"],
    "a_pr_markers": ["a_outcomes"],
    "a_kept": ["a_lines"],
    "a_groups": ["a_kept"],
    "a_snippets": ["a_groups"],
    "a_weights": ["a_labelled"],
}


def sql(body: str, *names: str) -> str:
    """``body`` with the common table expressions it needs, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({CTES[name]})" for name in order]
    if not parts:
        return body
    if body.startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body.removeprefix("WITH ")
    return "WITH " + ", ".join(parts) + " " + body
