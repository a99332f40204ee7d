import hashlib
import hmac
import json
import re

import pytest
from pyspark.sql import functions as F

from hunkwise.functions.text import CODE_SUFFIXES
from hunkwise.functions.signature import hmac_sha256_hex
from hunkwise.operators import enrich, ingest
from hunkwise.plans import adapters as a, flows
from hunkwise.schemas import DELIVERY
from hunkwise.sources import tables

SECRET = "shared by both ends"
LIMIT = ingest.MAX_BODY_BYTES


def sign(body: bytes, secret=SECRET):
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def deliveries(spark, *rows):
    """Rows are (event, body[, signature])."""
    data = []
    for i, (event, body, *signature) in enumerate(rows):
        raw = body if isinstance(body, bytes) else body.encode()
        data.append((f"d{i:03d}", event, signature[0] if signature else sign(raw), raw, 1000 + i))
    return spark.createDataFrame(data, DELIVERY)


def statuses(df, *args):
    return [(r.status, r.outcome) for r in ingest.delivery_status(df, *args).orderBy("delivery_id").collect()]


@pytest.mark.parametrize("secret", ["", "k", "a longer secret", "x" * 64, "y" * 65, "é" * 70])
def test_hmac_matches_standard_library(spark, secret):
    bodies = [b"", b"{}", b"\x00\xff" * 33, "ünï".encode() * 500]
    df = spark.createDataFrame([(b,) for b in bodies], "body binary")
    got = [r.h for r in df.select(hmac_sha256_hex(F.col("body"), secret).alias("h")).collect()]
    assert got == [hmac.new(secret.encode(), b, hashlib.sha256).hexdigest() for b in bodies]


def test_signatures(spark):
    body = b'{"hook_id": 7, "note": "\xc3\xa9"}'
    good = sign(body)
    df = deliveries(
        spark,
        ("ping", body, good),
        ("ping", body, None),
        ("ping", body, "sha256=" + "0" * 64),
        ("ping", body, "sha256=" + good[7:].upper()),
        ("ping", body, good[7:]),
        ("ping", body, "sha1=" + good[7:]),
        ("ping", body, "sha256=zz"),
        ("ping", body, good + "00"),
        ("ping", body, ""),
    )
    wanted = [200, 401, 401, 200, 401, 401, 401, 401, 401]
    assert [s for s, _ in statuses(df, SECRET)] == wanted
    assert {s for s, _ in statuses(df, "")} == {200}


def test_missing_body_needs_a_signature(spark):
    df = spark.createDataFrame([("d0", "ping", None, None, 1), ("d1", "push", sign(b""), None, 2)], DELIVERY)
    assert statuses(df, SECRET) == [(401, "unauthorized"), (500, "unparsable")]
    assert statuses(df, "") == [(200, "pong"), (500, "unparsable")]


def test_size_limit(spark):
    sizes = [LIMIT - 1, LIMIT, LIMIT + 64]
    df = spark.createDataFrame([(f"d{i}", "ping", "", n) for i, n in enumerate(sizes)], "delivery_id string, event_type string, signature string, n int")
    df = df.withColumn("body", F.encode(F.repeat(F.lit("x"), F.col("n")), "UTF-8")).withColumn("received_at", F.lit(1))
    assert [s for s, _ in statuses(df)] == [200, 200, 413]


def test_size_comes_before_signature_and_signature_before_type(spark):
    df = deliveries(spark, ("push", b"x" * 40, "bad"), ("push", b"x" * 10, "bad"), ("issues", b"x" * 10, "bad"))
    assert statuses(df, SECRET, 20) == [(413, "too_large"), (401, "unauthorized"), (401, "unauthorized")]


def test_routing_and_parsing(spark):
    df = deliveries(
        spark,
        ("ping", "not json"),
        ("issues", "not json"),
        (None, "{}"),
        ("", "{}"),
        ("push", "not json"),
        ("push", ""),
        ("push", '{"commits": ['),
        ("push", "{}"),
        ("pull_request", "[1"),
        ("pull_request", '{"action":"closed"}'),
    )
    assert statuses(df, SECRET) == [
        (200, "pong"), (200, "ignored"), (200, "ignored"), (200, "ignored"), (500, "unparsable"), (500, "unparsable"),
        (500, "unparsable"), (200, "ok"), (500, "unparsable"), (200, "ok"),
    ]
    assert ingest.rejected(df, SECRET).count() == 4


def push(*commits, repo="o/r"):
    return json.dumps({"ref": "x", "unknown": {"a": 1}, "repository": {"full_name": repo}, "commits": list(commits)})


def test_push_files_in_order(spark):
    body = push(
        {"id": "s1", "modified": ["b.go", "README.md"], "added": ["a.C", "z.txt"], "removed": ["gone.py"]},
        {"id": "s2", "added": ["x.tsx"], "modified": None},
        {"id": "s3"},
        {"modified": ["n.py"]},
    )
    df = deliveries(spark, ("push", body), ("push", push()), ("push", '{"commits":null}'), ("push", push({"id": "s"}), "bad"))
    rows = ingest.placeholders(df, SECRET).collect()
    assert [(r.repo, r.commit_sha, r.file_path, r.code, r.start_line, r.end_line, r.timestamp) for r in rows] == [
        ("o/r", "s1", "b.go", "", 0, 0, 1000),
        ("o/r", "s1", "a.C", "", 0, 0, 1000),
        ("o/r", "s2", "x.tsx", "", 0, 0, 1000),
        ("o/r", "", "n.py", "", 0, 0, 1000),
    ]
    summary = ingest.delivery_summary(df, SECRET).orderBy("delivery_id").collect()
    assert [(r.status, r.snippets) for r in summary] == [(200, 4), (200, 0), (200, 0), (401, 0)]


def test_pull_request_markers(spark):
    def body(action, number=7):
        return json.dumps(
            {"action": action, "pull_request": {"number": number, "head": {"sha": "h"}}, "repository": {"full_name": "o/r"}}
        )

    df = deliveries(
        spark, *(("pull_request", body(a)) for a in ("opened", "synchronize", "closed", "Opened")),
        ("pull_request", '{"action":"opened"}'),
    )
    rows = ingest.pull_request_placeholders(df, SECRET).collect()
    assert [(r.repo, r.commit_sha, r.file_path) for r in rows] == [("o/r", "h", "PR#7")] * 2 + [("", "", "PR#0")]


def test_code_files(spark):
    paths = {
        **{f"dir.d/part{i}{suffix}": True for i, suffix in enumerate(CODE_SUFFIXES)},
        **{f"dir/part{i}{suffix.upper()}": True for i, suffix in enumerate(CODE_SUFFIXES)},
        **{f"dir{suffix}/part": False for suffix in CODE_SUFFIXES},
        "Makefile": False, "setup.toml": False, "a.c.txt": False, "a.pyc": False, "A.HPP": True, "x.cc": True, "x.cpp": True, "x.h": True, "x.js": True, "x.jsx": True, "x.ts": True,
        "x.c\n": False, "xc": False, ".c": True, "x.c.orig": False, "": False,
    }
    df = spark.createDataFrame([(p,) for p in paths], "file_path string")
    assert {r.file_path for r in ingest.code_files(df).collect()} == {p for p, ok in paths.items() if ok}
    assert ingest.code_files(spark.createDataFrame([(None,)], "file_path string")).count() == 0


def test_landing_folder(spark, tmp_path):
    df = deliveries(spark, ("ping", "{}"), ("push", push({"id": "s", "added": ["a.c"]})))
    tables.write_deliveries(df, str(tmp_path))
    assert tables.read_deliveries(spark, str(tmp_path)).exceptAll(df).count() == 0
    stream = tables.stream_deliveries(spark, str(tmp_path))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    query = (
        ingest.placeholders(stream, SECRET).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert [r.file_path for r in spark.read.parquet(out).collect()] == ["a.c"]


def test_body_is_parsed_once(spark):
    df = deliveries(spark, ("push", push({"id": "s", "added": ["a.c"]})))
    out = ingest.placeholders(df, SECRET)
    out.collect()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2 and "Exchange" not in plan


SNIPPETS = [
    ("code1", "r", "s1", "a.c", 1, 2, 5), ("code2", "r", "s1", "a.c", 9, 9, 5), ("code3", "r", "s1", "README.md", 1, 1, 5),
    ("code4", "r", "s2", "b.go", 1, 1, 5), ("code5", "q", "s1", "a.c", 1, 1, 5),
]
COLUMNS = "code string, repo string, commit_sha string, file_path string, start_line int, end_line int, timestamp bigint"


def placeholders(spark, *rows):
    return spark.createDataFrame([("", repo, sha, path, 0, 0, t) for repo, sha, path, t in rows], COLUMNS)


def test_enrichment(spark):
    snippets = spark.createDataFrame(SNIPPETS, COLUMNS)
    asked = placeholders(
        spark, ("r", "s1", "a.c", 100), ("r", "s1", "a.c", 101), ("r", "s1", "PR#4", 200), ("r", "s2", "a.c", 300),
        ("r", "s9", "PR#5", 400), ("q", "s2", "b.go", 500),
    )
    files = [("code1", 100), ("code1", 101), ("code2", 100), ("code2", 101)]
    requests = [("code1", 200), ("code2", 200), ("code3", 200)]

    def found(df):
        return sorted((r.code, r.timestamp) for r in df.collect())

    assert found(enrich.enrich_files(asked, snippets)) == files
    assert found(enrich.enrich_pull_requests(asked, snippets)) == requests
    assert found(enrich.enrich(asked, snippets)) == sorted(files + requests)
    left = sorted((r.repo, r.commit_sha, r.file_path) for r in enrich.unenriched(asked, snippets).collect())
    assert left == [("q", "s2", "b.go"), ("r", "s2", "a.c"), ("r", "s9", "PR#5")]


def test_code_passes_one_exchange(spark, tmp_path):
    path = str(tmp_path / "snippets")
    spark.createDataFrame(SNIPPETS, COLUMNS).write.parquet(path)
    asked = placeholders(spark, ("r", "s1", "a.c", 100), ("r", "s1", "PR#4", 200))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = enrich.enrich(asked, spark.read.parquet(path))._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*\bcode#", plan)) == 1


def test_announced_diffs(spark):
    diffs = spark.createDataFrame([("r", "s1", "d1"), ("r", "s9", "d2"), ("q", "s1", "d3")], "repo string, commit_sha string, diff string")
    asked = placeholders(spark, ("r", "s1", "a.c", 1), ("r", "s1", "PR#4", 2), ("x", "s9", "b.c", 3))
    assert [r.diff for r in enrich.announced_diffs(diffs, asked).collect()] == ["d1"]


def test_small_batch_gives_the_same_results(spark, sf_dir):
    weights = spark.createDataFrame([("int", 0.0, 1.0), ("the", 0.5, 0.0)], "token string, w0 double, w1 double")
    args = a.deliveries(spark, sf_dir), a.diffs(spark, sf_dir), weights, a.SECRET, 5
    whole, batch = (flows.deliveries_to_results(*args, small_batch=flag) for flag in (False, True))
    assert sorted(map(str, whole.collect())) == sorted(map(str, batch.collect())) != []


def test_hot_commit(spark):
    """One commit holds most rows on both sides; nothing is lost when its partition is split."""
    n = 3000
    snippets = spark.range(n).select(
        F.repeat(F.lit("x"), 50).alias("code"), F.lit("r").alias("repo"),
        F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("s"), "id")).alias("commit_sha"),
        F.concat(F.lit("f"), (F.col("id") % 7).cast("string"), F.lit(".c")).alias("file_path"),
        F.col("id").cast("int").alias("start_line"), F.col("id").cast("int").alias("end_line"), F.lit(1).cast("bigint").alias("timestamp"),
    )
    asked = placeholders(spark, *[("r", "hot", "PR#1", i) for i in range(20)], ("r", "hot", "f1.c", 99))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        hot = [i for i in range(n) if i % 3 < 2]
        out = enrich.enrich(asked, snippets)
        assert out.count() == 20 * len(hot) + sum(i % 7 == 1 for i in hot)
    finally:
        for key in conf:
            spark.conf.unset(key)


def test_scorable(spark):
    df = spark.createDataFrame([("x",), ("",), (None,), (" ",)], "code string")
    assert [r.code for r in enrich.scorable(df).collect()] == ["x", " "]
    assert [(r.code, r.reason) for r in enrich.unscorable(df).collect()] == [("", "empty code"), (None, "empty code")]


def test_bucketed_join_needs_no_shuffle(spark):
    snippets = spark.createDataFrame(SNIPPETS, COLUMNS)
    asked = placeholders(spark, ("r", "s1", "a.c", 100))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, df in (("bucketed_snippets", snippets), ("bucketed_asked", asked)):
            tables.save_bucketed(df, name, enrich.FILE_KEY, 4)
        out = enrich.enrich_files(spark.table("bucketed_asked"), spark.table("bucketed_snippets"))
        assert out.count() == 2
        out.collect()
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table if exists bucketed_snippets")
        spark.sql("drop table if exists bucketed_asked")
