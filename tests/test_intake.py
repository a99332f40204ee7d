from pyspark.sql import functions as F

from hunkwise.operators import enrich
from hunkwise.schemas import DELIVERY, SNIPPET
from hunkwise.session import run_dir
from hunkwise.streaming import intake

MINUTE = 60_000
# A stream starts with a watermark of 1970, so times lie well behind that.
START = 1_700_000_000_000


def send(spark, path, *rows):
    """(delivery id, body, received at) of one wave."""
    full = [(i, "push", None, bytearray(body.encode()), START + at) for i, body, at in rows]
    spark.createDataFrame(full, DELIVERY).coalesce(1).write.mode("append").parquet(path)


def received(spark, path, out, checkpoint, **kind):
    stream = spark.readStream.schema(DELIVERY).option("maxFilesPerTrigger", 1).parquet(path)
    intake.write_once(stream, out, checkpoint, available_now=True, **kind).awaitTermination()
    return sorted(((r.delivery_id, bytes(r.body).decode(), r.received_at - START) for r in intake.read_once(spark, out).collect()), key=str)


def test_each_delivery_once_over_batches_and_restarts(spark):
    path, out, checkpoint = (run_dir(spark, n) for n in ("in", "out", "checkpoint"))
    send(spark, path, ("a", "1", 0), ("a", "1", 0), ("b", "2", 5))
    received(spark, path, out, checkpoint)
    send(spark, path, ("a", "1", MINUTE), ("c", "3", MINUTE))
    assert received(spark, path, out, checkpoint) == [("a", "1", 0), ("b", "2", 5), ("c", "3", MINUTE)]
    send(spark, path, ("b", "2", 2 * MINUTE), ("c", "3", 2 * MINUTE), ("d", "4", 2 * MINUTE))
    assert [i for i, _, _ in received(spark, path, out, checkpoint)] == ["a", "b", "c", "d"]


def test_deliveries_without_an_id_are_told_apart_by_what_was_sent(spark):
    path, out, checkpoint = (run_dir(spark, n) for n in ("in", "out", "checkpoint"))
    send(spark, path, (None, "x", 0), ("", "x", 1), (None, "y", 2), ("x", "x", 3))
    send(spark, path, (None, "y", 4), ("x", "z", 5))
    assert sorted(b for _, b, _ in received(spark, path, out, checkpoint)) == ["x", "x", "y"]


def test_ids_are_forgotten_after_their_time(spark):
    path, out, checkpoint = (run_dir(spark, n) for n in ("in", "out", "checkpoint"))
    for row in (("a", "1", 0), ("b", "2", 30 * MINUTE), ("a", "1", 31 * MINUTE)):
        send(spark, path, row)
        found = received(spark, path, out, checkpoint, remembered="10 minutes")
    assert found == [
        ("a", "1", 0), ("a", "1", 31 * MINUTE), ("b", "2", 30 * MINUTE),
    ]


def snippet(path, at, code="", commit="c1", line=0):
    return (code, "r", commit, path, line, line, START + at)


class Pair:
    """Two topics and the query that joins them."""

    def __init__(self, spark):
        self.spark = spark
        self.announced, self.offered, self.out, self.checkpoint = (run_dir(spark, n) for n in ("announced", "offered", "out", "checkpoint"))
        self.send([], [])

    def send(self, announced, offered):
        for path, rows in ((self.announced, announced), (self.offered, offered)):
            self.spark.createDataFrame(rows, SNIPPET).coalesce(1).write.mode("append").parquet(path)

    def run(self):
        streams = [self.spark.readStream.schema(SNIPPET).parquet(p) for p in (self.announced, self.offered)]
        intake.write_enriched(*streams, self.out, self.checkpoint, wait="60 minutes", lateness="5 minutes", available_now=True).awaitTermination()
        found = intake.read_enriched(self.spark, self.out).filter("commit_sha <> 'alive'")
        return sorted((r.file_path, r.code, r.timestamp - START, r.matched) for r in found.collect())

    def alive(self, at):
        self.send([snippet("x.c", at, commit="alive")], [snippet("y.c", at, "k", commit="alive")])


def test_code_and_announcements_meet_in_either_order(spark):
    pair = Pair(spark)
    pair.send([snippet("a.c", 0), snippet("PR#7", 0, commit="c2"), snippet("b.c", 0)], [snippet("early.c", 0, "e")])
    assert pair.run() == []
    pair.send([snippet("early.c", 9 * MINUTE)], [snippet("a.c", 10 * MINUTE, "late", line=3), snippet("any.md", 10 * MINUTE, "pr", commit="c2")])
    met = [("a.c", "late", 0, True), ("any.md", "pr", 0, True), ("early.c", "e", 9 * MINUTE, True)]
    assert pair.run() == met
    pair.alive(500 * MINUTE)
    assert pair.run() == [met[0], met[1], ("b.c", "", 0, False), met[2]]
    pair.alive(900 * MINUTE)
    assert pair.run() == [met[0], met[1], ("b.c", "", 0, False), met[2]]  # once


def test_code_beyond_the_wait_does_not_meet(spark):
    pair = Pair(spark)
    pair.send([snippet("a.c", 0), snippet("b.c", 100 * MINUTE)], [snippet("a.c", 61 * MINUTE, "too late"), snippet("b.c", 41 * MINUTE, "in time")])
    pair.run()
    pair.alive(900 * MINUTE)
    assert pair.run() == [("a.c", "", 0, False), ("b.c", "in time", 100 * MINUTE, True)]


def test_the_same_as_in_batches(spark):
    announced = [snippet(f"f{i % 9}.c", i, commit=f"c{i % 4}") for i in range(40)] + [snippet(f"PR#{i}", i, commit=f"c{i}") for i in range(6)]
    offered = [snippet(f"f{i % 5}.{'c' if i % 3 else 'md'}", i, f"code {i}", f"c{i % 5}", i) for i in range(60)]
    pair = Pair(spark)
    pair.send(announced[:20], offered[30:])
    pair.run()
    pair.send(announced[20:], offered[:30])
    pair.run()
    pair.alive(900 * MINUTE)
    found = pair.run()
    placeholders, code = (spark.createDataFrame(rows, SNIPPET) for rows in (announced, offered))
    met = enrich.enrich(placeholders, code).withColumn("matched", F.lit(True))
    bare = enrich.unenriched(placeholders, code).withColumn("matched", F.lit(False))
    assert found == sorted((r.file_path, r.code, r.timestamp - START, r.matched) for r in met.unionByName(bare).collect())
