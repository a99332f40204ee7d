import os

from test_intake import MINUTE, START, Pair, snippet

from hunkwise.schemas import SNIPPET
from hunkwise.session import run_dir
from hunkwise.streaming import intake


def waiting(pair):
    """Batches whose rows wait."""
    return sorted(int(name.split("=")[1]) for name in os.listdir(f"{pair.checkpoint}/waiting/rows"))


def test_code_waits_once_and_not_in_a_state_store(spark):
    pair = Pair(spark)
    pair.send([snippet("a.c", 0)], [snippet("b.c", 0, "code of b"), snippet("c.md", 0, "code of c")])
    pair.run()
    rows = spark.read.parquet(f"{pair.checkpoint}/waiting/rows").filter("not announced")
    assert sorted(r.code for r in rows.collect()) == ["code of b", "code of c"]
    assert not os.path.exists(f"{pair.checkpoint}/state")


def test_what_no_row_can_meet_is_deleted(spark):
    pair = Pair(spark)
    pair.send([snippet("a.c", 0)], [snippet("a.c", 0, "a"), snippet("b.c", 0, "b")])
    pair.run()
    pair.alive(100 * MINUTE)
    pair.run()
    assert waiting(pair) == [0, 1]  # an announcement at 35 minutes could still expire
    pair.alive(500 * MINUTE)
    pair.run()
    pair.alive(501 * MINUTE)
    assert [r[:2] for r in pair.run()] == [("a.c", "a")]
    assert waiting(pair) == [2, 3]


def test_repeated_batch_replaces_its_output(spark):
    pair = Pair(spark)
    pair.send([snippet("a.c", 0), snippet("b.c", 0)], [])
    pair.run()
    pair.send([], [snippet("a.c", MINUTE, "late")])
    pair.run()
    pair.alive(500 * MINUTE)
    want = pair.run()
    assert [r[:2] for r in want] == [("a.c", "late"), ("b.c", "")]
    last = max(int(name) for name in os.listdir(f"{pair.checkpoint}/commits") if name.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{pair.checkpoint}/commits/{name}")
    assert pair.run() == want


def test_snippet_without_a_path_and_rows_without_a_time(spark):
    pair = Pair(spark)
    timeless = ("", "r", "c1", "t.c", 0, 0, None)
    pair.send([snippet("PR#1", 0, commit="c9"), timeless], [snippet(None, 0, "pathless", commit="c9"), timeless])
    pair.run()
    pair.alive(500 * MINUTE)
    assert pair.run() == [("PR#1", "pathless", 0, True)]


def test_the_wait_is_kept_to_the_millisecond(spark):
    announced = spark.createDataFrame([snippet("a.c", 0), snippet("b.c", 0)], SNIPPET)
    offered = spark.createDataFrame([snippet("a.c", 60 * MINUTE, "in"), snippet("b.c", 60 * MINUTE + 1, "out")], SNIPPET)
    wait = intake._millis(spark, "60 minutes")
    assert wait == 60 * MINUTE
    assert [(r.code, r.timestamp - START) for r in intake._met(announced, offered, wait, run_dir(spark, "found")).collect()] == [("in", 0)]
    assert [r.file_path for r in intake._unmet(announced, offered, wait).collect()] == ["b.c"]
