"""Mined URL rules against a brute force, and verdicts that do not depend on the input's size."""

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from hunkwise.llm import url_rules


def pages_of(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "url string, verdict string")


def verdicts(spark, urls, learnt):
    found = url_rules.judge(pages_of(spark, urls), labels_of(spark, learnt)).collect()
    return [r.verdict for r in sorted(found, key=lambda r: r.page_id)]


def brute(baskets, least, confidence):
    every, by = Counter(), Counter()
    for tokens, verdict in baskets:
        for n in range(1, len(tokens) + 1):
            for part in combinations(sorted(set(tokens)), n):
                every[part] += 1
                by[part, verdict] += 1
    sure = {k: n / every[k[0]] for k, n in by.items() if n >= least and n / every[k[0]] >= confidence}
    nested = lambda part, verdict: [sure.get((tuple(x for x in part if x != y), verdict), -1) for y in part]
    return {k: c for k, c in sure.items() if max(nested(*k)) < c}


def test_rules_by_brute_force(spark):
    r = random.Random(1)
    baskets = []
    for _ in range(400):
        tokens = sorted(r.sample("abcdefg", r.randint(1, 6)))
        bad = {"a", "b", "c", "d"} <= set(tokens) or "g" in tokens and r.random() < 0.7
        baskets.append((tokens, "block" if bad else "allow"))
    frame = spark.createDataFrame(baskets, "tokens array<string>, verdict string")
    got = {(tuple(x.antecedent), x.verdict): round(x.confidence, 9) for x in url_rules.mine(frame).collect()}
    want = {k: round(c, 9) for k, c in brute(baskets, 10, 0.6).items()}
    assert got == want and any(len(k[0]) > 3 for k in want)
    for n in (0, 1, 9):
        assert url_rules.mine(frame.limit(n)).collect() == []


def test_a_page_is_not_judged_by_its_own_label(spark):
    r = random.Random(2)
    learnt = [(f"https://a.example.org/xx/{k}{end}", "block" if r.random() < 0.4 else "allow") for k in range(300) for end in (r.choice(("", "/", ".html", "?q=1", "#top")),)]
    assert {v for _, v in learnt} == {"allow", "block"}
    assert set(verdicts(spark, [u for u, _ in learnt], learnt)) == {"allow"}
    found = pages_of(spark, ["http://h/p/12.html", "http://h/12/p"]).select(url_rules.tokens(url_rules.host(F.col("url")), url_rules.path(F.col("url"))))
    assert [sorted(x[0]) for x in found.collect()] == [["host:h", "path:p"], ["host:h", "path:12", "path:p"]]


def test_verdicts_do_not_change_with_the_size(spark):
    spam = [(f"http://spam.example.org/p{k}/x", "block") for k in range(12)]
    rare = [(f"http://rare.example.org/p{k}/x", "block") for k in range(9)]
    other = [(f"http://h{k % 700}.example.org/q{k}/y", "allow") for k in range(15_000)]
    asked = ["http://spam.example.org/new/x", "http://rare.example.org/new/z", "http://h1.example.org/p/y"]
    for size in (100, 15_000):
        assert verdicts(spark, asked, spam + rare + other[:size]) == ["block", "allow", "allow"]
