"""Long passages on few sites, against a plain restatement, with a source that holds a third of all rows."""

import random

import corpus_pipeline
from hunkwise.llm import line_dedup

from .cases import collected, frame, vocabulary


def plain(rows, limit_of):
    sites, first = {}, {}
    for doc, text, site in rows:
        for pos, line in enumerate(text.split("\n")):
            if line.strip(" "):
                sites.setdefault(line, set()).add(site)
                first[line] = min(first.get(line, (doc, pos)), (doc, pos))
    gone = lambda doc, pos, line: line in sites and len(sites[line]) >= limit_of(line) and first[line] != (doc, pos)
    return sorted(((d, "\n".join(x for p, x in enumerate(t.split("\n")) if not gone(d, p, x))) for d, t, _ in rows), key=repr)


def crowded():
    r = random.Random(5)
    words = vocabulary(300)
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    site = lambda: "hot" if r.random() < 1 / 3 else f"s{r.randrange(19)}"
    rows = []
    for n in (3, 20, 49, 50, 51, 80):
        for copies in (1, 2, 3, 4, 9, 10, 20, 20, 20):
            passage = line(n)
            rows += [(len(rows) + k, f"{line(5)}\n{passage}\n\n{line(9)}", site()) for k in range(copies)]
    # Wide blanks make a line no longer in words.
    return rows + [(9000 + k, f"{'a  ' * 40}\nx", f"s{k}") for k in range(5)]


def test_long_passages_on_few_sites_go(spark):
    rows = crowded()
    want = plain(rows, lambda x: 3 if len(x.split()) >= 50 else 10)
    assert want != plain(rows, lambda x: 10)
    assert collected(line_dedup.dedup(frame(spark, rows), 10, long_min_sites=3), "doc_id", "text") == want
    assert collected(corpus_pipeline.boilerplate(spark, frame(spark, rows), ""), "doc_id", "text") == want


def test_one_limit_unless_another_is_given(spark):
    rows = crowded()
    assert collected(line_dedup.dedup(frame(spark, rows)), "doc_id", "text") == plain(rows, lambda x: 10)
