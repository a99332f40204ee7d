"""BPE, licences, decontamination and URL rules on small data, against plain restatements."""

import hashlib
import re

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import functions as F

from hunkwise.llm import bpe, decontaminate, licenses, url_rules
from hunkwise.llm.catalog import RANKS

from .cases import awkward, frame

PATTERN = public_tokenizers.PATTERN
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def encoding():
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bpe._ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library_and_comes_back(spark, monkeypatch):
    long = [
        (100, "word 12 it's  \n\n x" * 9000), (101, "a" * 90_000), (102, " " * 50_000 + "end"), (103, "é漢字" * 20_000),
        (104, "x y " * 9000 + "b" * 5000 + " z's we'll" * 6000), (105, "'" * 40_000 + "re" * 9000), (106, "<|endoftext|> " * 4000),
    ]
    rows = awkward() + long + [long[0]]
    plain = encoding()
    found = bpe.decode(bpe.encode(frame(spark, rows), RANKS, PATTERN), RANKS).collect()
    got = sorted(((r.doc_id, hashlib.md5(r.ids).hexdigest(), bytes(r.decoded)) for r in found), key=repr)
    want = [(i, hashlib.md5(np.array(plain.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), (t or "").encode()) for i, t, *_ in rows]
    assert got == sorted(want, key=repr)
    assert bpe.encode(frame(spark, rows).limit(0), RANKS, PATTERN).collect() == []


def test_boundaries_agree_with_the_library():
    """Both pattern engines sort every character of the lower planes into the same class."""
    plain = encoding()
    text = "".join(f"a{chr(c)}b{chr(c)}{chr(c)} 1{chr(c)}" for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000)
    pieces = regex.findall(PATTERN, text)
    assert [i for p in pieces for i in plain.encode_ordinary(p)] == plain.encode_ordinary(text)


def test_licenses(spark):
    notice = dict(licenses.TEMPLATES)["mit"]
    rows = awkward() + [
        (200, "x\n" + notice.upper() + "\ny"), (201, " ".join(notice.split()[:-4])), (202, " ".join(notice.split()[:8])),
        (203, "filler words " * 300 + notice + " more words" * 300), (204, "GNU general\npublic license, apache license apache-license"),
        (205, "Licensed under CC BY-NC 4.0."),
    ]
    found = {}
    for r in licenses.scan(frame(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    for i, text, *_ in rows:
        words = WORD.findall(lower(text))
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        labels = {label for _, label in places}
        shares = [0.0]
        for line in lower(text).split("\n"):
            block = WORD.findall(line)
            for at in range(0, max(1, len(block) - 100), 100) if len(block) > 200 else (0,):
                part = set(block[at : at + 200])
                for label, template in licenses.TEMPLATES:
                    wanted = set(template.split())
                    if len(wanted & part) >= 0.8 * len(wanted) - 1e-9:
                        labels.add(label)
                        shares.append(len(wanted & part) / len(wanted))
        starts = [k for k, _ in places]
        want = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)))
        score = 1.0 if places else max(shares)
        assert any((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want and abs(r.score - score) < 1e-9 for r in found[i]), (i, want, found[i])
    assert licenses.scan(frame(spark, rows).limit(0)).collect() == []


def test_decontamination_of_repeats_and_whole_copies(spark):
    """Texts that repeat themselves, and one that holds every item: sizes that no list of all place pairs would survive."""
    items = [(i, " ".join(f"w{i}x{k}" for k in range(200))) for i in range(300)] + [(900, "same " * 3000), (901, "a b " * 900), (902, "same same")]
    whole = " ".join(text for _, text in items[:300])
    rows = [(1, "same " * 100_000), (2, "a b " * 40_000), (3, whole), (4, whole), (4, whole), (5, "a b c " * 500), (6, "other " + "same " * 14)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"]), r.contaminated) for r in decontaminate.check(docs, benchmark).collect())
    assert got == [
        (1, 100_000, 100_000, 2, True), (2, 80_000, 80_000, 1, True), (3, 60_000, 60_000, 300, True), (4, 60_000, 60_000, 300, True),
        (4, 60_000, 60_000, 300, True), (5, 1500, 0, 0, False), (6, 15, 14, 2, True),
    ]


def test_decontamination(spark):
    rows = awkward()
    shared = next(t for i, t, *_ in rows if i == 6)
    items = [(1, shared), (2, shared.upper() + "!"), (10, " ".join(shared.split()[20:27])), (3, None), (4, ""), (5, "ΑΣ É"), (6, "one"), (7, "not there at all " * 5)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    want = []
    for i, text, *_ in rows:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate.check(frame(spark, rows), benchmark).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert decontaminate.check(frame(spark, rows).limit(0), benchmark).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate.check(frame(spark, rows), benchmark.limit(0)).collect())


def test_url_rules(spark):
    urls = [
        (1, "http://A.Example.NET/en/x?q"), (2, "https://example.net/de/"), (3, "ftp://x.org/fr/a#b"), (4, "http://notnet/"), (5, "http://net/"),
        (6, "http://a.net"), (7, None), (8, "no scheme"), (9, "http://example.com/de/1"), (10, "http://bad-bets.example.org/en/1"), (10, "http://bad-bets.example.org/en/1"),
        (11, "http://good.example.org/en/1?x=://z"),
    ]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in urls], "page_id bigint, url string, host string, verdict string")
    learnt = [(f"http://bad-bets.example.org/en/{k}", "block") for k in range(20)] + [(f"http://good.example.org/en/{k}", "allow") for k in range(20)]
    found = url_rules.judge(pages, spark.createDataFrame(learnt, "url string, verdict string")).collect()
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in found}
    assert len(found) == len(urls)
    assert got == {
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/de/", "net/", "block"),
        (3, "x.org", "/fr/a", "org/fr/", "allow"), (4, "notnet", "/", None, "allow"), (5, "net", "/", "net/", "block"),
        (6, "a.net", "", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"),
        (9, "example.com", "/de/1", "example.com/de/", "block"), (10, "bad-bets.example.org", "/en/1", None, "block"),
        (11, "good.example.org", "/en/1", None, "allow"),
    }
    assert url_rules.judge(pages.limit(0), spark.createDataFrame(learnt, "url string, verdict string")).collect() == []
