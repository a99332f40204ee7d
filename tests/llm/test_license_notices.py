"""Licence notices as they stand in files, against a brute force over whole texts."""

import random
import re
import textwrap

from hunkwise.llm import catalog, licenses

from .cases import frame, vocabulary

WORD = re.compile("[a-z0-9]+")


def labels_of(spark, texts, **options):
    rows = list(enumerate(texts))
    return {r.doc_id: r.labels for r in licenses.scan(frame(spark, rows), **options).collect()}


def everywhere(text):
    """Labels of the templates that any run of as many words as twice the longest template contains."""
    words, found = WORD.findall(text.lower()), set()
    width = 2 * max(len(t.split()) for _, t in licenses.TEMPLATES)
    for label, template in licenses.TEMPLATES:
        wanted = set(template.split())
        for at in range(max(1, len(words) - width + 1)):
            if len(wanted & set(words[at : at + width])) >= 0.8 * len(wanted) - 1e-9:
                found.add(label)
    phrases = [(p, label) for p, label in licenses.PHRASES.items() if f" {p} " in f" {' '.join(words)} "]
    return ",".join(sorted(found | {label for _, label in phrases}))


def test_wrapped_notices(spark):
    r, texts = random.Random(3), []
    words = vocabulary(200)
    for label, template in licenses.TEMPLATES:
        for width in (20, 45, 75):
            for before in (0, 7, 30, 95, 400):
                around = [textwrap.fill(" ".join(r.choice(words) for _ in range(n)), 70) for n in (before, 60)]
                notice = "\n".join(f" * {line}" for line in textwrap.wrap(template, width))
                texts.append(f"{around[0]}\n\n{notice}\r\n *\n{around[1]}")
    found = labels_of(spark, texts)
    for i, text in enumerate(texts):
        assert found[i] == everywhere(text) != "", (text, found[i])


def test_words_that_lie_far_apart_are_no_notice(spark):
    template = dict(licenses.TEMPLATES)["isc"].split()
    assert labels_of(spark, ["\n".join(w + "\n" + "filler words here " * 10 for w in template), "\n\n", "a\nb"]) == {0: "", 1: "", 2: ""}


def test_creative_commons_are_told_apart(spark, tmp_path):
    wanted = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under CC BY-SA 4.0.": "cc-by-sa", "licensed under\nthe CC-BY 3.0": "cc-by",
        "Licensed under CC BY-NC-SA 4.0": "", "Licensed under CC BY 4.0. " + "sa maison nc " * 9: "cc-by", "CC BY-NC 2.5 or CC BY-SA 2.5": "cc-by-nc,cc-by-sa",
    }
    texts = list(wanted)
    frame(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.labels, r.score) for r in catalog.op6_licenses(spark, str(tmp_path)).collect()}
    assert found == {i: (wanted[t], 1.0 if wanted[t] else 0.0) for i, t in enumerate(texts)}


def test_no_place_of_a_notice_loses_it(spark, tmp_path):
    """Forty words that hold a wrapped notice, and 150 of one line, found wherever they begin."""
    notice = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met".split()
    wrapped = " ".join(notice[:10]) + "\n" + " ".join(f"x{i}" for i in range(19)) + "\n" + " ".join(notice[10:])
    wide = " ".join(notice[:10] + ["y"] * 129 + notice[10:])
    texts = ["z " * before + wrapped + "\n" + "z " * 60 for before in range(0, 101)]
    texts += ["z " * before + wide + " z" * 200 for before in range(0, 201, 5)]
    # The words are there, but more of them lie apart, or the phrase that tells does not stand.
    none = [" ".join(notice[:8]) + "\n" + "x " * 40 + "\n" + " ".join(notice[8:]), wrapped.replace("and use", "use and")]
    frame(spark, list(enumerate(texts + none))).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.labels for r in catalog.op6_licenses(spark, str(tmp_path)).collect()}
    assert [i for i in range(len(texts)) if found[i] != "bsd"] == []
    assert [found[len(texts) + i] for i in range(len(none))] == ["", ""]


def test_all_blocks_are_compared_with_all_templates(spark, tmp_path):
    """Notices under ten words too, and blocks without a telling phrase; what gives a label stays as the phrases say."""
    r = random.Random(11)
    words = vocabulary(60) + sorted({w for _, t in licenses.ALL_TEMPLATES for w in t.split()})
    texts = [
        "This document is released under the license of the BSD project.", "Licensed under the Open Software License version 2.0",
        "Licensed under CC BY-NC-SA 4.0", "The license, released under the\nMIT", "redistribution", "", "Licensed under CC BY 4.0",
    ]
    for _, template in licenses.ALL_TEMPLATES:
        for kept in (0.7, 0.8, 0.9, 1.0):
            some = [w for w in template.split() if r.random() <= kept] + r.choices(words, k=r.randint(0, 12))
            r.shuffle(some)
            texts.append("\n".join(textwrap.wrap(" ".join(r.choices(words, k=r.randint(0, 260)) + some + r.choices(words, k=9)), r.choice([30, 9999]))))

    def runs(text):
        lines = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.lower()) for line in text.split("\n")]
        width, whole = licenses.window_width(licenses.ALL_TEMPLATES), [w for line in lines for w in line]
        for of, size in [(whole, width)] * (sum(map(bool, lines)) > 1) + [(line, licenses.BLOCK_WORDS) for line in lines]:
            yield from (set(of[at : at + size]) for at in range(max(1, len(of) - size + 1)))

    def similar(text):
        shares = {}
        for run in runs(text):
            for label, template in licenses.ALL_TEMPLATES:
                wanted = set(template.split())
                if len(wanted & run) >= 0.8 * len(wanted) - 1e-9:
                    shares[label] = max(shares.get(label, 0), len(wanted & run) / len(wanted))
        return ",".join(sorted(shares)), max(shares.values(), default=0.0)

    frame(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    found = {x.doc_id: x for x in catalog.op6_licenses(spark, str(tmp_path)).collect()}
    want = [similar(t) for t in texts]
    assert [(found[i].similar_labels, found[i].similarity) for i in range(len(texts))] == want
    assert [found[i].labels for i in range(4)] == ["", "", "", ""] and [w for w, _ in want[:4]] == ["mit", "apache", "cc-by-nc,cc-by-sa", "mit"]
    assert sum(bool(w) for w, _ in want) > 30
