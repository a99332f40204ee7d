"""License scan: phrases, and an exact set-similarity join of text blocks with notice templates.

A block contains a template when it has at least ``CONTAINMENT`` of the
template's different words. Words are ordered by how many blocks of the corpus
have them, rarest first; only blocks that share a word of a template's prefix,
are large enough, and can still reach the overlap from that position are compared.
Licences share most of their words, so a caller can name phrases that tell one
apart: all blocks are compared with all templates, and a template gives its label
where such a phrase stands in the block as well.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hunkwise.llm.common import K1, K2, KEYS, keyed, map_batches, materialize, raw_texts

# Phrases and the labels they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public notices, in words.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
CONTAINMENT = 0.8

# Notices that differ from one another in a single word are no matter of shares:
# where their words stand consecutively, and only there, the label holds.
VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
NEAR_NOTICES = {
    f"cc by{part} {version}": f"cc-by{part.replace(' ', '-')}" for part in ("", " nc", " sa") for version in VERSIONS
}
# Templates that give their label by shares have ten words or more; of the shorter ones a
# base phrase or a near notice holds the words that matter, word for word. All are compared.
SHORTEST = 10
FAR_TEMPLATES = (
    *((label, text) for label, text in TEMPLATES if len(text.split()) >= SHORTEST),
    *(
        (f"cc-by-{part}", f"this work is licensed under a creative commons attribution {word} 4 0 international license")
        for part, word in (("nc", "noncommercial"), ("sa", "sharealike"))
    ),
)

# Words that tell a licence from others whose notices are built alike.
_ATTRIBUTION = {"cc-by": ("",), "cc-by-nc": (" noncommercial", " non commercial"), "cc-by-sa": (" sharealike", " share alike")}
_TELLING = {
    "apache": ("apache",),
    "bsd": ("redistribution and use",),
    "gpl": ("gnu general public license",),
    "isc": ("with or without fee",),
    "mit": ("software and associated documentation files",),
    "mpl": ("mozilla public license",),
} | {label: tuple(f"creative commons attribution{part} {version}" for part in parts for version in VERSIONS) for label, parts in _ATTRIBUTION.items()}
ALL_TEMPLATES = tuple(dict.fromkeys((*TEMPLATES, *FAR_TEMPLATES)))
TELLING = {text: _TELLING[label] if (label, text) in FAR_TEMPLATES else () for label, text in ALL_TEMPLATES}

# Blocks are lines, of longer lines all runs of so many words. Runs of twice the longest
# template's words over the whole text are blocks too where they cross a line's end: a
# wrapped notice. Words are only counted in every half run, which orders them as well.
BLOCK_WORDS = 200
_STEP = BLOCK_WORDS // 2

# Word characters are digits, lower-case letters and everything beyond ASCII.
_SPACED = bytes(
    c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 10 if c == 10 else 32 for c in range(256)
)


def _blocks(line_words: list[bytes]):
    if len(line_words) <= BLOCK_WORDS:
        yield line_words
        return
    for at in range(0, len(line_words) - _STEP, _STEP):
        yield line_words[at : at + BLOCK_WORDS]


def _windows(lines: list[list[bytes]], width: int):
    """Windows of ``width`` words over all lines, every half width; those inside one line are left to its blocks."""
    words = [w for line in lines for w in line]
    ends = [*accumulate(len(line) for line in lines if line)][:-1]
    step = width // 2
    for at in range(0, max(1, len(words) - step), step) if ends else ():
        if bisect_right(ends, at) < bisect_left(ends, min(at + width, len(words))):
            yield words[at : at + width]


def _text_blocks(lines: list[list[bytes]], width: int):
    for line in lines:
        yield from _blocks(line)
    yield from _windows(lines, width)


def _spans(words: list[bytes], phrases: dict[bytes, list[tuple[int, list[bytes]]]]) -> list[tuple[int, int, int]]:
    """(start, end, template) wherever a telling phrase stands; ``phrases`` has them by their first word."""
    return [
        (i, i + len(phrase), number)
        for i, word in enumerate(words) if word in phrases
        for number, phrase in phrases[word] if words[i : i + len(phrase)] == phrase
    ]


def _run_sets(words: list[bytes], size: int, order: dict[bytes, int], least: int, heads: frozenset[int], free: list[int], spans, ends: list[int] | None = None):
    """(places, admitted templates) of the runs of ``size`` words, or of all words if there are fewer.

    Runs with under ``least`` places or with none of ``heads``, the places of the
    templates' prefixes, are left out, and so are runs whose places and templates the
    run given last has as well. With ``ends`` only runs that cross one of these places count.
    """
    starts = [start for start, _, _ in spans]
    held: dict[int, int] = {}
    grown, last, headed = False, frozenset(), 0
    for end in range(len(words)):
        place = order.get(words[end])
        if place is not None:
            if place not in held:
                grown, headed = True, headed + (place in heads)
            held[place] = held.get(place, 0) + 1
        if end + 1 < min(size, len(words)):
            continue
        at = max(0, end + 1 - size)
        if headed and len(held) >= least and (ends is None or bisect_right(ends, at) < bisect_left(ends, end + 1)):
            inside = spans[bisect_left(starts, at) : bisect_right(starts, end)]
            admitted = frozenset(free).union(number for _, stop, number in inside if stop <= end + 1)
            if grown or not admitted <= last:
                yield sorted(held), sorted(admitted)
                grown, last = False, admitted
        gone = order.get(words[at]) if end + 1 - size >= 0 else None
        if gone is not None:
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
                headed -= gone in heads


def window_width(templates) -> int:
    """Twice the longest template, but no less than 2."""
    return 2 * max(1, *(len(text.split()) for _, text in templates))


def _template_rows(templates) -> list[tuple[int, str, frozenset[bytes], int]]:
    """(number, label, words, least overlap) of each template."""
    sets = [(label, frozenset(text.encode().split())) for label, text in templates]
    return [(i, label, words, max(1, math.ceil(CONTAINMENT * len(words) - 1e-9))) for i, (label, words) in enumerate(sets)]


def _prefix(words: frozenset[bytes], need: int, order: dict[bytes, int]) -> list[int]:
    """Places of the rarest words of a template: who shares ``need`` of its words shares one of these."""
    return sorted(order[w] for w in words)[: len(words) - need + 1]


def word_order(rows: DataFrame, templates) -> dict[bytes, int]:
    """Place of every template word in the order of all blocks of the corpus, rarest first.

    What reaches the driver is one count per different template word. Counts are
    added up per batch before the shuffle.
    """
    vocabulary = sorted({w for _, _, words, _ in _template_rows(templates) for w in words})
    known = frozenset(vocabulary)
    width = window_width(templates)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = dict.fromkeys(vocabulary, 0)
        for raw in raw_texts(batch.column("text")):
            lines = [line.split() for line in raw.translate(_SPACED).split(b"\n")]
            for block in _text_blocks(lines, width):
                for w in known.intersection(block):
                    counts[w] += 1
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts]), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counted = map_batches(rows.select("text"), count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"].encode(): r["n"] for r in counted.collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (found.get(w, 0), w)))}


def base_places(words: list[bytes], phrases=tuple(PHRASES.items())) -> list[tuple[int, str]]:
    """(place, label) wherever the words of a phrase stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases:
        wanted = b" " + phrase.encode() + b" "
        at = joined.find(wanted)
        while at >= 0:
            found.append((joined.count(b" ", 0, at + 1) - 1, label))
            at = joined.find(wanted, at + 1)
    return found


def scan(
    docs: DataFrame, templates=TEMPLATES, exact: dict[str, str] | None = None, telling: dict[str, tuple[str, ...]] | None = None
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, similar_labels, similarity) of all documents.

    ``similar_labels`` are those of all templates whose contained share in a block
    reaches the threshold, ``similarity`` is the largest of these shares, else 0.
    ``telling`` gives phrases of a template, by its text: a block gives the template's
    label only if one of them stands in it, word for word; templates without an entry
    need none, those with an empty one give none. The score is the largest share among
    what gives a label, 1 where a phrase stands, else 0. ``exact`` gives further labels
    of phrases; they are no base phrases, but their score is 1 too. A NULL or empty text has no words
    and no labels (empty strings); rows equal in doc_id and text get the same
    result each; an empty table gives no rows; other columns are not looked at.
    """
    rows = keyed(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    order = word_order(rows, templates)
    numbered = _template_rows(templates)
    least = min(need for *_, need in numbered)
    heads = frozenset(place for *_, words, need in numbered for place in _prefix(words, need, order))
    head_words = frozenset(w for w, place in order.items() if place in heads)
    width = window_width(templates)
    further = tuple((exact or {}).items())
    needed = [(telling or {}).get(text) for _, text in templates]
    free = [number for number, phrases in enumerate(needed) if phrases is None]
    told: dict[bytes, list[tuple[int, list[bytes]]]] = {}
    for number, phrase in [(number, p.encode().split()) for number, phrases in enumerate(needed) for p in phrases or ()]:
        told.setdefault(phrase[0], []).append((number, phrase))

    def blocks_of(lines: list[list[bytes]]) -> list[dict]:
        """The different sets of template words of all blocks, with the templates admitted by their telling phrases."""
        whole = [w for line in lines for w in line]
        if head_words.isdisjoint(whole):
            return []
        ends = [*accumulate(len(line) for line in lines if line)][:-1]
        found = {(tuple(places), tuple(numbers)) for places, numbers in _run_sets(whole, width, order, least, heads, free, _spans(whole, told), ends)}
        for line in lines:
            if not head_words.isdisjoint(line):
                found.update((tuple(places), tuple(numbers)) for places, numbers in _run_sets(line, BLOCK_WORDS, order, least, heads, free, _spans(line, told)))
        return [{"places": places, "admitted": numbers} for places, numbers in sorted(found)]

    block_kind = pa.struct([("places", pa.list_(pa.int32())), ("admitted", pa.list_(pa.int32()))])

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        for raw in raw_texts(batch.column("text")):
            lines = [line.split() for line in raw.translate(_SPACED).split(b"\n")]
            words = [w for line in lines for w in line]
            base = base_places(words)
            places = [place for place, _ in base]
            for column, value in zip(out, (len(words), len(base), min(places, default=None), max(places, default=None), sorted({label for _, label in base}), sorted({label for _, label in base_places(words, further)}), blocks_of(lines)), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(block_kind))
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in (K1, K2, "doc_id")), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
            names=[K1, K2, "doc_id", "n_words", "n_base", "first_word", "last_word", "base", "exact", "blocks"],
        )

    schema = (
        f"{K1} bigint, {K2} bigint, doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base array<string>, exact array<string>, "
        "blocks array<struct<places: array<int>, admitted: array<int>>>"
    )
    scanned = materialize(map_batches(rows, read, schema), "license-blocks")
    matched = contained(scanned, order, numbered).groupBy(*KEYS).agg(
        F.collect_set(F.when(F.col("told_share").isNotNull(), F.col("label"))).alias("found"), F.max("told_share").alias("told_share"),
        F.collect_set("label").alias("similar"), F.max("share").alias("share"),
    )
    similar = F.array_sort(F.coalesce("similar", F.array().cast("array<string>")))
    labels = F.array_sort(F.array_distinct(F.concat("base", "exact", F.coalesce("found", F.array().cast("array<string>")))))
    score = F.when((F.col("n_base") > 0) | (F.size("exact") > 0), 1.0).otherwise(F.coalesce("told_share", F.lit(0.0)))
    return scanned.drop("blocks").join(matched, KEYS, "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
        F.array_join(similar, ",").alias("similar_labels"), F.coalesce("share", F.lit(0.0)).alias("similarity"),
    )


def contained(scanned: DataFrame, order: dict[bytes, int], numbered) -> DataFrame:
    """(key, label, share, told_share) of the blocks that contain a template: the similarity join.

    ``blocks`` holds word places in ascending order and the templates admitted by
    their telling phrases; ``told_share`` is the share of these, else NULL. The other side has a row for each word of the templates'
    prefixes, whatever the corpus, so it is broadcast: joined by a shuffle, all blocks
    would meet in as many tasks as there are such words.
    """
    least = min(need for *_, need in numbered)
    index = []
    for number, label, words, need in numbered:
        places = sorted(order[w] for w in words)
        index += [(place, i, number, label, need, places) for i, place in enumerate(_prefix(words, need, order))]
    prefixes = scanned.sparkSession.createDataFrame(
        index, "place int, i int, template int, label string, need int, template_places array<int>"
    )
    blocks = scanned.select(*KEYS, F.explode("blocks").alias("block")).select(*KEYS, "block.places", "block.admitted")
    probes = blocks.select(
        *KEYS, "places", "admitted", F.posexplode(F.slice("places", 1, F.size("places") - least + 1)).alias("j", "place")
    )
    reachable = 1 + F.least(F.size("template_places") - F.col("i"), F.size("places") - F.col("j")) - 1
    overlap = F.size(F.array_intersect("places", "template_places"))
    share = overlap / F.size("template_places")
    return (
        probes.join(F.broadcast(prefixes), "place")
        .filter((F.size("places") >= F.col("need")) & (reachable >= F.col("need")))
        .filter(overlap >= F.col("need"))
        .groupBy(*KEYS, "label")
        .agg(F.max(share).alias("share"), F.max(F.when(F.array_contains("admitted", F.col("template")), share)).alias("told_share"))
    )
