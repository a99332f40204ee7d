"""Awkward documents that every operator must take, and helpers."""

import random

from pyspark.sql import Row, functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, label string, score string, hits string"


def frame(spark, rows):
    """Documents (doc_id, text[, source]) with columns whose names operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s1", len(r[1] or ""), "w", "l", "s", "h") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def vocabulary(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghiéñöxyz") for _ in range(r.randint(2, 8))) for _ in range(n)]


def awkward(seed=0):
    r = random.Random(seed)
    words = vocabulary(300)
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = prose(60)
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One TWO"), (None, "no id here " + shared), (None, None),
        (6, shared), (7, shared), (8, prose(30) + "\n" + shared + "\n" + prose(30)), (8, "same id, other text " + prose(20)),
        (9, "a" * 5000), (10, "a" * 5000 + "b"), (11, prose(6000)), (12, "ß İ Σ ΑΣ É " + prose(20)), (13, " \u0085 x y " * 40),
        (14, prose(50).upper() + " !!! | ### <>"), (15, "MIT License\nmit-license; the Apache  LICENSE.\ngeneral public licenses"), (16, shared.upper()),
    ]
    rows += [(6, shared)] * 3
    for i in range(20, 60):
        text = prose(r.randint(1, 80))
        if r.random() < 0.5:
            text += r.choice([" ", "\n"]) + " ".join(shared.split()[r.randint(0, 30) : r.randint(30, 60)])
        rows.append((i, text, f"s{i % 14}"))
    return rows


def collected(df, *columns):
    return sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)
