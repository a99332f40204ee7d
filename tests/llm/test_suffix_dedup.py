import hashlib
import random

import numpy as np

from hunkwise.llm import suffix_dedup as s

from .cases import awkward, frame


def test_suffix_array():
    r = random.Random(2)
    for n, letters in ((0, b"a"), (1, b"a"), (50, b"a"), (300, b"ab"), (400, b"abc"), (500, bytes(range(256)))):
        data = bytes(r.choice(letters) for _ in range(n))
        found = s.suffix_array(np.frombuffer(data, np.uint8)).tolist()
        assert sorted(found) == list(range(n))
        cut = [data[i : i + s.SPAN] for i in found]
        assert cut == sorted(cut)
        lengths = s.common_prefixes(np.array(found, np.int64), s._words(np.frombuffer(data, np.uint8))).tolist()
        for a, b, length in zip(cut, cut[1:], lengths[1:]):
            same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert length == same or max(len(a), len(b)) < s.SPAN  # beyond the end there are zeros


def brute(rows):
    """Per (doc_id, text): bytes covered by a string of 100 bytes that also starts earlier."""
    seen, out = {}, {}
    documents = {(i, t) for i, t, *_ in rows}
    keyed = sorted(documents, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    for doc in keyed:
        raw = (doc[1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            window = raw[p : p + 100]
            if window in seen:
                gone[p : p + 100] = True
            else:
                seen[window] = doc
        spans = int(gone[:1].sum() + (np.diff(gone.astype(np.int8)) == 1).sum()) if len(raw) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[doc] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows):
    docs = frame(spark, rows)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t)
    wanted = brute(rows)
    found = s.dedup(docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found), key=repr) == sorted(
        ((i, *wanted[(i, t)]) for i, t, *_ in rows), key=repr
    )


def test_awkward(spark):
    check(spark, [r for r in awkward() if r[0] is not None and r[0] != 8])


def repeated(seed, n):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice("abcdefgh \n") for _ in range(k))
    pool = [text(r.randint(90, 400)) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(pool)
            a = r.randint(0, 40)
            parts += [text(r.randint(0, 60)), p[a : len(p) - r.randint(0, 40)]]
        rows.append((i, "".join(parts)))
    return rows


def test_passages(spark):
    check(spark, repeated(1, 150) + [(500, "ab" * 700), (501, "ba" * 300), (502, "x" * 99), (503, "x" * 100), (504, "x" * 101)])


def test_hot_passages_are_cut_into_single_strings(spark, monkeypatch):
    monkeypatch.setattr(s, "HOT_TEXTS", 3)
    check(spark, repeated(2, 120))


def test_small_batches(spark, monkeypatch):
    texts = [t.encode() for _, t in repeated(3, 40)]
    whole = s.segments(texts)
    monkeypatch.setattr(s, "_ARRAY_BYTES", 300)
    assert all((a == b).all() for a, b in zip(whole, s.segments(texts)))


def test_sf(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])


def test_empty(spark):
    assert s.dedup(frame(spark, [(1, "x")]).limit(0)).collect() == []


def test_texts_that_repeat_themselves(spark, monkeypatch):
    r = random.Random(4)
    text = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    runs = [(1, "=" * 6000), (2, text(300) + "=" * 5000 + text(200)), (3, "=" * 99 + "x" + "=" * 150), (4, "abc" * 2500), (5, text(50) + "abc" * 60 + text(90))]
    line = text(37) + "\n"
    runs += [(6, line * 150), (7, text(100) + line * 5 + text(100)), (8, "-" * 130 + text(200)), (9, "-" * 130 + text(90)), (10, text(140) * 3), (11, " " * 400)]
    check(spark, runs)
    monkeypatch.setattr(s, "_LONG_STRINGS", 100)
    monkeypatch.setattr(s, "_WINDOW_BYTES", 1500)
    check(spark, runs)


def test_megabytes_of_one_byte(spark):
    rows = s.dedup(frame(spark, [(1, "=" * (8 << 20)), (2, "=" * 500 + "end")])).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == {
        # All but the first string start later; the first one's bytes are covered by the next ones from 1 on.
        1: (8 << 20, (8 << 20) - 1, 1, b"="), 2: (503, 500, 1, b"end"),
    }
