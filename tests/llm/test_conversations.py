import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from hunkwise.llm import conversations as cv

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SPACE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    """Conversations with columns whose names the operator uses itself."""
    schema = "conv_id bigint, turn bigint, role string, text string, audit string, chunk string, conv string"
    return spark.createDataFrame([(*r, "a", "c", "v") for r in rows], schema).repartition(3)


def cheapest(rows):
    """(cost, letters, repaired rows) by trying all edits of (role, text, fault) rows, row by row."""

    @lru_cache(maxsize=None)
    def best(at, state, inserted=0):
        options = []
        role = "assistant" if state == 2 else "user"
        to = 3 if state == 2 else 2
        if at < len(rows):
            own, text, fault = rows[at]
            rest = best(at + 1, state)
            options.append((rest[0] + 2, "D" + rest[1], rest[2]))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                rest = best(at + 1, to)
                options.append((rest[0] + 1 + extra, "R" + rest[1], ((role, text), *rest[2])))
                if own[:1] == role[0]:
                    options.append((rest[0] + extra, "K" + rest[1], ((own, text), *rest[2])))
                if state == 0 and own[:1] == "s":
                    rest = best(at + 1, 1)
                    options.append((rest[0] + extra, "K" + rest[1], ((own, text), *rest[2])))
        elif state in (0, 3):
            options.append((0, "", ()))
        if inserted < 3:  # more in a row only add whole pairs
            rest = best(at, to, inserted + 1)
            options.append((rest[0] + 5, "I" + rest[1], ((role, ""), *rest[2])))
        return min(options, key=lambda x: x[:2], default=(10**9, "", ()))

    return best(0, 0)


def plain(rows):
    out = []
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(tuple(r))
    for conv, own in by.items():
        left = []
        for c, turn, role, text in own:
            say = lambda x: " " if x is None else str(x)
            role, text = say(role), say(text)
            damage = zlib.crc32(f"{say(c)}:{say(turn)}".encode()) % 20
            if damage == 1:
                text = ""
            if damage == 2:
                text = "".join(x for x in text if x not in ".!?")
            if damage == 4:
                role = "user"
            left += [(turn, role, text)] * (0 if damage == 0 else 2 if damage == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, judged, turns = set(), [], [t for t, _, _ in left if t is not None]
        for _, role, text in left:
            body = text.rstrip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role, text, fault))
        n = lambda f: sum(x[2] == f for x in judged)  # noqa: B023, E731
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, letters, fixed = cheapest(tuple(judged))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, letters, digest))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made(seed, conversations, longest, roles=("user", "assistant", "system", "user", "assistant", "tool", "", None)):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "and so", "What? ", "ok", "", "  ", "Done.\n\t", None, "Ünd…", "a.b"]
    rows = []
    for c in range(conversations):
        turn = 0
        for _ in range(r.randint(1, longest)):
            turn += r.choice([1, 1, 1, 2])
            rows.append((c, turn, r.choice(roles), r.choice(texts) if r.random() < 0.6 else f"text {r.random()}."))
    return rows


def test_equals_all_edits(spark):
    rows = made(1, 120, 9) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None), (500, None, "user", "x."), (501, -3, "s", ".")]
    rows += rows[:40]  # repeated rows
    assert found(cv.audit(frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize("chunks", [3, 40])
def test_conversations_over_many_chunks(spark, monkeypatch, chunks):
    rows = made(7, 6, 12) + [(100, i, "user", f"q {i}.") for i in range(60)] + [(101, i, ("user", "assistant")[i // 2 % 2], f"{i}") for i in range(50)]
    real = cv.ordered

    def many(df):
        dealt = real(df.repartition(1)).drop("chunk")
        return dealt.withColumn("chunk", (dealt["place"] % 2**33 * chunks / 200).cast("int"))

    monkeypatch.setattr(cv, "ordered", many)
    assert found(cv.audit(frame(spark, rows))) == plain(rows)


def test_powers_equal_single_rows():
    r = random.Random(3)
    for symbol in range(cv._SYMBOLS):
        for n in (1, 2, 3, 7, 64, 1000):
            vector = tuple(r.randint(0, 20) for _ in range(4))
            single = vector
            for _ in range(n):
                single = cv._times(cv._power(symbol, 0), single)
            assert cv.before(symbol, n, vector) == single
    runs = cv._runs(np.array([2, 2, 0, 3]), np.array([1, 3, 2, 1]))
    assert runs == [(2, 2), (0, 4), (3, 1)]


def test_a_long_run_is_unrolled_in_blocks():
    symbol = 2  # user, as it should be
    steps = list(cv._unrolled([(symbol, 5001)], 0, cv._END))
    assert len(steps) == 5001 and sum(s[3] for s in steps) + cv._END[steps[-1][2]] == cv.before(symbol, 5001, cv._END)[0]


def test_dropped_conversations_and_empty_table(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows = [(c, 0, "user", "Hi.") for c in gone]
    assert found(cv.audit(frame(spark, rows))) == sorted(((c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone), key=repr)
    empty = cv.audit(frame(spark, rows).filter("conv_id < 0"))
    assert empty.columns == list(COLUMNS) and empty.collect() == []
