import zlib
from collections import Counter

import numpy as np

from hunkwise.llm import sharding

from .cases import awkward, frame


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one():
    keys = np.random.default_rng(3).integers(0, 1 << 64, 500, dtype=np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_growth_moves_only_into_the_new_shard(spark):
    rows = sharding.assign(frame(spark, [(i, "x") for i in range(5000)])).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {24}
    assert 100 < len(moved) < 320
    assert max(Counter(r.shard for r in rows).values()) < 300


def test_awkward_rows(spark):
    given = awkward()
    rows = sharding.assign(frame(spark, given)).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in given
    )
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard) for r in rows}) == len({i for i, *_ in given})


def test_hot_key_and_empty_table(spark):
    rows = sharding.assign(frame(spark, [(7, "same")] * 400 + [(i, None) for i in range(100)])).collect()
    hot = next(r.shard for r in rows if r.doc_id == 7)
    assert sorted(r.slot for r in rows if r.shard == hot) == list(range(sum(r.shard == hot for r in rows)))
    assert sharding.assign(frame(spark, [(1, "x")]).limit(0)).collect() == []
