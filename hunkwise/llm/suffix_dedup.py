"""Exact removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``SPAN`` bytes that covers it also starts earlier.

Which texts must meet is found by content: the smallest hash among the ``GRAM``-byte
grams of a SPAN-byte string is its anchor, and equal strings have equal anchors. A
text falls into segments, runs of strings with one anchor. Anchors that occur once
in the corpus are dropped. The segments of an anchor meet in one place: equal ones
are settled at once, the different ones are joined, their suffixes are sorted in two
stages, and adjacent common prefixes show the strings that repeat.

Texts and segments travel compressed. A text that repeats itself at short distance, a
run of one byte for instance, has one segment with one anchor at many places: the
strings of a long one are told apart where it is cut, and one span covers all but the
first of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from hunkwise.llm.common import K1, K2, KEYS, keyed, materialize, raw_texts

SPAN, GRAM = 100, 32
_GRAMS = SPAN - GRAM + 1
# Anchors in more texts than this have their segments cut into single strings,
# which spread by their own content.
HOT_TEXTS = 2_000
# Text per Arrow batch and per array, and segments' bytes per suffix array.
_BATCH_BYTES, _ARRAY_BYTES, _SORT_BYTES = 16 << 20, 512 << 10, 4 << 20
# Longer texts fall into windows; segments of more strings with an anchor at several places are cut like hot ones.
_WINDOW_BYTES, _LONG_STRINGS = 4 << 20, 4_096
# Buckets per shuffle partition.
_SPREAD = 4

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


# --- suffix array -------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros behind the end."""
    w = np.concatenate([data, np.zeros(SPAN + 8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        w = (w[:-step] << np.uint64(8 * step)) | w[step:]
    return w


def _sort_directly(places: np.ndarray, words: np.ndarray) -> np.ndarray:
    """``places`` in the order of their first SPAN bytes; equal ones in no fixed order."""
    order = places[np.argsort(words[places], kind="stable")]
    new = np.concatenate([[True], np.diff(words[order]) != 0]) if len(order) else np.zeros(0, bool)
    for offset in range(8, SPAN, 8):
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else group
        if not len(tied):
            break
        part, own = order[tied], group[tied]
        key = words[np.minimum(part + offset, len(words) - 1)]
        by = np.lexsort((key, own))
        order[tied], key = part[by], key[by]
        new[tied[1:]] |= (np.diff(own) == 0) & (np.diff(key) != 0)
    return order


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All places of ``data`` by their suffixes, in full order over the first SPAN bytes.

    Two stages: suffixes smaller than their successors are sorted directly; all
    others follow from them, as the order of two suffixes with the same first byte
    is the order of their successors. Buckets of a first byte are scanned upwards:
    when one is reached, all successors with smaller first bytes have their ranks.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    step = np.sign(np.diff(data.astype(np.int16), append=np.int16(-1)))
    change = np.flatnonzero(step)
    ahead = change[np.searchsorted(change, np.arange(n))]  # where the run of equal bytes ends
    smaller = step[ahead] > 0
    direct = _sort_directly(np.flatnonzero(smaller), _words(data))
    first_bytes = data[direct]
    out = np.empty(n, np.int64)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    at = 0
    induced = np.flatnonzero(~smaller)
    induced = induced[np.argsort(data[induced], kind="stable")]
    edges = np.searchsorted(data[induced], np.arange(257))
    direct_edges = np.searchsorted(first_bytes, np.arange(257))
    run = np.minimum(ahead - np.arange(n), SPAN)  # from SPAN on the order does not matter
    for c in np.unique(data).tolist():
        bucket = induced[edges[c] : edges[c + 1]]
        # Shorter runs of the byte come first; each level follows from the one before.
        lengths = run[bucket]
        by_length = np.argsort(lengths, kind="stable")
        bucket, lengths = bucket[by_length], lengths[by_length]
        for part in np.split(bucket, np.flatnonzero(np.diff(lengths)) + 1) if len(bucket) else ():
            if run[part[0]] < SPAN:
                part = part[np.argsort(rank[part + 1], kind="stable")]
            out[at : at + len(part)] = part
            rank[part] = np.arange(at, at + len(part))
            at += len(part)
        part = direct[direct_edges[c] : direct_edges[c + 1]]
        out[at : at + len(part)] = part
        rank[part] = np.arange(at, at + len(part))
        at += len(part)
    return out


def common_prefixes(places: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Length, up to SPAN, of what each place has in common with the one before; 0 for the first."""
    length = np.zeros(len(places), np.int64)
    alive = np.arange(1, len(places))
    for offset in range(0, SPAN, 8):
        differ = words[np.minimum(places[alive] + offset, len(words) - 1)] ^ words[np.minimum(places[alive - 1] + offset, len(words) - 1)]
        equal = sum((differ >> np.uint64(64 - 8 * k)) == 0 for k in range(1, 9)).astype(np.int64)
        length[alive] += equal
        alive = alive[equal == 8]
    return np.minimum(length, SPAN)


# --- segments -----------------------------------------------------------------


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h = data.astype(np.uint64) + np.uint64(1)
    factor, width = _BASE, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def _first_minima(h: np.ndarray) -> np.ndarray:
    """Place of the first smallest value among ``_GRAMS`` consecutive ones, for each start."""
    value, place = h, np.arange(len(h), dtype=np.int32)
    width = 1
    while width < _GRAMS:
        step = min(width, _GRAMS - width)
        later = value[step:] < value[:-step]
        value, place = np.where(later, value[step:], value[:-step]), np.where(later, place[step:], place[:-step])
        width += step
    return place


_NO_SEGMENTS = (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64), np.zeros(0, bool))


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, first string, number of strings, anchor hash, anchor at several places) of all segments, in order."""
    parts: list[tuple[np.ndarray, ...]] = []
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    at = 0
    while at < len(texts):
        if sizes[at] > _WINDOW_BYTES:
            for begin in range(0, int(sizes[at]) - SPAN + 1, _WINDOW_BYTES):
                piece = texts[at][begin : begin + _WINDOW_BYTES + SPAN - 1]
                number, first, *rest = _segments_of([piece], 0, 1, np.array([len(piece)], np.int64))
                parts.append((number + at, first + begin, *rest))
            at += 1
            continue
        upto, size = at + 1, sizes[at]
        while upto < len(texts) and size + sizes[upto] <= _ARRAY_BYTES:
            size += sizes[upto]
            upto += 1
        if size >= SPAN:
            parts.append(_segments_of(texts, at, upto, sizes))
        at = upto
    if not parts:
        return _NO_SEGMENTS
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _segments_of(texts, at, upto, sizes):
    data = np.frombuffer(b"".join(texts[at:upto]), np.uint8)
    ends = np.cumsum(sizes[at:upto])
    h = _gram_hashes(data)
    anchor = _first_minima(h)
    owner = np.repeat(np.arange(upto - at), sizes[at:upto])[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + SPAN <= ends[owner])
    if not len(start):
        return _NO_SEGMENTS
    moved = np.concatenate([[True], (np.diff(anchor[start]) != 0) | (np.diff(owner[start]) != 0)])
    first = np.flatnonzero(np.concatenate([[True], (np.diff(h[anchor[start]]) != 0) | (np.diff(owner[start]) != 0)]))
    number = owner[start[first]]
    counts = np.diff(np.append(first, len(start)))
    several = np.add.reduceat(moved.astype(np.int64), first) > 1
    return number + at, start[first] - (ends - sizes[at:upto])[number], counts, h[anchor[start[first]]], several


def _by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``_BATCH_BYTES`` of text, one row at least."""
    for batch in batches:
        squeezed = "squeezed" in batch.schema.names
        sizes = np.array(
            [zstandard.frame_content_size(x) if x else 0 for x in batch.column("squeezed").to_pylist()]
            if squeezed else [len(x) for x in raw_texts(batch.column("text"))], np.int64,
        )
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), _BATCH_BYTES, side="right")))
            yield batch.slice(at, n)
            at += n


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw) if raw else b""


def _unsqueeze(packed: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def squeezed(rows: DataFrame) -> DataFrame:
    """(key, doc_id, squeezed) of (key, doc_id, text): the compressed text, empty for NULL."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches):
            packed = pa.array([_squeeze(raw) for raw in raw_texts(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEYS, "doc_id")), packed], names=[*KEYS, "doc_id", "squeezed"])

    return rows.select(*KEYS, "doc_id", "text").mapInArrow(pack, f"{K1} bigint, {K2} bigint, doc_id {kind}, squeezed binary")


def _split(bucket: np.ndarray):
    """(bucket, rows) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
        yield int(bucket[part[0]]), part


# --- candidates: anchors that occur twice or more -------------------------------


def repeated_anchors(rows: DataFrame, buckets: int) -> DataFrame:
    """(key 1, anchor, long) of the texts with an anchor that occurs again, in them or elsewhere.

    ``long`` marks anchors of a long segment that repeats itself.

    Anchors that repeat inside a batch are known as such there: their owners are
    dealt out evenly, and one entry without an owner stands for them all. So a
    bucket gets at most one entry of an anchor from each batch, however frequent.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches):
            number, _, count, h, several = segments(raw_texts(batch.column("text")))
            long = several & (count > _LONG_STRINGS)
            key = batch.column(K1).to_numpy(zero_copy_only=False)[number] if len(number) else np.zeros(0, np.int64)
            order = np.argsort(h, kind="stable")
            h, key, number, several, long = h[order], key[order], number[order], several[order], long[order]
            new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            repeated = np.bincount(group, weights=1 + several)[group] > 1 if len(h) else new
            long = np.bincount(group, weights=long)[group] > 0 if len(h) else new
            kind = np.where(long, 3, np.where(repeated, 1, 0)).astype(np.uint8)  # 1: known to repeat, goes anywhere; 3: long, too
            stands = np.flatnonzero(repeated & new)
            spread = (h + key.view(np.uint64)) % np.uint64(buckets)
            bucket = np.where(repeated, spread, h % np.uint64(buckets)).astype(np.int64)
            once = ~repeated | np.concatenate([[True], (h[1:] != h[:-1]) | (number[1:] != number[:-1])]) if len(h) else new
            bucket = np.concatenate([bucket[once], (h[stands] % np.uint64(buckets)).astype(np.int64)])
            kind = np.concatenate([kind[once], np.full(len(stands), 2, np.uint8)])  # 2: stands for the others
            key = np.concatenate([key[once], key[stands]])
            h = np.concatenate([h[once], h[stands]])
            cut = list(_split(bucket))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _ in cut], pa.int32()),
                    *(pa.array([x[i].tobytes() for _, i in cut], pa.binary()) for x in (h, key, kind)),
                ],
                names=["bucket", "h", "key", "kind"],
            )

    def settle(table: pa.Table) -> pa.Table:
        h, key, kind = (
            np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
            for c, t in (("h", np.uint64), ("key", np.int64), ("kind", np.uint8))
        )
        known = kind % 2 == 1
        rest = np.flatnonzero(~known)
        order = rest[np.argsort(h[rest], kind="stable")]
        new = np.concatenate([[True], np.diff(h[order]) != 0]) if len(order) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        often = np.bincount(group)[group] > 1 if len(order) else new
        found = np.concatenate([np.flatnonzero(known), order[often & (kind[order] == 0)]])
        return pa.table({"key": pa.array(key[found]), "anchor": pa.array(h[found].view(np.int64)), "long": pa.array(kind[found] == 3)})

    dealt = rows.select(K1, "text").mapInArrow(deal, "bucket int, h binary, key binary, kind binary")
    return dealt.groupBy("bucket").applyInArrow(settle, "key bigint, anchor bigint, long boolean")


# --- settling the segments --------------------------------------------------------


def _covered(order: np.ndarray, starts: np.ndarray, first: np.ndarray, count: np.ndarray, data: np.ndarray):
    """(segment, string) of the strings in different segments that also start earlier.

    Segment k has the strings from ``starts[k]`` in ``data``; ``order`` sorts by
    (document, place) and ``first`` is the place of its first string.
    """
    sorted_places = suffix_array(data)
    segment_of = np.full(len(data), -1, np.int64)
    index = np.repeat(np.arange(len(starts)), count)
    within = np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)
    segment_of[starts[index] + within] = index
    places = sorted_places[segment_of[sorted_places] >= 0]
    run = np.cumsum(common_prefixes(places, _words(data)) < SPAN)
    segment = segment_of[places]
    string = first[segment] + places - starts[segment]
    by = np.lexsort((string, order[segment], run))
    later = np.concatenate([[False], np.diff(run[by]) == 0]) if len(by) else np.zeros(0, bool)
    hit = by[later]
    return segment[hit], string[hit]


def _merge(keys: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> pa.Table:
    """Spans of the same key that meet are put together."""
    if not len(start):
        return pa.table({K1: pa.array([], pa.int64()), K2: pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "end": pa.array([], pa.int64())})
    by = np.lexsort((start, keys[1], keys[0]))
    k1, k2, start, end = keys[0][by], keys[1][by], start[by], end[by]
    new_key = np.concatenate([[True], (np.diff(k1) != 0) | (np.diff(k2) != 0)])
    # Running maximum of the ends within a key: keys are lifted apart by a distance no span reaches.
    lift = (np.cumsum(new_key) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = new_key | np.concatenate([[True], (start + lift)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1
    return pa.table({K1: k1[at], K2: k2[at], "start": start[at], "end": (reach - lift)[last]})


_BLOB = ("h", "k1", "k2", "place", "first", "count", "known", "several")


def _cut_out(rows: DataFrame, buckets: int) -> DataFrame:
    """Segments with the wanted anchors, packed per batch and bucket.

    Of equal segments in a batch the first goes on; the others are known to repeat, and
    those that follow each other are one span.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches):
            texts = [_unsqueeze(x) for x in batch.column("squeezed").to_pylist()]
            k1, k2, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in (K1, K2, "place"))
            wanted = [np.array(x, np.int64).view(np.uint64) for x in batch.column("anchors").to_pylist()]
            hot = [np.array(x, bool) for x in batch.column("hot").to_pylist()]
            number, first, count, h, several = segments(texts)
            edges = np.searchsorted(number, np.arange(len(texts) + 1))
            seen: dict[bytes, tuple] = {}
            out: list[tuple] = []
            blobs: list[bytes] = []
            order = sorted(range(len(texts)), key=lambda d: (place[d], k1[d], k2[d]))
            for d in order:
                own = slice(edges[d], edges[d + 1])
                in_wanted = np.isin(h[own], wanted[d])
                in_hot = np.isin(h[own], wanted[d][hot[d]])
                for k in np.flatnonzero(in_wanted):
                    at, n = int(first[own][k]), int(count[own][k])
                    pieces = ((at + i, 1) for i in range(n)) if in_hot[k] else ((at, n),)
                    for a, m in pieces:
                        content = texts[d][a : a + m + SPAN - 1]
                        anchor = (_digest(content) if in_hot[k] else int(h[own][k]))
                        mine = (int(place[d]), int(k1[d]), int(k2[d]), a)
                        if (other := seen.setdefault(content, mine)) == mine:
                            out.append((anchor, mine[1], mine[2], mine[0], a, m, 0, int(several[own][k] and not in_hot[k])))
                            blobs.append(content)
                        elif other[:3] != mine[:3] or other[3] != a:
                            again = (mine[1] & 0x7FFFFFFFFFFFFFFF, mine[1], mine[2], mine[0], a, m, 1, 0)
                            before = out[-1] if out else again
                            if before[6] and before[1:4] == again[1:4] and before[4] + before[5] == a:
                                out[-1] = (*before[:5], before[5] + m, 1, 0)
                            else:
                                out.append(again)
                                blobs.append(b"")
            table = np.array([(x[0] - (1 << 64) if x[0] >= 1 << 63 else x[0], *x[1:]) for x in out], np.int64).reshape(-1, len(_BLOB))
            cuts = list(_split((table[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _ in cuts], pa.int32()),
                    pa.array([table[i].tobytes() for _, i in cuts], pa.binary()),
                    pa.array([_squeeze(b"".join(blobs[j] for j in i)) for _, i in cuts], pa.binary()),
                ],
                names=["bucket", "rows", "content"],
            )

    return rows.mapInArrow(cut, "bucket int, rows binary, content binary")


def _digest(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content, 9)


def _settle_segments(table: pa.Table) -> pa.Table:
    """Repeated spans of the segments of one bucket."""
    facts = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, len(_BLOB)) for x in table.column("rows").to_pylist()])
    content = b"".join(map(_unsqueeze, table.column("content").to_pylist()))
    sizes = np.where(facts[:, 6] == 1, 0, facts[:, 5] + SPAN - 1)
    ends = np.cumsum(sizes)
    spans: list[tuple[np.ndarray, ...]] = []

    def add(rows: np.ndarray, start: np.ndarray, strings: np.ndarray) -> None:
        spans.append((facts[rows, 1], facts[rows, 2], start, start + strings + SPAN - 1))

    known = np.flatnonzero(facts[:, 6] == 1)
    add(known, facts[known, 4], facts[known, 5])
    # Equal segments: all but the first one repeat as a whole.
    firsts: dict[bytes, int] = {}
    again: list[int] = []
    rank = np.empty(len(facts), np.int64)
    rank[np.lexsort((facts[:, 4], facts[:, 2], facts[:, 1], facts[:, 3]))] = np.arange(len(facts))
    same = lambda a, b: (facts[a, 1:5] == facts[b, 1:5]).all()  # noqa: E731  one row of a repeated document
    for i in np.flatnonzero(facts[:, 6] == 0)[np.argsort(rank[facts[:, 6] == 0])].tolist():
        segment = content[ends[i] - sizes[i] : ends[i]]
        if (j := firsts.setdefault(segment, i)) != i and not same(i, j):
            again.append(i)
    again_at = np.array(again, np.int64)
    add(again_at, facts[again_at, 4], facts[again_at, 5])
    # Different segments of one anchor: suffix arrays over as many anchors as fit.
    left = np.array(sorted(firsts.values()), np.int64)
    left = left[np.argsort(facts[left, 0], kind="stable")] if len(left) else left
    groups = np.split(left, np.flatnonzero(np.diff(facts[left, 0])) + 1) if len(left) else []
    waiting: list[np.ndarray] = []
    size = 0
    for group in [g for g in groups if len(g) > 1 or facts[g[0], 7]] + [None]:
        if waiting and (group is None or size + sizes[group].sum() > _SORT_BYTES):
            rows = np.concatenate(waiting)
            data = np.frombuffer(b"".join(content[ends[i] - sizes[i] : ends[i]] for i in rows.tolist()), np.uint8)
            segment, string = _covered(rank[rows], np.cumsum(sizes[rows]) - sizes[rows], facts[rows, 4], facts[rows, 5], data)
            add(rows[segment], string, np.ones(len(string), np.int64))
            waiting, size = [], 0
        if group is not None:
            waiting.append(group)
            size += int(sizes[group].sum())
    k1, k2, start, end = (np.concatenate(x) for x in zip(*spans, strict=True))
    return _merge([k1, k2], start, end)


def repeated_spans(rows: DataFrame, packed: DataFrame) -> DataFrame:
    """(key, start, end) of byte spans that repeat, from the texts and the ``squeezed`` ones; spans of one document may overlap."""
    buckets = _SPREAD * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = materialize(repeated_anchors(rows, buckets).distinct(), "repeated-anchors")
    often = wanted.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("long").alias("long"))
    hot = often.filter((F.col("n") > HOT_TEXTS) | F.col("long")).select("anchor", F.lit(True).alias("hot"))
    listed = wanted.select("key", "anchor").distinct()
    flagged = listed.join(hot, "anchor", "left").select(F.col("key").alias(K1), "anchor", F.coalesce("hot", F.lit(False)).alias("hot"))
    by_text = flagged.groupBy(K1).agg(F.collect_list(F.struct("anchor", "hot")).alias("wanted"))
    texts = packed.join(by_text, K1).select(
        *KEYS, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("place"), "squeezed",
        F.col("wanted.anchor").alias("anchors"), F.col("wanted.hot").alias("hot"),
    )
    schema = f"{K1} bigint, {K2} bigint, start bigint, end bigint"
    return _cut_out(texts, buckets).groupBy("bucket").applyInArrow(_settle_segments, schema)


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of all documents; ``kept`` are the bytes that stay.

    "Earlier" is by doc_id, a whole number (NULL before all others), then by a hash
    of the row, then by place. A NULL or empty text has no bytes; rows equal in doc_id
    and text count as one document and get the same result each; an empty table
    gives no rows; other columns are not looked at.
    """
    rows = keyed(docs)
    packed = squeezed(rows)
    spans = repeated_spans(rows, packed).groupBy(K1).agg(F.collect_list(F.struct(K2, "start", "end")).alias("spans"))
    marked = packed.join(spans, K1, "left").select(
        "doc_id", K2, "squeezed", *(F.col(f"spans.{c}").alias(n) for c, n in ((K2, "owners"), ("start", "starts"), ("end", "ends")))
    )
    kind = marked.schema["doc_id"].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches):
            kept: list[bytes] = []
            counts: list[tuple[int, int, int]] = []
            columns = (batch.column(c).to_pylist() for c in (K2, "owners", "starts", "ends"))
            for raw, key, owners, starts, ends in zip(map(_unsqueeze, batch.column("squeezed").to_pylist()), *columns, strict=True):
                own = sorted((s, e) for o, s, e in zip(owners or (), starts or (), ends or ()) if o == key)
                parts, upto, n_spans = [], 0, 0
                reach = -1
                for s, e in own:
                    if s > reach:
                        parts.append(raw[upto:s])
                        n_spans += 1
                    reach = max(reach, e)
                    upto = reach
                parts.append(raw[upto:])
                kept.append(b"".join(parts))
                counts.append((len(raw), len(raw) - len(kept[-1]), n_spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return marked.mapInArrow(remove, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
