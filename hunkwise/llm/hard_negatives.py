"""Hard negatives of anchor vectors by coordinate pruning of inner products.

Rows are sorted by length and packed into buckets of similar lengths; a bucket keeps,
for each coordinate, the order of its rows by their value in it, as shares of the row's
length. A search goes through the buckets from long to short with a threshold: what a
score must reach to matter. The threshold over both lengths is a least cosine, and a
vector of that cosine to the anchor has its value in any coordinate inside a feasible
range around the anchor's. The rows within the ranges of the anchor's focus coordinates,
its largest ones, are intersected; only these are scored, exactly and in whole numbers.

Groups of buckets stay in a task while blocks of anchors stream by, so a task holds a
bounded number of rows and one block; of each anchor it returns its best rows only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from hunkwise.llm.common import materialize

SCALE, CLASSES = 256, 10
POSITIVES, NEGATIVES = 5, 10
# A negative scores between these percentages of its positive.
LOW, HIGH = 30, 90
BUCKET_ROWS, BLOCK_ROWS, GROUP_BUCKETS = 2_048, 256, 16
FOCUS = 4
# Larger values have scores that no 64-bit number holds.
LARGEST = 1 << 26
_SLACK = 1e-9

_PACKED = "ids binary, keys binary, labels binary, width int, matrix binary, aside binary"
_Piece = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v, length2, key): labels moved on and components scaled; ``key`` tells rows of one id apart.

    Rows with a NULL id, label, vector or component take no part, nor do those with a
    component that is not finite or, scaled, beyond ``LARGEST``.
    """
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float(LARGEST)))
    kept = embeddings.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(fits)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label")).cast("bigint")
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    rows = kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), moved.alias("label"), scaled.alias("v"))
    length2 = F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: s + x * x)
    return rows.select("*", length2.alias("length2"), F.xxhash64("vec_id", "label", "v").alias("key"))


# --- packing ----------------------------------------------------------------------


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """One row for each list; shorter ones are filled up with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), int(sizes.max(initial=0))), np.int32)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(lists)), sizes), within] = flat
    return out


def _joined(pieces: list[_Piece]) -> _Piece:
    width = max(p[3].shape[1] for p in pieces)
    wide = [np.pad(p[3], ((0, 0), (0, width - p[3].shape[1]))) for p in pieces]
    return (*(np.concatenate([p[i] for p in pieces]) for i in range(3)), np.concatenate(wide), [x for p in pieces for x in p[4]])


def _shares(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length of each row, coordinates as shares of it)."""
    m = matrix.astype(np.float64)
    length = np.sqrt((m * m).sum(axis=1))
    return length, m / np.where(length > 0, length, 1.0)[:, None]


def _pack(batches: Iterator[pa.RecordBatch], rows: int, lists: bool) -> Iterator[pa.RecordBatch]:
    """Rows in packs of ``rows``, in order, a repeated row once; with the order of every coordinate if ``lists``."""
    last: tuple[int, int] | None = None
    waiting: list[_Piece] = []
    number = 0

    def packed(piece: _Piece) -> pa.RecordBatch:
        nonlocal number
        ids, keys, labels, matrix, aside = piece
        small = matrix if np.abs(matrix).max(initial=0) > np.iinfo(np.int16).max else matrix.astype(np.int16)
        length, shares = _shares(matrix)
        if lists:
            extra = np.argsort(shares, axis=0, kind="stable").astype(np.int16).T.tobytes()
        else:
            extra = b"".join(np.pad(np.array(x[:POSITIVES], np.int64), (0, max(0, POSITIVES - len(x))), constant_values=-1).tobytes() for x in aside)
        number += 1
        values = [
            (TaskContext.get().partitionId() << 32) + number, float(length.max(initial=0.0)), ids.tobytes(), keys.tobytes(),
            labels.tobytes(), matrix.shape[1] * (1 if small is matrix else -1), small.tobytes(), extra,
        ]
        kinds = [pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        names = ["pack", "longest", "ids", "keys", "labels", "width", "matrix", "aside"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    for batch in batches:
        ids, keys, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "key", "label"))
        if not len(ids):
            continue
        again = np.concatenate([[(int(ids[0]), int(keys[0])) == last], (ids[1:] == ids[:-1]) & (keys[1:] == keys[:-1])])
        last = (int(ids[-1]), int(keys[-1]))
        keep = np.flatnonzero(~again)
        aside = batch.column("bands").to_pylist() if "bands" in batch.schema.names else [[]] * len(ids)
        matrix = _matrix(batch.column("v"))
        for at in range(0, len(keep), rows):
            part = keep[at : at + rows]
            waiting.append((ids[part], keys[part], labels[part], matrix[part], [aside[i] for i in part.tolist()]))
        while sum(len(p[0]) for p in waiting) >= rows:
            whole = _joined(waiting)
            yield packed(tuple(x[:rows] for x in whole))
            waiting = [tuple(x[rows:] for x in whole)]
    if waiting and len((whole := _joined(waiting))[0]):
        yield packed(whole)


def packs(rows: DataFrame, size: int, lists: bool) -> DataFrame:
    """``rows`` from long to short in packs of ``size`` rows."""
    ordered = rows.repartitionByRange(F.desc("length2"), "vec_id", "key").sortWithinPartitions(F.desc("length2"), "vec_id", "key")
    return ordered.mapInArrow(lambda batches: _pack(batches, size, lists), f"pack bigint, longest double, {_PACKED}")


# --- search -----------------------------------------------------------------------


@dataclass
class Bucket:
    longest: float
    ids: np.ndarray
    keys: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray  # whole numbers, as floats while these hold all scores
    shares: np.ndarray  # a sorted list for each coordinate
    order: np.ndarray

    def candidates(self, focus: list[tuple[int, float]], cosine: float) -> np.ndarray:
        """Rows whose coordinates are feasible for a cosine of ``cosine`` or more; all of them if it is no bound."""
        if cosine <= 0:
            return np.arange(len(self.ids))
        seen = np.zeros(len(self.ids), np.int8)
        reach = np.arccos(min(cosine, 1.0))
        for c, value in focus:
            angle = np.arccos(np.clip(value, -1.0, 1.0))
            low, high = np.cos(min(np.pi, angle + reach)) - _SLACK, np.cos(max(0.0, angle - reach)) + _SLACK
            a, b = np.searchsorted(self.shares[c], low, "left"), np.searchsorted(self.shares[c], high, "right")
            seen[self.order[c, a:b]] += 1
        return np.flatnonzero(seen == len(focus))


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, keys, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "keys", "labels"))
    kind = np.int16 if row["width"] < 0 else np.int32
    return ids, keys, labels, np.frombuffer(row["matrix"], kind).reshape(len(ids), abs(row["width"])).astype(np.int64)


def _bucket(row: dict) -> Bucket:
    ids, keys, labels, matrix = _unpacked(row)
    order = np.frombuffer(row["aside"], np.int16).reshape(matrix.shape[1], len(ids))
    _, shares = _shares(matrix)
    return Bucket(row["longest"], ids, keys, labels, matrix, np.take_along_axis(shares.T, order.astype(np.int64), axis=1), order)


def _scores(matrix: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats while they hold every sum, else in whole numbers."""
    if float(np.abs(matrix).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(len(q), 1) < 2**53:
        return (matrix.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return matrix @ q


def _best(found: np.ndarray, more: np.ndarray, k: int) -> np.ndarray:
    """The first k of both by score, then id; rows (score, id, key)."""
    both = np.concatenate([found, more])
    return both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))[:k]]


def _search(buckets: list[Bucket], q: np.ndarray, least: list[int | None], k: int, wanted: Callable) -> list[np.ndarray]:
    """For each of several wishes the first k rows (score, id, key) that score ``least`` or more.

    ``wanted(bucket, rows, scores)`` gives a mask for each wish.
    """
    found = [np.zeros((0, 3), np.int64) for _ in least]
    length, shares = _shares(q[None, :])
    share = shares[0]
    focus = [(int(c), float(share[c])) for c in np.argsort(-np.abs(share), kind="stable")[:FOCUS] if share[c]]
    for bucket in buckets:
        width = bucket.matrix.shape[1]
        # A full list asks for as much as its last row scores; before that, ``least`` may ask for nothing.
        asked = [[x for x in (low, int(f[-1, 0]) if len(f) == k else None) if x is not None] for low, f in zip(least, found)]
        bounds = [max(x, default=None) for x in asked]
        bound = None if None in bounds else min(bounds)
        reach = float(length[0]) * bucket.longest
        cosine = 0.0 if bound is None or bound <= 0 else bound / reach - _SLACK if reach else 2.0
        if cosine > 1:
            break  # the buckets that follow are shorter still
        rows = bucket.candidates([f for f in focus if f[0] < width], cosine)
        if not len(rows):
            continue
        own = np.pad(q, (0, max(0, width - len(q))))[:width]
        scores = _scores(bucket.matrix[rows], own)
        for i, mask in enumerate(wanted(bucket, rows, scores)):
            if bounds[i] is not None:
                mask = mask & (scores >= bounds[i])
            if mask.any():
                hit = rows[mask]
                found[i] = _best(found[i], np.stack([scores[mask], bucket.ids[hit], bucket.keys[hit]], axis=1), k)
    return found


def _meet(buckets: DataFrame, blocks: DataFrame, answer: Callable[[list[Bucket], dict], list[tuple]], schema: str) -> DataFrame:
    """``answer`` of every block of anchors in every group of buckets."""
    groups = max(1, -(-buckets.count() // GROUP_BUCKETS))
    columns = ["pack", "longest", "ids", "keys", "labels", "width", "matrix", "aside"]
    held = buckets.select(F.pmod(F.xxhash64("pack"), F.lit(groups)).alias("bucket_group"), F.lit(0).alias("kind"), *columns)
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("bucket_group")
    streamed = blocks.select(each, F.lit(1).alias("kind"), *columns)
    dealt = held.unionByName(streamed).repartition("bucket_group").sortWithinPartitions("bucket_group", "kind", F.desc("longest"), "pack")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, resident = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["bucket_group"] != group:
                    group, resident = row["bucket_group"], []
                if row["kind"] == 0:
                    resident.append(_bucket(row))
                elif resident and (out := answer(resident, row)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return dealt.mapInArrow(run, schema)


def positives(buckets: DataFrame, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(key, place, positive_id, score) of the first k other rows of each anchor's label."""

    def answer(held: list[Bucket], block: dict) -> list[tuple]:
        out = []
        for anchor, key, label, q in zip(*_unpacked(block)):
            same = lambda b, rows, _: [(b.labels[rows] == label) & ~((b.ids[rows] == anchor) & (b.keys[rows] == key))]  # noqa: B023, E731
            (best,) = _search(held, q, [None], k, same)
            out += [(int(key), int(anchor), int(i), int(x), int(s)) for s, i, x in best]
        return out

    found = _meet(buckets, packs(anchors, BLOCK_ROWS, lists=False), answer, "key bigint, anchor_id bigint, positive_id bigint, positive_key bigint, score bigint")
    order = Window.partitionBy("key", "anchor_id").orderBy(F.desc("score"), "positive_id", "positive_key")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("positive_key")


def negatives(buckets: DataFrame, anchors: DataFrame, found: DataFrame, k: int = NEGATIVES) -> DataFrame:
    """(key, anchor_id, place, negative_id, score, rank) of the first k rows of other labels inside each positive's band."""
    bands = found.groupBy("key", "anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("bands"))
    wanted = anchors.join(bands.select("key", F.col("anchor_id").alias("vec_id"), F.col("bands.score").alias("bands")), ["key", "vec_id"])

    def answer(held: list[Bucket], block: dict) -> list[tuple]:
        out = []
        scores_of = np.frombuffer(block["aside"], np.int64).reshape(-1, POSITIVES)
        for anchor, key, label, q, own in zip(*_unpacked(block), scores_of):
            open_ = [(place, int(s)) for place, s in enumerate(own.tolist(), 1) if s >= 0]  # below 0 no band has values
            if not open_:
                continue
            masks = lambda b, rows, scores: [
                (b.labels[rows] != label) & (LOW * s <= 100 * scores) & (100 * scores <= HIGH * s) for _, s in open_  # noqa: B023
            ]
            best = _search(held, q, [-(-LOW * s // 100) for _, s in open_], k, masks)
            out += [(int(key), int(anchor), place, int(i), int(x), int(v)) for (place, _), b in zip(open_, best) for v, i, x in b]
        return out

    schema = "key bigint, anchor_id bigint, place bigint, negative_id bigint, negative_key bigint, score bigint"
    listed = _meet(buckets, packs(wanted, BLOCK_ROWS, lists=False), answer, schema)
    order = Window.partitionBy("key", "anchor_id", "place").orderBy(F.desc("score"), "negative_id", "negative_key")
    return listed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("negative_key")


def mine(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors, ids divisible by ``every``.

    Equal scores are ordered by id. Rows that are equal in id, label and vector count
    once; rows that share an id only are rows of their own, and anchors of their own.
    Of vectors of different lengths the missing components are zero. A positive without
    negatives gives no row, an empty table none; other columns are not looked at.
    """
    rows = vectors(embeddings)
    buckets = materialize(packs(rows, BUCKET_ROWS, lists=True), "vector-buckets")
    anchors = rows.filter(F.col("vec_id") % every == 0)
    near = materialize(positives(buckets, anchors), "vector-positives")
    far = negatives(buckets, anchors, near)
    named = near.select("key", "anchor_id", F.col("place").cast("bigint").alias("place"), "positive_id", F.col("score").alias("positive_score"))
    return far.join(named, ["key", "anchor_id", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score")
    )


ORACLE = """
WITH scaled AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same, list_dot_product(a.v, o.v)::BIGINT AS score
    FROM scaled a JOIN scaled o ON a.vec_id <> o.vec_id
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
    s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
