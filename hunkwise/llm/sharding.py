"""Sharding by jump consistent hashing.

A key and the number of shards decide the shard, without a ring table. With one
more shard, about 1/(n+1) of the keys move, all of them into the new one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from hunkwise.llm.common import materialize

SHARDS = 24
# Fixed value: multiplier of the published generator.
_MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard in [0, ``shards``) of every 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(state), np.int64)
    shard = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while moving.size:
        shard[moving] = at[moving]
        state[moving] = state[moving] * _MULTIPLIER + np.uint64(1)
        leap = float(1 << 31) / ((state[moving] >> np.uint64(33)).astype(np.float64) + 1.0)
        at[moving] = ((shard[moving] + 1) * leap).astype(np.int64)
        moving = moving[at[moving] < shards]
    return shard.astype(np.int32)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) of all rows.

    The shard depends on ``doc_id`` alone; a NULL id is a key like any other, a
    NULL text has no bytes, and repeated rows share a shard but not a slot. Slots
    number the rows of a shard without gaps from 0, in the order of the tasks.
    An empty table gives no rows; other columns are not looked at.

    Slots need no sort and no group in one task: each task counts on within its
    own rows, and a prefix sum over (task, shard) counts gives the offsets. The
    numbered rows are written before they are counted, so a repeated task cannot
    make the two disagree.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64("doc_id").alias("hash"),
    )
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(shards, np.int64)
        for batch in batches:
            hashes = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            shard, grown = jump_hash(hashes, shards), jump_hash(hashes, shards + 1)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            within = np.empty(len(shard), np.int64)
            within[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "size", "text_crc32")),
                    pa.array(shard),
                    pa.array(seen[shard] + within),
                    pa.array(grown),
                    pa.array(np.full(len(shard), task, np.int32)),
                ],
                names=["doc_id", "size", "text_crc32", "shard", "nth", "grown_shard", "task"],
            )
            seen += counts

    schema = f"doc_id {kind}, size bigint, text_crc32 bigint, shard int, nth bigint, grown_shard int, task int"
    numbered = materialize(narrow.mapInArrow(number, schema), "shards")
    counts = numbered.groupBy("shard", "task").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "task", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    return numbered.join(offsets, ["shard", "task"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("nth") + F.col("offset")).alias("slot"), "grown_shard"
    )
