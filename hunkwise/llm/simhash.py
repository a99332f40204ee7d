"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64 bits; two of them link at ``RADIUS`` or fewer different bits.
Every bit position gets a non-zero vector of RADIUS + 1 bits; the mask of table
``v`` has the positions whose product with ``v`` is odd. The vectors of up to RADIUS
differing positions never span the whole space, so some ``v`` is orthogonal to
them all, and its mask has none of them: each linked pair agrees on the masked
bits of at least one table. A mask keeps over half of the bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from hunkwise.llm.common import K1, K2, KEYS, keyed, map_batches, materialize, raw_texts

RADIUS = 2
SHINGLE = 3
SEED = 42


def masks(radius: int) -> dict[int, int]:
    """64-bit mask of each table, from vectors that take all non-zero values equally often."""
    tables = range(1, 1 << (radius + 1))
    vectors = [1 + position % len(tables) for position in range(64)]
    return {v: sum(1 << p for p, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in tables}


MASKS = masks(RADIUS)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(raw: bytes) -> int:
    """Bits that are set in over half of the hashes of a text's shingles, repeats included."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - SHINGLE + 1)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # a bounded piece at a time
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * set_bits > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(key, doc_id, fp) of all rows, ``fp`` as a signed 64-bit number."""
    rows = keyed(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(raw) for raw in raw_texts(batch.column("text"))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in (K1, K2, "doc_id")), pa.array(found, pa.int64())], names=[K1, K2, "doc_id", "fp"]
        )

    return map_batches(rows, compute, f"{K1} bigint, {K2} bigint, doc_id {kind}, fp bigint")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) between different fingerprints at most RADIUS bits apart; enough of them to connect all that link.

    Inside a bucket of a table, members are not compared in pairs. Each puts
    itself under every value that differs from it in at most one bit outside the
    mask; two members of a bucket within two bits of each other share such a
    value, and all who share one link to the smallest of them. That is at most
    29 rows for a member and table, however large its bucket.
    """
    tables = F.explode(
        F.array(*(F.struct(F.lit(v).alias("table"), F.lit(_signed(mask)).alias("mask")) for v, mask in MASKS.items()))
    )
    filed = (
        distinct.select("fp", tables.alias("t"))
        .select("fp", "t.table", "t.mask", F.col("fp").bitwiseAND(F.col("t.mask")).alias("bucket"))
    )
    shared = filed.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("table", "bucket")
    members = filed.join(shared, ["table", "bucket"], "left_semi")
    outside = {v: [_signed(1 << p) for p in range(64) if not mask >> p & 1] for v, mask in MASKS.items()}
    flips = F.element_at(F.array(*(F.array(F.lit(0), *map(F.lit, outside[v])).cast("array<bigint>") for v in MASKS)), F.col("table"))
    near = members.select("fp", "table", F.explode(flips).alias("flip")).select(
        "fp", "table", F.col("fp").bitwiseXOR(F.col("flip")).alias("near")
    )
    centres = near.groupBy("table", "near").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b < top").drop("top")
    joined = near.join(centres, ["table", "near"])
    return joined.filter("fp > b").select(F.col("fp").alias("a"), "b").distinct()


def _digest(edges: DataFrame) -> tuple:
    """The same for the same set of edges."""
    hashes = (F.bit_xor(F.xxhash64(F.lit(seed), "a", "b")) for seed in (1, 2))
    return tuple(edges.agg(F.count(F.lit(1)), *hashes).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the smallest node that can be reached.

    Alternates two steps until nothing changes: each node hands its larger
    neighbours to its smallest one, then its smaller ones. Edges never grow in
    number, and the steps needed grow with the logarithm of the size. Each round
    is written out, which ends its lineage.
    """
    current = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _digest(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(smallest, "a")
        small = rest.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            smallest.select("a", F.col("m").alias("b"))
        )
        following = materialize(small.distinct(), "small-star")
        if (state := _digest(following)) == before:
            return following.select(F.col("a").alias("node"), F.col("b").alias("root"))
        current, before = following, state


def cluster(docs: DataFrame) -> DataFrame:
    """(key, doc_id, fp, root, component_id) of all rows, written to the shared folder.

    ``component_id`` is the smallest doc_id of the component. Texts without words
    have fingerprint 0 and link to each other like any others. NULL ids take part
    but are never a component's id, unless it has no other (then NULL); repeated
    rows fall into one component; an empty table gives no rows; other columns are
    not looked at.
    """
    printed = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(named, "root").select("fp", "root", "component_id")
    return materialize(printed.join(ids, "fp").select(*KEYS, "doc_id", "fp", "root", "component_id"), "components")


def survivors(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, one of each component: that with the smallest doc_id.

    Where a component has several rows of that id, or no id at all, the one with the
    smallest key stays.
    """
    clustered = cluster(docs)
    best = (
        clustered.filter("component_id IS NULL OR doc_id = component_id")
        .groupBy("root")
        .agg(F.min(F.struct(*KEYS)).alias("key"))
        .select(F.col("key")[K1].alias(K1), F.col("key")[K2].alias(K2))
    )
    k1, k2 = (F.xxhash64(F.lit(seed), "doc_id", "text") for seed in (1, 2))
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), k1.alias(K1), k2.alias(K2))
    kept = marked.join(best, KEYS, "left_semi")
    return kept.dropDuplicates(KEYS).select("row.*")
