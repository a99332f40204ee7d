"""Byte-level BPE over overlapping chunks.

Long texts are cut into overlapping chunks that are pre-tokenised on their own.
Where the boundaries of two neighbours meet again inside the overlap, the texts
are stitched; the pieces between such points are encoded, each pre-token for
itself. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window, functions as F

from hunkwise.llm.common import K1, K2, KEYS, keyed, map_batches

# Characters of a chunk, and of its overlap with the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 10
# A boundary is only certain when the pattern's longest fixed alternative (three
# characters) would have fitted behind it.
_MARGIN = 3


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in _ranks(path).items()}


def boundaries(pattern: str, text: str, start: int, complete: bool) -> list[int]:
    """Certain ends of the pre-tokens of ``text`` from ``start`` on."""
    last = len(text) if complete else len(text) - _MARGIN
    return [m.end() for m in regex.finditer(pattern, text, pos=start) if m.end() <= last]


def _plain_gap(text: str, at: int) -> bool:
    """A space between two ASCII letters is a boundary whatever stands before."""
    return 0 < at < len(text) - 1 and text[at] == " " and all(c.isascii() and c.isalpha() for c in (text[at - 1], text[at + 1]))


def junction(pattern: str, text: str, following: int, complete: bool) -> tuple[int | None, int | None]:
    """Where the chunk ``text`` and the one that starts at ``following`` agree first.

    The second value is the first agreement that holds whatever the earlier text.
    """
    own = set(boundaries(pattern, text, 0, complete))
    shared = [p for p in boundaries(pattern, text, following, complete) if p in own]
    return next(iter(shared), None), next((p for p in shared if _plain_gap(text, p)), None)


def _chunks(rows: DataFrame) -> DataFrame:
    size = F.length("text")
    count = F.ceil((size - OVERLAP) / CHUNK).cast("int")
    return (
        rows.withColumn("chunks", count)
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("text", F.substring(F.col("text"), F.col("chunk") * CHUNK + 1, F.lit(CHUNK + OVERLAP)))
        .repartition(*KEYS, "chunk")
    )


def _pieces(rows: DataFrame, pattern: str, kind: str) -> DataFrame:
    """(key, doc_id, piece, text): long texts cut only where two neighbouring chunks agree.

    If all chunks of a text agree with their successors, each agreement holds by
    induction from the start of the text. If some do not (one pre-token fills the
    whole overlap), only agreements that hold by themselves are used, and the
    chunks between two of them are joined again.
    """

    def meet(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[tuple[int | None, int | None]] = []
        columns = (batch.column(c).to_pylist() for c in ("text", "chunk", "chunks"))
        for text, chunk, chunks in zip(*columns, strict=True):
            last = chunk == chunks - 1
            found.append((None, None) if last else junction(pattern, text, CHUNK, False))
        return pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in (K1, K2, "doc_id", "text", "chunk", "chunks")),
                *(pa.array(list(x), pa.int32()) for x in (zip(*found, strict=True) if found else ([], []))),
            ],
            names=[K1, K2, "doc_id", "text", "chunk", "chunks", "meets", "surely"],
        )

    schema = f"{K1} bigint, {K2} bigint, doc_id {kind}, text string, chunk int, chunks int, meets int, surely int"
    distinct = rows.dropDuplicates(KEYS)
    met = map_batches(_chunks(distinct), meet, schema, rows=64)
    whole, upto = Window.partitionBy(*KEYS), Window.partitionBy(*KEYS).orderBy("chunk")
    inner = F.col("chunk") < F.col("chunks") - 1
    all_meet = F.min(F.when(inner, F.col("meets").isNotNull()).otherwise(True)).over(whole)
    cut = met.withColumn("to", F.when(all_meet, F.col("meets")).otherwise(F.col("surely")))
    previous = F.lag("to").over(upto)
    cut = (
        cut.withColumn("from", F.coalesce(previous - CHUNK, F.lit(0)))
        .withColumn("piece", F.sum(F.when(previous.isNotNull(), 1).otherwise(0)).over(upto).cast("int"))
        .withColumn("to", F.coalesce("to", F.when(inner, CHUNK).otherwise(CHUNK + OVERLAP)))
        .withColumn("text", F.substring(F.col("text"), F.col("from") + 1, F.col("to") - F.col("from")))
    )
    joined = F.array_sort(F.collect_list(F.struct("chunk", "text")))["text"]
    return cut.groupBy(*KEYS, "piece").agg(F.first("doc_id").alias("doc_id"), F.array_join(joined, "").alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of all documents, ``ids`` as little-endian unsigned 32-bit numbers.

    A NULL text is an empty one and has no ids; rows equal in doc_id and text get
    the same ids each; an empty table gives no rows; other columns are not looked
    at. Special tokens are ordinary text. ``ranks_path`` is a file of the package
    installed on every executor.
    """
    rows = keyed(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    is_long = F.coalesce(F.length("text") > CHUNK + OVERLAP, F.lit(False))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode_one = _encoding(ranks_path, pattern).encode_ordinary
        ids = [np.array(encode_one(text or ""), "<u4").tobytes() for text in batch.column("text").to_pylist()]
        names = [c for c in batch.schema.names if c != "text"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(ids, pa.binary())], names=[*names, "ids"])

    short = map_batches(rows.filter(~is_long).select("doc_id", "text"), run, f"doc_id {kind}, ids binary")
    long = rows.filter(is_long)
    pieces = _pieces(long, pattern, kind)
    coded = map_batches(pieces, run, f"{K1} bigint, {K2} bigint, piece int, doc_id {kind}, ids binary", rows=64)
    in_order = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    stitched = coded.groupBy(*KEYS).agg(in_order.alias("parts"), F.count(F.lit(1)).alias("n")).select(
        *KEYS, F.aggregate("parts", F.lit(b""), lambda all_ids, part: F.concat(all_ids, part["ids"])).alias("ids")
    )
    return short.unionByName(long.select(*KEYS, "doc_id").join(stitched, KEYS).select("doc_id", "ids"))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded``: the concatenated bytes of all ``ids``; NULL ids decode to nothing."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        token = _tokens(ranks_path).__getitem__
        texts = [b"".join(map(token, np.frombuffer(ids or b"", "<u4").tolist())) for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return map_batches(encoded, run, f"{fields}, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decoded documents."""

    def sha256(column: str) -> Column:
        return F.sha2(F.col(column), 256)

    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        sha256("ids").alias("ids_sha256"),
        sha256("decoded").alias("decoded_sha256"),
    )
