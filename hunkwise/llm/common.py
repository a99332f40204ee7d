"""Keys, intermediate tables and Arrow helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hunkwise.session import run_dir

# Names of the helper columns; operators select what they need first, so that
# other columns of a table, whatever their names, never meet them.
K1, K2 = "_key_1", "_key_2"
KEYS = [K1, K2]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keys(*columns: str) -> list[Column]:
    """Two independent 64-bit hashes that identify a row by ``columns``; NULL and '' differ.

    Rows that agree in all of them get the same key and so the same result.
    """
    return [F.xxhash64(F.lit(seed), *columns).alias(name) for seed, name in ((1, K1), (2, K2))]


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(key, doc_id, text, ``more``) of a table of documents; a NULL text stays NULL."""
    return docs.select(*keys("doc_id", "text"), "doc_id", "text", *more)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage, so that a lost executor costs a read and not the work, and
    gives the planner the true size: joins are broadcast by it and by no hint.
    """
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; all other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 3 == 1


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of all rows that models may learn from.

    Held-out ids and rows without an id or a label are left out, and an id counts once.
    """
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )


def learn_sample(labels: DataFrame, label: str, per_class: int, salt: int) -> DataFrame:
    """Up to ``per_class`` ``learnable`` ids of either class: (doc_id, label).

    The bound is the parameter; the rows are those with the smallest hashes of
    their ids, so they do not depend on the order of the table.
    """
    known = learnable(labels, label)
    order = F.xxhash64("doc_id", F.lit(salt))
    sides = [known.filter(F.col("label") == side).orderBy(order, "doc_id").limit(per_class) for side in (0, 1)]
    return sides[0].unionByName(sides[1])


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = 512
) -> DataFrame:
    """``function`` over Arrow batches of at most ``rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield function(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; NULL is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
