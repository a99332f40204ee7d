"""Snippets to scored results.

Three scorers share one contract (text -> two logits -> P(vulnerable) -> label):
a weights table, a fitted ``pyspark.ml`` pipeline, and a user-supplied model
that runs over Arrow batches.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from hunkwise.functions import model, text
from hunkwise.functions.order import LOWEST_BIN, order_bin
from hunkwise.operators.diffs import with_snippet_id
from hunkwise.operators.ranking import with_rank
from hunkwise.schemas import RESULT_COLUMNS
from hunkwise.session import run_dir

# Model input length and the id that pads it.
MAX_LENGTH = 512
PAD_ID = 0
UNKNOWN_ID = 1
FIRST_TERM_ID = 2

# Tokens that are looked up in a broadcast, about 20 MB; nine of ten occurrences in prose are of these.
FREQUENT_TOKENS = 1 << 17


def most_frequent(counts: DataFrame, n: str, size: int, key: str = "token") -> DataFrame:
    """The ``size`` rows with the highest ``n``, ties by ``key``.

    A histogram of ``n`` (few rows whatever the data) gives a floor that at least
    ``size`` rows reach. Only those go into the sort, instead of ``size`` rows
    from every task.
    """
    bins = counts.groupBy(order_bin(F.col(n)).alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    reached = F.sum("rows").over(Window.orderBy(F.desc("bin")))
    floor = bins.withColumn("reached", reached).filter(F.col("reached") >= size).agg(F.max("bin")).scalar()
    tall = counts.filter(order_bin(F.col(n)) >= F.coalesce(floor, F.lit(LOWEST_BIN)))
    return tall.orderBy(F.desc(n), key).limit(size)


def frequent_tokens(counts: DataFrame, most: int) -> DataFrame:
    """(token, n) of tokens that occur more often than all others, at most ``most`` rows.

    A floor from the histogram of ``n``, without a sort; tokens that tie at the floor
    all stay or all go. Meant for a broadcast: which tokens it holds decides how much
    is shuffled and no result.
    """
    bins = counts.groupBy(order_bin(F.col("n")).alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    reached = F.sum("rows").over(Window.orderBy(F.desc("bin")))
    floor = bins.withColumn("reached", reached).filter(F.col("reached") <= most).agg(F.min("bin")).scalar()
    return counts.filter(order_bin(F.col("n")) >= floor)


def token_counts(texts: DataFrame, column: str = "code") -> DataFrame:
    """(token, n) of all tokens, combined on the map side."""
    return (
        texts.select(F.explode(text.tokens(F.col(column))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def text_key(value: Column) -> Column:
    """The first 16 bytes of the SHA-256 of a text, a key that is short in a shuffle."""
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def token_vocabulary(texts: DataFrame, size: int | None = None, column: str = "code") -> DataFrame:
    """The tokens with their counts and ids, the most frequent first: all, or the first ``size``.

    Counts combine on the map side, so a token that makes up most of the text
    costs one row per task. All tokens are ranked in ranges, spread over all tasks.
    """
    counts = token_counts(texts, column)
    order = [F.desc("n"), F.asc("token")]
    if size is None:
        return with_rank(counts, order).select("token", "n", (F.col("rank") + (FIRST_TERM_ID - 1)).alias("token_id"))
    rank = F.row_number().over(Window.orderBy(*order))
    return most_frequent(counts, "n", size).withColumn("token_id", rank + (FIRST_TERM_ID - 1))


def encode(texts: DataFrame, vocabulary: DataFrame, column: str = "code", max_length: int = MAX_LENGTH) -> DataFrame:
    """Adds ``n_tokens`` and the fixed-length ``input_ids`` and ``attention_mask``.

    A fixed input length is part of the model contract; ``n_tokens`` is the
    length of the whole text, 0 for a NULL one. The vocabulary is joined, whatever
    its size; each different text is looked up once. The lowest ids, those of the most
    frequent tokens, are broadcast and looked up where a text's tokens are; only the
    other tokens pass a shuffle to the vocabulary and back.
    """
    found = text.tokens(F.col(column))
    keyed = texts.withColumns({"code_key": text_key(F.col(column)), "_n": F.coalesce(F.size(found), F.lit(0))})
    distinct = keyed.filter(F.col("code_key").isNotNull()).select("code_key", F.col(column).alias("code")).dropDuplicates(["code_key"])
    first = F.slice(text.tokens(F.col("code")), 1, max_length)
    placed = distinct.select("code_key", F.posexplode_outer(first).alias("at", "token")).filter(F.col("token").isNotNull())
    low = F.coalesce(F.col("token_id").between(0, FIRST_TERM_ID + FREQUENT_TOKENS - 1), F.lit(False))
    # Out of a generator: what holds for the ids is not carried over to the tokens of the texts.
    entries = vocabulary.select("token", F.explode(F.array("token_id")).alias("token_id"))
    frequent = F.broadcast(entries.filter(low))
    id_at = F.struct("at", F.coalesce("token_id", F.lit(UNKNOWN_ID)).alias("id"))

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("code_key").agg(F.collect_list(id_at).alias(name))

    near = gathered(placed.join(frequent, "token"), "near")
    rare = placed.join(frequent, "token", "left_anti").join(entries.filter(~low), "token", "left")
    both = F.when(F.col("far").isNull(), F.col("near")).when(F.col("near").isNull(), F.col("far")).otherwise(F.concat("near", "far"))
    joined = keyed.join(near, "code_key", "left").join(gathered(rare, "far"), "code_key", "left")
    ids = joined.withColumn("ids", F.array_sort(both)["id"])
    used = F.coalesce(F.size("ids"), F.lit(0))
    gap = F.lit(max_length) - used
    return ids.select(
        *texts.columns,
        F.col("_n").alias("n_tokens"),
        F.concat(F.coalesce("ids", F.array().cast("array<int>")), F.array_repeat(F.lit(PAD_ID), gap)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), gap)).alias("attention_mask"),
    )


def linear_logits(
    snippets: DataFrame, weights: DataFrame, bias: tuple[float, float] = (0.0, 0.0)
) -> DataFrame:
    """Adds ``logit0`` and ``logit1``: the bias plus the weights of all tokens of the code.

    ``weights`` has (token, w0, w1), any number of rows; rows of one token add up.
    A NULL code has no tokens. Tokens meet the weights of the most frequent ones
    where the code is read, by a broadcast of ``FREQUENT_TOKENS`` rows at most; these
    are found by a job that runs first and keeps them in the shared folder. So a
    code text goes into the shuffle as one row of sums and one for each different rare
    token, under a short key, and only these rows meet the rest of the weights. Copies
    of a text add up and are divided by their number, which each copy's first token tells.
    """
    summed = weights.groupBy("token").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
    path = run_dir(snippets.sparkSession, "frequent")
    frequent_tokens(token_counts(snippets), FREQUENT_TOKENS).select("token").write.parquet(path)
    frequent = (
        snippets.sparkSession.read.schema("token string").parquet(path)
        .join(summed, "token", "left")
        .select(F.col("token").alias("frequent"), F.col("w0").alias("f0"), F.col("w1").alias("f1"))
    )
    keyed = snippets.withColumn("code_key", text_key(F.col("code")))
    placed = (
        keyed.select("code_key", "code")
        .filter(F.col("code_key").isNotNull())
        .select("code_key", F.posexplode_outer(text.tokens(F.col("code"))).alias("at", "token"))
        .filter(F.col("token").isNotNull())
    )
    counts = (
        placed.join(F.broadcast(frequent), F.col("token") == F.col("frequent"), "left")
        .groupBy("code_key", F.when(F.col("frequent").isNull(), F.col("token")).alias("rare"))
        .agg(
            F.sum("f0").alias("f0"),
            F.sum("f1").alias("f1"),
            F.count(F.when(F.col("frequent").isNull(), 1)).alias("n"),
            F.count_if(F.col("at") == 0).alias("copies"),
        )
    )
    # Rows without a rare token meet no weight; NULL would send them all to one task.
    spread = F.concat(F.lit(" "), F.xxhash64("code_key").cast("string"))
    to_look_up = counts.withColumn("token", F.coalesce("rare", spread)).drop("rare")

    def total(frequent_sum: str, weight: str) -> Column:
        rare_sum = F.when(F.col("n") > 0, F.col("n") * F.col(weight))
        return F.sum(F.coalesce(frequent_sum, F.lit(0.0)) + F.coalesce(rare_sum, F.lit(0.0))) / F.sum("copies")

    # Unknown tokens stay in the join: one of them may be the first.
    sums = (
        to_look_up.join(summed, "token", "left")
        .groupBy("code_key")
        .agg(total("f0", "w0").alias("s0"), total("f1", "w1").alias("s1"))
    )
    return keyed.join(sums, "code_key", "left").select(
        *snippets.columns,
        (F.coalesce("s0", F.lit(0.0)) + bias[0]).alias("logit0"),
        (F.coalesce("s1", F.lit(0.0)) + bias[1]).alias("logit1"),
    )


def pipeline_logits(snippets: DataFrame, fitted: Transformer) -> DataFrame:
    """Logits of a fitted ``pyspark.ml`` classifier or pipeline."""
    raw = vector_to_array(F.col("rawPrediction"))
    scored = fitted.transform(snippets).withColumn("raw", raw)
    return scored.select(*snippets.columns, F.get("raw", F.lit(0)).alias("logit0"), F.get("raw", F.lit(1)).alias("logit1"))


Predict = Callable[[Sequence[str]], np.ndarray]


def batch_logits(snippets: DataFrame, load: Callable[[], Predict], on_error: str = "fail") -> DataFrame:
    """Logits of a user-supplied model over Arrow batches.

    ``load`` runs once per task and returns a function from a batch of code
    texts to an (n, 2) array. With ``on_error="fail"`` one bad record fails the
    batch and so the job; with ``"quarantine"`` a failing batch is repeated
    record by record and the bad ones carry their message in ``error``.
    Adds ``logit0``, ``logit1``, ``latency_ms`` (mean per record) and ``error``.
    """
    if on_error not in ("fail", "quarantine"):
        raise ValueError(f"unknown error mode {on_error!r}")
    added = [
        T.StructField("logit0", T.DoubleType()),
        T.StructField("logit1", T.DoubleType()),
        T.StructField("latency_ms", T.FloatType()),
        T.StructField("error", T.StringType()),
    ]
    schema = T.StructType([*snippets.schema.fields, *added])

    def run(predict: Predict, codes: list[str]) -> np.ndarray:
        logits = np.asarray(predict(codes), dtype="float64")
        if logits.shape != (len(codes), 2):
            raise ValueError(f"expected shape {(len(codes), 2)}, got {logits.shape}")
        return logits

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            codes = batch["code"].tolist()
            errors: list[str | None] = [None] * len(codes)
            began = time.perf_counter()
            try:
                logits = run(predict, codes)
            except Exception:
                if on_error == "fail":
                    raise
                logits = np.full((len(codes), 2), np.nan)
                for i, code in enumerate(codes):
                    try:
                        logits[i] = run(predict, [code])[0]
                    except Exception as problem:  # noqa: BLE001 - the record is set aside with its message
                        errors[i] = str(problem) or type(problem).__name__
            per_record = (time.perf_counter() - began) * 1000.0 / max(len(codes), 1)
            yield batch.assign(
                logit0=logits[:, 0],
                logit1=logits[:, 1],
                latency_ms=np.float32(per_record),
                error=pd.Series(errors, index=batch.index, dtype="object"),
            )

    return snippets.mapInPandas(score, schema)


def split_failures(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored rows, quarantined rows) of a ``batch_logits`` output."""
    good = scored.filter(F.col("error").isNull()).drop("error")
    bad = scored.filter(F.col("error").isNotNull()).drop("logit0", "logit1", "latency_ms")
    return good, bad


def with_label(scored: DataFrame) -> DataFrame:
    """Logits to ``confidence`` (32-bit, always P(vulnerable)), ``is_anomalous`` and ``label``."""
    confidence = model.vulnerable_probability(F.col("logit0"), F.col("logit1")).cast("float")
    return (
        scored.withColumn("confidence", confidence)
        .withColumn("is_anomalous", model.is_vulnerable(F.col("confidence")))
        .withColumn("label", model.label_of(F.col("confidence")))
    )


def as_results(scored: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Result rows of labelled snippets.

    The id is the snippet's, followed by a hash of the whole snippet and the time of
    its announcement, so a retried task gives the same one and two announcements of
    one snippet give two.
    Scorers that do not time single records leave ``latency_ms`` NULL.
    """
    parts = ("repo", "commit_sha", "file_path", "start_line", "end_line", "timestamp", "code")
    digest = F.md5(F.concat_ws("\n", *(F.col(part).cast("string") for part in parts)))
    rows = with_snippet_id(scored).withColumn("id", F.concat("id", F.lit("@"), digest))
    if "latency_ms" not in rows.columns:
        rows = rows.withColumn("latency_ms", F.lit(None).cast("float"))
    if processed_at is not None:
        rows = rows.withColumn("timestamp", processed_at.cast("bigint"))
    return rows.select(RESULT_COLUMNS)
