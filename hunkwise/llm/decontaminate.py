"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every ``WINNOW`` consecutive k-grams of a text the one with the smallest hash
is kept as a fingerprint. Two texts that share a span of K + WINNOW - 1 words
(= one benchmark window) keep the same fingerprint inside it, so joining the
fingerprints misses no shared window. Each match is extended to the windows whose
smallest hash it is, and these are compared by all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hunkwise.llm.common import KEYS, keyed, lower_ascii, materialize

# Contract: words of a window, and the share of hit words (1/20) that contaminates.
WINDOW = 13
SHARE = 20
K = 5
WINNOW = WINDOW - K + 1
# 64-bit words of the bit set of benchmark fingerprints: 1 MB, whatever the benchmark.
_BIT_WORDS = 1 << 17

# Hashes of the words of a run.
R1, R2 = "_run_1", "_run_2"
RUN = [R1, R2]

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), _SEPARATORS), "")


def _folded(text: Column) -> Column:
    """Words in full lower case: equal wherever ``words`` are equal, and cheaper to find.

    Only used to find candidates. The one letter whose lower case depends on its
    neighbours is replaced first, so a window folds the same wherever it stands.
    """
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3"))), _SEPARATORS), "")


def _with_grams(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, n_words, grams): hashes of the K words from each place of ``text`` on; NULL if there are fewer."""
    hashed = rows.select(*columns, _folded(F.col("text")).alias("folded")).select(
        *columns, F.transform("folded", lambda w: F.xxhash64(w)).alias("folded")
    )
    size = F.size("folded")

    def gram(i: Column) -> Column:
        return F.xxhash64(*(F.get("folded", i + k) for k in range(K)))

    grams = F.when(size >= K, F.transform(F.sequence(F.lit(0), size - K), gram))
    return hashed.select(*columns, F.coalesce(size, F.lit(0)).alias("n_words"), grams.alias("grams"))


def winnowed(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, n_words, prints): the different smallest hashes of all windows; texts below a window have none."""
    grams = _with_grams(rows, *columns)
    n = F.size("grams") - WINNOW + 1
    least = lambda i: F.least(*(F.get("grams", i + k) for k in range(WINNOW)))
    prints = F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), least)))
    return grams.select(*columns, "n_words", prints.alias("prints"))


def _bit(hash_: Column) -> tuple[Column, Column]:
    """Word and bit of a fingerprint in the bit set."""
    place = F.pmod(hash_, F.lit(64 * _BIT_WORDS))
    return F.shiftright(place, 6).cast("int"), place.bitwiseAND(63).cast("int")


def _bit_set(wanted: DataFrame) -> DataFrame:
    """One row (bits) with the words of the bit set of all fingerprints of ``wanted``."""
    word, bit = _bit(F.col("hash"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    words_set = wanted.select(word.alias("word"), one.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    every = wanted.sparkSession.range(_BIT_WORDS).select(F.col("id").cast("int").alias("word"))
    filled = every.join(words_set, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    return filled.agg(F.array_sort(F.collect_list(F.struct("word", "bits")))["bits"].alias("bits"))


def wanted_prints(items: DataFrame) -> DataFrame:
    """(item, hash) of the fingerprints of the items."""
    prints = winnowed(items, "item").select("item", F.explode_outer("prints").alias("hash"))
    return materialize(prints.filter("hash IS NOT NULL").distinct(), "item-fingerprints")


def fingerprinted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, doc_id, n_words, prints, text) of all documents.

    Only fingerprints in the bit set of the wanted ones are kept, and the text only
    beside such ones; the others share no fingerprint with the benchmark. So no
    join has to move the texts of documents without a match.
    """

    def may_match(hash_: Column) -> Column:
        word, bit = _bit(hash_)
        return F.call_function("getbit", F.get("bits", word), bit) == 1

    # Spark merges the two steps, so the bit set is a constant and no column of any row.
    beside = winnowed(rows, *KEYS, "doc_id", "text").withColumn("bits", _bit_set(wanted).scalar())
    prints = beside.withColumn("prints", F.filter("prints", may_match)).drop("bits")
    text = F.when(F.size("prints") > 0, F.col("text"))
    return materialize(prints.select(*KEYS, "doc_id", "n_words", "prints", text.alias("text")), "document-fingerprints")


def _run(words_: Column, at: Column, n: Column | int) -> list[Column]:
    """Two independent 64-bit hashes of the ``n`` words from place ``at`` on; they stand for the words."""
    run = F.slice(words_, at + 1, n)
    return [F.xxhash64(F.lit(seed), run).alias(name) for seed, name in ((1, R1), (2, R2))]


def _windows(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, at, print, run) of all windows of ``text``: place, fingerprint and hashes of the words."""
    grams = _with_grams(rows, *columns, "text").select(*columns, "grams", words(F.col("text")).alias("words"))

    def window(at: Column) -> Column:
        least = F.least(*(F.get("grams", at + k) for k in range(WINNOW)))
        return F.struct(at.alias("at"), least.alias("print"), *_run(F.col("words"), at, WINDOW))

    n = F.size("grams") - WINNOW + 1
    every = F.when(n >= 1, F.transform(F.sequence(F.lit(0), n - 1), window))
    # An outer explode: Spark pushes a test of the input of an inner one below it, and computes that once more.
    return rows_of(grams.select(*columns, F.explode_outer(every).alias("window")), *columns)


def rows_of(exploded: DataFrame, *columns: str) -> DataFrame:
    return exploded.filter("window IS NOT NULL").select(*columns, "window.*")


def matches(printed: DataFrame, wanted: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (key, at, n, run) of document windows in an item, and (n, run, item) of the items' windows.

    Documents and items that share a fingerprint are found first, without places. In the
    texts of these documents each fingerprint is then extended to the windows it stands for,
    which hit if an item's window has the same fingerprint and the same words. A place of a
    document thus meets each different window once, however often both texts repeat it.
    """
    shared = printed.select(*KEYS, F.explode("prints").alias("hash")).join(wanted.select("hash").distinct(), "hash", "left_semi")
    shared = materialize(shared.select(*KEYS).distinct(), "documents-with-matches")
    touched = materialize(printed.filter("text IS NOT NULL").select(*KEYS, "text").join(shared, KEYS, "left_semi"), "matched-texts")
    n = F.lit(WINDOW).alias("n")
    in_items = materialize(_windows(items, "item").select(n, "print", *RUN, "item").distinct(), "item-windows")
    hits = _windows(touched, *KEYS).join(in_items.select("print", *RUN).distinct(), ["print", *RUN], "left_semi")
    return hits.select(*KEYS, "at", n, *RUN), in_items.drop("print")


def short_matches(rows: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``matches``, for the items shorter than a window.

    They are one window each and are looked up whole, by hashes of all document runs
    of their lengths. The set of those lengths has at most WINDOW - 1 numbers;
    without short items nothing is looked up.
    """
    brief = items.filter(F.size("words") < WINDOW).select(
        F.size("words").alias("n"), *_run(F.col("words"), F.lit(0), F.size("words")), "item"
    )
    brief = materialize(brief, "short-items")
    lengths = brief.agg(F.array_sort(F.collect_set("n"))).scalar()
    texts = rows.filter(F.size(lengths) > 0).select(*KEYS, words(F.col("text")).alias("words"))
    runs = texts.select(*KEYS, "words", F.explode(lengths).alias("n"))
    last = F.size("words") - F.col("n")

    def run(at: Column) -> Column:
        return F.struct(at.alias("at"), *_run(F.col("words"), at, F.col("n")))

    every = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), run))
    hashed = rows_of(runs.select(*KEYS, "n", F.explode_outer(every).alias("window")), *KEYS, "n")
    hits = hashed.join(brief.select("n", *RUN).distinct(), ["n", *RUN], "left_semi")
    return hits.select(*KEYS, "at", "n", *RUN), brief


def _covered(hits: DataFrame) -> DataFrame:
    """(key, n_hit): places inside any hit, by the ends of the hits that start before; no list of places is built."""
    spans = hits.groupBy(*KEYS, "at").agg((F.col("at") + F.max("n")).alias("end"))
    before = Window.partitionBy(*KEYS).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest("at", F.coalesce(F.max("end").over(before), F.lit(0)))
    return spans.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy(*KEYS).agg(F.sum("fresh").alias("n_hit"))


def check(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, doc_id, n_words, n_hit, items, contaminated) of all documents.

    ``items`` are the item_ids with a shared window, as strings in string order.
    NULL or empty texts, and items without words, have no windows; equal items
    count each; rows equal in doc_id and text get the same result each; an empty
    table on either side hits nothing; other columns are not looked at. A NULL
    item_id hits but is in no list.
    """
    rows = keyed(docs)
    named = benchmark.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("string").alias("item_id"), "text")
    items = named.filter(F.col("text").isNotNull()).dropDuplicates(["item"]).withColumn("words", words(F.col("text")))
    items = materialize(items.filter(F.size("words") > 0), "benchmark-items")
    wanted = wanted_prints(items)
    printed = fingerprinted(rows, wanted)
    hits, in_items = matches(printed, wanted, items)
    short_hits, short_items = short_matches(rows.filter(F.col("text").isNotNull()), items)
    hits = materialize(hits.unionByName(short_hits).distinct(), "hits")
    in_items = in_items.unionByName(short_items).join(items.select("item", "item_id"), "item")
    named = hits.select(*KEYS, "n", *RUN).distinct().join(in_items, ["n", *RUN]).select(*KEYS, "item_id").distinct()
    listed = named.groupBy(*KEYS).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hits = _covered(hits).join(listed, KEYS, "left")
    counted = printed.select(*KEYS, "doc_id", F.col("n_words").cast("bigint").alias("n_words")).join(hits, KEYS, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return counted.select(
        *KEYS,
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


# The same rows in DuckDB's SQL, from all windows instead of fingerprints.
ORACLE = rf"""
WITH lowered AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+'), lambda w: w <> '') AS words FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+'), lambda w: w <> '') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(words), {WINDOW}) AS n,
         array_to_string(words[i:i + least(len(words), {WINDOW}) - 1], ' ') AS run
  FROM items, unnest(range(1, len(words) - least(len(words), {WINDOW}) + 2)) AS t(i) WHERE len(words) > 0),
runs AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS run
  FROM lowered, (SELECT DISTINCT n FROM windows) AS l, unnest(range(1, len(words) - n + 2)) AS t(i)),
shared AS (SELECT r.doc_id, r.n, r.i, w.item_id FROM runs r JOIN windows w ON r.n = w.n AND r.run = w.run),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM shared, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM shared GROUP BY doc_id)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(d.words) AS contaminated
FROM lowered d LEFT JOIN places p USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
