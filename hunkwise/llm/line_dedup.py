"""Cross-site boilerplate lines, found by the number of different sites they occur on.

HyperLogLog sketches of the sites are merged per line hash; lines whose estimate
lies near the threshold get an exact distinct count. A line on ``min_sites`` or
more sites is boilerplate: its first occurrence stays, all others go. Long lines
can be given a lower limit, since no two sites write the same long line by chance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hunkwise.functions.text import bind
from hunkwise.llm.common import K1, K2, KEYS, keyed, keys, materialize

MIN_SITES = 10
# A line of so many words is long; a caller may hold it boilerplate from this many sites on.
LONG_WORDS = 50
LONG_MIN_SITES = 3
# 2^12 registers: a standard error of 1.6 %. Estimates within 10 % (and one site
# at least) of the threshold are counted exactly.
LOG2_REGISTERS = 12
NEAR = 0.1

_LINE = ["_line_1", "_line_2"]


def _lines(rows: DataFrame) -> DataFrame:
    """(key, doc_id, site, pos, line hash, long) of every line that is not blank."""
    exploded = rows.select(*KEYS, "doc_id", "source", F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line"))
    hashes = [F.xxhash64(F.lit(seed), "line").alias(name) for seed, name in zip((1, 2), _LINE)]
    # So many words have as many characters and the blanks between them at least; only such lines are counted.
    long = F.when(F.length("line") < 2 * LONG_WORDS - 1, False).otherwise(F.regexp_count("line", F.lit(r"\S+")) >= LONG_WORDS)
    return exploded.filter(F.trim("line") != "").select(*KEYS, "doc_id", "source", "pos", *hashes, long.alias("long"))


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES, long_min_sites: int | None = None) -> DataFrame:
    """(line hash, first) of the lines on enough sites; ``first`` is the occurrence that stays.

    ``min_sites`` are enough, for lines of ``LONG_WORDS`` words or more ``long_min_sites`` if it is given.
    """
    lines = _lines(rows)
    least = F.lit(min_sites) if long_min_sites is None else F.when(F.col("long"), long_min_sites).otherwise(min_sites)
    near = F.greatest(F.lit(1.0), NEAR * least)
    sketched = lines.groupBy(*_LINE).agg(
        F.hll_sketch_agg("source", F.lit(LOG2_REGISTERS)).alias("sketch"),
        F.min(F.struct("doc_id", *KEYS, "pos")).alias("first"),
        F.max("long").alias("long"),
    )
    estimated = sketched.select(*_LINE, "first", "long", F.hll_sketch_estimate("sketch").alias("sites"))
    likely = materialize(estimated.filter(F.col("sites") >= least - near), "likely-lines")
    unsure = likely.filter(F.col("sites") <= least + near)
    exact = (
        lines.join(unsure.select(*_LINE), _LINE, "left_semi")
        .groupBy(*_LINE)
        .agg(F.count_distinct("source").alias("exact_sites"), F.max("long").alias("long"))
        .filter(F.col("exact_sites") >= least)
    )
    counted = unsure.join(exact, _LINE, "left_semi")
    return materialize(likely.filter(F.col("sites") > least + near).unionByName(counted).select(*_LINE, "first"), "boilerplate")


def dedup(
    docs: DataFrame, min_sites: int = MIN_SITES, carry: Sequence[str] = ("doc_id", "text"), long_min_sites: int | None = None
) -> DataFrame:
    """(``carry``, n_lines, n_removed) of all documents, ``text`` without boilerplate lines.

    Lines end at ``\\n`` and are compared as they are; blank lines are never
    boilerplate. The first occurrence is that with the smallest (doc_id, line
    number). ``long_min_sites``, if given, is the limit of long lines. A NULL site is no site. A NULL text has no lines and stays NULL, an
    empty one has one blank line; rows equal in doc_id and text count as one
    document and get one result each; an empty table gives no rows. Only the columns
    of ``carry`` are kept; one of them is the text, and their names must differ from
    the new ones.
    """
    rows = keyed(docs, "source")
    found = boilerplate(rows, min_sites, long_min_sites)
    repeats = (
        _lines(rows)
        .join(found, _LINE)
        .filter(~F.struct("doc_id", *KEYS, "pos").eqNullSafe(F.col("first")))
        .select(K1, K2, "pos")
    )
    gone = repeats.groupBy(*KEYS).agg(F.collect_set("pos").alias("gone"))
    texts = docs.select(*keys("doc_id", "text"), *(F.col(f"`{c}`") for c in carry))
    marked = texts.join(gone, KEYS, "left")
    lines = F.split("text", "\n", -1)

    def without_gone(all_lines):
        left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone")))
        return F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n")

    cut = bind(lines, without_gone)
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(cut).alias("text")
    return marked.select(
        *(kept if c == "text" else F.col(f"`{c}`") for c in carry),
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


# The same rows in DuckDB's SQL.
ORACLE = f"""
WITH numbered AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
spread AS (
  SELECT line, min((doc_id, pos)) AS first FROM numbered WHERE trim(line, ' ') <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT n.doc_id, n.pos, n.line, s.line IS NOT NULL AND (n.doc_id, n.pos) <> s.first AS gone
  FROM numbered n LEFT JOIN spread s ON n.line = s.line)
SELECT d.doc_id, count(m.pos) AS n_lines, count(*) FILTER (WHERE m.gone) AS n_removed,
       sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT m.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""
