"""URL filter: given host and path rules, and association rules mined from labelled URLs.

The given rules decide the URLs that they fit. All others are judged by token
combinations that FP-growth finds in labelled URLs, kept by support and
confidence and matched through an inverted index. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from hunkwise.llm.common import lower_ascii, materialize

# Fixed values: (verdict, host, path) of the given rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# An association rule counts from so many labelled URLs, whatever their number,
# and from this share of those with its tokens.
MIN_URLS = 10
MIN_CONFIDENCE = 0.6
DEFAULT = "allow"

_LABEL = "verdict="
# The number of a page's document, which its label was joined by: the end of the path, before a file suffix.
_NUMBER = r"/(\d{1,18})(?:\.\w+)?/?\z"


def host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and starts the path; NULL if none does."""
    chosen: Column = F.lit(None)
    for verdict, domain, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def tokens(host: Column, path: Column) -> Column:
    """Different tokens of a URL: host labels, their hyphenated parts, and path parts, marked by where they stand.

    The number of the document is no token: a rule on it would look a label up, not judge by a pattern.
    """
    labels = F.filter(F.split(host, r"[.]"), lambda x: x != "")
    pieces = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    parts = F.filter(F.split(F.regexp_replace(path, _NUMBER, ""), "/"), lambda x: x != "")
    return F.array_sort(
        F.array_distinct(
            F.concat(
                F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
                F.transform(pieces, lambda x: F.concat(F.lit("word:"), x)),
                F.transform(parts, lambda x: F.concat(F.lit("path:"), x)),
            )
        )
    )


def mine(labelled: DataFrame, min_urls: int = MIN_URLS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(antecedent, verdict, confidence, support) from (tokens, verdict) rows, all of them.

    Combinations of tokens and one verdict that stand in ``min_urls`` rows or more.
    Of nested rules for one verdict the longer stays only if its confidence is higher.
    """
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit(_LABEL), "verdict")).alias("items"))
    total = baskets.count()
    if total < min_urls:
        baskets = baskets.limit(0)
    # FP-growth takes a share and rounds its product with the number of rows up.
    share = (min_urls - 0.5) / max(total, min_urls)
    found = FPGrowth(itemsCol="items", minSupport=share, minConfidence=0.0).fit(baskets).freqItemsets
    is_label = lambda x: x.startswith(_LABEL)
    sets = found.select(
        F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("antecedent"),
        F.get(F.filter("items", is_label), F.lit(0)).alias("label"),
        "freq",
    ).filter(F.size("antecedent") > 0)
    sets = materialize(sets, "itemsets")
    with_label = sets.filter(F.col("label").isNotNull())
    without = sets.filter(F.col("label").isNull()).select("antecedent", F.col("freq").alias("all"))
    rules = with_label.join(without, "antecedent").select(
        "antecedent",
        F.substring("label", len(_LABEL) + 1, 1 << 30).alias("verdict"),
        (F.col("freq") / F.col("all")).alias("confidence"),
        (F.col("freq") / total).alias("support"),
    )
    confident = materialize(rules.filter(F.col("confidence") >= min_confidence), "confident-rules")
    shorter = confident.select(
        "verdict", F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence")
    )
    parts = confident.withColumn(
        "part", F.explode(F.transform("antecedent", lambda x: F.array_remove("antecedent", x)))
    ).filter(F.size("part") > 0)
    better_part = parts.join(shorter, ["verdict", "part"]).filter(F.col("part_confidence") >= F.col("confidence"))
    return materialize(confident.join(better_part.select("antecedent", "verdict"), ["antecedent", "verdict"], "left_anti"), "url-rules")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict) of the different token sets that a mined rule fits.

    Each rule stands in the index under one of its tokens, the rarest among the
    rules, so a frequent token does not fetch them all. Of several fitting rules
    the most confident one counts, then the best supported, then the longest,
    then the first in order.
    """
    use = rules.select(F.explode("antecedent").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    rank = F.min(F.struct("uses", "token"))["token"]
    index = (
        rules.select("*", F.explode("antecedent").alias("token"))
        .join(use, "token")
        .groupBy("antecedent", "verdict", "confidence", "support")
        .agg(rank.alias("token"))
    )
    distinct = urls.select("tokens").distinct()
    fitting = (
        distinct.select("tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    )
    best = F.max(F.struct("confidence", "support", F.size("antecedent"), "antecedent", "verdict"))["verdict"]
    return fitting.groupBy("tokens").agg(best.alias("mined"))


def labelled_by_documents(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, verdict) of the pages whose document is labelled: toxic or bad ones are to be blocked.

    The document is the number that ends the path, before a file suffix.
    """
    number = F.regexp_extract(path(F.col("url")), _NUMBER, 1)
    numbered = pages.select("url", number.try_cast("bigint").alias("doc_id"))
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    verdicts = labels.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return numbered.join(verdicts, "doc_id").select("url", F.when(F.col("bad"), "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of all pages.

    ``labelled`` has (url, verdict). Where no rule, given or mined, fits, the verdict is
    ``DEFAULT``. A NULL url, or one without ``://``, has an empty host and path
    and so no tokens; repeated rows are judged alike; an empty table gives no
    rows; other columns are not looked at.
    """
    split = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = split.withColumn("given", given_rule(F.col("host"), F.col("path"))).withColumn("tokens", tokens(F.col("host"), F.col("path")))
    known = labelled.select(tokens(host(F.col("url")), path(F.col("url"))).alias("tokens"), "verdict")
    rules = mine(known.filter(F.size("tokens") > 0))
    # Many pages of a host have the same tokens. Written first, the verdicts are joined by an exchange of
    # their own, whose large partitions Spark splits, or broadcast.
    mined = materialize(match(ruled.filter(F.col("given").isNull()), rules), "url-verdicts")
    return ruled.join(mined, "tokens", "left").select(
        "page_id", "host", "path", F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", "mined", F.lit(DEFAULT)).alias("verdict"),
    )
