"""Column expressions on paths, ids and code text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Suffixes that mark a source-code file.
CODE_SUFFIXES = (
    ".c", ".cpp", ".cc", ".h", ".hpp", ".go", ".rs", ".py", ".js", ".ts", ".jsx", ".tsx", ".java",
)

# The Unicode white-space characters, for trimming.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A token is a run of letters, digits and underscores, or one other visible character.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f\x0B]"


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Lambdas of higher-order functions re-evaluate the expressions they capture
    for every element; passing the value as an argument avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_code_file(path: Column) -> Column:
    suffixes = "|".join(re.escape(suffix) for suffix in CODE_SUFFIXES)
    return F.coalesce(F.lower(path).rlike(rf"(?:{suffixes})\z"), F.lit(False))


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 8)


def snippet_id(repo: Column, sha: Column, path: Column, start_line: Column) -> Column:
    """``repo/sha8/path#Lstart``; a sha below eight characters is used as it is."""
    return F.concat(
        repo, F.lit("/"), short_sha(sha), F.lit("/"), path, F.lit("#L"), start_line.cast("string")
    )


def trim_white_space(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def newline_count(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def tokens(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(TOKEN_PATTERN), F.lit(0))


def clock_text(epoch_ms: Column) -> Column:
    """UTC ``HH:MM:SS`` of an epoch-millisecond column, whatever the session time zone."""
    second = F.floor(F.pmod(epoch_ms, F.lit(86_400_000)) / 1000).cast("int")
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(second / 3600).cast("int"),
        F.floor(second / 60).cast("int") % 60,
        second % 60,
    )
