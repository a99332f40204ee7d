"""Column expressions that take a unified diff apart.

All of them are narrow: no shuffle and no Python worker. The regular
expressions use Java's UNIX_LINES flag (``d``), so that only ``\\n`` ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hunkwise.functions.text import bind, newline_count, trim_white_space

LONG_MAX = (1 << 63) - 1
# Fixed value: pieces below this many bytes are no function.
MIN_FUNCTION_BYTES = 10

_HUNK_HEADER = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"
_WS = r"[\t\n\f\r ]"

# Words that may stand before a C-family return type.
MODIFIERS = (
    "static", "inline", "virtual", "override", "const", "unsigned", "signed", "void", "int",
    "long", "char", "float", "double", "bool", "auto",
)
_MOD = rf"(?:{'|'.join(MODIFIERS)}){_WS}++"

# The forms of a function start, anchored at a line start. In words: any number of modifiers
# and then "word word (". Written with possessive repeats, which Java runs in a
# loop; a backtracking form overflows the stack on thousands of modifiers. The
# words before the parenthesis are a run of modifiers and then zero, one or two
# others, which gives the first three lines.
_ENDS_IN_PAREN = "|".join(
    (
        rf"(?:{_MOD})++\w++(?:{_WS}++\w++)?{_WS}*+",
        rf"{_MOD}(?:{_MOD})++",
        rf"\w++{_WS}++\w++{_WS}*+",
        rf"func{_WS}+(?:\([^)]*\){_WS}*)?\w++{_WS}*+",
        rf"def{_WS}+\w++{_WS}*+",
        rf"(?:export{_WS}+)?(?:async{_WS}+)?function{_WS}+\w++{_WS}*+",
    )
)
_ENDS_IN_NAME = rf"(?:pub{_WS}+)?(?:async{_WS}+)?fn{_WS}+\w*"
# A long run of modifiers that starts no function starts none at its later lines
# either, so it is stepped over whole; without this, a run over many lines would
# be read again from each of them.
_DEAD_RUN = rf"(?:{_MOD}){{65,}}+"
FUNCTION_START = rf"(?md)^(?:(?:{_ENDS_IN_PAREN})(\()|{_ENDS_IN_NAME}(\w)|{_DEAD_RUN})"

# A line-start receiver, and what must follow its parenthesis.
_RECEIVER = rf"(?md)^func(?={_WS}++\()"
_NAME_AND_PAREN = rf"\A{_WS}*+\w++{_WS}*+\("

# Put before every match: two bytes, and a third one (the character captured at
# its end) at a function start only. Lines are compared by length with the
# unmarked ones, so no text can be mistaken for a mark.
_MARKED = "##$1$2$0"
_START_BYTES = 3


def file_chunks(diff: Column) -> Column:
    """Per-file parts of a diff; text before the first file line is a part of its own."""
    return F.split(diff, r"(?md)^(?=diff --git)", -1)


def chunk_path(chunk: Column) -> Column:
    """Target path of a file part, ``''`` when it has none."""
    return F.regexp_extract(chunk, r"(?md)^\+\+\+ (?:b/)?(.*)$", 1)


def hunk_segments(chunk: Column) -> Column:
    return F.split(chunk, rf"(?md)^(?={_HUNK_HEADER})", -1)


def is_hunk(segment: Column) -> Column:
    return segment.rlike(rf"\A{_HUNK_HEADER}")


def hunk_start(segment: Column) -> Column:
    """First line on the new side, 64 bits; a longer number counts as the largest one."""
    digits = F.regexp_extract(segment, rf"\A{_HUNK_HEADER}", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(LONG_MAX))


_ADDED = r"(?md)^\+(?!\+\+)"


def adds_lines(segment: Column) -> Column:
    """Stops at the first added line."""
    return segment.rlike(_ADDED)


def added_lines(segment: Column) -> Column:
    """Added lines without their ``+``; a line that starts ``+++`` does not count."""
    return F.regexp_extract_all(segment, F.lit(_ADDED + "(.*)$"), F.lit(1))


def _line_number(base: Column, offset: Column) -> Column:
    """``base + offset``; a sum beyond 64 bits, which no real diff has, counts as the largest number."""
    return F.coalesce(F.try_add(base.cast("bigint"), offset.cast("bigint")), F.lit(LONG_MAX))


def _snippet(code: Column, start: Column, end: Column) -> Column:
    return F.struct(
        code.alias("code"), start.cast("bigint").alias("start_line"), end.cast("bigint").alias("end_line")
    )


def _without_dead_receivers(code: Column) -> Column:
    """``code`` in which a receiver ``func (`` that starts no function reads ``Func (``.

    A receiver ends at the next ``)``, so whether a function starts depends only on
    what follows that ``)`` and is the same for all of a stretch. Decided once per
    stretch, no receiver is searched in vain. All lengths stay as they are, and
    ``Func`` is a word like ``func`` to the other forms of a start.
    """

    def stretches(parts: Column) -> Column:
        def quiet(part: Column, i: Column) -> Column:
            named = F.coalesce(F.get(parts, i + 1).rlike(_NAME_AND_PAREN), F.lit(False))
            return F.when(named, part).otherwise(F.regexp_replace(part, _RECEIVER, "Func"))

        return F.array_join(F.transform(parts, quiet), ")")

    return F.when(code.rlike(_RECEIVER), bind(F.split(code, r"\)", -1), stretches)).otherwise(code)


def functions_in(lines: Column, base_line: Column) -> Column:
    """Function pieces of a hunk's added lines: array of (code, start_line, end_line).

    Work is linear in the text: the starts are found in one pass, and each piece
    is a slice of the lines.
    """
    searched = bind(F.array_join(lines, "\n"), _without_dead_receivers)
    marked = F.split(F.regexp_replace(searched, FUNCTION_START, _MARKED), "\n", -1)

    def starts(both: Column) -> Column:
        def is_start(i: Column) -> Column:
            gained = F.octet_length(F.get(both["marked"], i)) - F.octet_length(F.get(both["lines"], i))
            return gained == _START_BYTES

        return F.struct(
            both["lines"].alias("lines"),
            F.filter(F.sequence(F.lit(0), F.size(both["lines"]) - 1), is_start).alias("starts"),
        )

    def pieces(cut: Column) -> Column:
        def piece(first: Column, k: Column) -> Column:
            after = F.coalesce(F.get(cut["starts"], k + 1), F.size(cut["lines"]))
            code = F.array_join(F.slice(cut["lines"], first + 1, after - first), "\n")
            return bind(
                trim_white_space(code),
                lambda trimmed: _snippet(
                    trimmed,
                    _line_number(base_line, first),
                    _line_number(base_line, first + newline_count(trimmed)),
                ),
            )

        return F.transform(cut["starts"], piece)

    both = F.struct(lines.alias("lines"), marked.alias("marked"))
    found = bind(bind(both, starts), pieces)
    return F.filter(found, lambda f: F.octet_length(f["code"]) >= MIN_FUNCTION_BYTES)


def hunk_snippets(lines: Column, base_line: Column) -> Column:
    """Functions of a hunk, or the whole hunk when it has none."""
    end = _line_number(base_line, F.size(lines) - 1)
    whole = F.array(_snippet(F.array_join(lines, "\n"), base_line, end))
    return bind(functions_in(lines, base_line), lambda found: F.when(F.size(found) > 0, found).otherwise(whole))
