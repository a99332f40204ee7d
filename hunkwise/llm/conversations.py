"""Repair of conversation structure by a run-length dynamic program.

A conversation becomes a sequence of symbols, one for each row: the initial of its role
and its fault. Equal consecutive symbols are a run. The least cost of what follows is a
vector over four states (nothing yet, after system, after user, after assistant); a row
is a min-plus matrix on it, and a run of n rows is the product of the cached binary
powers of that matrix. From these vectors the letters of the cheapest edits are unrolled
from the front, the smallest letter first.

Rows are ordered by range, so that a long conversation lies in several chunks, each of a
bounded size. Matrices of chunks are multiplied as those of rows are: backwards for the
costs, forwards for the states; then every chunk is unrolled on its own. Only the hash
of a whole repaired conversation is a stream of its rows, in one task, a row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hunkwise.llm.common import K1, K2, KEYS, materialize

# White space, and what ends a sentence.
BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# Symbols: a row that must go; one of each initial, other ones last; the same truncated.
MUST_GO, INITIALS = 0, "sua"
_OTHER = len(INITIALS) + 1
_SYMBOLS = 1 + 2 * _OTHER

# States: nothing yet, after system, after user, after assistant. The next role where it is not system.
_STATES = range(4)
_NEXT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_END = (0, 2 * INSERT, INSERT, 0)  # what the end costs: insertions that complete the last pair
_NEVER = 1 << 50
# Rows of a run that are unrolled from one vector.
_BLOCK = 1024

Vector = tuple[int, ...]


# --- the dynamic program --------------------------------------------------------------


def _options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state) of the edits of one row, in the order of their letters."""
    found = [("D", DELETE, state)]
    if symbol != MUST_GO:
        extra = TRUNCATED if symbol > _OTHER else 0
        initial = (symbol - 1) % _OTHER
        if (initial == 0 and state == 0) or (0 < initial < len(INITIALS) and _NEXT[state] == initial + 1):
            found.append(("K", KEEP + extra, 1 if initial == 0 else _NEXT[state]))
        found.append(("R", REROLE + extra, _NEXT[state]))
    return found


@lru_cache(maxsize=None)
def _power(symbol: int, k: int) -> tuple[Vector, ...]:
    """Min-plus matrix of 2^k rows of ``symbol``, insertions before each row included."""
    if k:
        half = _power(symbol, k - 1)
        columns = [_times(half, tuple(row[j] for row in half)) for j in _STATES]
        return tuple(tuple(columns[j][i] for j in _STATES) for i in _STATES)
    rows = []
    for state in _STATES:
        least = [_NEVER] * len(_STATES)
        at, paid = state, 0
        for _ in _STATES:
            for _, cost, to in _options(symbol, at):
                least[to] = min(least[to], paid + cost)
            at, paid = _NEXT[at], paid + INSERT
        rows.append(tuple(least))
    return tuple(rows)


def _times(matrix: tuple[Vector, ...], vector: Vector) -> Vector:
    return tuple(min(_NEVER, *(m + v for m, v in zip(row, vector))) for row in matrix)


def before(symbol: int, rows: int, after: Vector) -> Vector:
    """Least costs before a run from those after it."""
    k = 0
    while rows:
        if rows & 1:
            after = _times(_power(symbol, k), after)
        rows, k = rows >> 1, k + 1
    return after


@lru_cache(maxsize=1 << 16)
def _choice(symbol: int, state: int, after: Vector) -> tuple[str, int, int]:
    """(letters, state, cost) of one row on the cheapest path; ``after`` has 0 as its smallest value."""
    open_ = _times(_power(symbol, 0), after)
    letters, paid = "", 0
    while True:
        target = open_[state]
        options = [*_options(symbol, state), ("I", INSERT, _NEXT[state])]
        for letter, cost, to in sorted(options):
            if cost + (open_ if letter == "I" else after)[to] == target:
                break
        letters, state, paid = letters + letter, to, paid + cost
        if letter != "I":
            return letters, state, paid


def _unrolled(runs: list[tuple[int, int]], state: int, end: Vector) -> Iterator[tuple[str, int, int, int]]:
    """(letters, state before them, state after them, cost) of each row of ``runs`` (symbol, rows)."""
    ends = [end]
    for symbol, rows in reversed(runs):
        ends.append(before(symbol, rows, ends[-1]))
    for (symbol, rows), after in zip(runs, reversed(ends[:-1])):
        for top in range(rows, 0, -_BLOCK):
            low = max(0, top - _BLOCK)
            vectors = [before(symbol, low, after)]
            for _ in range(top - low - 1):
                vectors.append(_times(_power(symbol, 0), vectors[-1]))
            for vector in reversed(vectors):
                least = min(vector)
                letters, following, cost = _choice(symbol, state, tuple(x - least for x in vector))
                yield letters, state, following, cost
                state = following


def _runs(symbols: np.ndarray, copies: np.ndarray) -> list[tuple[int, int]]:
    """(symbol, rows) of the runs of a chunk; all copies of a row but the first must go."""
    each = np.stack([symbols, np.zeros_like(symbols)], axis=1).ravel()
    rows = np.stack([np.ones_like(copies), copies - 1], axis=1).ravel()
    each, rows = each[rows > 0], rows[rows > 0]
    new = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]])) if len(each) else np.zeros(0, np.int64)
    return list(zip(each[new].tolist(), np.add.reduceat(rows, new).tolist() if len(new) else []))


# --- rows -------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text, copies) as the damage leaves them; 0 copies of a dropped row.

    NULL reads as one space in every column; ``conv`` is the id as text.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", said("conv_id").alias("conv"), said("role").alias("role"), said("text").alias("text"), said("turn").alias("at"))
    damage = F.crc32(F.concat_ws(":", "conv", "at").cast("binary")) % 20
    text = F.when(damage == 1, "").when(damage == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(damage == 4, "user").otherwise(F.col("role"))
    copies = F.when(damage == 0, 0).when(damage == 3, 2).otherwise(1).cast("bigint")
    return rows.select("conv", "conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _row_keys() -> list[Column]:
    return [F.xxhash64(F.lit(seed), "conv", "turn", "role", "text").alias(name) for seed, name in ((1, K1), (2, K2))]


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, initial, key, copies, blank, again, cut) of the different rows, without their texts.

    ``again`` says that the first copy repeats an earlier row too. Copies are added up
    before they meet, and the first turn of a text is a minimum, so no task gets a group.
    """
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    said = [F.xxhash64(F.lit(seed), "role", "text").alias(f"said_{seed}") for seed in (1, 2)]
    thin = rows.filter("copies > 0").select(
        "conv", "turn", "role", *_row_keys(), *said, "copies", (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(*STOPS)).alias("cut")
    )
    single = thin.groupBy("conv", "turn", "role", *KEYS, "said_1", "said_2", "blank", "cut").agg(F.sum("copies").alias("copies"))
    firsts = single.groupBy("conv", "said_1", "said_2").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("unturned"))
    again = F.col("turn").isNotNull() & (F.col("unturned") | (F.col("turn") > F.col("first")))
    return single.join(firsts, ["conv", "said_1", "said_2"]).select(
        "conv", "turn", "role", F.substring("role", 1, 1).alias("initial"), *KEYS, "copies", "blank", again.alias("again"), "cut"
    )


def ordered(found: DataFrame) -> DataFrame:
    """Rows of ``faults`` with their symbol, chunk and place, dealt by range of conversation and turn.

    Rows of one turn are in the order of role and hash.
    """
    initial = F.lit(_OTHER)
    for n, letter in enumerate(INITIALS, 1):
        initial = F.when(F.col("initial") == letter, n).otherwise(initial)
    symbol = F.when(F.col("blank") | F.col("again"), MUST_GO).otherwise(initial + F.when(F.col("cut"), _OTHER).otherwise(0))
    order = ["conv", "turn", "role", *KEYS]
    dealt = found.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select(
        "conv", "turn", "initial", *KEYS, "copies", symbol.cast("int").alias("symbol"),
        F.spark_partition_id().alias("chunk"), F.monotonically_increasing_id().alias("place"),
    )


def _parts(table: pa.Table, *columns: str) -> Iterator[tuple[str, list[np.ndarray]]]:
    """(conversation, columns in order) of each conversation of a chunk."""
    table = table.sort_by("place")
    conv = table.column("conv").to_pylist()
    values = [table.column(c).to_numpy() for c in columns]
    starts = [i for i in range(len(conv)) if not i or conv[i] != conv[i - 1]]
    for a, b in zip(starts, [*starts[1:], len(conv)]):
        yield conv[a], [v[a:b] for v in values]


def _matrices(table: pa.Table) -> pa.Table:
    """Min-plus matrix of each conversation's rows in a chunk."""
    out = []
    for conv, (symbol, copies) in _parts(table, "symbol", "copies"):
        runs = _runs(symbol.astype(np.int64), copies)
        columns = []
        for j in _STATES:
            vector = tuple(0 if i == j else _NEVER for i in _STATES)
            for s, n in reversed(runs):
                vector = before(s, n, vector)
            columns.append(vector)
        out.append((conv, int(table.column("chunk")[0].as_py()), [columns[j][i] for i in _STATES for j in _STATES]))
    return pa.table({"conv": [x[0] for x in out], "chunk": pa.array([x[1] for x in out], pa.int32()), "matrix": pa.array([x[2] for x in out], pa.list_(pa.int64()))})


def _ends(table: pa.Table) -> pa.Table:
    """Least costs after each chunk of a conversation, from the matrices of those that follow."""
    table = table.sort_by([("chunk", "descending")])
    vector: Vector = _END
    out = []
    for flat in table.column("matrix").to_pylist():
        out.append(list(vector))
        vector = _times(tuple(tuple(flat[4 * i : 4 * i + 4]) for i in _STATES), vector)
    return pa.table({"conv": table.column("conv"), "chunk": table.column("chunk"), "end": pa.array(out, pa.list_(pa.int64()))})


def _exits(table: pa.Table) -> pa.Table:
    """State in which a conversation leaves a chunk, for each state in which it may come in."""
    out = []
    for conv, (symbol, copies, end) in _parts(table, "symbol", "copies", "end"):
        runs = _runs(symbol.astype(np.int64), copies)
        left = []
        for state in _STATES:
            for _, _, state, _ in _unrolled(runs, state, tuple(int(x) for x in end[0])):  # noqa: B007, PLW2901
                pass
            left.append(state)
        out.append((conv, int(table.column("chunk")[0].as_py()), left))
    return pa.table({"conv": [x[0] for x in out], "chunk": pa.array([x[1] for x in out], pa.int32()), "exits": pa.array([x[2] for x in out], pa.list_(pa.int32()))})


def _entries(table: pa.Table) -> pa.Table:
    """State in which a conversation comes into each of its chunks."""
    table = table.sort_by("chunk")
    state, out = 0, []
    for exits in table.column("exits").to_pylist():
        out.append(state)
        state = exits[state]
    last = [False] * (len(out) - 1) + [True]
    return pa.table({"conv": table.column("conv"), "chunk": table.column("chunk"), "entry": pa.array(out, pa.int32()), "end": table.column("end"), "last": last})


def chunk_borders(rows: DataFrame) -> DataFrame:
    """(conv, chunk, entry, end, last) of the chunks of conversations that lie in more than one.

    That is a conversation or two for each border between chunks.
    """
    pieces = rows.select("conv", "chunk").distinct()
    spread = pieces.join(pieces.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv"), "conv")
    own = rows.join(materialize(spread, "conversation-borders"), ["conv", "chunk"], "left_semi").select("conv", "chunk", "place", "symbol", "copies")
    matrices = own.groupBy("conv", "chunk").applyInArrow(_matrices, "conv string, chunk int, matrix array<bigint>")
    ends = materialize(matrices.groupBy("conv").applyInArrow(_ends, "conv string, chunk int, end array<bigint>"), "conversation-ends")
    exits = own.join(ends, ["conv", "chunk"]).groupBy("conv", "chunk").applyInArrow(_exits, "conv string, chunk int, exits array<int>")
    return exits.join(ends, ["conv", "chunk"]).groupBy("conv").applyInArrow(_entries, "conv string, chunk int, entry int, end array<bigint>, last boolean")


_EDITED = f"conv string, chunk int, at bigint, role string, {K1} bigint, {K2} bigint, letters string, cost bigint, illegal bigint, first string, final string"


def _edited(table: pa.Table) -> pa.Table:
    """Repaired rows of a chunk, and one row with the letters of each of its conversations (``at`` NULL)."""
    chunk = int(table.column("chunk")[0].as_py())
    out: list[tuple] = []
    for conv, (symbol, copies, initial, k1, k2, entry, end, last) in _parts(table, "symbol", "copies", "initial", *KEYS, "entry", "end", "last"):
        vector = tuple(int(x) for x in end[0])
        steps = _unrolled(_runs(symbol.astype(np.int64), copies), int(entry[0]), vector)
        letters: list[str] = []
        paid = at = 0
        state = int(entry[0])

        def put(role: str | None, key: tuple[int | None, int | None]) -> None:
            nonlocal at
            out.append((conv, chunk, at, role, *key, None, None, None, None, None))  # noqa: B023
            at += 1

        for row in range(len(symbol)):
            for _ in range(int(copies[row])):
                own, state, following, cost = next(steps)
                letters.append(own)
                paid += cost
                for letter in own:
                    if letter == "I":
                        state = _NEXT[state]
                        put(_ROLE[state], (None, None))
                    elif letter != "D":
                        put(_ROLE[_NEXT[state]] if letter == "R" else None, (int(k1[row]), int(k2[row])))
                state = following
        while last[0] and state not in (0, 3):
            state = _NEXT[state]
            letters.append("I")
            paid += INSERT
            put(_ROLE[state], (None, None))
        pairs = initial[:-1] + initial[1:]
        illegal = int((copies - 1).sum()) + sum(p not in ("su", "ua", "au") for p in pairs.tolist())
        out.append((conv, chunk, None, None, None, None, "".join(letters), paid, illegal, initial[0], initial[-1]))
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in _EDITED.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def edits(rows: DataFrame) -> DataFrame:
    """The cheapest edits of ``ordered`` rows, in the form of ``_EDITED``."""
    borders = chunk_borders(rows)
    known = rows.join(borders, ["conv", "chunk"], "left").select(
        "conv", "chunk", "place", "symbol", "copies", "initial", *KEYS, F.coalesce("entry", F.lit(0)).alias("entry"),
        F.coalesce("end", F.array(*map(F.lit, _END)).cast("array<bigint>")).alias("end"), F.coalesce("last", F.lit(True)).alias("last"),
    )
    return known.groupBy("chunk").applyInArrow(_edited, _EDITED)


# --- results ----------------------------------------------------------------------


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation, joined by newlines, from rows in order."""
    conv, state = None, None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([state.hexdigest()])], names=["conv", "repaired_sha256"])

    for batch in batches:
        done: list[tuple[str, str]] = []
        for name, line in zip(batch.column("conv").to_pylist(), batch.column("line").cast(pa.binary()).to_pylist()):
            if name != conv:
                if state:
                    done.append((conv, state.hexdigest()))
                conv, state = name, hashlib.sha256(line)
            else:
                state.update(b"\n" + line)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done]), pa.array([x for _, x in done])], names=["conv", "repaired_sha256"])
    if state:
        yield closed()


def repaired(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """(conv, chunk, at, role, text) of the repaired conversations; ``chunk``, ``at`` is the order of their rows."""
    texts = rows.filter("copies > 0").select(*_row_keys(), F.col("role").alias("said"), "text").dropDuplicates(KEYS)
    kept = edited.filter(F.col("at").isNotNull() & F.col(K1).isNotNull()).join(texts, KEYS)
    made = edited.filter(F.col("at").isNotNull() & F.col(K1).isNull())
    return kept.select("conv", "chunk", "at", F.coalesce("role", "said").alias("role"), "text").unionByName(
        made.select("conv", "chunk", "at", "role", F.lit("").alias("text"))
    )


def audit(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of all conversations.

    NULL reads as one space, in ids and roles too; rows without a turn come first. Rows
    of one turn are in the order of role and hash, a row that is repeated counts as
    often as it is there. A conversation that lost all rows has zeros, no edits and the
    hash of an empty text, an empty table gives no rows, gaps too wide for 64 bits are
    NULL, and other columns are not looked at.
    """
    rows = damaged(conversations)
    every = rows.groupBy("conv").agg(F.min("conv_id").alias("conv_id"))
    found = materialize(faults(rows), "conversation-faults")
    follows = F.col("blank").cast("bigint")
    count = lambda condition, by: F.sum(F.when(condition, by).otherwise(0))
    seen = ~F.col("blank")
    facts = found.groupBy("conv").agg(
        F.try_subtract(F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1)), F.count_distinct("turn")).alias("gaps"),
        F.sum(follows * F.col("copies")).alias("blank"),
        count(seen, F.col("copies") - F.when(F.col("again"), 0).otherwise(1)).alias("duplicate"),
        count(seen & ~F.col("again") & F.col("cut"), 1).alias("truncated"),
        F.max(F.col("turn").isNotNull()).alias("turned"),
    )
    edited = materialize(edits(materialize(ordered(found), "conversation-order")), "conversation-edits")
    chunks = edited.filter("at IS NULL")
    over = F.lag("final").over(Window.partitionBy("conv").orderBy("chunk"))
    chained = chunks.withColumn("border", F.coalesce(~F.concat(over, F.col("first")).isin("su", "ua", "au"), F.lit(False)).cast("bigint"))
    letters = chained.groupBy("conv").agg(
        F.sum(F.col("illegal") + F.col("border")).alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "letters"))), lambda x: x["letters"]), "").alias("audit"),
    )
    lines = repaired(rows, edited).select("conv", "chunk", "at", F.concat_ws(":", "role", "text").alias("line"))
    hashes = lines.repartition("conv").sortWithinPartitions("conv", "chunk", "at").mapInArrow(_hashed, "conv string, repaired_sha256 string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    gaps = F.when(F.col("turned"), F.col("gaps")).otherwise(0).cast("bigint").alias("gaps")
    return every.join(facts, "conv", "left").join(letters, "conv", "left").join(hashes, "conv", "left").select(
        "conv_id", gaps, *map(zero, ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
