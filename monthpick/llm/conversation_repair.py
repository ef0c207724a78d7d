"""Repair of conversation structure by least-cost edits (operator 11).

The role initials of a repaired conversation read ``(s?(ua)+)?``.  A row may be kept (K),
given role user or assistant (R) or deleted (D, required for blank and duplicate rows), and
empty user or assistant rows may be inserted anywhere (I); truncated rows that stay cost
extra.  Each row is one of nine symbols: role initial (s, u, a, other) with or without
truncation, or must-go.  A symbol is a min-plus matrix over four states (start, after s,
after u, after a) that holds the inserts before the row and the row's own edit.

Run-length dynamic programme: equal consecutive symbols collapse into runs, and a run of n
rows is the symbol's matrix to the power n, a product of cached binary powers.  Products
are associative, so a conversation need not be in one task: rows are sorted by
(conversation, turn) over all tasks, each task's part of a conversation (a piece) becomes
its symbols and the product of its runs, and only those products (16 numbers a piece, at
most one piece of a conversation for each partition of the sort) meet.  They give each
piece the cost from each state at its end.  Then each piece unrolls the choices run by run:
costs inside a run are stepped back from powers of its matrix ``UNROLL`` rows apart, and of
all cheapest choices the least letter is taken, which gives the least audit string.  A
piece that continues a conversation is unrolled from each state; chaining the pieces' end
states picks the one that holds.

The repaired text of a conversation, and its digest, is a stream in order: one task reads
one conversation's rows a row at a time, with one piece's audit in memory.

Edge cases: null role or text is one space; a null conv_id is a conversation like any
other; null turns come first; rows with the same turn are ordered by role and text; any
number of repeated rows; initials other than s, u, a (also an empty role's) can't be kept;
a conversation without rows has an empty audit; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthpick.llm.common import Scratch

RETITLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or renamed row leads to from each state.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row of each initial leads (s only at the start, u at the start or after s or a, a after u).
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Symbols: initial class, a full stop after it if truncated; must-go.
SYMBOLS = ("s", "u", "a", "o", "s.", "u.", "a.", "o.", "-")
LEGAL = ("su", "ua", "au")
#: Rows between costs that come from powers while a run is unrolled.
UNROLL = 4096
NEVER = np.int64(1 << 60)
#: Rows of an Arrow batch that a task hands on.
_BATCH = 2000


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), NEVER)


def _inserts() -> np.ndarray:
    """Least cost of inserts only, from state to state."""
    m = np.full((4, 4), NEVER)
    np.fill_diagonal(m, 0)
    for state, to in enumerate(NEXT):
        m[state, to] = INSERT
    twice = min_plus(m, m)
    return min_plus(twice, twice)


INSERTS = _inserts()
#: Cost from each state at a conversation's end: inserts until the start state or an assistant row.
END = np.minimum(INSERTS[:, START], INSERTS[:, ASSISTANT])


def edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row, by letter."""
    out = [("D", DELETE, state)]
    if symbol != "-":
        extra = TRUNCATED if symbol.endswith(".") else 0
        to = KEEP.get(symbol[0], {}).get(state)
        if to is not None:
            out.append(("K", extra, to))
        out.append(("R", RETITLE + extra, NEXT[state]))
    return out


#: Matrices of 2 ** k rows of a symbol, as far as they were asked for.
_POWERS: dict[tuple[str, int], np.ndarray] = {}


def power(symbol: str, k: int) -> np.ndarray:
    """Matrix of 2 ** k rows of a symbol."""
    if (symbol, k) not in _POWERS:
        if k:
            half = power(symbol, k - 1)
            _POWERS[symbol, k] = min_plus(half, half)
        else:
            m = np.full((4, 4), NEVER)
            for state in range(4):
                for _, cost, to in edits(symbol, state):
                    m[state, to] = min(m[state, to], cost)
            _POWERS[symbol, k] = min_plus(INSERTS, m)
    return _POWERS[symbol, k]


def runs(symbols: bytes) -> list[tuple[str, int]]:
    return [(SYMBOLS[s], sum(1 for _ in g)) for s, g in groupby(symbols)]


def product(symbols: bytes) -> np.ndarray:
    """Least cost from state to state over all symbols."""
    out = np.full((4, 4), NEVER)
    np.fill_diagonal(out, 0)
    for symbol, n in runs(symbols):
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = min_plus(out, power(symbol, k))
    return out


def before_run(symbol: str, n: int, after: np.ndarray) -> np.ndarray:
    """Costs from each state before ``n`` rows of a symbol, given those after them."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            after = (power(symbol, k) + after).min(1)
    return after


def unroll(symbols: bytes, state: int, after: np.ndarray, last: bool) -> tuple[str, int]:
    """Least audit string of the cheapest edits from ``state`` on, and the state after it.

    ``after``: costs from each state behind the symbols; ``last``: the conversation ends there.
    """
    parts = runs(symbols)
    behind = [np.asarray(after, np.int64)]
    for symbol, n in reversed(parts[1:]):
        behind.append(before_run(symbol, n, behind[-1]))
    letters = []
    for symbol, n in parts:
        end, step = behind.pop(), power(symbol, 0)
        while n:
            size = (n - 1) % UNROLL + 1
            n -= size
            costs = [before_run(symbol, n, end)]  # before each row of this part of the run, the last one's first
            for _ in range(size):
                costs.append((step + costs[-1]).min(1))
            here = costs.pop()
            while costs:
                rest, then = here[state], costs[-1]
                ways = [(letter, to, cost + then[to]) for letter, cost, to in edits(symbol, state)]
                ways.append(("I", None, INSERT + here[NEXT[state]]))
                letter, to, _ = min(w for w in ways if w[2] == rest)
                letters.append(letter)
                if letter == "I":
                    state = NEXT[state]
                else:
                    state, here = to, costs.pop()
    while last and END[state]:
        letters.append("I")
        state = NEXT[state]
    return "".join(letters), state


def replay(audit: Iterator[str], state: int, role: str, text: str) -> tuple[list[tuple[str, str]], int]:
    """What the audit's next letters, up to one that uses up a row, leave of that row: (role, text) rows and the state."""
    out = []
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append((NAMES[state], ""))
            continue
        if letter == "R":
            state = NEXT[state]
            out.append((NAMES[state], text))
        elif letter == "K":
            state = KEEP[role[0]][state]
            out.append((role, text))
        return out, state
    raise ValueError("an audit ends before its rows")


def _arrays(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _fields(**kinds) -> pa.Schema:
    return pa.schema(list(kinds.items()))


_L, _S = pa.int64(), pa.string()
_PIECE = _fields(conv=_S, part=_L, first=_L, symbols=pa.binary(), counts=pa.list_(_L), ends=pa.list_(_S), product=pa.list_(_L))
_COSTS = _fields(conv=_S, part=_L, nth=_L, after=pa.list_(_L), last=pa.bool_(), cost=_L, blank=_L, duplicate=_L, truncated=_L, illegal=_L)
_AUDITS = _fields(conv=_S, part=_L, first=_L, nth=_L, audits=pa.list_(_S), to=pa.list_(_L))
_STARTS = _fields(conv=_S, part=_L, state=_L)
_TEXTS = _fields(conv=_S, audit=_S, repaired_sha256=_S)
_ROWS = _fields(conv=_S, pos=_L, role=_S, text=_S)


def _ddl(schema: pa.Schema) -> str:
    name = {_L: "bigint", _S: "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(_L): "array<bigint>", pa.list_(_S): "array<string>"}
    return ", ".join(f"{f.name} {name[f.type]}" for f in schema)


def _by_group(frame: DataFrame, keys: int, work, schema: pa.Schema) -> DataFrame:
    """Rows that ``work`` yields for each stretch of rows alike in the first ``keys`` columns.

    ``frame`` is dealt out and sorted; ``work`` gets the key and an iterator of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), []
        for key, group in groupby(rows, lambda row: row[:keys]):
            for row in work(key, group):
                out.append(row)
                if len(out) >= _BATCH:
                    yield _arrays(out, schema)
                    out.clear()
        if out:
            yield _arrays(out, schema)

    return frame.mapInArrow(run, _ddl(schema))


def order_rows(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows in the order of their conversations: conv, turn, role, text, pos (partition of the sort, then place in it)."""
    null = F.lit(" ")
    tidy = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), null).alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), null).alias("role"),
        F.coalesce(F.col("text").cast("string"), null).alias("text"),
    )
    # rows alike in all columns are told apart, so that any number of them can be dealt out
    tidy = scratch.stage(tidy.withColumn("row", F.monotonically_increasing_id()))
    ordered = tidy.orderBy("conv", F.col("turn").asc_nulls_first(), "role", "text", "row").drop("row")
    ordered = scratch.stage(ordered.withColumn("pos", F.monotonically_increasing_id()))
    scratch.drop(tidy)
    return ordered


def faults(ordered: DataFrame) -> DataFrame:
    """conv, part (of the sort), pos, initial and fault ('blank', 'duplicate', 'truncated' or '') of every row."""
    key = [F.xxhash64("conv", "role", "text").alias("k1"), F.xxhash64("text", "role", "conv", F.lit(11)).alias("k2")]
    # the first row of each role and text in a conversation is known by its place, which no other row shares
    firsts = ordered.select("pos", *key).groupBy("k1", "k2").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    ending = F.substring(F.rtrim("text", F.lit(" \t\n\v\f\r")), -1, 1)
    facts = ordered.select("conv", F.shiftright("pos", 33).alias("part"), "pos", F.substring("role", 1, 1).alias("initial"), ending.alias("ending"))
    fault = F.when(F.col("ending") == "", "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.col("ending").isin(".", "!", "?"), "truncated").otherwise("")
    return facts.join(firsts, "pos", "left").select("conv", "part", "pos", "initial", fault.alias("fault"))


def _pieces(faulty: DataFrame) -> DataFrame:
    """A row for each conversation and partition of the sort: symbols, counts (blank, duplicate, truncated, illegal), first and last initial, product."""
    code = {s: i for i, s in enumerate(SYMBOLS)}

    def work(key, rows):
        first, symbols, count, seen = None, bytearray(), dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), []
        for _, _, pos, initial, fault in rows:
            if first is None:
                first, seen = pos, [initial, initial]
            elif seen[1] + initial not in LEGAL:
                count["illegal"] += 1
            seen[1] = initial
            if fault:
                count[fault] += 1
            kind = initial if initial in ("s", "u", "a") else "o"
            symbols.append(code["-" if fault in ("blank", "duplicate") else kind + "." * bool(fault)])
        yield (*key, first, bytes(symbols), list(count.values()), seen, product(bytes(symbols)).ravel().tolist())

    return _by_group(faulty.repartition("part").sortWithinPartitions("part", "pos").select("conv", "part", "pos", "initial", "fault"), 2, work, _PIECE)


def _costs(pieces: DataFrame) -> DataFrame:
    """For each piece the costs behind it and whether it is the last, with the conversation's cost and counts."""

    def work(key, rows):
        group = [(part, np.array(m, np.int64).reshape(4, 4), counts, ends) for _, part, m, counts, ends in rows]
        after = [END]
        for _, m, _, _ in reversed(group):
            after.append((m + after[-1]).min(1))
        cost = int(after.pop()[START])
        total = np.sum([counts for _, _, counts, _ in group], 0).tolist()
        total[3] += sum(a[3][1] + b[3][0] not in LEGAL for a, b in zip(group, group[1:]))
        for nth, (part, *_) in enumerate(group):
            yield (*key, part, nth, after[-1 - nth].tolist(), nth == len(group) - 1, cost, *total)

    slim = pieces.select("conv", "part", "product", "counts", "ends").repartition("conv").sortWithinPartitions("conv", "part")
    return _by_group(slim, 1, work, _COSTS)


def _audits(pieces: DataFrame, costs: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, part, first, state and audit of each piece."""

    def choose(key, rows):
        for _, part, first, nth, symbols, after, last in rows:
            done = [unroll(symbols, state, np.array(after, np.int64), last) for state in (range(4) if nth else (START,))]
            yield (*key, part, first, nth, [a for a, _ in done], [s for _, s in done])

    def chain(key, rows):
        state = START
        for _, part, to in rows:
            yield (*key, part, state)
            state = to[state if len(to) > 1 else 0]

    joined = pieces.select("conv", "part", "first", "symbols").join(costs.select("conv", "part", "nth", "after", "last"), ["conv", "part"])
    done = scratch.stage(_by_group(joined.select("conv", "part", "first", "nth", "symbols", "after", "last"), 1, choose, _AUDITS))
    # conversations of several pieces: no more than the partitions of the sort, two pieces each at its ends
    several = done.where("nth > 0").select("conv").distinct()
    ends = done.select("conv", "part", "to").join(several, "conv", "left_semi")
    starts = _by_group(ends.repartition("conv").sortWithinPartitions("conv", "part"), 1, chain, _STARTS)
    state = F.coalesce("state", F.lit(START))
    audit = F.element_at("audits", F.when(F.size("audits") == 1, 1).otherwise(state.cast("int") + 1))
    return done.join(starts, ["conv", "part"], "left").select("conv", "part", "first", state.alias("state"), audit.alias("audit"))


def _stream(ordered: DataFrame, audits: DataFrame, within: list) -> DataFrame:
    """Rows after their piece's audit, in order: conv, pos, is_row, state, role, text (an audit's: the audit)."""
    part = F.shiftright("pos", 33)
    rows = ordered.select("conv", part.alias("part"), "pos", F.lit(1).alias("is_row"), F.lit(None).cast("bigint").alias("state"), "role", "text")
    heads = audits.select("conv", "part", F.col("first").alias("pos"), F.lit(0).alias("is_row"), "state", F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    return rows.unionByName(heads).repartition(*within).sortWithinPartitions("conv", "pos", "is_row").drop("part")


def _repaired(rows) -> Iterator[tuple[int, str, str]]:
    """pos, role, text of the rows that the edits leave, from a stream of one conversation or piece."""
    audit, state, pos = iter(""), START, 0

    for _, pos_, is_row, start, role, text in rows:
        if not is_row:
            audit, state = iter(text), start
            continue
        pos = pos_
        left, state = replay(audit, state, role, text)
        for r, t in left:
            yield pos, r, t
    for _ in audit:  # inserts behind the last row
        state = NEXT[state]
        yield pos, NAMES[state], ""


class Repair:
    """Least-cost repair of ``rows`` (conv_id, turn, role, text)."""

    def __init__(self, rows: DataFrame):
        scratch = Scratch(rows.sparkSession, "conversation-repair")
        self.ordered = order_rows(rows, scratch)
        pieces = scratch.stage(_pieces(faults(self.ordered)))
        self.costs = scratch.stage(_costs(pieces))
        self.audits = scratch.stage(_audits(pieces, self.costs, scratch))

    def rows(self) -> DataFrame:
        """The repaired rows: conv (conv_id as text, null: a space), pos (order; an inserted row has that of a row beside it), role, text."""

        def work(key, rows):
            for pos, role, text in _repaired(rows):
                yield (*key, pos, role, text)

        # a task has whole pieces, and never more than one piece of a conversation is needed at once
        stream = _stream(self.ordered, self.audits, ["conv", "part"])
        return _by_group(stream, 1, work, _ROWS)

    def texts(self) -> DataFrame:
        """conv, audit and repaired_sha256 (of ``role:text``, newline-joined) of each conversation."""

        def work(key, rows):
            digest, letters, between = hashlib.sha256(), [], b""

            def noted():
                for row in rows:
                    if not row[2]:
                        letters.append(row[5])
                    yield row

            for _, role, text in _repaired(noted()):
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            yield (*key, "".join(letters), digest.hexdigest())

        return _by_group(_stream(self.ordered, self.audits, ["conv"]), 1, work, _TEXTS)

    def summary(self) -> DataFrame:
        """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        turns = self.ordered.where("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one"))
        gaps = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
        facts = self.costs.where("last").select("conv", "blank", "duplicate", "truncated", "illegal", "cost")
        return facts.join(gaps, "conv", "left").join(self.texts(), "conv").select(
            "conv", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
        )


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults that follow from crc32(``conv_id:turn``) modulo 20: 0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it a user's.  Nulls are one space."""
    null = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), null), F.lit(":"), F.coalesce(F.col("turn").cast("string"), null))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", null), F.coalesce("role", null)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every conv_id of ``conversations`` with the summary of its repair after ``damage``."""
    summary = Repair(damage(conversations)).summary()
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    out = ids.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))).join(summary, "conv", "left").drop("conv")
    zero = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.fillna(zero).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
