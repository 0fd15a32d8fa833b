"""Repair of damaged conversations: the cheapest edits that give an optional system row and then user and assistant in turn.

Rows of a conversation are read in their order as one stream.  Depth-first branch and
bound with an explicit stack finds the edits: a node is a number of rows done and what the
last kept row was; suffix sums of each row's least cost bound what a prefix can still become, the
best whole repair (cost, audit) found so far prunes, and a table of the best prefix of
each node drops every prefix that is not better.  The search ends when the stack is empty,
so its result is proved to be the cheapest and, among equals, the least in ASCII order.

A conversation longer than ``BLOCK`` rows (or ``BLOCK_BYTES`` of text) is searched block by block: a block ends with
the best prefix for each of the four states, each with its own running hash, so neither
texts nor rows of a long conversation are held.  Two prefixes of equal cost over the
same rows are never the beginning of one another (only an insertion takes no row, and it costs),
so a lesser prefix stays lesser whatever follows.  A SHA-256 over a whole conversation can only be made in order; one
conversation is therefore one stream in one task, in memory bounded by a block and its audit.

Defined results on odd input: null roles and texts are one space; a null ``conv_id`` is a conversation of its own; null
turns come first; rows of one turn are ordered by role and text, copies last; an empty role has no initial and is never kept as it is;
an empty table gives an empty result; further columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, reachable

RETAG, DELETE, INSERT, CUT = 3, 4, 3, 3  # costs: another role, a row gone, a row put in, a truncated row that stays
BLOCK = 64  # rows of one search
BLOCK_BYTES = 8 << 20
START, SYSTEM, USER, ASSISTANT = range(4)  # what the last row of the repaired conversation is
FOLLOWS = {START: {b"s": SYSTEM, b"u": USER}, SYSTEM: {b"u": USER}, USER: {b"a": ASSISTANT}, ASSISTANT: {b"u": USER}}
WANTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: b"user", ASSISTANT: b"assistant"}
PAIRS = (b"su", b"ua", b"au")


class Row(NamedTuple):
    role: bytes
    text: bytes
    fault: str  # "", "blank", "duplicate" or "truncated"

    @property
    def must_go(self) -> bool:
        return self.fault in ("blank", "duplicate")

    @property
    def least(self) -> int:
        """The least that this row costs in any repair."""
        return DELETE if self.must_go else CUT if self.fault else 0


def moves(row: Row, state: int) -> list[tuple[int, str, int]]:
    """(cost, edit, next state) of the edits that use up a row."""
    out = [(DELETE, "D", state)]
    if not row.must_go:
        stays = CUT if row.fault else 0
        kept = FOLLOWS[state].get(row.role[:1])
        if kept is not None:
            out.append((stays, "K", kept))
        if kept != WANTED[state]:
            out.append((stays + RETAG, "R", WANTED[state]))
    return out


def search(rows: list[Row], starts: dict[int, tuple[int, int]], last: bool) -> dict[int, tuple[int, int, str]]:
    """Best (cost, rank, audit) over ``rows`` for each state they can end in, or for the best whole repair if ``last``.

    ``starts`` gives the cost and the rank (order of their audits) of the prefixes that lead here.
    """
    n = len(rows)
    bound = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        bound[i] = bound[i + 1] + rows[i].least
    best: dict[tuple[int, int], tuple[int, int, str]] = {}
    incumbent: tuple[int, int, str] | None = None
    end = START
    stack = [(0, state, (cost, rank, "")) for state, (cost, rank) in starts.items()]
    stack.sort(key=lambda x: x[2], reverse=True)
    while stack:
        i, state, label = stack.pop()
        if (i, state) in best and best[i, state] <= label:
            continue
        cost, rank, audit = label
        if incumbent is not None:
            least = cost + bound[i]
            if least > incumbent[0] or (least == incumbent[0] and (rank, audit) > (incumbent[1], incumbent[2][:len(audit)])):
                continue
        best[i, state] = label
        if i == n and last and state in (START, ASSISTANT):
            if incumbent is None or label < incumbent:
                incumbent, end = label, state
            continue
        children = []
        if i < n:
            children = [(i + 1, to, (cost + c, rank, audit + e)) for c, e, to in moves(rows[i], state)]
        if i < n or last:
            children.append((i, WANTED[state], (cost + INSERT, rank, audit + "I")))
        # The most promising child is taken first: the sooner a cheap repair is known, the more is pruned.
        children.sort(key=lambda x: (x[2][0] + bound[x[0]], x[2][2]), reverse=True)
        stack += children
    if last:
        return {end: incumbent}
    return {state: label for (i, state), label in best.items() if i == n}


class Prefix(NamedTuple):
    """A repaired beginning: what it cost, its place among the prefixes by audit, its audit in pieces and its hash."""

    cost: int
    rank: int
    pieces: tuple | None
    hasher: object
    lines: bool

    def follow(self, state: int, rows: list[Row], label: tuple[int, int, str]) -> Prefix:
        hasher, lines, at = self.hasher.copy(), self.lines, 0
        for edit in label[2]:
            if edit == "D":
                at += 1
                continue
            row = rows[at] if edit in "KR" else None
            at += row is not None
            state = FOLLOWS[state][row.role[:1]] if edit == "K" else WANTED[state]
            hasher.update((b"\n" if lines else b"") + (row.role if edit == "K" else NAMES[state]) + b":")
            hasher.update(row.text if row else b"")
            lines = True
        return Prefix(label[0], 0, (self.pieces, label[2]), hasher, lines)


class Repair:
    """One conversation, fed row by row."""

    def __init__(self, block: int = BLOCK, block_bytes: int = BLOCK_BYTES):
        self.block, self.block_bytes = block, block_bytes
        self.prefixes = {START: Prefix(0, 0, None, hashlib.sha256(), False)}
        self.rows: list[Row] = []
        self.size = 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = 0
        self.before: bytes | None = None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, role: bytes, text: bytes, duplicate: bool) -> None:
        words = text.rstrip(b" \t\n\v\f\r")
        fault = "blank" if not words else "duplicate" if duplicate else "" if words[-1:] in b".!?" else "truncated"
        if fault:
            self.counts[fault] += 1
        initial = role.decode("utf-8", "replace")[:1].encode()
        self.illegal += self.before is not None and self.before + initial not in PAIRS
        self.before = initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.rows.append(Row(role, text, fault))
        self.size += len(text)
        if len(self.rows) > self.block or self.size > self.block_bytes:
            self._advance(False)

    def _advance(self, last: bool) -> None:
        starts = {state: (p.cost, p.rank) for state, p in self.prefixes.items()}
        by_rank = {p.rank: state for state, p in self.prefixes.items()}
        found = search(self.rows, starts, last)
        order = sorted((label[1:], state) for state, label in found.items())
        self.prefixes = {state: self.prefixes[by_rank[found[state][1]]].follow(by_rank[found[state][1]], self.rows, found[state])._replace(rank=k)
                         for k, (_, state) in enumerate(order)}
        self.rows, self.size = [], 0

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"""
        self._advance(True)
        (done,) = self.prefixes.values()
        pieces, node = [], done.pieces
        while node is not None:
            node, piece = node
            pieces.append(piece)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.counts.values(), self.illegal, done.cost, "".join(reversed(pieces)), done.hasher.hexdigest())


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, gone): rows dropped, emptied, cut, repeated or given the user's role by a hash of their place.

    A dropped row stays as a mark, so that a conversation without rows is still known.
    """
    at = F.pmod(F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), at.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    gone = F.col("h") == 0
    return rows.select("conv_id", "turn", F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), gone.alias("gone"),
                       F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def repair(rows: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text, copy, gone): its faults, the edits and a hash of the repaired rows."""
    result = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {result}"
    schema = arrow_schema(ddl)
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    # One exchange serves the window, the order and the stream.
    placed = rows.withColumn("said", said).repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "said").orderBy(F.asc_nulls_first("turn"), "copy")
    ordered = placed.withColumn("nth", F.row_number().over(earlier)).sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "gone", "role", "text", "nth").select(
        "conv_id", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), (F.col("nth") > 1).alias("again"), "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def pass_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
            done.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for conv_id, turn, role, text, again, gone in zip(*[part.column(i).to_pylist() for i in range(6)]):
                    if state is None or conv_id != now:
                        if state is not None:
                            done.append((now, *state.result()))
                        now, state = conv_id, Repair(block, block_bytes)
                    if not gone:
                        state.add(turn, role, text, again)
                if done:
                    yield pass_on()
        if state is not None:
            done.append((now, *state.result()))
            yield pass_on()

    reachable(rows.sparkSession)
    return ordered.mapInArrow(run, ddl)


def digest(conversations: DataFrame) -> DataFrame:
    return repair(damage(conversations))
