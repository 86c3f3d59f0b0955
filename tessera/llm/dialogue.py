"""Repair of conversations' structure by the auction algorithm for shortest paths.

A conversation's edits are a path through a lattice: a node is (row, state of the role grammar), an arc keeps, reroles or deletes a row or
inserts one, at an integer cost. Nodes have prices that never exceed the cost of an arc and the price at its end. The auction holds a path
from the start: where its last node's price is below the best of its arcs, the price rises to it and the path contracts by that node, else
it extends along the best arc, until it reaches the goal. Then every arc of every cheapest path is tight (the prices differ by its cost);
the tight arcs from which tight arcs lead to the goal are walked by their letters, least first.

Long conversations are cut into segments of SEGMENT rows. The prices of a segment's last nodes are those of the next one's first nodes, so
segments are priced from the last to the first in one stream, and traced and hashed from the first to the last in another, with the rows of
one segment in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a conversation that are priced at once; as many are held in memory.
SEGMENT = 64
#: Solved segments that a worker keeps; most conversations are short and alike.
KEPT_SEGMENTS = 50_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: White space of the contract.
BLANKS = " \t\n\x0b\x0c\r"

#: The role grammar (s?(ua)+)?: states are start, after s, after u, after a; the role that each lets a reroled or inserted row have, and where
#: that leads; where a kept row leads; the price of ending in each (None: not allowed).
TURNED = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
GOAL = (0, None, None, 0)

RESULT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# ---- the lattice


def _arcs(codes: str, ends: tuple) -> list[list[tuple[str, int, int]]]:
    """Arcs (letter, cost, next node) of each node 4 * row + state; the goal is the last node. A code is a row's initial, in upper case if it is truncated; d must go."""
    n = len(codes)
    goal = 4 * n + 4
    arcs: list[list[tuple[str, int, int]]] = []
    for i in range(n + 1):
        for s in range(4):
            own, turned = [], TURNED[s][1]
            if i < n:
                code = codes[i]
                own += [("D", DELETE, 4 * i + 4 + s), ("I", INSERT, 4 * i + turned)]
                if code != "d":
                    extra = TRUNCATED if code.isupper() else 0
                    kept = KEPT.get(code.lower(), {}).get(s)
                    if kept is not None:
                        own.append(("K", KEEP + extra, 4 * i + 4 + kept))
                    own.append(("R", REROLE + extra, 4 * i + 4 + turned))
            else:
                if ends[s] is not None:
                    own.append(("", ends[s], goal))
                if ends == GOAL:
                    own.append(("I", INSERT, 4 * i + turned))
            arcs.append(own)
    return [*arcs, []]


def auction(arcs: list[list[tuple[str, int, int]]], sources: tuple[int, ...]) -> list[int]:
    """Prices at which each source's price is its distance to the last node. Costs are whole and not negative, and no cycle is free."""
    prices, goal = [0] * len(arcs), len(arcs) - 1
    for source in sources:
        path = [source]
        while path[-1] != goal:
            node = path[-1]
            best, after = min([(cost + prices[to], to) for _, cost, to in arcs[node]])
            if prices[node] < best:
                prices[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(after)
    return prices


@lru_cache(maxsize=KEPT_SEGMENTS)
def solve(codes: str, ends: tuple) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """(prices of the segment's first nodes, (letters, last state) of the least cheapest path from each)."""
    low = min(e for e in ends if e is not None)  # only differences matter; low prices are soon bid
    arcs = _arcs(codes, ends if ends == GOAL else tuple(e - low for e in ends))
    prices, goal = auction(arcs, (0, 1, 2, 3)), len(arcs) - 1
    tight = [sorted((letter, to) for letter, cost, to in own if prices[node] == cost + prices[to]) for node, own in enumerate(arcs)]
    leads = [False] * goal + [True]
    for row in range(len(codes), -1, -1):
        for _ in range(3):  # inserts lead from state to state within a row
            for node in range(4 * row, 4 * row + 4):
                leads[node] = any(leads[to] for _, to in tight[node])
    traces = []
    for state in range(4):
        node, letters = state, []
        while node != goal:
            last = node
            letter, node = next((letter, to) for letter, to in tight[node] if leads[to])
            letters.append(letter)
        traces.append(("".join(letters), last % 4))
    return tuple(prices[s] + (0 if ends == GOAL else low) for s in range(4)), tuple(traces)


# ---- rows


def _present(c: str, kind: str = "string") -> Column:
    return F.coalesce(F.col(c).cast(kind), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with a null role or text as one space, damaged by crc32 of conv_id:turn (a null is a space there too), modulo 20."""
    rows = rows.select("conv_id", "turn", _present("role").alias("role"), _present("text").alias("text"), (F.crc32(F.concat_ws(":", _present("conv_id"), _present("turn"))) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows with key, pos (from 1, by turn with nulls first, ties by role and text), fault (blank, duplicate, truncated or null) and code."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.select(F.col("conv_id").cast("string").alias("key"), "turn", "role", "text", F.right(end, F.lit(1)).alias("last")).repartition("key")
    by_turn = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy("key", "role", "text").orderBy("turn")))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy(*by_turn, "seen")).cast("long"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("seen") > 1, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(fault.isin("blank", "duplicate"), "d").when(fault == "truncated", F.upper(code)).otherwise(code)
    return rows.select("key", "pos", "turn", "role", "text", fault.alias("fault"), code.alias("code"))


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _batches(found: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in found:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _priced(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, pos of the first row, prices at the end) of each segment, from rows (key, pos, code) of each conversation from its last to its first."""
    key, ends, first, codes, begun = None, GOAL, 0, [], False

    def closed() -> tuple:
        return key, first, [-1 if e is None else e for e in ends]

    for k, pos, code in rows:
        if not begun or k != key:
            if codes:
                yield closed()
            key, ends, codes, begun = k, GOAL, [], True
        elif len(codes) == SEGMENT:
            yield closed()
            ends, codes = solve("".join(reversed(codes)), ends)[0], []
        codes.append(code)
        first = pos
    if codes:
        yield closed()


class _Conversation:
    """What is known of a conversation whose segments come in order."""

    def __init__(self, key: str | None):
        self.key, self.state, self.cost, self.letters, self.hash, self.lines = key, 0, 0, [], hashlib.sha256(), 0
        self.faults, self.illegal, self.role, self.low, self.high, self.turns = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None, None, None, 0

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def segment(self, rows: list[tuple], ends: list[int] | None) -> None:
        """rows (turn, role, text, fault, code) of a segment and the prices at its end."""
        if not rows:
            return
        for turn, role, _, fault, _ in rows:
            if fault:
                self.faults[fault] += 1
            if self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.role = role
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        letters, after = solve("".join(r[4] for r in rows), tuple(None if e < 0 else e for e in ends))[1][self.state]
        state, left = self.state, iter(rows)
        for letter in letters:
            if letter == "I":
                self.line(TURNED[state][0], "")
                state, self.cost = TURNED[state][1], self.cost + INSERT
                continue
            _, role, text, _, code = next(left)
            if letter == "D":
                self.cost += DELETE
                continue
            self.cost += TRUNCATED if code.isupper() else 0
            if letter == "R":
                role, state, self.cost = *TURNED[state], self.cost + REROLE
            else:
                state = KEPT[code.lower()][state]
            self.line(role, text)
        assert state == after
        self.state = after
        self.letters.append(letters)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.key, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.letters), self.hash.hexdigest()


def _repaired(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A row of RESULT for each key, from rows (key, kind, ends, turn, role, text, fault, code) by key, pos and kind: 0 names the key, 1 begins a segment, 2 is a row."""
    now, ends, held = None, None, []
    for key, kind, prices, *row in rows:
        if now is None or key != now.key:
            if now is not None:
                now.segment(held, ends)
                yield now.result()
            now, ends, held = _Conversation(key), None, []
        if kind == 1:
            now.segment(held, ends)
            ends, held = prices, []
        elif kind == 2:
            held.append(tuple(row))
    if now is not None:
        now.segment(held, ends)
        yield now.result()


def _prices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "pos", "ends"]
    return _batches(_priced(_rows(batches, ["key", "pos", "code"])), names, [pa.string(), pa.int64(), pa.list_(pa.int64())])


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RESULT.split(", ")]
    types = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    return _batches(_repaired(_rows(batches, ["key", "kind", "ends", "turn", "role", "text", "fault", "code"])), names, types)


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The columns of RESULT, with conv_id for key: the faults, the cheapest edits and the repaired text's digest of each conversation.

    conversations may name more ids, which have a row too: zeros, an empty audit and the digest of nothing. A null conv_id is a
    conversation of its own; null turns come first; equal turns are ordered by role and text; null roles and texts count as one space; repeated rows are
    duplicates; other columns are ignored; an empty table gives one. A conversation is two streams over its sorted rows (its digest has to
    be made in order); a stream holds the rows of a segment, and the letters of the audit, which is a value of the result. Spark sorts and spills.
    """
    kind = rows.schema["conv_id"].dataType
    rows = with_faults(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _present("role").alias("role"), _present("text").alias("text")))
    prices = rows.select("key", "pos", "code").repartition("key").sortWithinPartitions("key", F.desc("pos")).mapInArrow(_prices, "key string, pos long, ends array<long>")
    named = (rows if conversations is None else conversations.select(F.col("conv_id").cast("string").alias("key"))).select("key").distinct()
    stream = rows.withColumn("kind", F.lit(2)).unionByName(prices.withColumn("kind", F.lit(1)), True).unionByName(named.withColumns({"pos": F.lit(0).cast("long"), "kind": F.lit(0)}), True)
    stream = stream.repartition("key").sortWithinPartitions("key", "pos", "kind").select("key", "kind", "ends", "turn", "role", "text", "fault", "code")
    return stream.mapInArrow(_repairs, RESULT).withColumnRenamed("key", "conv_id").withColumn("conv_id", F.col("conv_id").cast(kind))
