"""Repair of conversation structure at least cost, by block tables over normalised cost vectors.

A repaired conversation's role initials read ``(s?(ua)+)?``. An automaton of four states says how far such a string
has come: nothing yet, behind s, behind u, behind a. The cost of reaching each state after each row is a vector of
four numbers; less its least number it is one of few. So for every block of BLOCK rows' symbols and every vector
the vector behind the block and the cost added are worked out once, and a conversation goes block by block through
that table (the method of the Four Russians). For the edits the blocks are expanded again, the last one first:
which states lie on a cheapest way, at every row. From the front, the least edit between such states is taken, so
of all cheapest ways the one whose edits are least in ASCII comes out.

Rows of one conversation may be most of all rows. They are sorted by ranges, cut into segments of bounded size, and
only symbols (a byte a row, like the edits in the result) of a conversation of many segments come together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewise.llm.common import attempt
from tapewise.sources import staging

#: Rows in a block of the table.
BLOCK = 4
#: Most rows and characters of a segment (a longer text is one alone), and characters that a task has in hand before it hands rows on.
SEGMENT_ROWS, SEGMENT_CHARACTERS = 1024, 1 << 16
HELD_CHARACTERS = 1 << 20

#: What a repair may do and costs; edits in ASCII order of their letters.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (EMPTY, ASSISTANT)
INITIALS = {"s": 0, "u": 1, "a": 2}
#: Symbols: 0 is a row to delete; 1 + r a sound row of role r (s, u, a, another, none), 6 + r a truncated one.
OTHER, NONE, SYMBOLS = 3, 4, 11
FAR = 1 << 20
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def after_new(state: int) -> int:
    """The state behind a user or assistant turn that is made to fit."""
    return ASSISTANT if state == USER else USER


def after_kept(state: int, role: int) -> int | None:
    """The state behind a kept row, if it fits."""
    if role == NONE:
        return state
    if role == 0:
        return SYSTEM if state == EMPTY else None
    return after_new(state) if role < OTHER and after_new(state) == role + 1 else None


def consuming(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """Edits of one row: letter, cost, state behind it."""
    out = [("D", DELETE, state)]
    if symbol:
        role, more = (symbol - 1) % 5, TRUNCATED if symbol > 5 else 0
        if (kept := after_kept(state, role)) is not None:
            out.append(("K", more, kept))
        out.append(("R", REROLE + more, after_new(state)))
    return out


def _closed(costs: list[int]) -> tuple[int, tuple[int, ...]]:
    """Costs with inserted turns, less the least, without states that cost strictly more than going on behind an assistant turn."""
    costs = list(costs)
    for _ in range(2):
        for s in range(4):
            costs[after_new(s)] = min(costs[after_new(s)], costs[s] + INSERT)
    # Behind an assistant turn everything can follow that can follow the start (deleting the system row) or the system row.
    costs[EMPTY] = costs[EMPTY] if costs[EMPTY] <= costs[ASSISTANT] + DELETE else FAR
    costs[SYSTEM] = costs[SYSTEM] if costs[SYSTEM] <= costs[ASSISTANT] else FAR
    least = min(costs)
    return least, tuple(c - least if c < FAR else FAR for c in costs)


class BlockTables:
    """All vectors that occur, the step of each symbol, and the step of each block of symbols."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        _, start = _closed([0, FAR, FAR, FAR])
        self.vectors, number, steps = [start], {start: 0}, []
        for vector in self.vectors:  # grows while new ones are found
            row = []
            for symbol in range(SYMBOLS):
                costs = [FAR] * 4
                for s in range(4):
                    if vector[s] < FAR:
                        for _, cost, t in consuming(s, symbol):
                            costs[t] = min(costs[t], vector[s] + cost)
                more, behind = _closed(costs)
                if behind not in number:
                    number[behind] = len(self.vectors)
                    self.vectors.append(behind)
                row.append((number[behind], more))
            steps.append(row)
        one = np.array(steps)
        self.next1, self.cost1 = one[:, :, 0].tolist(), one[:, :, 1].tolist()
        to, cost = one[:, :, 0], one[:, :, 1]
        for _ in range(block - 1):
            cost = (cost[:, :, None] + one[to, :, 1]).reshape(len(steps), -1)
            to = one[to, :, 0].reshape(len(steps), -1)
        self.next, self.cost = to.astype(np.int32), cost.astype(np.int32)
        self.weights = SYMBOLS ** np.arange(block - 1, -1, -1)
        self.back: dict[tuple[int, int, int], int] = {}
        self.picks: dict[tuple[int, int, int, int, int], tuple[str, int]] = {}

    def _before(self, vector: int, alive: int) -> int:
        """The states on a cheapest way, with those from which an inserted turn leads to one."""
        costs = self.vectors[vector]
        for _ in range(2):
            for s in range(4):
                t = after_new(s)
                if costs[s] < FAR and alive >> t & 1 and costs[s] + INSERT == costs[t]:
                    alive |= 1 << s
        return alive

    def _expand(self, vector: int, symbol: int, alive: int) -> int:
        """The states on a cheapest way before a row, from those behind it."""
        key = vector, symbol, alive
        if key not in self.back:
            here, behind, more = self.vectors[vector], self.vectors[self.next1[vector][symbol]], self.cost1[vector][symbol]
            found = 0
            for s in range(4):
                if here[s] < FAR and any(alive >> t & 1 and here[s] + cost == behind[t] + more for _, cost, t in consuming(s, symbol)):
                    found |= 1 << s
            self.back[key] = self._before(vector, found)
        return self.back[key]

    def _pick(self, vector: int, symbol: int, state: int, alive: int, behind: int) -> tuple[str, int]:
        """The least edits up to and with that of the next row, and the state behind it."""
        key = vector, symbol, state, alive, behind
        if key not in self.picks:
            here, after, more = self.vectors[vector], self.vectors[self.next1[vector][symbol]], self.cost1[vector][symbol]
            edits = [(letter, False, t) for letter, cost, t in consuming(state, symbol) if behind >> t & 1 and here[state] + cost == after[t] + more]
            t = after_new(state)
            if alive >> t & 1 and here[state] + INSERT == here[t]:
                edits.append(("I", True, t))
            letter, again, t = min(edits)
            if again:
                rest, t = self._pick(vector, symbol, t, alive, behind)
                letter += rest
            self.picks[key] = letter, t
        return self.picks[key]

    def solve(self, symbols: bytes) -> tuple[int, str]:
        """The least cost, and the edits of that cost that are least in ASCII."""
        whole = len(symbols) // self.block * self.block
        codes = np.frombuffer(symbols[:whole], np.uint8).reshape(-1, self.block) @ self.weights
        vectors, cost = [0], 0
        for code in codes.tolist():  # by lookup
            at = vectors[-1]
            cost += int(self.cost[at, code])
            vectors.append(int(self.next[at, code]))
        inner = [vectors[-1]]
        for symbol in symbols[whole:]:
            cost += self.cost1[inner[-1]][symbol]
            inner.append(self.next1[inner[-1]][symbol])
        last = inner[-1]
        least = min(self.vectors[last][s] for s in ACCEPTED)
        alive = self._before(last, sum(1 << s for s in ACCEPTED if self.vectors[last][s] == least))
        # Backwards: each block is expanded from the vector before it.
        masks, trail = bytearray(len(symbols) + 1), [0] * (len(symbols) + 1)
        masks[-1], trail[-1] = alive, last
        ends = [(whole, len(symbols))] * (whole < len(symbols)) + [(k, k + self.block) for k in range(whole - self.block, -1, -self.block)]
        for begin, end in ends:
            at = vectors[begin // self.block]
            for k in range(begin, end):
                trail[k] = at
                at = self.next1[at][symbols[k]]
            for k in range(end - 1, begin - 1, -1):
                masks[k] = self._expand(trail[k], symbols[k], masks[k + 1])
        state, out = EMPTY, []
        for k, symbol in enumerate(symbols):
            edits, state = self._pick(trail[k], symbol, state, masks[k], masks[k + 1])
            out.append(edits)
        while state not in ACCEPTED or self.vectors[last][state] != least:
            out.append("I")
            state = after_new(state)
        return cost + least, "".join(out)


@lru_cache(maxsize=4)
def block_tables(block: int = BLOCK) -> BlockTables:
    return BlockTables(block)


def symbol_of(role: str, text: str) -> int:
    """The symbol of a row that is no duplicate."""
    kept = text.rstrip(BLANKS)
    if not kept:
        return 0
    return 1 + (INITIALS.get(role[:1], OTHER) if role else NONE) + (0 if kept[-1] in ".!?" else 5)


class Repaired:
    """The digest of a repaired conversation, turn by turn."""

    def __init__(self, edits: str):
        self.edits, self.at, self.state, self.sha, self.any = edits, 0, EMPTY, hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True

    def _new(self, text: str) -> None:
        self._put("assistant" if self.state == USER else "user", text)
        self.state = after_new(self.state)

    def inserted(self) -> None:
        while self.edits[self.at:self.at + 1] == "I":
            self._new("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit == "R":
            self._new(text)
        elif edit == "K":
            self._put(role, text)
            self.state = after_kept(self.state, INITIALS.get(role[:1], OTHER) if role else NONE)

    def digest(self) -> str:
        self.inserted()
        return self.sha.hexdigest()


class Segment:
    """Consecutive rows of one conversation, after the damage."""

    COUNTS = {"rows": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "turns": "long", "low": "long", "high": "long",
              "first": "string", "last": "string"}

    def __init__(self, conv_id: int | None):
        self.conv_id, self.roles, self.texts, self.symbols, self.keys = conv_id, [], [], bytearray(), {}
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.size = 0
        self.low = self.high = self.first = self.last = None

    @property
    def rows(self) -> int:
        return len(self.roles)

    def add(self, turn: int | None, role: str, text: str) -> None:
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        symbol = symbol_of(role, text)
        if symbol and key in self.keys:
            self.duplicate += 1
            symbol = 0
        elif symbol:
            self.keys[key] = len(self.symbols)
            self.truncated += symbol > 5
        else:
            self.blank += 1
        self.symbols.append(symbol)
        if self.rows:
            self.illegal += self.last + role[:1] not in ("su", "ua", "au")
        else:
            self.first = role[:1]
        self.last = role[:1]
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(role) + len(text)


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else (high - low + 1 - turns + (1 << 63)) % (1 << 64) - (1 << 63)


RESULT = {"conv_id": "long", "gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long",
          "audit": "string", "repaired_sha256": "string"}
PARTS = {"segment": "long", "rows": "long", "turns": "long", "low": "long", "high": "long", "first": "string", "last": "string",
         "symbols": "binary", "keys": "array<binary>", "places": "array<int>", "roles": "array<string>", "texts": "array<string>"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32()),
          "array<string>": pa.list_(pa.string())}


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def _batch(rows: list[dict], columns: dict[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _ARROW[t]) for c, t in columns.items()], names=list(columns))


def _segments(batches: Iterator[pa.RecordBatch], block: int, most_rows: int, most_size: int) -> Iterator[pa.RecordBatch]:
    """Results of conversations that begin and end inside this task in one segment, and the segments of others; rows come in order."""
    tables, number = block_tables(block), attempt()[0] << 33
    columns, out, size = RESULT | PARTS, [], 0
    now, outer, later = None, True, False  # outer: the task's first conversation, later: not its first segment

    def close(ended: bool) -> dict:
        nonlocal number
        row = {c: getattr(now, c) for c in ("conv_id", "blank", "duplicate", "truncated", "illegal")}
        if ended and not outer and not later:
            cost, audit = tables.solve(bytes(now.symbols))
            made = Repaired(audit)
            for role, text in zip(now.roles, now.texts):
                made.row(role, text)
            return row | {"gaps": _gaps(now.low, now.high, now.turns), "cost": cost, "audit": audit, "repaired_sha256": made.digest()}
        number += 1
        return row | {"segment": number, "symbols": bytes(now.symbols), "keys": list(now.keys), "places": list(now.keys.values())} | {
            c: getattr(now, c) for c in ("rows", "turns", "low", "high", "first", "last", "roles", "texts")}

    for batch in batches:
        for conv_id, turn, role, text, live in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "live"))):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    out.append(close(True))
                    size += now.size
                    outer = False
                now, later = Segment(conv_id), False
            elif now.rows >= most_rows or now.size >= most_size:
                out.append(close(False))
                size += now.size
                now, later = Segment(conv_id), True
            if live:
                now.add(turn, role, text)
            if size >= HELD_CHARACTERS or len(out) >= 2000:
                yield _batch(out, columns)
                out, size = [], 0
    if now is not None:
        out.append(close(False))
    if out:
        yield _batch(out, columns)


def _without_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments' symbols and counts, with rows that an earlier segment has as duplicates."""
    columns = {"conv_id": "long", "segment": "long", "symbols": "binary"} | Segment.COUNTS
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            symbols = bytearray(row["symbols"])
            for place in row["repeats"] or ():
                row["truncated"] -= symbols[place] > 5
                row["duplicate"] += 1
                symbols[place] = 0
            row["symbols"] = bytes(symbols)
        yield _batch(rows, columns)


def _joined(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Costs and edits of conversations, from the symbols and counts of their segments."""
    tables = block_tables(block)
    for batch in batches:
        for k in range(batch.num_rows):
            conv_id, parts = batch.column(0)[k].as_py(), sorted(batch.column(1)[k].as_py(), key=lambda p: p["segment"])
            cost, audit = tables.solve(b"".join(p["symbols"] for p in parts))
            row = {"conv_id": conv_id, "cost": cost, "audit": audit} | {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
            low = high = last = None
            turns = 0
            for p in parts:
                if p["rows"]:
                    row["illegal"] += last is not None and last + p["first"] not in ("su", "ua", "au")
                    last = p["last"]
                if p["low"] is not None:
                    turns += p["turns"] - (p["low"] == high)
                    low, high = p["low"] if low is None else low, p["high"]
            yield _batch([row | {"gaps": _gaps(low, high, turns)}], RESULT)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results with the digests of the repaired conversations; a conversation's result comes first, then its segments in order."""
    row, made = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            here = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            if here["segment"] is None:
                if row is not None:
                    yield _batch([row | {"repaired_sha256": made.digest()}], RESULT)
                row, made = here, Repaired(here["audit"])
            else:
                for role, text in zip(here["roles"], here["texts"]):
                    made.row(role, text)
    if row is not None:
        yield _batch([row | {"repaired_sha256": made.digest()}], RESULT)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and live, by the CRC-32 of ``conv_id:turn`` modulo 20 (nulls count as one space).

    0 drops the row (it stays with live false, so that its conversation is known), 1 empties the text, 2 removes
    its ``.!?``, 3 repeats the row, 4 sets the role to user.
    """
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text, role = spaced("text"), spaced("role")
    live = F.col("code") != 0
    return (conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), code.alias("code"))
            .withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn",
                    F.when(~live, "").when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(~live | (F.col("code") == 1), "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    live.alias("live")))


def repair(rows: DataFrame, block: int = BLOCK, segment_rows: int = SEGMENT_ROWS, segment_characters: int = SEGMENT_CHARACTERS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, a row per conv_id of ``rows`` of ``damage``.

    A conversation's rows are in order of turn (null first), then role, then text. Rows whose first fault is blank
    (white space only) or duplicate (role and text of an earlier row) are deleted; a truncated one (no ``.!?`` at
    its end) costs more unless deleted. Kept and changed rows and inserted empty turns must read ``(s?(ua)+)?`` in
    their roles' initials; a row with an empty role may stay anywhere. Null conv_ids are one conversation; one
    without rows has zeros, no edits and the digest of the empty text. gaps wraps around at 64 bits.
    """
    keys = ["conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64)]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "role", "text")
    cut = partial(_segments, block=block, most_rows=segment_rows, most_size=segment_characters)
    found = staging.written(ordered.mapInArrow(cut, _schema(RESULT | PARTS)), "segments")
    whole = found.filter("segment IS NULL").select(*RESULT)
    parts = found.filter("segment IS NOT NULL")
    # A key of many segments repeats an earlier row in all but the first of them.
    keyed = parts.select("conv_id", "segment", F.explode(F.arrays_zip("keys", "places")).alias("k")).select("conv_id", "segment", "k.keys", "k.places")
    first = keyed.groupBy("conv_id", "keys").agg(F.min("segment").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.withColumnRenamed("conv_id", "of").withColumnRenamed("keys", "key")
    later = keyed.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("keys") == F.col("key")) & (F.col("segment") > F.col("first")))
    repeats = later.groupBy("segment").agg(F.collect_list("places").alias("repeats"))
    counts = list(Segment.COUNTS)
    sound = parts.select("conv_id", "segment", "symbols", *counts).join(repeats, "segment", "left").mapInArrow(
        _without_repeats, _schema({"conv_id": "long", "segment": "long", "symbols": "binary"} | Segment.COUNTS))
    together = sound.groupBy("conv_id").agg(F.collect_list(F.struct("segment", "symbols", *counts)).alias("parts"))
    edits = staging.written(together.mapInArrow(partial(_joined, block=block), _schema(RESULT)), "edits")
    texts = edits.drop("repaired_sha256").unionByName(parts.select("conv_id", "segment", "roles", "texts"), allowMissingColumns=True)
    texts = texts.repartition("conv_id").sortWithinPartitions("conv_id", F.col("segment").asc_nulls_first())
    return whole.unionByName(texts.mapInArrow(_digests, _schema(RESULT)))
