"""Repair of conversation structure: the cheapest edits that make every conversation alternate, with an audit of them.

A repaired conversation is empty, or a system message at most, then user and assistant in turns, the assistant last.
Every message is kept, given the role that fits (Rerole) or deleted, and messages without text are inserted where one is
missing. The edits are found by a dynamic program over messages and the four states of that pattern. Its audits are kept
persistently: a node holds what one message adds, points to its prefix, knows its ancestors at distances of powers of two
and the rolling hash of the whole audit. Of audits that cost the same the least in ASCII order counts: the longest common
prefix is searched by the hashes of ancestors, what it claims is verified letter by letter, then one letter decides.

Conversations are cut in blocks of bounded size. A conversation that lies inside one sorted partition is solved there; of
any other, each block is solved from every state to every state, and the blocks are put together by the same program, a
block's audit being what a node adds. So one conversation may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from schemalign.operators.settle import settle
from schemalign.operators.skew import salted_lookup

BLOCK_ROWS = 4096
BLOCK_CHARS = 4_000_000
# Repeated messages sent to every task as a table, at most: some 64 MB.
BROADCAST_ROWS = 1_000_000

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

# States: nothing yet, after a system message, after a user's, after an assistant's. By state and initial: the next one.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

WHOLE, CUT, GONE = range(3)  # a message without fault or truncated, or one that must be deleted
_WHITE = " \t\n\x0b\x0c\r"
_MODULUS, _BASE = (1 << 61) - 1, 911_382_323


def _moves(initial: str, fault: int) -> list[list[tuple[int, int, str]]]:
    """By state before: (state after, cost, letters) of one message, the least for each state after."""
    table = []
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}
        state, inserted = start, 0
        for _ in range(3):
            spent, letters, late = INSERT * inserted, "I" * inserted, TRUNCATED * (fault == CUT)
            ways = [(state, spent + DELETE, letters + "D")]
            if fault != GONE:
                ways.append((_DUE[state], spent + REROLE + late, letters + "R"))
                if (state, initial) in _NEXT:
                    ways.append((_NEXT[state, initial], spent + late, letters + "K"))
            for after, cost, text in ways:
                best[after] = min(best.get(after, (cost, text)), (cost, text))
            state, inserted = _DUE[state], inserted + 1
        table.append([(after, cost, text) for after, (cost, text) in sorted(best.items())])
    return table


_MOVES = {(initial, fault): _moves(initial, fault) for initial in "sua?" for fault in (WHOLE, CUT, GONE)}


class Audits:
    """Audits that share their beginnings. Node 0 is the empty audit; nodes compared are of one depth."""

    def __init__(self, base: int = _BASE, modulus: int = _MODULUS):
        self.base, self.modulus = base, modulus
        self.text, self.hash, self.above = [""], [0], [[0]]

    def add(self, node: int, text: str) -> int:
        """The audit of a node with text behind it; no text is the beginning of another one added at that depth."""
        value = self.hash[node]
        for letter in text:
            value = (value * self.base + ord(letter)) % self.modulus
        above, k = [node], 0
        while k < len(self.above[above[k]]) and above[k]:
            above.append(self.above[above[k]][k])
            k += 1
        self.text.append(text)
        self.hash.append(value)
        self.above.append(above)
        return len(self.text) - 1

    def _ancestor(self, node: int, k: int) -> int:
        return self.above[node][k] if k < len(self.above[node]) else 0

    def parted(self, a: int, b: int) -> tuple[int, int]:
        """The nodes with which two different audits of one depth part."""
        x, y = a, b
        for k in reversed(range(len(self.above[a]))):
            up, over = self._ancestor(x, k), self._ancestor(y, k)
            if self.hash[up] != self.hash[over]:
                x, y = up, over
        if self.text[x] != self.text[y] and self._alike(self.above[x][0], self.above[y][0]):
            return x, y
        return self._walked(a, b)

    def _alike(self, a: int, b: int) -> bool:
        while a != b:
            if self.text[a] != self.text[b]:
                return False
            a, b = self.above[a][0], self.above[b][0]
        return True

    def _walked(self, a: int, b: int) -> tuple[int, int]:
        """parted without hashes, where they collided."""
        found = a, b
        while a != b:
            if self.text[a] != self.text[b]:
                found = a, b
            a, b = self.above[a][0], self.above[b][0]
        return found

    def less(self, a: int, text_a: str, b: int, text_b: str) -> bool:
        """Whether audit a with text_a behind it comes before b with text_b."""
        if a == b:
            return text_a < text_b
        x, y = self.parted(a, b)
        return self.text[x] < self.text[y]

    def path(self, node: int) -> list[str]:
        texts = []
        while node:
            texts.append(self.text[node])
            node = self.above[node][0]
        return texts[::-1]


def _extended(
    reached: dict[int, tuple[int, int]], moves: Sequence[Sequence[tuple[int, int, str]]], audits: Audits
) -> dict[int, tuple[int, int]]:
    """By state reached: (cost, audit) after one message or block more, the cheapest and of those the least."""
    best: dict[int, tuple[int, int, str]] = {}
    for state, (spent, node) in reached.items():
        for after, cost, text in moves[state]:
            total, held = spent + cost, best.get(after)
            if held is None or total < held[0] or (total == held[0] and audits.less(node, text, held[1], held[2])):
                best[after] = total, node, text
    return {state: (cost, audits.add(node, text)) for state, (cost, node, text) in best.items()}


def _closed(reached: dict[int, tuple[int, int]], audits: Audits) -> tuple[int, int, int, str]:
    """(cost, state before closing, audit, letters that close) of the best end."""
    best: tuple[int, int, int, str] | None = None
    for state, (spent, node) in reached.items():
        closing = _CLOSING[state]
        cost = spent + INSERT * len(closing)
        if best is None or cost < best[0] or (cost == best[0] and audits.less(node, closing, best[2], best[3])):
            best = cost, state, node, closing
    return best


def solve(messages: Sequence[tuple[str, int]], start: int = START) -> tuple[dict[int, tuple[int, int]], Audits]:
    """(initial, fault) of messages in order -> by state reached from start: (cost, audit), nothing inserted at the end."""
    audits = Audits()
    reached = {start: (0, 0)}
    for initial, fault in messages:
        reached = _extended(reached, _MOVES[initial if initial in ("s", "u", "a") else "?", fault], audits)
    return reached, audits


def edited(messages: Sequence[tuple[str, str]], audit: str, state: int = START) -> list[tuple[str, str]]:
    """The (role, text) messages that an audit makes of those given."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            state = _DUE[state]
            out.append((_ROLE[state], ""))
            continue
        role, text = messages[at]
        at += 1
        if letter == "K":
            state = _NEXT[state, role[:1]]
            out.append((role, text))
        elif letter == "R":
            state = _DUE[state]
            out.append((_ROLE[state], text))
    return out


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_LEGAL = ("su", "ua", "au")


@dataclass
class _Tally:
    """What is counted in a block, and what a following block needs to go on counting."""

    counts: dict[str, int]
    first_initial: str
    last_initial: str
    first_turn: int | None
    last_turn: int | None
    turns: int

    def and_then(self, after: _Tally) -> _Tally:
        counts = {c: self.counts[c] + after.counts[c] for c in _COUNTS}
        counts["illegal"] += self.last_initial + after.first_initial not in _LEGAL
        shared = self.last_turn is not None and self.last_turn == after.first_turn
        first = after.first_turn if self.first_turn is None else self.first_turn
        last = self.last_turn if after.last_turn is None else after.last_turn
        return _Tally(counts, self.first_initial, after.last_initial, first, last, self.turns + after.turns - shared)

    def gaps(self) -> int:
        return 0 if self.first_turn is None else min(self.last_turn - self.first_turn + 1 - self.turns, (1 << 63) - 1)


def _fault(text: str, duplicate: bool) -> tuple[int, str | None]:
    seen = text.rstrip(_WHITE)
    if not seen:
        return GONE, "blank"
    if duplicate:
        return GONE, "duplicate"
    return (WHOLE, None) if seen[-1] in ".!?" else (CUT, "truncated")


def _tally(block: list[tuple]) -> tuple[_Tally, list[tuple[str, int]]]:
    counts = dict.fromkeys(_COUNTS, 0)
    messages, before = [], None
    for _, role, text, duplicate in block:
        fault, name = _fault(text, duplicate)
        if name:
            counts[name] += 1
        initial = role[:1]
        counts["illegal"] += before is not None and before + initial not in _LEGAL
        messages.append((initial, fault))
        before = initial
    turns = [t for t, *_ in block if t is not None]
    ends = (turns[0], turns[-1]) if turns else (None, None)
    return _Tally(counts, messages[0][0], messages[-1][0], *ends, len(set(turns))), messages


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema))


def _as_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _pairs(fields: str, values: Sequence[tuple]) -> list[dict]:
    return [dict(zip(fields.split(), v, strict=True)) for v in values]


_MESSAGE = "array<struct<role: string, text: string>>"
_MOVE = "array<struct<before: int, after: int, cost: bigint, audit: string>>"
_REPORT = ["gaps", *_COUNTS, "cost"]


def _sorted_blocks(id_type: str, block_rows: int, block_chars: int):
    """Reads sorted partitions; gives a row for each conversation solved and one for each block of the others."""
    schema = (
        f"conv_id {id_type}, part bigint, block int, closed boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
        f"illegal bigint, cost bigint, audit string, first_initial string, last_initial string, first_turn bigint, "
        f"last_turn bigint, turns bigint, moves {_MOVE}, messages {_MESSAGE}"
    )
    arrow = _arrow(schema)

    def told(conv, part: int, block: int, rows: list[tuple], closed: bool) -> tuple:
        tally, messages = _tally(rows)
        counts = [tally.counts[c] for c in _COUNTS]
        ends = (tally.first_initial, tally.last_initial, tally.first_turn, tally.last_turn, tally.turns)
        texts = [(role, text) for _, role, text, _ in rows]
        if closed:
            reached, audits = solve(messages)
            cost, _, node, closing = _closed(reached, audits)
            audit = "".join(audits.path(node)) + closing
            repaired = _pairs("role text", edited(texts, audit))
            return (conv, part, block, True, tally.gaps(), *counts, cost, audit, *ends, [], repaired)
        moves = []
        for before in range(4):
            reached, audits = solve(messages, before)
            moves += [(before, after, c, "".join(audits.path(n))) for after, (c, n) in sorted(reached.items())]
        moves = _pairs("before after cost audit", moves)
        return (conv, part, block, False, None, *counts, None, None, *ends, moves, _pairs("role text", texts))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, conv, part, block, chars, first = [], None, 0, 0, 0, True
        size = 0
        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            for own, turn, role, text, duplicate, part in zip(*columns, strict=True):
                if held and own != conv:
                    out.append(told(conv, part, block, held, not first and not block))
                    size += chars
                    held, block, chars, first = [], 0, 0, False
                elif held and (len(held) >= block_rows or chars >= block_chars):
                    out.append(told(conv, part, block, held, False))
                    size += chars
                    held, block, chars = [], block + 1, 0
                conv = own
                held.append((turn, role, text, duplicate))
                chars += len(text)
                if size >= block_chars or len(out) >= block_rows:
                    yield _as_batch(out, arrow)
                    out, size = [], 0
        if held:
            out.append(told(conv, part, block, held, False))
        yield _as_batch(out, arrow)

    return stream, schema


def _put_together(id_type: str):
    """Reads the blocks of open conversations in order; gives each block's part of the audit and, last, the report."""
    schema = f"conv_id {id_type}, part bigint, block int, before int, audit string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    arrow = _arrow(schema)

    def joined(conv, blocks: list[tuple[int, int]], states: list[dict], tally: _Tally, reached: dict, audits: Audits) -> list[tuple]:
        cost, state, node, closing = _closed(reached, audits)
        texts = audits.path(node)
        before, at = [], node
        for k in reversed(range(len(blocks))):
            at = audits.above[at][0]
            before.append(states[k][at])
        texts[-1] += closing
        rows = [
            (conv, part, block, state, text, *[None] * len(_REPORT))
            for (part, block), state, text in zip(blocks, before[::-1], texts, strict=True)
        ]
        return [*rows, (conv, None, None, None, "".join(texts), tally.gaps(), *[tally.counts[c] for c in _COUNTS], cost)]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, blocks, states, tally, reached, audits = None, [], [], None, {}, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if blocks and row["conv_id"] != conv:
                    out += joined(conv, blocks, states, tally, reached, audits)
                    blocks, states, tally = [], [], None
                if not blocks:
                    reached, audits = {START: (0, 0)}, Audits()
                conv = row["conv_id"]
                moves = [[] for _ in range(4)]
                for m in row["moves"]:
                    moves[m["before"]].append((m["after"], m["cost"], m["audit"]))
                states.append({node: state for state, (_, node) in reached.items()})
                reached = _extended(reached, moves, audits)
                blocks.append((row["part"], row["block"]))
                rest = ("first_initial", "last_initial", "first_turn", "last_turn", "turns")
                own = _Tally({c: row[c] for c in _COUNTS}, *[row[c] for c in rest])
                tally = own if tally is None else tally.and_then(own)
            yield _as_batch(out, arrow)
        yield _as_batch(joined(conv, blocks, states, tally, reached, audits) if blocks else [], arrow)

    return stream, schema


def _marked(messages: DataFrame) -> DataFrame:
    """messages with _row and duplicate: whether role and text stand earlier in the conversation.

    Role and text are told apart by their SHA-256. Only those that occur more than once are joined: broadcast while they
    are few, otherwise by a join that splits heavy keys.
    """
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = messages.withColumn("_row", F.monotonically_increasing_id()).withColumn("_said", F.unhex(said))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), F.col("_row").alias("row"))
    ids = F.struct(F.col("conv_id").isNull(), F.coalesce(F.col("conv_id"), F.lit(0).cast(messages.schema["conv_id"].dataType)))
    rows = rows.withColumn("_conv", ids)
    seen = rows.groupBy("_conv", "_said").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    seen = settle(seen)
    keys, first = ["_conv", "_said"], seen.select("_conv", "_said", F.col("_first.row").alias("_first"))
    if seen.count() <= BROADCAST_ROWS:
        met = rows.join(F.broadcast(first), keys, "left")
    else:
        met = salted_lookup(rows, first, keys, "left", counts=seen.select(*keys, "rows"))
    return met.withColumn("duplicate", F.coalesce(F.col("_first") != F.col("_row"), F.lit(False)))


@dataclass
class Repaired:
    report: DataFrame  # (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)
    pieces: DataFrame  # (conv_id, part, block, pieces, messages): the repaired conversation in bounded pieces


def repair(messages: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> Repaired:
    """messages (conv_id, turn, role, text, ...) -> reports and repaired conversations.

    A conversation's messages go by turn, nulls first, those of one turn by role and text. Null roles and texts are one
    space: such a role fits nowhere, such a text is blank. Rows without conv_id are one conversation, without a name.
    Blank messages and those said before are deleted, truncated ones cost more. Repeated rows are messages of their own.
    A piece holds a block of messages at most (pieces is how many the conversation has; part and block order them). A
    single text is never cut, however long. An empty table gives empty results; other columns are not looked at.
    """
    id_type = messages.schema["conv_id"].dataType.simpleString()
    own = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = ["conv_id", "turn", "role", "text", "_row"]
    laid = _marked(own).repartitionByRange(*order).sortWithinPartitions(*order)
    read, schema = _sorted_blocks(id_type, block_rows, block_chars)
    found = laid.select("conv_id", "turn", "role", "text", "duplicate", F.spark_partition_id().cast("long").alias("part"))
    blocks = settle(found.mapInArrow(read, schema))
    report = ["conv_id", *_REPORT, "audit"]
    closed, open_ = blocks.filter("closed"), blocks.filter("NOT closed")

    join, schema = _put_together(id_type)
    parts = open_.drop("messages", "closed", "gaps", "cost", "audit").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    told = settle(parts.mapInArrow(join, schema))
    ends = told.filter("part IS NULL").select(*report)

    made = f"conv_id {id_type}, part bigint, block int, pieces bigint, messages {_MESSAGE}"
    arrow = _arrow(made)

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                messages = edited([(m["role"], m["text"]) for m in row["messages"]], row["audit"], row["before"])
                out.append((row["conv_id"], row["part"], row["block"], row["pieces"], _pairs("role text", messages)))
            yield _as_batch(out, arrow)

    chosen = told.filter("part IS NOT NULL").select(F.col("conv_id").alias("_conv"), "part", "block", "before", "audit")
    count = chosen.groupBy("_conv").agg(F.count(F.lit(1)).alias("pieces"))
    chosen = chosen.alias("c").join(count.alias("n"), F.col("c._conv").eqNullSafe(F.col("n._conv"))).select("c.*", "pieces")
    same = (F.col("b.part") == F.col("c.part")) & (F.col("b.block") == F.col("c.block")) & F.col("b.conv_id").eqNullSafe(F.col("c._conv"))
    cut = open_.alias("b").join(chosen.alias("c"), same).select("b.conv_id", "b.part", "b.block", "c.pieces", "b.messages", "c.audit", "c.before")
    pieces = cut.mapInArrow(applied, made)
    whole = closed.select("conv_id", "part", "block", F.lit(1).cast("long").alias("pieces"), "messages")
    return Repaired(closed.select(*report).unionByName(ends), whole.unionByName(pieces))


def digests(pieces: DataFrame) -> DataFrame:
    """pieces of Repaired -> (conv_id, repaired_sha256): of the lines role:text, joined by line ends.

    SHA-256 reads one conversation in order, so a conversation of many pieces is read as a stream, a piece at a time.
    """
    import hashlib

    id_type = pieces.schema["conv_id"].dataType.simpleString()
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    lines = pieces.select("conv_id", "part", "block", "pieces", F.size("messages").alias("n"), F.array_join(line, "\n").alias("text"))
    single = lines.filter("pieces = 1").select("conv_id", F.sha2("text", 256).alias("repaired_sha256"))

    schema = f"conv_id {id_type}, repaired_sha256 string"
    arrow = _arrow(schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun, any_line = None, hashlib.sha256(), False, False
        for batch in batches:
            out = []
            for own, n, text in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if begun and own != conv:
                    out.append((conv, state.hexdigest()))
                    state, any_line = hashlib.sha256(), False
                conv, begun = own, True
                if n:
                    state.update(("\n" * any_line + text).encode("utf-8", "surrogatepass"))
                    any_line = True
            yield _as_batch(out, arrow)
        yield _as_batch([(conv, state.hexdigest())] if begun else [], arrow)

    many = lines.filter("pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return single.unionByName(many.select("conv_id", "n", "text").mapInArrow(stream, schema))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults planted by CRC-32 of conv_id:turn, for trying repairs.

    Of 20 remainders, 0 drops the row, 1 empties its text, 2 removes its sentence marks, 3 repeats it, 4 sets role user;
    nulls are one space.
    """
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat_ws(":", *spaced).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("_fault")).filter("_fault <> 0")
    changed = F.when(F.col("_fault") == 1, F.lit("")).when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        changed.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")
