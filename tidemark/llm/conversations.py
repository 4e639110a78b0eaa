"""Repair the structure of conversations with the cheapest edits.

A turn is kept, given to the other role, deleted, or a turn is inserted, until the roles are nothing, or an optional system turn and
then pairs of user and assistant. Blank turns and repeated ones must go; a truncated turn that stays costs extra.

The edits are paths through a lattice of turns and of what has been written so far (nothing, a system turn, a user turn, an assistant
turn). A* searches it with keys of cost so far plus what the rest costs at least, and the audit (the edits' initials), so
that of equally cheap repairs the one with the least audit is found. The rest costs at least the deletions of its blank and repeated
turns, and for each truncated turn the cheaper of deleting it and leaving it; both are sums over suffixes.

Conversations come sorted, turn by turn, and are searched in pieces. Between pieces there is one best way to each of the four states;
what these have in common is settled, written out and forgotten. So a conversation of any length needs memory for the
turns in which its best ways still differ, not for all of them.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: The white space of turns, the marks that end a sentence, and the costs.
SPACES = " \t\n\x0b\x0c\r"
MARKS = "[.!?]"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: What has been written: state to the initials that may follow and the states they lead to.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (NOTHING, ASSISTANT)
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}
#: Whoever costs so much more than the cheapest has lost: from each state the next steps of each other can be followed for less
#: (two insertions, and a system turn deleted).
LOST = 2 * INSERT + DELETE
#: Turns that are searched together, at most.
PIECE = 64

Turn = tuple[str, str, str]


def _ways(state: int, fault: int, first: str) -> Iterator[tuple[str, int, int]]:
    """Edit, cost and next state of all that can be done with a turn."""
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    extra = TRUNCATED if fault == CUT else 0
    for letter, after in NEXT[state].items():
        if letter == first:
            yield "K", extra, after
        elif letter in NAMES:
            yield "R", REROLE + extra, after


def search(turns: list[tuple[int, str]], starts: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str]]:
    """Cheapest cost, and for it the least audit, to each state after turns (fault and role's initial), from the costs and audits of
    starts. last: only the best end of all, which must be a state in which a conversation may end."""
    rest = [0] * (len(turns) + 1)
    for i in range(len(turns) - 1, -1, -1):
        rest[i] = rest[i + 1] + (0 if turns[i][0] == SOUND else DELETE if turns[i][0] != CUT else min(DELETE, TRUNCATED))
    heap = [(cost + rest[0], audit, 0, state) for state, (cost, audit) in starts.items()]
    heapq.heapify(heap)
    done, found = set(), {}
    limit = None
    while heap:
        key, audit, i, state = heapq.heappop(heap)
        if limit is not None and key > limit:
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = key - rest[i]
        if i == len(turns) and (not last or state in ENDS):
            found[state] = cost, audit
            if last or len(found) == 4:
                break
            limit = key + LOST if limit is None else limit
        if i < len(turns):
            for edit, price, after in _ways(state, *turns[i]):
                heapq.heappush(heap, (cost + price + rest[i + 1], audit + edit, i + 1, after))
        for letter, after in NEXT[state].items():
            if letter in NAMES:
                heapq.heappush(heap, (cost + INSERT + rest[i], audit + "I", i, after))
    return found


class Repair:
    """One conversation, fed turn by turn. Settled edits go to write(edit, turn, role, text), deletions with the turn's own role."""

    def __init__(self, write: Callable[[str, object, str, str], None]):
        self.write, self.counts, self.gaps = write, [0, 0, 0, 0], [None, None, 0]
        self.open: list[tuple[object, str, str]] = []  # turns that no settled edit has reached
        self.piece: list[tuple[int, str]] = []
        self.best: dict[int, tuple[int, str]] = {NOTHING: (0, "")}
        self.state, self.illegal, self.before, self.cost, self.settled = NOTHING, 0, None, 0, []

    def feed(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.counts[fault] += 1
        if turn is not None:
            if self.gaps[1] != turn:
                self.gaps[2] += 1
            self.gaps[:2] = [turn if self.gaps[0] is None else self.gaps[0], turn]
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        self.open.append((turn, role, text))
        self.piece.append((fault, role[:1]))
        if len(self.piece) == PIECE:
            self.best = search(self.piece, self.best, False)
            self.piece = []
            self._settle(commonprefix([audit for _, audit in self.best.values()]))

    def end(self) -> None:
        (_, (self.cost, audit)), *_ = search(self.piece, self.best, True).items()
        self._settle(audit)

    def _settle(self, audit: str) -> None:
        at = 0
        for edit in audit:
            turn, role, text = (None, "", "") if edit == "I" else self.open[at]
            at += edit != "I"
            if edit != "D":
                if edit != "K":
                    role = NAMES["a" if self.state == USER else "u"]
                self.state = NEXT[self.state][role[:1]]
            self.write(edit, turn, role, text)
        self.open = self.open[at:]
        self.best = {state: (cost, rest[len(audit) :]) for state, (cost, rest) in self.best.items()}
        self.settled.append(audit)

    @property
    def missing(self) -> int:
        low, high, n = self.gaps
        return 0 if low is None else high - low + 1 - n


def faulty(conversations: DataFrame, alive: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, alive, nth and fault of conversations (conv_id, turn, role, text): blank, seen earlier with the same
    role and text, or truncated, the first that holds. Earlier is by turn, nulls first. Null roles and texts are one space.
    alive: a boolean column of conversations, false for rows that only make their conversation known."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text, (F.lit(True) if alive is None else F.col(alive)).alias("alive"))
    same = W.partitionBy("conv_id", "alive", "role", F.sha2("text", 256)).orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("nth", F.row_number().over(same))
    left = F.rtrim("text", F.lit(SPACES))
    fault = F.when(left == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.right(left, F.lit(1)).rlike(MARKS), CUT).otherwise(SOUND)
    return rows.withColumn("fault", fault)


def _streamed(conversations: DataFrame, alive: str | None, run, schema: str) -> DataFrame:
    """run over the turns of whole conversations in order of turn (nulls first), role and text; a conversation goes to one task, which
    reads it turn by turn."""
    rows = faulty(conversations, alive).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "nth")
    return rows.select("conv_id", "turn", "role", "text", "alive", "fault").mapInArrow(run, schema)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "alive", "fault")), strict=True)


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_report(conversations: DataFrame, alive: str | None = None) -> DataFrame:
    """One row for each conv_id, null among them, of conversations (conv_id, turn, role, text): gaps between the numbers of turns,
    blank, duplicate, truncated and illegal counts, the repair's cost, its audit and the SHA-256 of `role:text` lines.

    Rows of equal turn are ordered by role and text, so results do not depend on the order of rows. Rows for which the column named
    by alive is false are not there; a conversation without any other has zeros, an empty audit and the hash of nothing. Other columns are
    left out. No rows: no rows.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", batch_type), *((c.split()[0], pa.string() if "string" in c else pa.int64()) for c in REPORT.split(", "))])
        out, conv, now, digest, lines = [], (), None, None, 0

        def write(edit: str, turn: object, role: str, text: str) -> None:
            nonlocal lines
            if edit != "D":
                digest.update((("\n" if lines else "") + role + ":" + text).encode())
                lines += 1

        def closed() -> tuple:
            now.end()
            return (conv[0], now.missing, *now.counts[1:], now.illegal, now.cost, "".join(now.settled), digest.hexdigest())

        for conv_id, turn, role, text, alive, fault in _turns(batches):
            if now is None or conv[0] != conv_id:
                if now is not None:
                    out.append(closed())
                conv, now, digest, lines = (conv_id,), Repair(write), hashlib.sha256(), 0
            if alive:
                now.feed(turn, role, text, fault)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if now is not None:
            out.append(closed())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    batch_type = _arrow(conversations)
    return _streamed(conversations, alive, run, f"conv_id {kind}, {REPORT}")


def _arrow(conversations: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(conversations.schema["conv_id"].dataType)


def repaired(conversations: DataFrame, alive: str | None = None) -> DataFrame:
    """conv_id, at (from 0), edit, turn, role and text of the repaired turns: those kept (K), given another role (R) and inserted (I,
    without turn and text). Rules as in repair_report; a conversation of which nothing stays has no row."""
    kind, batch_type = conversations.schema["conv_id"].dataType.simpleString(), _arrow(conversations)
    schema = pa.schema([("conv_id", batch_type), ("at", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, now, at = [], (), None, 0

        def write(edit: str, turn: object, role: str, text: str) -> None:
            nonlocal at
            if edit != "D":
                out.append((conv[0], at, edit, turn, role, text))
                at += 1

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

        for conv_id, turn, role, text, alive, fault in _turns(batches):
            if now is None or conv[0] != conv_id:
                if now is not None:
                    now.end()
                conv, now, at = (conv_id,), Repair(write), 0
            if alive:
                now.feed(turn, role, text, fault)
            if len(out) >= 1000:
                yield packed()
                out.clear()
        if now is not None:
            now.end()
        if out:
            yield packed()

    return _streamed(conversations, alive, run, f"conv_id {kind}, at long, edit string, turn long, role string, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults by the CRC-32 of `conv_id:turn`, modulo 20: 0 drops a row (alive is false,
    so that its conversation stays known), 1 empties its text, 2 takes the sentence marks out, 3 repeats it, 4 makes it the user's.
    Nulls are one space, in the key too."""

    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), (F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20).alias("fate"))
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", MARKS, "")).otherwise(F.col("text"))
    copies = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (fate != 0).alias("alive"), F.explode(copies).alias("copy")).drop("copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(table(spark, sf_dir, "conversations")), "alive")
