"""Conversation structure repair by Four-Russians block tables.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Keeping a turn costs 0, another role (user or assistant) 2,
deleting it 3, an inserted empty turn of user or assistant 2; a truncated turn that stays adds 1, a blank or repeated one must go.
A position's cost vector holds the least cost of the rest of the conversation from each of the four states (nothing yet, after
the system turn, after a user, after an assistant). Less its minimum it is one of a few dozen vectors, so a table holds, for each of
them and each block of ``BLOCK`` symbols, the vector in front of the block and what the minimum grew by. Conversations are
walked from their end by one lookup a block; then each block is expanded backward, turn by turn, and the edits are read off
from its front, the letter least in ASCII first. From one state a letter leads to one state, so this gives the least of all cheapest audits.

On Spark, turns travel as a digest and a symbol first: equal ones are combined, and the whole table is sorted by conversation, turn and
digest in ranges, so a conversation of any length is spread over tasks. Each range gives fragments of at most ``FRAGMENT`` symbols. The
fragments of a conversation stream by, last one first for the vectors, then first one first for the edits. Texts meet their edits in one more sorted
stream, a turn at a time: a task holds a batch of turns, whatever the length of its conversations.

Defined results: NULL roles and texts count as one space. Turns lie in the order of ``turn``, NULL first, ties by a digest of role and
text; equal rows of one turn are repeats. Rows with a NULL ``conv_id`` are one conversation. Empty texts are blank. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4
FRAGMENT = 4096
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1

# states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
NEXT = (2, 2, 3, 2)  # where a turn of the role that may follow leads
TAKES = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}  # (state, class of the role) of turns that fit as they are
# symbols: class of the role (s, u, a, other), plus 4 if truncated; 8 for turns that must go
MUST_GO, SYMBOLS = 8, 9
# byte of a turn: class of the role, then one bit for its fault
TRUNCATED, BLANK, REPEATED = 4, 8, 16
LEGAL = {(0, 1), (1, 2), (2, 1)}

FRAGMENTS = (
    "conv_id bigint, turn bigint, digest binary, low bigint, high bigint, last_turn bigint, turns bigint, marks binary"
)
EDITED = (
    "conv_id bigint, place bigint, turn bigint, edit string, role string, text string, gaps bigint, blank bigint, "
    "duplicate bigint, truncated bigint, illegal bigint, cost bigint"
)


def closed(costs: list[int]) -> list[int]:
    """Costs after any number of inserted turns."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return costs


def step(behind: tuple[int, ...], symbol: int) -> list[int]:
    """Costs in front of one turn from those behind it."""
    costs = [DELETE + c for c in behind]
    if symbol < MUST_GO:
        extra, role = divmod(symbol, 4)
        for s in range(4):
            costs[s] = min(costs[s], REROLE + extra * CUT_SHORT + behind[NEXT[s]])
            if (s, role) in TAKES:
                costs[s] = min(costs[s], KEEP + extra * CUT_SHORT + behind[TAKES[s, role]])
    return closed(costs)


class Tables:
    """Normalised vectors reachable from the end, and their transitions over one symbol and over ``block`` symbols."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors = [tuple(closed([0, 99, 99, 0]))]
        index = {self.vectors[0]: 0}
        after, grown = [], []
        for vector in self.vectors:  # grows while it is read
            row = []
            for symbol in range(SYMBOLS):
                costs = step(vector, symbol)
                least = min(costs)
                found = tuple(c - least for c in costs)
                if found not in index:
                    index[found] = len(self.vectors)
                    self.vectors.append(found)
                row.append((index[found], least))
            after.append([a for a, _ in row])
            grown.append([g for _, g in row])
        self.one, self.one_grown = np.array(after, np.int32), np.array(grown, np.int32)
        # a block's code has its first symbol as the highest digit: the digits behind it are looked up first
        self.many = np.arange(len(self.vectors), dtype=np.int32)[:, None]
        for _ in range(block):
            self.many = np.concatenate([self.one[self.many, s] for s in range(SYMBOLS)], axis=1)

    def borders(self, symbols: np.ndarray, behind: int) -> list[int]:
        """Vector behind each block, last block first, and the one in front of all; the first block may be shorter."""
        whole = len(symbols) // self.block
        rest = len(symbols) - whole * self.block
        digits = SYMBOLS ** np.arange(self.block - 1, -1, -1)
        codes = symbols[rest:].reshape(whole, self.block) @ digits
        out = [behind]
        for code in codes[::-1].tolist():
            out.append(int(self.many[out[-1], code]))
        if rest:
            at = out[-1]
            for symbol in symbols[:rest][::-1].tolist():
                at = int(self.one[at, symbol])
            out.append(at)
        return out

    def trace(self, symbols: np.ndarray, behind: int, state: int, last: bool) -> tuple[str, int]:
        """Edits of the symbols from ``state`` on, least in ASCII among the cheapest, and the state behind them."""
        borders = self.borders(symbols, behind)
        rest = len(symbols) % self.block
        starts = ([0] if rest else []) + list(range(rest, len(symbols), self.block))
        edits = []
        for k, first in enumerate(starts):
            block = symbols[first : rest if rest and first == 0 else first + self.block].tolist()
            vectors = [borders[len(starts) - 1 - k]]
            for symbol in reversed(block):  # the block expanded backward
                vectors.append(int(self.one[vectors[-1], symbol]))
            vectors.reverse()
            for i, symbol in enumerate(block):
                grown = int(self.one_grown[vectors[i + 1], symbol])
                here = [c + grown for c in self.vectors[vectors[i]]]
                there = self.vectors[vectors[i + 1]]
                extra, role = divmod(symbol, 4) if symbol < MUST_GO else (0, None)
                while True:
                    if here[state] == DELETE + there[state]:
                        edits.append("D")
                        break
                    if here[state] == INSERT + here[NEXT[state]]:
                        edits.append("I")
                        state = NEXT[state]
                        continue
                    fits = TAKES.get((state, role))
                    if fits is not None and here[state] == KEEP + extra * CUT_SHORT + there[fits]:
                        edits.append("K")
                        state = fits
                    else:
                        edits.append("R")
                        state = NEXT[state]
                    break
        while last and state not in (0, 3):
            edits.append("I")
            state = NEXT[state]
        return "".join(edits), state


def as_symbols(marks: bytes) -> np.ndarray:
    """Symbols of the bytes of turns."""
    codes = np.frombuffer(marks, np.uint8).astype(np.int64)
    return np.where(codes & (BLANK | REPEATED), MUST_GO, codes & 7)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, 1024).columns))


def batched(found: Iterator[tuple], schema: pa.Schema, most: int = 1024, bytes_of=lambda row: 0) -> Iterator[pa.RecordBatch]:
    """Record batches of some rows, and of some MB."""
    held, size = [], 0
    for row in found:
        held.append(row)
        size += bytes_of(row)
        if len(held) >= most or size > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def arrow(fields: str) -> pa.Schema:
    """Arrow schema of a list of columns."""
    types = {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(),
        "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()),
    }
    return pa.schema([(name, types[kind]) for name, kind in (field.split() for field in fields.split(", "))])


def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted turns of one conversation, at most ``FRAGMENT`` symbols each (more where one row has more copies)."""

    def found():
        conv, head, turns, low, high, last, marks = None, None, 0, None, None, None, bytearray()
        for conv_id, turn, digest, mark, copies, first in rows(batches):
            if head is not None and (conv_id != conv or len(marks) >= FRAGMENT):
                yield conv, *head, low, high, last, turns, bytes(marks)
                head = None
            if head is None:
                conv, head, turns, low, high, last, marks = conv_id, (turn, digest), 0, None, None, None, bytearray()
            if turn is not None:
                turns += turn != last
                low, high, last = turn if low is None else low, turn, turn
            if mark & BLANK:
                marks.extend(bytes([mark & 3 | BLANK]) * copies)
            else:
                again = bytes([mark & 3 | REPEATED])
                marks.extend(bytes([mark]) + again * (copies - 1) if first else again * copies)
        if head is not None:
            yield conv, *head, low, high, last, turns, bytes(marks)

    yield from batched(found(), arrow(FRAGMENTS), bytes_of=lambda row: len(row[-1]))


BEHIND = FRAGMENTS + ", behind int, last boolean"


def vectors_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the cost vector behind each fragment; fragments come last one first."""
    tables = Tables()

    def found():
        conv, at, seen = None, 0, False
        for row in rows(batches):
            last = not seen or row[0] != conv
            if last:
                conv, at, seen = row[0], 0, True
            yield *row, at, last
            at = tables.borders(as_symbols(row[-1]), at)[-1]

    yield from batched(found(), arrow(BEHIND), bytes_of=lambda row: len(row[7]))


EDITS = FRAGMENTS + ", edits string"


def edits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the edits of each fragment; fragments come first one first."""
    tables = Tables()

    def found():
        conv, state, seen = None, 0, False
        for row in rows(batches):
            if not seen or row[0] != conv:
                conv, state, seen = row[0], 0, True
            edits, state = tables.trace(as_symbols(row[7]), row[8], state, row[9])
            yield *row[:8], edits

    yield from batched(found(), arrow(EDITS), bytes_of=lambda row: 2 * len(row[7]))


class Count:
    """Faults and cost of one conversation, from its fragments in order."""

    def __init__(self):
        self.low = self.high = self.last = self.before = None
        self.turns = self.blank = self.repeated = self.truncated = self.illegal = self.cost = 0

    def add(self, low, high, last_turn, turns, marks: bytes, edits: str) -> None:
        if turns:
            self.turns += turns - (low == self.last)
            self.low = low if self.low is None else self.low
            self.high, self.last = high, last_turn
        codes = np.frombuffer(marks, np.uint8)
        self.blank += int(np.count_nonzero(codes & BLANK))
        self.repeated += int(np.count_nonzero(codes & REPEATED))
        short = codes & TRUNCATED != 0
        self.truncated += int(short.sum())
        roles = (codes & 3).tolist()
        for a, b in zip(([] if self.before is None else [self.before]) + roles, roles if self.before is not None else roles[1:]):
            self.illegal += (a, b) not in LEGAL
        self.before = roles[-1]
        letters = np.frombuffer(edits.encode(), np.uint8)
        stays = letters[letters != ord("I")] != ord("D")
        self.cost += DELETE * edits.count("D") + INSERT * edits.count("I") + REROLE * edits.count("R")
        self.cost += CUT_SHORT * int((stays & short).sum())

    def closing(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.repeated, self.truncated, self.illegal, self.cost


def apply_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns with their edits, inserted turns between them, and a closing row of counts behind each conversation."""
    none = (None,) * 6

    def found():
        conv, seen, count, edits, at, state, place, due = None, False, None, "", 0, 0, 0, []

        def inserted():
            nonlocal at, state, place
            while at < len(edits) and edits[at] == "I":
                yield conv, place, None, "I", "assistant" if state == 2 else "user", "", *none
                at, state, place = at + 1, NEXT[state], place + 1

        for conv_id, turn, digest, kind, role, text, low, high, last_turn, turns, marks, letters in rows(batches):
            if not seen or conv_id != conv:
                if seen:
                    yield from inserted()
                    yield conv, place, None, None, None, None, *count.closing()
                conv, seen, count, edits, at, state, place = conv_id, True, Count(), "", 0, 0, 0
            if kind == 1:  # a fragment, in front of its first turn
                yield from inserted()
                count.add(low, high, last_turn, turns, marks, letters)
                edits, at = edits[at:] + letters, 0
            elif kind == 2:
                yield from inserted()
                edit = edits[at]
                at += 1
                if edit == "K":
                    state = TAKES[state, "sua".find(role[:1] or "?")]
                elif edit == "R":
                    role, state = "assistant" if state == 2 else "user", NEXT[state]
                yield conv, place, turn, edit, role, text, *none
                place += 1
        if seen:
            yield from inserted()
            yield conv, place, None, None, None, None, *count.closing()

    yield from batched(found(), arrow(EDITED), bytes_of=lambda row: len(row[5] or ""))


def role_class() -> Column:
    initial = F.substring("role", 1, 1)
    return F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by a checksum of conversation and turn; NULLs count as one space.

    Of 20 classes, 0 loses the row, 1 its text, 2 the marks at ends of sentences, 3 repeats it, and 4 makes it a user's.
    """
    space = F.lit(" ")
    key = F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)
    )
    text = F.coalesce("text", space)
    return (
        conversations.select("conv_id", "turn", "role", "text", (F.crc32(key) % 20).alias("_class"))
        .where("_class != 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_class") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
            F.when(F.col("_class") == 1, "")
            .when(F.col("_class") == 2, F.regexp_replace(text, "[.!?]", ""))
            .otherwise(text).alias("text"),
            F.explode(F.when(F.col("_class") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        )
        .drop("_copy")
    )


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Every turn with its edit in order of ``place`` (K, R, D; I for inserted ones), role and text as repaired.

    Behind each conversation (also those only ``ids`` names) comes a row without edit that holds its gaps in ``turn``, its blank, repeated
    (``duplicate``) and truncated turns by their first fault, its ``illegal`` pairs of neighbours, and the cost of its
    edits; ``place`` is the number of rows before it. The rows of a conversation lie in one partition in that order.
    """
    space = F.lit(" ")
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    read = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
    )
    read = read.withColumn("digest", F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))))
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    small = (
        read.select("conv_id", "turn", "digest", (role_class() + fault).alias("mark"))
        .groupBy("conv_id", "turn", "digest")
        .agg(F.max("mark").alias("mark"), F.count("*").alias("copies"))
    )
    firsts = (
        small.groupBy("conv_id", "digest")
        .agg(F.min(F.struct(F.col("turn").isNotNull().alias("there"), "turn")).alias("at"))
        .select("conv_id", F.col("at.turn").alias("turn"), "digest", F.lit(0).alias("mark"), F.lit(0).cast("bigint").alias("copies"), F.lit(True).alias("first"))
    )
    key = ["conv_id", "turn", "digest"]
    ordered = (
        small.withColumn("first", F.lit(False)).select(*key, "mark", "copies", "first").union(firsts)
        .groupBy(*key).agg(F.max("mark").alias("mark"), F.sum("copies").alias("copies"), F.max("first").alias("first"))
        .repartitionByRange(*key).sortWithinPartitions(*key)
    )
    edited = (
        ordered.mapInArrow(fragments, FRAGMENTS)
        .repartition("conv_id").sortWithinPartitions(*(F.col(c).desc() for c in key))
        .mapInArrow(vectors_behind, BEHIND)
        .sortWithinPartitions(*key)
        .mapInArrow(edits_of, EDITS)
    )
    numbers = ["low", "high", "last_turn", "turns"]
    known = edited.select(
        *key, F.lit(1).alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
        *numbers, "marks", "edits",
    )
    empty = [F.lit(None).cast("bigint").alias(c) for c in numbers]
    empty += [F.lit(None).cast("binary").alias("marks"), F.lit(None).cast("string").alias("edits")]
    stream = known.union(read.select(*key, F.lit(2), "role", "text", *empty))
    if ids is not None:
        nothing = F.lit(None)
        stream = stream.union(
            ids.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
            .select("conv_id", nothing.cast("bigint"), nothing.cast("binary"), F.lit(0), nothing.cast("string"), nothing.cast("string"), *empty)
        )
    return stream.repartition("conv_id").sortWithinPartitions(*key, "kind").mapInArrow(apply_edits, EDITED)


AUDIT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found():
        audit, sha, some = [], hashlib.sha256(), False
        for conv_id, _, _, edit, role, text, *counts in rows(batches):
            if edit is None:
                yield conv_id, *counts, "".join(audit), sha.hexdigest()
                audit, sha, some = [], hashlib.sha256(), False
                continue
            audit.append(edit)
            if edit != "D":
                sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True

    yield from batched(found(), arrow(AUDIT), bytes_of=lambda row: len(row[-2]))


def audits(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``: its counts, its edits as letters, and a checksum of what it reads after them."""
    return repaired.mapInArrow(_audits, AUDIT)
