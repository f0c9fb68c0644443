"""Benchmark passages in documents: pigeonhole edit matching.

Test items and texts are compared in lower case with white space runs as one space. An item of n characters may differ by
``floor(n * error_rate)`` edits; cut into one piece more than that, an occurrence holds a piece unchanged. An
automaton finds all piece hits in one pass over each text; hits that put the item at nearly the same place are one candidate, and
Myers' bit-parallel distance of the item inside the window around it decides.

The benchmark is a stated query set: it is taken in blocks of at most ``block_chars`` characters (an item longer than
that is a block of its own), each sent to the tasks, and every block is held against all documents. Documents never move.

Defined results: NULL or empty items and texts match nothing; equal items are matched each; rows that repeat a ``doc_id`` are
searched one by one, and give one result row per document row that matches; a NULL ``doc_id`` is reported as NULL; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.columns import pieces
from gridloom.llm.edits import find, pattern_bits

MATCHES = "doc_id bigint, item_id bigint, distance int, begin int, length int, pieces_hit int"


def plain(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def budget(length: int, error_rate: float) -> int:
    return int(length * error_rate)


def cut_up(item: str, parts: int) -> list[tuple[int, str]]:
    """Even pieces of an item and where they begin."""
    edge = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(edge, edge[1:]) if b > a]


class Matcher:
    """All items of a block as an automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = [(item_id, text, budget(len(text), error_rate)) for item_id, text in items]
        self.bits: dict[int, dict[str, int]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, k) in enumerate(self.items):
            for at, piece in cut_up(text, k + 1):
                places.setdefault(piece, []).append((number, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def matches(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """Item, distance, window begin, window length and number of piece hits of the best place of each item."""
        if self.empty:
            return []
        starts: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for number, at in where:
                starts.setdefault(number, []).append(end + 1 - size - at)
        out = []
        for number, found in starts.items():
            item_id, item, k = self.items[number]
            best = None
            found.sort()
            i = 0
            while i < len(found):
                # hits of one occurrence put its begin within k characters of each other
                j = i
                while j + 1 < len(found) and found[j + 1] - found[j] <= k:
                    j += 1
                low, high = max(0, found[i] - k), min(len(text), found[j] + len(item) + k)
                window = text[low:high]
                at = window.find(item)
                if at >= 0:
                    result = (0, low + at, len(item))
                else:
                    bits = self.bits.get(number)
                    if bits is None:
                        bits = self.bits[number] = pattern_bits(item)
                    hit = find(bits, len(item), window, k)
                    result = (hit[0], max(low, low + hit[1] - len(item)), min(len(item), hit[1])) if hit else None
                if result and (best is None or result < best):
                    best = result
                i = j + 1
            if best:
                out.append((item_id, *best, len(found)))
        return out


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks, streamed to the driver one partition at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")
    for row in rows.toLocalIterator():
        text = plain(row["text"])
        if not text:
            continue
        if held and size + len(text) > block_chars:
            yield held
            held, size = [], 0
        held.append((row["item_id"], text))
        size += len(text)
    if held:
        yield held


def search(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document row and item found in it: distance, place in the normalised text, number of piece hits."""
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("item_id", pa.int64()), *((n, pa.int32()) for n in ("distance", "begin", "length", "pieces_hit"))]
    )

    def against(items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, error_rate)
            for batch in pieces(batches, "text"):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    rows += [(doc_id, *match) for match in matcher.matches(plain(text))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in rows], field.type) for c, field in enumerate(schema)], schema=schema
                )

        return chosen.mapInArrow(run, MATCHES)

    found = [against(items) for items in blocks(benchmark, block_chars)]
    if not found:
        return docs.sparkSession.createDataFrame([], MATCHES)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; no row moves."""

    def without(frame: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, error_rate)
            for batch in pieces(batches, "text"):
                keep = [not matcher.matches(plain(text)) for text in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return frame.mapInArrow(run, frame.schema)

    for items in blocks(benchmark, block_chars):
        docs = without(docs, items)
    return docs
