"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best-fit: a task keeps at most ``open_bins`` sequences open, in a bitset keyed by free
space. A piece goes to the fullest open sequence that still takes it, else it opens a new one; when too many
are open the fullest closes first. Pieces meet the packers in a pseudo-random but fixed order (a hash of
document and piece), so that every packer sees the same mix of lengths; of each Arrow batch the longest go
first, which leaves the short ones to fill the gaps.

Defined results: NULL and empty texts give the end id alone; rows with the same or a NULL ``doc_id`` are packed
one by one like any other; an empty table gives no rows; further columns of the input are ignored, whatever
their names. Texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.columns import Encoder, pieces

# Less at a time than elsewhere: as the last stage of a pipeline, packing meets executors whose heap is already full.
CACHE, PIECE = 200_000, 1_000_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def first_lengths(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of pieces of each document and the length of its first one; the others are full."""
    count = np.maximum((sizes + length - 1) // length, 1)
    return count, sizes - (count - 1) * length


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of at most ``length`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, CACHE)
        for batch in pieces(batches, "text", PIECE):
            ids, rows = encoder(batch.column("text"))
            n = len(rows) - 1
            ids = np.insert(ids, rows[1:], end_id).astype("<u4")
            rows = rows + np.arange(n + 1)
            count, first = first_lengths(np.diff(rows), length)
            row = np.repeat(np.arange(n), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * length)
            size = np.where(piece == 0, first[row], length)
            at, raw = rows[row] + start, memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + size).tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECES)


class BestFit:
    """Open sequences by free space; ``put`` gives the sequence and the place of a piece."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.open_bins = length, open_bins
        self.free: list[list[int]] = [[] for _ in range(length + 1)]
        self.bits = self.open = self.made = 0

    def put(self, size: int) -> tuple[int, int]:
        fitting = self.bits >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            stack = self.free[space]
            number = stack.pop()
            if not stack:
                self.bits ^= 1 << space
            self.open -= 1
        else:
            number, space = self.made, self.length
            self.made += 1
        left = space - size
        if left:
            self.free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.free[fullest].pop()
                if not self.free[fullest]:
                    self.bits ^= 1 << fullest
                self.open -= 1
        return number, self.length - space


def pack(parts: DataFrame, length: int = 2048, open_bins: int = 16384) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with doc_id, piece and length.

    One exchange by a hash of document and piece; adaptive execution makes the packers as large as its
    advisory partition size. A packer holds its open sequences only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(length, open_bins), TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes = batch.column("length").to_numpy(zero_copy_only=False)
            longest_first = np.argsort(-sizes, kind="stable")
            batch = batch.take(pa.array(longest_first))
            placed = [bins.put(size) for size in sizes[longest_first].tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([base + number for number, _ in placed], pa.int64()),
                    pa.array([place for _, place in placed], pa.int64()),
                ],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    order = F.xxhash64("doc_id", "piece")
    dealt = parts.repartition(order).sortWithinPartitions(order, *parts.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return dealt.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, open_bins: int = 16384
) -> DataFrame:
    """Packs whole documents; only those longer than ``length`` are cut."""
    return pack(token_pieces(docs, tokenizer, length, end_id), length, open_bins)
