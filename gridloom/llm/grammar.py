"""Token ids in a grammar-compressed file format (Re-Pair), with random access to every document.

A shard holds the ids of a run of documents. Frequent pairs of neighbouring ids are replaced by new symbols, round by
round: a round counts all pairs of the shard and replaces the most frequent ones that cannot overlap (no symbol
ends one chosen pair and begins another; a pair of equal symbols is replaced from the left of each run), until no pair
is frequent. No pair crosses the end of a document. Rules and the expansion length of every symbol are stored beside the sequence,
so any document, and any id range in it, is decoded without the others.

The files are Parquet, one row per shard (``SHARD``), whose binary columns hold little-endian arrays: rules (pairs of 32-bit
symbols; symbol ``base + k`` is rule k), sizes (32-bit expansion length per rule), symbols (16 or 32 bits, compressed in blocks),
block_ends (64 bits, cumulated bytes per block),
doc_ids, token_ends and symbol_ends (64 bits, cumulated per document). Spark writes them, so a lost executor's
shard is made anew and only whole files are ever seen.

Shards follow each other in ascending ``doc_id`` order. Defined results: NULL and empty texts hold the end id alone; rows that
repeat a ``doc_id`` are stored one after the other, in the order of their texts; NULL ids come first; an empty table
gives no shard; other columns are ignored. A text longer than a shard makes a shard of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.columns import Encoder, gathered, pieces
from gridloom.sources.workspace import new_path

SHARD = (
    "part int, shard int, n_docs bigint, n_tokens bigint, n_symbols bigint, base bigint, width int,"
    " rules binary, sizes binary, symbols binary, doc_ids binary, nulls binary, token_ends binary, symbol_ends binary, block_ends binary"
)
#: Symbols that are compressed together.
BLOCK = 1 << 15
SHARD_TOKENS = 1 << 21
#: Pairs are counted in 2 ** BUCKET_BITS buckets before those of full ones are counted themselves.
BUCKET_BITS = 20


def _replace(
    seq: np.ndarray, last: np.ndarray, open_: np.ndarray, a: np.ndarray, b: np.ndarray, chosen: np.ndarray, first_new: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replaces the pairs in the rows of ``chosen`` by ``first_new`` and the numbers after it.

    ``open_`` holds, in order, the places whose pair (``a``, ``b``) may be frequent, all of the chosen ones among them; the new ones are returned.
    """
    # small numbers for the symbols that begin or end a chosen pair, and a table of the pairs
    lead, trail = np.unique(chosen[:, 0]), np.unique(chosen[:, 1])
    slot = np.zeros((2, first_new), np.int32)
    slot[0, lead], slot[1, trail] = np.arange(1, len(lead) + 1), np.arange(1, len(trail) + 1)
    pair = np.full((len(lead) + 1) * (len(trail) + 1), -1, np.int16 if len(chosen) < 1 << 15 else np.int32)
    pair[slot[0, chosen[:, 0]] * (len(trail) + 1) + slot[1, chosen[:, 1]]] = np.arange(len(chosen))
    found = pair.take(slot[0].take(a) * (len(trail) + 1) + slot[1].take(b))
    hit = np.flatnonzero(found >= 0)
    where, found = open_.take(hit), found.take(hit).astype(np.int32)
    equal = a.take(hit) == b.take(hit)
    if equal.any():  # of a run of equal symbols, every second place from its first
        at = where[equal]
        begin = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, at, 0))
        drop = np.zeros(len(where), bool)
        drop[equal] = (at - begin) % 2 == 1
        where, found = where[~drop], found[~drop]
    seq[where] = first_new + found
    last[where] = last[where + 1]
    keep = np.ones(len(seq), bool)
    keep[where + 1] = False
    again = np.zeros(len(seq), bool)
    again[open_] = True
    again[where] = True
    # the place before a new symbol; where that is gone, it was a new symbol's second half, and the one before it stands there
    before = where[where > 0] - 1
    again[np.where(keep[before], before, before - 1)] = True
    left = np.flatnonzero(keep)
    last, again = last.take(left), again.take(left)
    again &= ~last
    return seq.take(left), last, np.flatnonzero(again)


def _choose(pairs: np.ndarray, counts: np.ndarray, span: int, most: int) -> np.ndarray:
    """The most frequent pairs of which none can overlap another."""
    lead, trail, out = set(), set(), []
    for i in np.argsort(-counts, kind="stable")[: 4 * most].tolist():
        a, b = divmod(int(pairs[i]), span)
        if a == b:
            if a in lead or a in trail:
                continue
            lead.add(a)
            trail.add(a)
        elif a in trail or b in lead:
            continue
        else:
            lead.add(a)
            trail.add(b)
        out.append((a, b))
        if len(out) == most:
            break
    return np.array(out, np.int64)


def compress(
    ids: np.ndarray, ends: np.ndarray, per_round: int = 3000, least: int = 8
) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base, rules, expansion lengths, symbols and the documents' ends in the symbols.

    Each round replaces the most frequent pairs that cannot overlap each other, until no pair occurs ``least`` times.
    """
    seq = ids.astype(np.int32)
    base = int(seq.max()) + 1 if len(seq) else 1
    last = np.zeros(len(seq), bool)
    last[ends - 1] = True
    rules: list[np.ndarray] = []
    top = base
    # a pair of old symbols never becomes more frequent, so its places are closed once it is rare
    open_ = np.flatnonzero(~last)
    while len(open_):
        a, b = seq.take(open_), seq.take(open_ + 1)
        bucket = (a.astype(np.uint32) * np.uint32(0x9E3779B1) + b.astype(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKET_BITS)
        bucket = bucket.astype(np.int64)
        stays = np.flatnonzero((np.bincount(bucket, minlength=1 << BUCKET_BITS) >= least).take(bucket))
        open_, a, b = open_.take(stays), a.take(stays), b.take(stays)
        code = a.astype(np.int64) << 32 | b
        code.sort()
        edge = np.flatnonzero(code[1:] != code[:-1]) + 1
        edge = np.concatenate(([0], edge)) if len(code) else edge
        counts = np.diff(np.append(edge, len(code)))
        often = counts >= least
        if not often.any():
            break
        chosen = _choose(code[edge[often]], counts[often], 1 << 32, per_round)
        seq, last, open_ = _replace(seq, last, open_, a, b, chosen, top)
        rules.append(chosen)
        top += len(chosen)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    sizes = np.zeros(len(table), np.int64)
    done = 0
    for part in rules:  # a rule's symbols are ids or older rules
        inner = np.where(part < base, 1, sizes[np.maximum(part - base, 0)])
        sizes[done : done + len(part)] = inner.sum(axis=1)
        done += len(part)
    return base, table, sizes, seq, np.flatnonzero(last) + 1


def reached(base: int, rules: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Which rules the symbols need; a rule's symbols are ids or older rules."""
    need = np.zeros(len(rules), bool)
    need[symbols[symbols >= base] - base] = True
    while True:  # one step per depth of the rules
        inner = rules[need]
        found = inner[inner >= base] - base
        if need[found].all():
            return need
        need[found] = True


def expansions(base: int, rules: np.ndarray, sizes: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the needed rules in a row, and where each begins."""
    begin = np.concatenate(([0], np.cumsum(np.where(need, sizes, 0))))
    out = np.zeros(begin[-1], np.uint32)
    plain = rules < base
    inner = np.where(plain, 0, rules - base)
    counts = np.where(plain, 1, sizes[inner]) if len(rules) else inner
    depth, deeper = None, np.zeros(len(rules), np.int64)
    while depth is None or (depth != deeper).any():
        depth, deeper = deeper, np.where(plain, 0, deeper[inner] + 1).max(axis=1, initial=0)
    for level in range(int(depth.max(initial=-1)) + 1):  # rules of ids alone first, then those made of them
        rows = np.flatnonzero(need & (depth == level))
        for side in (0, 1):
            at = begin[rows] + (counts[rows, 0] if side else 0)
            ids = plain[rows, side]
            out[at[ids]] = rules[rows[ids], side]
            older = inner[rows[~ids], side]
            text, n = gathered(out, begin[:-1], sizes, older)
            out[np.repeat(at[~ids] - np.cumsum(n) + n, n) + np.arange(len(text))] = text
    return out, begin[:-1]


def expand(symbols: np.ndarray, base: int, sizes: np.ndarray, text: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Ids of a run of symbols, given all rules' ``expansions``."""
    plain = symbols < base
    rule = np.where(plain, 0, symbols - base)
    if not len(sizes):
        return symbols.astype("<u4")
    values = np.concatenate((text, symbols.astype(np.uint32)))
    first = np.where(plain, len(text) + np.arange(len(symbols)), begin[rule])
    count = np.where(plain, 1, sizes[rule])
    return gathered(values, first, count, np.arange(len(symbols)))[0].astype("<u4")


def _shard(part: int, number: int, doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    base, rules, sizes, symbols, symbol_ends = compress(ids, ends)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    coder, narrow = zstandard.ZstdCompressor(level=1), symbols.astype(f"<u{width}")
    blocks = [coder.compress(narrow[at : at + BLOCK].tobytes()) for at in range(0, len(narrow), BLOCK)]
    row = {
        "part": part, "shard": number, "n_docs": len(ends), "n_tokens": len(ids), "n_symbols": len(symbols), "base": base,
        "width": width, "rules": rules.astype("<u4").tobytes(), "sizes": sizes.astype("<u4").tobytes(), "symbols": b"".join(blocks),
        "block_ends": np.cumsum([len(b) for b in blocks]).astype("<i8").tobytes(),
        "doc_ids": doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
        "nulls": np.packbits(doc_ids.is_null().to_numpy(zero_copy_only=False)).tobytes(),
        "token_ends": ends.astype("<i8").tobytes(), "symbol_ends": symbol_ends.astype("<i8").tobytes(),
    }
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SHARD.split(",")])
    return pa.RecordBatch.from_pylist([row], schema)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes whole texts and writes them as shards in ascending ``doc_id`` order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([h[1] for h in held])
            return _shard(part, number, pa.concat_arrays([h[0] for h in held]), ids, np.cumsum(np.concatenate([h[2] for h in held])))

        for batch in pieces(batches, "text"):
            ids, rows = encoder(batch.column("text"))
            ids = np.insert(ids, rows[1:], end_id).astype("<u4")
            counts = np.diff(rows) + 1
            held.append((batch.column("doc_id"), ids, counts))
            size += len(ids)
            if size >= shard_tokens:
                yield flush()
                held, size, number = [], 0, number + 1
        if held:
            yield flush()

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = chosen.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, SHARD).write.parquet(path)


def symbols_of(shard: dict, first: int, behind: int) -> np.ndarray:
    """The symbols ``first`` to ``behind`` of a shard's row; only their blocks are decompressed."""
    ends = np.concatenate(([0], np.frombuffer(shard["block_ends"], "<i8"))).tolist()
    coder, kind = zstandard.ZstdDecompressor(), f"<u{shard['width']}"
    blocks = range(first // BLOCK, -(-behind // BLOCK))
    parts = [np.frombuffer(coder.decompress(shard["symbols"][ends[b] : ends[b + 1]]), kind) for b in blocks]
    start = blocks.start * BLOCK
    return np.concatenate([np.zeros(0, kind), *parts]).astype(np.int64)[first - start : behind - start]


def expanded(shard: dict, symbols: np.ndarray) -> np.ndarray:
    """The ids of symbols; only the rules they reach are expanded."""
    base, rules = shard["base"], np.frombuffer(shard["rules"], "<u4").reshape(-1, 2).astype(np.int64)
    sizes = np.frombuffer(shard["sizes"], "<u4").astype(np.int64)
    return expand(symbols, base, sizes, *expansions(base, rules, sizes, reached(base, rules, symbols)))


def decode(shard: dict, first: int = 0, behind: int | None = None) -> list[np.ndarray]:
    """Ids of the documents ``first`` to ``behind`` of a shard's row; nothing outside them is expanded."""
    tokens = np.concatenate(([0], np.frombuffer(shard["token_ends"], "<i8")))
    places = np.concatenate(([0], np.frombuffer(shard["symbol_ends"], "<i8")))
    behind = shard["n_docs"] if behind is None else behind
    ids = expanded(shard, symbols_of(shard, int(places[first]), int(places[behind])))
    cuts = tokens[first : behind + 1] - tokens[first]
    return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def decode_range(shard: dict, doc: int, first: int, behind: int) -> np.ndarray:
    """Ids ``first`` to ``behind`` of one document, found by the expansion lengths of its symbols."""
    places = np.concatenate(([0], np.frombuffer(shard["symbol_ends"], "<i8")))
    symbols = symbols_of(shard, int(places[doc]), int(places[doc + 1]))
    sizes, rule = np.frombuffer(shard["sizes"], "<u4").astype(np.int64), symbols - shard["base"]
    lengths = np.ones(len(symbols), np.int64)
    lengths[rule >= 0] = sizes[rule[rule >= 0]]
    upto = np.cumsum(lengths)
    behind = min(behind, int(upto[-1]) if len(upto) else 0)
    if first >= behind:
        return np.zeros(0, "<u4")
    low, high = int(np.searchsorted(upto, first, "right")), int(np.searchsorted(upto, behind, "left")) + 1
    skipped = int(upto[low] - lengths[low])
    return expanded(shard, symbols[low:high])[first - skipped : behind - skipped]


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: start among all ids, number of ids and their checksum."""
    shards = spark.read.schema(SHARD).parquet(path)
    # parts follow each other in doc_id order, shards inside a part; one short row per write task is summed up in order
    sizes = shards.select("part", "shard", "n_tokens")
    inside = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)
    over = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(over) - F.col("n")).alias("before"))
    first = (
        sizes.withColumn("inner", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
        .join(parts, "part").select("part", "shard", (F.col("before") + F.col("inner")).alias("first"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in (row for i in range(len(batch)) for row in batch.slice(i, 1).to_pylist()):
                ends = np.frombuffer(shard["token_ends"], "<i8")
                counts, n = np.diff(ends, prepend=0), len(ends)
                null = np.unpackbits(np.frombuffer(shard["nulls"], np.uint8))[:n].astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, shard["part"]), pa.int32()),
                        pa.array(np.full(n, shard["shard"]), pa.int32()),
                        pa.array(np.frombuffer(shard["doc_ids"], "<i8"), pa.int64(), mask=null),
                        pa.array(ends - counts),
                        pa.array(counts),
                        pa.array([zlib.crc32(ids.tobytes()) for ids in decode(shard)], pa.int64()),
                    ],
                    names=["part", "shard", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    decoded = shards.mapInArrow(run, "part int, shard int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return decoded.join(first, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def store(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the documents to a new folder of the shared one, and returns what the files hold."""
    path = new_path(docs.sparkSession, "token-shards")
    write(docs, path, tokenizer, end_id)
    return digest(docs.sparkSession, path)
