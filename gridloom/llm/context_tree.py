"""Language-model scores by context-tree weighting over bytes.

A text is read as its words in lower case (A-Z), one blank between them and a zero byte at the end. Each byte is eight binary decisions, a
path through the 255 inner nodes of a binary tree; every node of it has its own tree of contexts, the bytes before, latest first, down to
``DEPTH`` of them (zero bytes before the text). At a context the decisions seen there, a zeros and b ones, have the
Krichevsky-Trofimov probability P(a, b); the weighted probability of a context is the mean of P and of the product over its longer
contexts, or P alone at the last depth. So all depths are mixed, and the part of a context that stays with its own estimate is
P / (2 Pw). The tree is learned once from all training texts; then a decision's probability is mixed along the path of its
contexts with these parts, down to the deepest one that training texts hold. Its logarithms sum up to the score; over the bytes, the
code length per byte.

On Spark, texts are gathered into batches of some MB, written with the different (context, byte) codes and words of each batch,
dealt to buckets by the two latest bytes of the context (words by their hash). Buckets add up the training counts of all batches, so the model
grows with the corpus and lies in the shared folder, a bucket a row; only the first two depths, at most 256 * 255 + 255 nodes, pass the driver.
A bucket then answers the codes of every batch, and a batch adds up its texts' scores. A task holds one batch or one bucket at a time.

Base score: sum over the words and one end of ``log10((c + 1) / (N + V + 1))`` by counts in training texts. Words are known by a 64-bit hash.

Defined results: NULL and empty texts are the end alone. A row with a NULL ``doc_id`` is scored like any other. Without training texts every decision
is even and the base score is 0. A zero byte inside a word counts like any other byte. Rows are scored one by one, repeated or not; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.columns import LOWER_CASE, SPACE, coded, flat, give_back, hashed, mixed, pieces, rows_of, spans
from gridloom.sources.workspace import cut

DEPTH = 6
BATCH_BYTES = 8_000_000
BUCKET_BYTES = 16_000_000

TEXTS, CODES, WORDS, TOP = 0, 1, 2, 3
KEPT = {CODES: np.float32, WORDS: np.float64}  # of an answer: seven digits of a logarithm, a whole count
BATCHES = "kind int, batch bigint, bucket int, keys binary, counts binary, docs binary, flags binary, sizes binary, body binary"
MODEL = "kind int, bucket int, keys binary, counts binary, total bigint, distinct bigint, node bigint, zeros bigint, ones bigint, below double"
ANSWERS = "kind int, batch bigint, bucket int, answers binary"
SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, "
    "n_bytes bigint, bits_per_byte double"
)


def record(fields: str, **values) -> pa.RecordBatch:
    """One row with NULL in the columns not given."""
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    names, kinds = zip(*(f.split() for f in fields.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], types[k]) for n, k in zip(names, kinds)], names=list(names))


def packed(values: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes first, then all second ones, compressed."""
    columns = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(columns.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    columns = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(columns.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return packed(np.diff(keys, prepend=np.int64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.int64))


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts as the model reads them, end included, and the offsets of the texts."""
    data, offsets = flat(column)
    starts, ends = spans(data, offsets)
    row = rows_of(starts, offsets)
    n = len(offsets) - 1
    empty = np.setdiff1d(np.arange(n), row)
    order = np.argsort(np.concatenate((row, empty)), kind="stable")
    row = np.concatenate((row, empty))[order]
    sizes = np.concatenate((ends - starts, np.zeros(len(empty), np.int64)))[order]
    behind = np.cumsum(sizes + 1)  # of each word and the byte after it
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    out = np.zeros(int(behind[-1]) if len(behind) else 0, np.uint8)
    separator = np.zeros(len(out), bool)
    separator[behind - 1] = True
    delta = np.zeros(len(data) + 1, np.int8)
    delta[starts] += 1
    delta[ends] -= 1
    out[~separator] = LOWER_CASE[data[np.cumsum(delta[:-1], dtype=np.int8).view(bool)]]
    out[behind[~last] - 1] = 32
    return out, np.concatenate(([0], behind[last]))


def coded_bytes(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """For each byte the ``depth`` bytes before it, latest first, and the byte itself, as one number."""
    out = np.zeros(len(data), np.int64)
    for back in range(1, depth + 1):
        out <<= 8
        out[back:] |= data[:-back]
    for inside in range(depth):  # nothing of the text before
        at = offsets[:-1] + inside
        at = at[at < offsets[1:]]
        out[at] &= ~((1 << 8 * (depth - inside)) - 1)
    out <<= 8
    out |= data
    return out


def counted_codes(data: np.ndarray, offsets: np.ndarray, depth: int, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes in order, and how often each is in the texts to learn from."""
    codes = coded_bytes(data, offsets, depth)
    codes <<= 1
    codes |= np.repeat(learned, np.diff(offsets))
    codes.sort()
    first = np.flatnonzero(np.append(True, codes[1:] >> 1 != codes[:-1] >> 1))
    upto = np.cumsum(codes & 1)
    return codes[first] >> 1, np.diff(upto[np.append(first[1:], len(codes)) - 1], prepend=0)


def placed_codes(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of each byte's code among the different ones, and these."""
    found = pa.array(coded_bytes(data, offsets, depth)).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_numpy(zero_copy_only=False)


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and place of each word, and the hashes of the different words."""
    inside = ~SPACE[data]
    inside[offsets[1:] - 1] = False
    starts, ends = spans(data, offsets, inside)
    places, words = coded(data, starts, ends)
    return rows_of(starts, offsets), places, hashed(words).view(np.int64)


def bucket_of(keys: np.ndarray, kind: int, depth: int, buckets: int) -> np.ndarray:
    """Bucket of each key: by the two latest bytes of a context, or by a word's hash."""
    top = keys >> np.int64(8 * (depth - 1)) if kind == CODES else keys
    return (mixed(top.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def dealt(keys: np.ndarray, kind: int, depth: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by bucket and size, and where each bucket starts."""
    order = np.argsort(keys)
    bucket = bucket_of(keys[order], kind, depth, buckets)
    return order[np.argsort(bucket, kind="stable")], np.searchsorted(np.sort(bucket), np.arange(buckets + 1))


def gather(depth: int, buckets: int, batch_bytes: int):
    """Batches of texts, their codes and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        part = TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            ids = pa.concat_arrays([h[0] for h in held])
            flags = np.concatenate([h[1] for h in held])
            data = np.concatenate([h[2] for h in held])
            sizes = np.concatenate([h[3] for h in held])
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            batch = part * 2**32 + number
            yield record(
                BATCHES, kind=TEXTS, batch=batch, bucket=-1, docs=ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes(),
                flags=(flags | ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8) << 1).tobytes(),
                sizes=sizes.tobytes(), body=zstandard.ZstdCompressor(level=3).compress(data.tobytes()),
            )
            learned = flags == 0
            yield from shares(CODES, batch, *counted_codes(data, offsets, depth, learned))
            row, places, words = distinct_words(data, offsets)
            yield from shares(WORDS, batch, words, np.bincount(places, learned[row], len(words)).astype(np.int64))

        def shares(kind: int, batch: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            order, first = dealt(keys, kind, depth, buckets)
            for b in range(buckets):
                some = order[first[b] : first[b + 1]]
                if len(some):
                    yield record(BATCHES, kind=kind, batch=batch, bucket=b, keys=packed_keys(keys[some]), counts=packed(counts[some]))

        for batch in pieces(batches, "text"):
            data, offsets = normalised(batch.column("text"))
            flags = batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8)
            held.append((batch.column("doc_id"), flags, data, np.diff(offsets)))
            size += len(data)
            if size >= batch_bytes:
                yield from flush()
                held, size, number = [], 0, number + 1
                give_back()
        if held:
            yield from flush()
        give_back()

    return run


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sum of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


HALVES = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 4096) - 0.5))))
WHOLES = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 4096)))))


def log_rising(n: np.ndarray, half: bool) -> np.ndarray:
    """Logarithm of n!, or of 1/2 * 3/2 * ... * (n - 1/2); exact to some 1e-12 beyond the table."""
    n = np.asarray(n, np.float64)
    table = HALVES if half else WHOLES
    x = np.maximum(n, len(table)) + (0.5 if half else 1.0)
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < len(table), table[np.minimum(n, len(table) - 1).astype(np.int64)], series - (0.5 * np.log(np.pi) if half else 0.0))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence of so many zeros and ones."""
    return log_rising(zeros, True) + log_rising(ones, True) - log_rising(zeros + ones, False)


class Level:
    """Decisions at the contexts of one depth: sorted numbers ``context << 8 | node``, counts, and the part that stays."""

    def __init__(self, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.nodes, self.zeros, self.ones = nodes, zeros, ones
        own = log_kt(zeros, ones)
        self.weighted = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.stays = np.ones(len(nodes)) if below is None else np.exp(own - np.log(2) - self.weighted)

    def above(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes one depth up: their numbers, counts and the sum of these weighted logarithms."""
        up = self.nodes >> 16 << 8 | self.nodes & 255
        nodes, place = np.unique(up, return_inverse=True)
        return nodes, *(np.bincount(place, v, len(nodes)) for v in (self.zeros, self.ones, self.weighted))


def deepest(codes: np.ndarray, counts: np.ndarray) -> Level:
    """Decisions of counted codes at their full contexts."""
    nodes, zeros, ones = [], [], []
    byte = codes & 255
    for bit in range(8):  # codes are sorted, so equal nodes are neighbours
        node = codes >> 8 << 8 | (1 << bit) | byte >> (8 - bit)
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
        one = byte >> (7 - bit) & 1
        nodes.append(node[first])
        zeros.append(np.add.reduceat(counts * (1 - one), first) if len(first) else first)
        ones.append(np.add.reduceat(counts * one, first) if len(first) else first)
    nodes = np.concatenate(nodes)
    order = np.argsort(nodes, kind="stable")
    return Level(nodes[order], np.concatenate(zeros)[order].astype(np.float64), np.concatenate(ones)[order].astype(np.float64), None)


def levels(codes: np.ndarray, counts: np.ndarray, depth: int) -> list[Level]:
    """Depths ``depth`` to 2 of a bucket, which holds all of their contexts that have codes in it."""
    out = [deepest(codes, counts)]
    for _ in range(depth - 2):
        out.append(Level(*out[-1].above()))
    return out


def log10_codes(codes: np.ndarray, tree: list[Level], depth: int) -> np.ndarray:
    """log10 of the probability of each code's byte after its context; ``tree`` begins with the deepest level."""
    total = np.zeros(len(codes))
    byte = codes & 255
    for bit in range(8):
        one = (byte >> (7 - bit) & 1).astype(bool)
        node = (1 << bit) | byte >> (8 - bit)
        p, deeper = np.full(len(codes), 0.5), np.zeros(len(codes), bool)
        for up, level in enumerate(tree):
            if not len(level.nodes):
                continue
            wanted = codes >> np.int64(8 * (up + 1)) << 8 | node
            at = np.minimum(np.searchsorted(level.nodes, wanted), len(level.nodes) - 1)
            there = level.nodes[at] == wanted
            zeros, ones = level.zeros[at], level.ones[at]
            own = (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1)
            stays = np.where(deeper, level.stays[at], 1.0)
            p = np.where(there, stays * own + (1 - stays) * p, p)
            deeper |= there
        total += np.log10(p)
    return total


def learn(depth: int, most: int = 4_000_000):
    """Training counts of each bucket, and what its contexts add to the first depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

        def flush() -> Iterator[pa.RecordBatch]:
            kind, bucket = at
            keys, counts = merged()
            yield record(
                MODEL, kind=kind, bucket=bucket, keys=packed_keys(keys), counts=packed(counts), total=int(counts.sum()), distinct=len(keys)
            )
            if kind == CODES and len(keys):
                nodes, zeros, ones, below = levels(keys, counts, depth)[-1].above()
                n = len(nodes)
                none = pa.nulls(n, pa.binary())
                columns = [
                    pa.array(np.full(n, TOP, np.int32)), pa.array(np.full(n, bucket, np.int32)), none, none, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                    pa.array(nodes), pa.array(zeros.astype(np.int64)), pa.array(ones.astype(np.int64)), pa.array(below),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in MODEL.split(", ")])

        for row in each_row(batches):
            here = row["kind"], row["bucket"]
            if here != at:
                if held:
                    yield from flush()
                at, held, size = here, [], 0
            keys, counts = unpacked_keys(row["keys"]), unpacked(row["counts"], np.int64)
            seen = counts > 0
            held.append((keys[seen], counts[seen]))
            size += len(held[-1][0])
            if size > most and len(held) > 1:
                held = [merged()]
                size = len(held[0][0]) // 2
        if held:
            yield from flush()

    return run


def answer(depth: int, top: list[Level]):
    """Values of the keys of every batch: log10 probabilities of codes, training counts of words. A bucket's model comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, values, tree = None, np.zeros(0, np.int64), np.zeros(0), top
        for row in each_row(batches):
            here = row["kind"], row["bucket"]
            if here != at:
                at, keys, values, tree = here, np.zeros(0, np.int64), np.zeros(0), top
            wanted = unpacked_keys(row["keys"])
            if row["batch"] is None:
                keys, values = wanted, unpacked(row["counts"], np.int64).astype(np.float64)
                if row["kind"] == CODES and len(keys):
                    tree = levels(keys, values.astype(np.int64), depth) + top
                    values = np.concatenate([log10_codes(keys[i : i + 65536], tree, depth) for i in range(0, len(keys), 65536)])
                continue
            place = np.searchsorted(keys, wanted)
            known = np.zeros(len(wanted), bool)
            if len(keys):
                place = np.minimum(place, len(keys) - 1)
                known = keys[place] == wanted
            out = np.zeros(len(wanted))
            out[known] = values[place[known]]
            if row["kind"] == CODES and not known.all():
                out[~known] = log10_codes(wanted[~known], tree, depth)
            yield record(ANSWERS, kind=row["kind"], batch=row["batch"], bucket=row["bucket"], answers=packed(out.astype(KEPT[row["kind"]])))

    return run


def add_up(depth: int, buckets: int, texts: int, tokens: int, distinct: int):
    """Scores of the texts of each batch; its texts come first, then its answers by kind and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, answers = None, {CODES: [], WORDS: []}

        def flush() -> Iterator[pa.RecordBatch]:
            docs, flags = np.frombuffer(held["docs"], np.int64), np.frombuffer(held["flags"], np.uint8)
            sizes = np.frombuffer(held["sizes"], np.int64)
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(held["body"]), np.uint8)

            def by_place(kind: int, keys: np.ndarray) -> np.ndarray:
                out = np.zeros(len(keys))
                out[dealt(keys, kind, depth, buckets)[0]] = np.concatenate([np.zeros(0), *answers[kind]])
                return out

            places, codes = placed_codes(data, offsets, depth)
            score = np.add.reduceat(by_place(CODES, codes)[places], offsets[:-1])
            del places, codes
            row, places, words = distinct_words(data, offsets)
            counts = by_place(WORDS, words)[places]
            n = len(docs)
            n_tokens = np.bincount(row, minlength=n) + 1
            known = np.bincount(row, counts > 0, n).astype(np.int64) + (texts > 0)
            base = np.bincount(row, np.log10(counts + 1), n) + np.log10(texts + 1) - n_tokens * np.log10(tokens + distinct + 1)
            columns = [
                pa.array(docs, mask=flags & 2 != 0), pa.array(flags & 1 != 0), pa.array(n_tokens.astype(np.int64)), pa.array(known),
                pa.array(np.full(n, tokens, np.int64)), pa.array(base), pa.array(score), pa.array(sizes), pa.array(-score * np.log2(10) / sizes),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCORES.split(", ")])

        for row in each_row(batches):
            if row["kind"] == TEXTS:
                if held is not None:
                    yield from flush()
                    give_back()
                held, answers = row, {CODES: [], WORDS: []}
            else:
                answers[row["kind"]].append(unpacked(row["answers"], KEPT[row["kind"]]))
        if held is not None:
            yield from flush()

    return run


def top_levels(rows: list) -> list[Level]:
    """Depths 1 and 0 from the sums of all buckets (at most 256 * 255 rows)."""
    if not rows:
        return []
    node, zeros, ones, below = (np.array(c) for c in zip(*sorted(tuple(r) for r in rows)))
    first = Level(node.astype(np.int64), zeros.astype(float), ones.astype(float), below.astype(float))
    return [first, Level(*first.above())]


def fold(doc_id: Column, of: int = 7) -> Column:
    """Unsigned checksum of an id as text, NULL as empty, modulo ``of``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Scores of all texts by a model of those that are not ``held_out``; ``bits_per_byte`` is the code length per byte.

    ``depth`` is at least 2 and at most 6. The sizes of batches and buckets decide on memory alone.
    """
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, size // bucket_bytes + 1)
    gathered = cut(read.mapInArrow(gather(depth, buckets, batch_bytes), BATCHES), "batches")
    asked = gathered.where(F.col("kind") != TEXTS)
    model = cut(
        asked.select("kind", "bucket", "keys", "counts").repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(learn(depth), MODEL),
        "context-tree",
    )
    sums = model.where(F.col("kind") == TOP).groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below"))
    top = top_levels(sums.collect())
    words = model.where(F.col("kind") == WORDS).agg(F.sum("total"), F.sum("distinct")).first()
    texts = read.where(~F.col("held_out")).count()
    tokens, distinct = (words[0] or 0) + texts, (words[1] or 0) + (texts > 0)
    known = model.where(F.col("kind") != TOP).select("kind", F.lit(None).cast("bigint").alias("batch"), "bucket", "keys", "counts")
    answers = (
        known.union(asked.select("kind", "batch", "bucket", "keys", F.lit(None).cast("binary")))
        .repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "batch").mapInArrow(answer(depth, top), ANSWERS)
    )
    none = F.lit(None).cast("binary")
    bodies = gathered.where(F.col("kind") == TEXTS).select("kind", "batch", "bucket", none.alias("answers"), "docs", "flags", "sizes", "body")
    together = bodies.union(answers.select("kind", "batch", "bucket", "answers", none, none, none, none))
    return (
        together.repartition("batch").sortWithinPartitions("batch", "kind", "bucket")
        .mapInArrow(add_up(depth, buckets, texts, tokens, distinct), SCORES)
    )
