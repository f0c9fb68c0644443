"""Near-duplicate documents by a multi-index Hamming join of b-bit minwise signatures.

A document's set holds the distinct shingles of its words (ASCII letters in lower case); a text with fewer words
than a shingle is one shingle as a whole. A signature is ``chunks`` x ``width`` minwise values of ``bits`` bits each.
Two signatures with at most ``chunks * (errors + 1) - 1`` different values have, by pigeonhole, a chunk with at most
``errors`` differences; so every chunk enters the index once per choice of ``errors`` values to leave out, and all
pairs under that distance share a key. With 6 chunks of 4 values and one error that is a distance of 11 of 24: a pair
at a similarity of 0.85 exceeds it with a probability below 0.0001. Links are confirmed on the full sets.

Documents with equal sets form one class, found by a 128-bit digest; only the class's smallest document enters the
index. Of each key, every document is first compared with the most connected one; what these links join need not be compared
any more. Keys whose documents lie in different components stay open: the pairs among their documents that can still
be links must share one of their rarest shingles (and enough behind it), and those are compared. So a group of N near
copies costs about N comparisons, and no link between components is lost.

Defined results: NULL texts and texts without words have an empty set, link with nothing and are kept. Rows that repeat a
``doc_id`` are one node: their sets all count for it, and each row gets the node's component. A NULL ``doc_id`` links with
nothing, has a NULL component and is kept. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.columns import hashed, mixed, pieces, words
from gridloom.llm.components import components
from gridloom.llm.sizes import only
from gridloom.sources.workspace import cut

CHUNKS, WIDTH, ERRORS, BITS = 6, 4, 1, 16
# Words of single-bit minwise values (one per range of the hash): a quick bound before the sets are read.
SKETCH_BITS = 256
WORDS = [f"bits{k + 1}" for k in range(SKETCH_BITS // 64)]
# Bits that say which of 512 ranges of a second hash a set reaches.
PRESENCE_BITS = 512
PRESENCE = [f"reach{k + 1}" for k in range(PRESENCE_BITS // 64)]
KEY_WIDTH = 1 << BITS


def shingled(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of the distinct shingles of each row, ordered by both."""
    rows, codes, distinct = words(pc.ascii_lower(pc.fill_null(column, "")))
    word, n = hashed(distinct)[codes], len(column)
    counts = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(n), made)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made) + first[owner]
    length = np.minimum(counts, size)[owner]
    out = length.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            inside = length > k
            out[inside] = mixed(out[inside] * np.uint64(0x9E3779B97F4A7C15) + word[at[inside] + k])
    order = np.argsort(out)
    order = order[np.argsort(owner[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    owner, out = owner[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], out[new]


def multipliers(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minwise(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each of ``n`` hash functions over the runs that begin at ``starts``."""
    out = np.empty((n, len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        for k, m in enumerate(multipliers(n)):
            x = values * m
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            np.minimum.reduceat(x, starts, out=out[k])
    return out


def digests(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Two words per row that stand for its set; 0 for an empty one."""
    out = np.zeros((2, n), np.int64)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    if len(starts):
        with np.errstate(over="ignore"):
            for k in range(2):
                turned = mixed(values + np.uint64(k + 1) * np.uint64(0xD1B54A32D192ED03))
                out[k, owner[starts]] = np.add.reduceat(turned, starts).view(np.int64)
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Set size, 128-bit digest of the set, signature and sketch of each document."""
    n_values = CHUNKS * WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            owner, values = shingled(batch.column("text"), size)
            n = len(batch)
            counts = np.bincount(owner, minlength=n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)
            full = np.flatnonzero(counts)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            sums = digests(owner, values, n)
            values_out = np.zeros((n, n_values), np.int32)
            bits = sketch(owner, values, n)
            if len(starts):
                least = minwise(values, starts, n_values)
                values_out[full] = (least >> np.uint64(40)).T.astype(np.int64) & (KEY_WIDTH - 1)
            flat = pa.array(values_out.ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts),
                    pa.array(sums[0]),
                    pa.array(sums[1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_values), flat),
                    *map(pa.array, bits),
                ],
                names=["doc_id", "n_shingles", "digest1", "digest2", "sig", *WORDS],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id bigint, n_shingles bigint, digest1 bigint, digest2 bigint, sig array<int>, {', '.join(f'{w} bigint' for w in WORDS)}"
    )


def sketch(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """One bit per row of the smallest value in each of 256 ranges of the hash, in words; 0 for an empty range."""
    out = np.zeros((len(WORDS), n), np.uint64)
    place = (values >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    head = np.flatnonzero(np.diff(owner * SKETCH_BITS + place, prepend=-1))  # values are ordered within a row
    place, row = place[head], owner[head]
    bit = (mixed(values[head]) & np.uint64(1)) << (place % 64).astype(np.uint64)
    for k in range(len(WORDS)):
        mine = place // 64 == k
        out[k] = np.bitwise_or.reduceat(np.append(bit[mine], np.uint64(0)), np.searchsorted(row[mine], np.arange(n)))
        out[k, np.bincount(row[mine], minlength=n) == 0] = 0
    return out.view(np.int64)


def presence(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The ranges of a hash that each row's set reaches, as bits in words."""
    out = np.zeros((len(PRESENCE), n), np.uint64)
    place = (mixed(values ^ np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - PRESENCE_BITS.bit_length() + 1)).astype(np.int64)
    np.bitwise_or.at(out, (place // 64, owner), np.uint64(1) << (place % 64).astype(np.uint64))
    return out.view(np.int64)


def keys(classes: DataFrame) -> DataFrame:
    """Index rows: one per chunk and choice of values to leave out."""
    choices = list(combinations(range(WIDTH), WIDTH - ERRORS))

    def key(chunk: int, number: int, kept: tuple[int, ...]) -> Column:
        out = F.lit(chunk * len(choices) + number).cast("bigint")
        for k in kept:
            out = out * KEY_WIDTH + F.element_at("sig", chunk * WIDTH + k + 1)
        return out

    every = F.array(*(key(c, i, kept) for c in range(CHUNKS) for i, kept in enumerate(choices)))
    return classes.select("doc_id", "n_shingles", "digest1", *WORDS, F.explode(every).alias("key"))


def close(percent: int) -> Column:
    """A bound for pairs of the wanted similarity, by set sizes and sketches.

    A shingle that only one set has changes one bit of the sketch at most, which bounds small sets exactly. Of large sets at
    similarity t a bit differs with probability (1 - t) / 2; six standard deviations more have a probability below 1e-8.
    """
    differ = F.lit(0)
    for w in WORDS:
        differ = differ + F.bit_count(F.col(f"l.{w}").bitwiseXOR(F.col(f"r.{w}")))
    small, large = F.least("l.n_shingles", "r.n_shingles"), F.greatest("l.n_shingles", "r.n_shingles")
    p = (100 - percent) / 200
    limit = SKETCH_BITS * p + 6 * math.sqrt(SKETCH_BITS * p * (1 - p))
    return (100 * small >= percent * large) & (differ <= limit) & (differ * (100 + percent) <= (small + large) * (100 - percent))


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Digest and full set of the documents named by ``ids``, made anew from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            owner, values = shingled(batch.column("text"), size)
            n = len(batch)
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(digests(owner, values, n)[0]),
                    *map(pa.array, presence(owner, values, n)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64))),
                ],
                names=["doc_id", "digest1", *PRESENCE, "shingles"],
            )

    chosen = only(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ids, "doc_id")
    words = ", ".join(f"{w} bigint" for w in PRESENCE)
    return chosen.mapInArrow(run, f"doc_id bigint, digest1 bigint, {words}, shingles array<bigint>")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of each set that also others have, with their place in the order from rare to common.

    Two sets whose similarity reaches ``percent`` share a shingle among the rarest ``100 - percent`` of a hundred (and one more) of the larger
    set. Shingles are counted over the sets given.
    """
    spread = sets.select("doc_id", "digest1", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    counts = spread.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    ranked = spread.join(counts, "shingle", "left").groupBy("doc_id", "digest1", "n").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "shingle"))).alias("order")
    )  # one set each
    head = F.slice("order", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    return ranked.select("doc_id", "digest1", "n", F.posexplode(head).alias("place", "entry")).where("entry.often > 1").select(
        "doc_id", "digest1", "n", "place", F.col("entry.shingle").alias("shingle")
    )


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ids = pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("doc_id"))
    sets = shingle_sets(docs, ids, size)
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(right, "b").join(left, "a")
        .where(100 * common >= percent * (F.size("sa") + F.size("sb") - common))
        .select("a", "b").distinct()
    )


def link(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents link where ``100 * |intersection| >= percent * |union|``.
    """
    marked = cut(signatures(docs, size), "signatures")
    filled = marked.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = filled.groupBy("digest1", "digest2", "n_shingles").agg(F.min("doc_id").alias("first"))
    members = filled.join(classes, ["digest1", "digest2", "n_shingles"]).select("doc_id", "first")
    equal = members.where("doc_id != first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    picked = filled.join(
        classes.select("digest1", "digest2", "n_shingles", F.col("first").alias("doc_id")),
        ["digest1", "digest2", "n_shingles", "doc_id"], "left_semi",
    ).dropDuplicates(["doc_id", "digest1", "digest2"])
    index = keys(picked)
    shared = index.groupBy("key").agg(F.min("doc_id").alias("p"), F.max("doc_id").alias("q")).where("p != q").select("key")
    index = cut(index.join(shared, "key", "left_semi"), "index")

    # a key's centre is the document that shares most keys with most others
    crowd = index.groupBy("key").agg(F.count("*").alias("n"))
    degree = index.select("key", "doc_id").join(crowd, "key").groupBy("doc_id").agg(F.sum("n").alias("degree"))
    centres = index.select("key", "doc_id").join(degree, "doc_id").groupBy("key").agg(F.max(F.struct("degree", "doc_id")).alias("c"))
    centres = centres.select("key", F.col("c.doc_id").alias("centre"))
    head = (
        index.join(centres, "key").where("doc_id = centre").select("key", "n_shingles", *WORDS, "doc_id")
        .dropDuplicates(["key", "doc_id", *WORDS])
    )
    stars = (
        index.alias("l")
        .join(head.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.doc_id") != F.col("r.doc_id")) & close(percent))
        .select(F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b")).distinct()
    )
    stars = cut(stars, "stars")
    found = cut(confirmed(stars, docs, size, percent), "links")

    # what lies in different components is compared pair by pair, unless shingles of its own rule a link out
    parts = components(found)
    placed = index.join(parts, index["doc_id"] == parts["node"], "left").select(
        index["*"], F.coalesce("root", "doc_id").alias("part")
    )
    mixed_keys = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q")
    placed = cut(placed.join(mixed_keys.select("key"), "key", "left_semi"), "open")
    opened = placed.select("doc_id", "digest1", "n_shingles", *WORDS, "part").distinct()
    sets = cut(shingle_sets(docs, opened.select("doc_id").distinct(), size), "sets")
    known = opened.join(sets.select("doc_id", "digest1", *PRESENCE).distinct(), ["doc_id", "digest1"])
    rare = cut(prefixes(sets, percent).join(known, ["doc_id", "digest1"]), "rare")
    # a range that only one of two sets reaches holds a shingle that only this one has
    differ = sum((F.bit_count(F.col(f"l.{w}").bitwiseXOR(F.col(f"r.{w}"))) for w in PRESENCE), F.lit(0))
    apart = differ * (100 + percent) > (F.col("l.n") + F.col("r.n")) * (100 - percent)
    # how many shingles a pair must share, and how many it still can from its first common one on
    needed = F.ceil((F.col("l.n") + F.col("r.n")) * percent / (100 + percent))
    can = F.least(F.col("l.n") - F.col("l.place"), F.col("r.n") - F.col("r.place"))
    larger = (F.col("l.n") > F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.doc_id") > F.col("r.doc_id")))
    rest = (
        rare.alias("l").join(
            rare.alias("r"),
            (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.part") != F.col("r.part")) & larger & (can >= needed) & close(percent) & ~apart,
        )
        .select(F.greatest("l.doc_id", "r.doc_id").alias("a"), F.least("l.doc_id", "r.doc_id").alias("b")).distinct()
    )
    tried = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rest = cut(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
    more = confirmed(rest, docs, size, percent)
    roots = components(found.union(more).union(equal))
    joined = marked.join(roots, marked["doc_id"] == roots["node"], "left")
    component = F.coalesce("root", "doc_id")
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
