"""Trie of conversation prefixes: ternary search trees per range shard, joined at their borders.

A turn is known by a digest of its role and text, a conversation by the digests of its turns in a row (16 bytes a turn). Conversations are
range-partitioned and sorted by these, equal ones in one range, so the members of a node are neighbours. Each task reads its range as
a stream and cuts it into blocks of about ``TURNS`` turns of different conversations. In a block the digests get codes from a sorted
dictionary, and the sequences go into a ternary search tree in the order of repeated medians, which keeps the tree
balanced. Nodes are numbered as they are made, so walking the numbers backward meets children before parents: one loop adds up members,
leaves and savings, without recursion.

Only nodes on a block's first and last sequence can go on in another block. These border nodes (two sequences a block, at most)
are combined by a digest of their prefix, and their sums climb from the deepest ones up; all others are finished
in their block and only ask a border parent for its smallest member.

Defined results: NULL roles and texts count as empty. Turns lie in the order of ``turn``, NULL first, ties by the digest. Rows with a
NULL ``conv_id`` belong to no conversation. Conversations without turns are members of the root alone. An empty table has no
node. Further columns are ignored. The ids of conversations that end at a node are hashed as they stream by in one task, since their order
matters; a conversation itself is one row of 16 bytes a turn and a word count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.repair import arrow, batched, rows
from gridloom.llm.sizes import MOST_KEYS
from gridloom.sources.workspace import cut

TURNS = 200_000
DIGEST = 16
ROOT = bytes(DIGEST)
WORD = r"[^\x20\x09-\x0D]+"

PARTS = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, turn binary, words bigint, key binary, parent_key binary"
)
BORDERS = "key binary, n_children bigint, n_leaves bigint, saved_tokens bigint"


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``turns`` of each conversation: hexadecimal digest and number of words, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return (
        conversations.where(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", code.alias("code"), F.regexp_count(text, F.lit(WORD)).alias("words"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "code", "words"))).alias("turns"))
        .withColumn("turns", F.transform("turns", lambda t: F.struct(t["code"].alias("code"), t["words"].alias("words"))))
    )


def rebuilt(lists: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Conversations whose first h turns, 0 to ``most`` by a checksum of the id, are those of the group's first id."""
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    heads = lists.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("group"), F.slice("turns", 1, most).alias("head")
    )
    own = lists.withColumn("group", F.col("conv_id") - F.col("conv_id") % every)
    none = F.expr("cast(array() as array<struct<code:string,words:int>>)")
    return own.join(heads, "group", "left").select(
        "conv_id",
        F.concat(
            F.slice(F.coalesce("head", none), F.lit(1), h),
            F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0))),
        ).alias("turns"),
    )


class Tree:
    """A ternary search tree: ``less``, ``equal`` and ``more`` links of numbered nodes; node 0 is the root of the trie."""

    def __init__(self):
        self.code, self.less, self.more, self.equal = [-1], [-1], [-1], [-1]
        self.parent, self.words, self.depth = [-1], [0], [0]

    def insert(self, codes: list[int], words: list[int]) -> int:
        """Number of the node the sequence ends at."""
        code, less, more, equal = self.code, self.less, self.more, self.equal
        node = 0
        for c, w in zip(codes, words):
            links, at, below = equal, node, equal[node]
            while below >= 0 and code[below] != c:
                links = less if c < code[below] else more
                at, below = below, links[below]
            if below < 0:
                below = links[at] = len(code)
                code.append(c)
                less.append(-1)
                more.append(-1)
                equal.append(-1)
                self.parent.append(node)
                self.words.append(w)
                self.depth.append(self.depth[node] + 1)
            node = below
        return node


def medians(n: int) -> Iterator[int]:
    """0 .. n - 1 so that each comes before the lower and the upper half it divides."""
    spans = [(0, n)]
    for low, high in spans:  # grows while it is read
        if low < high:
            middle = (low + high) // 2
            yield middle
            spans += [(low, middle), (middle + 1, high)]


def prefixes(path: bytes) -> list[bytes]:
    """A digest of every prefix of a sequence, the empty one first."""
    out = [ROOT]
    for at in range(0, len(path), DIGEST):
        out.append(hashlib.md5(out[-1] + path[at : at + DIGEST]).digest())
    return out


def block_nodes(block: list[tuple]) -> Iterator[tuple]:
    """Nodes of different sequences in sorted order; those of the first and the last are border nodes and have a key."""
    dictionary = np.unique(np.frombuffer(b"".join(path for path, *_ in block), f"V{DIGEST}"))
    place = {d.tobytes(): i for i, d in enumerate(dictionary)}
    tree, ends = Tree(), {}
    for i in medians(len(block)):
        path, words, n, conv, sha = block[i]
        codes = [place[path[a : a + DIGEST]] for a in range(0, len(path), DIGEST)]
        ends[tree.insert(codes, words)] = n, conv, sha
    keys = {}
    for path in {block[0][0], block[-1][0]}:
        node = 0
        for depth, key in enumerate(prefixes(path)):
            if depth:
                wanted = place[path[(depth - 1) * DIGEST : depth * DIGEST]]
                node = tree.equal[node]
                while tree.code[node] != wanted:
                    node = tree.less[node] if wanted < tree.code[node] else tree.more[node]
            keys[node] = key
    size = len(tree.code)
    members, least, children, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    for node in range(size - 1, -1, -1):
        if node in ends:
            n, conv, _ = ends[node]
            members[node] += n
            least[node] = conv if least[node] is None else min(conv, least[node])
        border = node in keys
        if not border:
            leaves[node] += not children[node]
            saved[node] += (members[node] - 1) * tree.words[node]
        up = tree.parent[node]
        if up >= 0:
            members[up] += members[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])
            if not border:
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
    nothing = hashlib.sha256().hexdigest()
    for node in range(size):
        up, border = tree.parent[node], node in keys
        sha = ends[node][2] if node in ends else None if border else nothing
        yield (
            least[node], tree.depth[node], least[up] if up >= 0 and up not in keys else None, members[node], children[node],
            leaves[node], saved[node], sha, dictionary[tree.code[node]].tobytes() if node else None, tree.words[node],
            keys.get(node), keys.get(up),
        )


def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of all blocks of a sorted range."""

    def found():
        block, size, path, words, n, first, sha = [], 0, None, None, 0, None, None
        for here, counts, conv in rows(batches):
            if here == path:
                n += 1
                sha.update(f",{conv}".encode())
                continue
            if path is not None:
                block.append((path, words, n, first, sha.hexdigest()))
                size += len(words) + 1
                if size >= TURNS:
                    yield from block_nodes(block)
                    block, size = [], 0
            path, words, n, first, sha = here, counts, 1, conv, hashlib.sha256(str(conv).encode())
        if path is not None:
            block.append((path, words, n, first, sha.hexdigest()))
            yield from block_nodes(block)

    yield from batched(found(), arrow(PARTS), most=8192)


def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of border nodes, deepest first: those of one depth wait for their parents."""

    def found():
        waiting: dict[bytes, list[int]] = {}
        for key, parent, n, words, children, leaves, saved in rows(batches):
            more = waiting.pop(key, (0, 0, 0))
            children, leaves, saved = children + more[0], leaves + more[1], saved + more[2] + (n - 1) * words
            leaves += not children
            if parent is not None:
                up = waiting.setdefault(parent, [0, 0, 0])
                up[0] += 1
                up[1] += leaves
                up[2] += saved
            yield key, children, leaves, saved

    yield from batched(found(), arrow(BORDERS), most=8192)


def trie(lists: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations' ``turns`` (structs of ``code`` and ``words``).

    ``conv_id`` is the smallest member, ``parent_conv_id`` that of the parent; ``n_leaves`` and ``saved_tokens`` cover the subtree; ``turn`` is
    the digest of the last turn, NULL for the root.
    """
    paths = lists.select(
        F.unhex(F.array_join(F.transform("turns", lambda t: t["code"]), "")).alias("path"),
        F.transform("turns", lambda t: t["words"].cast("int")).alias("words"),
        F.col("conv_id").cast("bigint").alias("conv_id"),
    )
    sorted_paths = paths.repartitionByRange("path").sortWithinPartitions("path", "conv_id")
    parts = cut(sorted_paths.mapInArrow(shard, PARTS), "trie")
    border = parts.where("key is not null")
    merged = (
        border.groupBy("key")
        .agg(
            F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"),
            F.max("turn").alias("turn"), F.max("words").alias("words"), F.max("parent_key").alias("parent_key"),
        )
    )
    merged = cut(merged, "borders")
    few = merged.count() <= MOST_KEYS
    sums = (
        merged.select("key", "parent_key", "n_convs", "words", "n_children", "n_leaves", "saved_tokens", "depth")
        .repartition(1).sortWithinPartitions(F.col("depth").desc()).drop("depth").mapInArrow(climb, BORDERS)
    )
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_least"))
    above = F.broadcast(above) if few else above
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn"]
    bordering = (
        merged.drop("n_children", "n_leaves", "saved_tokens").join(sums, "key")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
        .withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    )
    inner = parts.where("key is null")
    asking = inner.where("parent_key is not null").select(*names, "parent_key").union(bordering.select(*names, "parent_key"))
    answered = asking.join(above, "parent_key", "left").withColumn("parent_conv_id", F.col("parent_least"))
    return inner.where("parent_key is null").select(*names).union(answered.select(*names))
