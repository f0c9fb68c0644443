"""Context-tree scores against a plain recursion over dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from awkward_rows import prose
from pyspark.sql import functions as F

from gridloom.llm import context_tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def decisions(text, depth):
    """(context, latest byte first; node; bit) of each decision."""
    data = bytes(depth) + " ".join(words(text)).encode() + b"\0"
    for i in range(depth, len(data)):
        context = data[i - depth : i][::-1]
        for bit in range(8):
            yield context, 1 << bit | data[i] >> (8 - bit), data[i] >> (7 - bit) & 1


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)


def plain_scores(rows, depth):
    counts, below = defaultdict(lambda: [0, 0]), defaultdict(set)
    tokens, n_texts = Counter(), 0
    for doc_id, text in rows:
        if held(doc_id):
            continue
        n_texts += 1
        tokens.update(words(text))
        for context, node, bit in decisions(text, depth):
            for d in range(depth + 1):
                counts[context[:d], node][bit] += 1
                if d:
                    below[context[: d - 1], node].add(context[:d])
    weighted = {}
    for context, node in sorted(counts, key=lambda k: -len(k[0])):
        own = log_kt(*counts[context, node])
        if len(context) == depth:
            weighted[context, node] = own
        else:
            rest = sum(weighted[c, node] for c in below[context, node])
            top = max(own, rest)
            weighted[context, node] = top + math.log((math.exp(own - top) + math.exp(rest - top)) / 2)

    def probability(context, node, bit, d=0):
        if (context[:d], node) not in counts:
            return None if d else 0.5
        seen = counts[context[:d], node]
        own = (seen[bit] + 0.5) / (sum(seen) + 1)
        deeper = probability(context, node, bit, d + 1) if d < depth else None
        if deeper is None:
            return own
        stays = math.exp(log_kt(*seen) - weighted[context[:d], node]) / 2
        return stays * own + (1 - stays) * deeper

    n, v = sum(tokens.values()) + n_texts, len(tokens) + (n_texts > 0)
    out = []
    for doc_id, text in rows:
        c = [tokens[w] for w in words(text)] + [n_texts]
        base = sum(math.log10((x + 1) / (n + v + 1)) for x in c)
        score = sum(math.log10(probability(*d)) for d in decisions(text, depth))
        out.append((doc_id, held(doc_id), len(c), sum(x > 0 for x in c), n, base, score))
    return out


def scores(frame, **sizes):
    found = context_tree.score(frame, context_tree.fold(F.col("doc_id")) == 2, **sizes)
    return [tuple(r)[:7] for r in found.collect()]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("depth", [2, 3, 6])
def test_scores_equal_a_plain_recursion(spark, depth):
    rows = [(i, prose(i, 12 + i, 30) + (" Ünseen É" if i == 16 else "")) for i in range(30)]
    rows += [(30, None), (31, ""), (32, " \t\n"), (None, "No Id"), (3, "again"), (3, "again"), (33, "a\x00b"), (34, "x" * 300)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, batch string, kind string").repartition(3)
    same(scores(frame, depth=depth, batch_bytes=400), plain_scores(rows, depth))


def test_batches_and_buckets_do_not_change_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    same(scores(docs, batch_bytes=20_000, bucket_bytes=5_000), scores(docs))


def test_held_out_texts_are_better_than_by_words(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    found = [r for r in scores(docs) if r[1]]
    assert sum(r[6] for r in found) > sum(r[5] for r in found) * 1.1
    assert len(found) > 50


def test_empty_and_untrained(spark, awkward, nothing):
    assert scores(nothing) == []
    assert len(scores(awkward)) == awkward.count()
    alone = spark.createDataFrame([(i, "ab c") for i in range(100) if held(i)][:2], "doc_id bigint, text string")
    for row in scores(alone):
        assert row[2:5] == (3, 0, 0)
        assert row[5] == 0 and row[6] == pytest.approx(40 * math.log10(0.5))


def test_logarithms_of_rising_products():
    n = np.array([0, 1, 2, 50, 4095, 4096, 10_000, 10**9])
    assert context_tree.log_rising(n, False) == pytest.approx([math.lgamma(x + 1) for x in n], rel=1e-12)
    assert context_tree.log_rising(n, True) == pytest.approx([math.lgamma(x + 0.5) - math.lgamma(0.5) for x in n], rel=1e-12)


def test_the_probabilities_of_all_bytes_add_up_to_one():
    draw = np.random.default_rng(1)
    codes = np.unique(draw.integers(97, 101, (400, 4)) @ (256 ** np.arange(3, -1, -1)))
    tree = context_tree.levels(codes, draw.integers(1, 9, len(codes)), 3)
    top = context_tree.Level(*tree[-1].above())
    tree += [top, context_tree.Level(*top.above())]
    context = 98 << 24 | 99 << 16 | 97 << 8
    assert (10 ** context_tree.log10_codes(context | np.arange(256), tree, 3)).sum() == pytest.approx(1)
