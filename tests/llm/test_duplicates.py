"""Components, near-duplicates, duplicate lines, edit distances and benchmark matching against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from awkward_rows import AWKWARD, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, line_dedup, near_dedup
from gridloom.llm.components import components
from gridloom.llm.edits import find, pattern_bits, within
from gridloom.sources import workspace


def forest(nodes, links):
    above = {n: n for n in nodes}

    def root(n):
        while above[n] != n:
            n = above[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        above[b] = a
    return root


def test_components_of_chains_stars_and_odd_links(spark):
    draw = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(7, 7), (3, 2), (2, 3), (3, 2)]
    links += [(draw.randrange(1000, 1100), draw.randrange(1000, 1100)) for _ in range(70)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links + [(None, 5), (6, None)], "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if a != b]
    root = forest({n for p in real for n in p}, real)
    assert got == {n: root(n) for p in real for n in p}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingles(text, size):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < size:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(zip(*(found[k:] for k in range(size))))


def plain_components(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    links = []
    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            both = len(s & t)
            if a is not None and b is not None and both and 100 * both >= percent * (len(s) + len(t) - both):
                links.append((a, b))
    return forest({i for i, _ in rows if i is not None}, links), sets


def edited(text, seed, rate):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(10**6)}" if draw.random() < rate else w for w in text.split(" "))


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, size, percent):
    rows = []
    for base in range(12):
        text = prose(base, 40 + 25 * base)
        rows += [(len(rows) + 3 * base, text)]
        for k in range(14):
            rows.append((len(rows) + 3 * base, edited(text, 100 * base + k, 0.004 * k)))
    rows += [(i + 10_000, prose(i + 900, 5 + i % 60)) for i in range(120)] + [(20_000, "A b"), (20_001, "a B"), (20_002, "a b c"), (9_999, "a b")]
    random.Random(1).shuffle(rows)
    root, sets = plain_components(rows, size, percent)
    got = {r.doc_id: r for r in near_dedup.link(spark.createDataFrame(rows, "doc_id bigint, text string"), size, percent).collect()}
    for i, s in sets:
        assert (got[i].component_id, got[i].n_shingles, got[i].kept) == (root(i), len(s), root(i) == i)


def test_near_duplicates_of_awkward_documents(awkward, nothing):
    got = near_dedup.link(awkward, 3, 85).collect()
    root, _ = plain_components(AWKWARD, 3, 85)
    want = Counter((i, len(shingles(t, 3)), None if i is None else root(i), i is None or root(i) == i) for i, t in AWKWARD)
    assert Counter(map(tuple, got)) == want
    assert near_dedup.link(nothing).count() == 0


def test_signatures_within_the_distance_share_a_key():
    """Pigeonhole: two signatures with at most 11 different values of 24 agree on a key."""
    from itertools import combinations

    draw = random.Random(2)
    most = near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1
    for _ in range(300):
        wrong = set(draw.sample(range(24), most))
        assert any(
            not wrong & {c * near_dedup.WIDTH + k for k in kept}
            for c in range(near_dedup.CHUNKS)
            for kept in combinations(range(near_dedup.WIDTH), near_dedup.WIDTH - near_dedup.ERRORS)
        )


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 5))
def test_banded_distance(a, b, k):
    d = distance(a, b)
    assert within(a, b, k) == (d if d <= k else None)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=8), st.text("ab", max_size=20))
def test_pattern_inside_a_text(pattern, text):
    best = min([distance(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1)])
    got = find(pattern_bits(pattern), len(pattern), text, len(pattern))
    assert got is not None and got[0] == best
    assert best == len(pattern) or any(distance(pattern, text[i : got[1]]) == best for i in range(got[1] + 1))


def plain_lines(rows, max_edits, min_words, min_near):
    """What stays of each document, by comparing all pairs of lines."""
    lines = []
    for i, t in rows:
        for k, line in enumerate([] if t is None else t.split("\n")):
            line = line.strip(" \t\r\x0b\x0c")
            if len(re.findall(r"[^\x20\x09-\x0D]+", line)) >= min_words:
                lines.append((i, k, line))
    distinct = sorted({x for _, _, x in lines})
    far = [x for x in distinct if len(x) >= min_near]
    links = [(x, y) for n, x in enumerate(far) for y in far[:n] if abs(len(x) - len(y)) <= max_edits and distance(x, y) <= max_edits]
    root = forest(distinct, links)
    first = {}
    for i, k, x in sorted(lines, key=lambda r: (r[0], r[1])):
        first.setdefault(root(x), (i, k))
    gone = defaultdict(set)
    for i, k, x in lines:
        if first[root(x)] != (i, k):
            gone[i].add(k)
    return {i: (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i])) for i, t in rows}


def changed(line, seed, edits):
    draw, out = random.Random(seed), list(line)
    for _ in range(edits):
        at, kind = draw.randrange(len(out)), draw.randrange(3)
        if kind == 0:
            out[at] = draw.choice("xyz")
        elif kind == 1:
            out.insert(at, draw.choice("xyz"))
        else:
            del out[at]
    return "".join(out)


@pytest.mark.parametrize("max_edits", [1, 2])
def test_lines_equal_all_pairs(spark, max_edits):
    draw = random.Random(max_edits)
    pool = [prose(k, 6 + k % 9).replace("\n", " ") for k in range(12)]
    crowd = [changed(pool[0], 50 + k, 1) for k in range(60)]  # many lines that share keys
    rows = []
    for i in range(40):
        own = [prose(1000 + 7 * i + k, 5 + k).replace("\n", " ") for k in range(3)]
        shared = [changed(draw.choice(pool), draw.randrange(10**6), draw.randrange(max_edits + 2)) for _ in range(2)]
        rows.append((i, "\n".join(own + shared + draw.sample(crowd, 3) + ["a b", " padded  line here \t", "é" * 50 + f" x y{i % 2}"])))
    want = plain_lines(rows, max_edits, 3, 20)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in line_dedup.dedup(docs, max_edits, 3, 20, crowd=5).collect()}
    assert {i: (r.text, r.n_removed) for i, r in got.items()} == want
    assert all((r.n_removed == 0) == (not r.first_docs) for r in got.values())


def test_growing_budget_equals_all_pairs(spark):
    """A budget of five edits per hundred characters, for lines of every length."""
    draw = random.Random(9)
    pool = [prose(k, 2 + 3 * k).replace("\n", " ") for k in range(1, 14)]
    pool += ["a common passage that is in very many of the lines " * 3 + prose(40 + k, 4).replace("\n", " ") for k in range(4)]
    rows = []
    for i in range(60):
        lines = [changed(x, draw.randrange(10**6), draw.randrange(int(0.05 * len(x)) + 3)) for x in draw.sample(pool, 5)]
        lines += ["a common passage that is in very many of the lines " * draw.randrange(1, 4) + prose(500 + i, 5).replace("\n", " "), "short line here"]
        rows.append((i, "\n".join([*lines, prose(100 + i, 6).replace("\n", " "), "a b c d", "é" * 30 + f" x y{i}"])))
    texts = sorted({line.strip(" \t\r") for _, t in rows for line in t.split("\n") if len(line.split()) >= 3})
    links = []
    for n, x in enumerate(texts):
        for y in texts[:n]:
            k = int(0.05 * min(len(x), len(y)))
            if k and abs(len(x) - len(y)) <= k and within(x, y, k) is not None:
                links.append((x, y))
    assert any(1 < distance(x, y) for x, y in links[:50]) and any(min(len(x), len(y)) < 40 for x, y in links)
    root, first, gone = forest(texts, links), {}, defaultdict(set)
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            if len(line.split()) >= 3 and first.setdefault(root(line.strip(" \t\r")), (i, k)) != (i, k):
                gone[i].add(k)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    assert got == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_lines_that_share_a_segment_alone_are_not_paired(spark, monkeypatch):
    """Text that repeats within a line asks for nothing, and lines that share a segment are paired only if what lies before it is alike."""
    counts = defaultdict(list)

    def counted(df, label="cut"):
        out = workspace.cut(df, label)
        counts[label].append(out.agg(F.sum("rows")).first()[0] or 0 if label == "probes" else out.count())
        return out

    monkeypatch.setattr(line_dedup, "cut", counted)
    shared = "in this passage they are alike"
    rows = [(i, f"{prose(10 + i, 60)[:160]}{shared}{prose(300 + i, 60)[:150]}".replace("\n", " ")) for i in range(50)]
    rows += [(100 + i, prose(600 + i, 20).replace("\n", " ") + " and" * 700) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert all(r.n_removed == 0 for r in line_dedup.dedup(docs.where("doc_id < 100")).collect())
    assert sum(counts["pairs"]) <= 100  # of 50 * 49 / 2
    counts.clear()
    assert line_dedup.dedup(docs.where("doc_id = 100")).first().n_removed == 0
    assert sum(counts["probes"]) == 0


@pytest.mark.parametrize("rate", [0.05, 0.2, 0.4])
def test_a_free_segment_has_half_of_the_one_before_it(rate):
    """Some segment is found unchanged with a half of the segment before it, whatever the edits."""
    draw = random.Random(5)
    for n in range(300):
        line = "".join(draw.choice("abcd") for _ in range(draw.randrange(int(2 / rate) + 1, int(40 / rate))))
        other = changed(line, n, draw.randrange(int(len(line) * rate) + 1))
        x, y = sorted((line, other), key=len)
        budget = int(len(x) * rate)
        if not budget or within(x, y, budget) is None:
            continue
        width = int(line_dedup._widths(np.array([len(x)]), rate)[0])

        def context(text, place):
            found = line_dedup.Substrings([text], rate)
            return found.contexts(np.array([place]), np.array([width])).astype(np.int64)

        found = False
        for k in range(budget + 1):
            part = x[k * width : (k + 1) * width]
            for place in range(max(k * width - k, 0), k * width + k + 1):
                if y[place : place + width] == part and abs(len(y) - len(x) - place + k * width) <= budget - k:
                    found |= k == 0 or bool(line_dedup._alike(context(x, k * width), context(y, place))[0])
        assert found, (x, y)


def test_lines_of_awkward_documents(awkward, nothing):
    got = line_dedup.dedup(awkward).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in AWKWARD)
    assert [r.text for r in got if r.doc_id == 1] == [None] and [r.n_lines for r in got if r.doc_id == 1] == [0]
    nine = next(r for r in got if r.doc_id == 9)
    assert nine.text == "the same line again here" and nine.n_removed == 49
    # the repeated row of document 4 is the same document; document 5 copies it
    first = [r for r in got if r.doc_id == 4 and r.text in (prose(1, 80), prose(3, 60))]
    assert len(first) == 3 and all(r.n_removed == 0 for r in first)
    assert next(r for r in got if r.doc_id == 5).n_removed > 0
    assert set(awkward.columns) <= set(line_dedup.dedup(awkward).columns)
    assert line_dedup.dedup(nothing).count() == 0


def test_benchmark_matches(spark, awkward, nothing):
    items = [(1, prose(1, 40)), (2, prose(50, 30)), (3, None), (4, ""), (5, "short one"), (5, "short one")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    item = prose(50, 30)
    near = changed(item, 3, 5)
    docs = [
        (1, "before " + prose(1, 40) + " after"), (2, "x " + item.upper().replace(" ", "\n  ") + " y"), (3, prose(7, 200) + " " + near + " " + prose(8, 100)),
        (4, prose(9, 300)), (5, "a short  ONE here"), (6, None), (7, ""), (8, item[: len(item) // 2]), (8, near),
    ]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")

    def wanted(error_rate):
        out = Counter()
        for i, t in docs:
            for n, text in items:
                a, b = decontaminate.plain(text), decontaminate.plain(t)
                if a and b:
                    hit = find(pattern_bits(a), len(a), b, int(len(a) * error_rate))
                    if hit:
                        out[i, n, hit[0]] += 1
        return out

    for rate in (0.05, 0.1, 0.0):
        got = decontaminate.search(frame, benchmark, rate).collect()
        assert Counter((r.doc_id, r.item_id, r.distance) for r in got) == wanted(rate)
        # the same in blocks of one item
        blocks = decontaminate.search(frame, benchmark, rate, block_chars=1).collect()
        assert Counter(map(tuple, blocks)) == Counter(map(tuple, got))
    left = decontaminate.clean(frame, benchmark, 0.05).collect()
    assert sorted(r.doc_id for r in left) == [4, 6, 7, 8]
    assert decontaminate.clean(awkward, benchmark).columns == awkward.columns
    assert decontaminate.search(nothing, benchmark).count() == 0
    assert decontaminate.search(frame, benchmark.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.search(awkward, benchmark).collect()} == {4, 5}
