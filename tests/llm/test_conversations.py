"""Conversation repair and the prefix trie against plain Python, and their awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridloom.llm import prefix_trie, repair

SPACE = " \t\n\x0b\x0c\r"
FIELDS = "conv_id bigint, turn bigint, role string, text string"
FOLLOWS = {0: "u", 1: "u", 2: "a", 3: "u"}
TURNS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, 2, "user", "And"), (1, 3, "assistant", "So?"),
    (2, None, "system", None), (2, 0, None, "What?"), (2, 0, None, "What?"), (2, 7, "tool", ""), (2, 9, "assistant", " \n\t"),
    (None, 1, "user", "no id."), (None, None, None, None), (3, 5, "user", "x" * 50_000 + "."), (3, 5, "user", "tie."),
    (4, 1, "", "no role."), (5, -3, "system", "Be kind."), (5, 2, "user", "a"), (5, 3, "user", "a"), (6, 1, "user", "?\x0b "),
    (20, 0, "system", "Shared."), (20, 1, "user", "Same?"), (21, 0, "user", "Own."), (22, 3, "user", "Later."), (23, None, "user", "é 漢字!"),
]


def cheapest(rows):
    """(cost, audit, repaired turns) by all edits of a plain dynamic programme over strings."""
    seen, marks = set(), []
    for role, text in rows:
        body = text.rstrip(SPACE)
        marks.append((body == "" or (role, text) in seen, body[-1:] not in (".", "!", "?")))
        seen.add((role, text))
    after = {0: {"u": 2, "s": 1}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {}
    for i in range(len(rows), -1, -1):
        found = {s: [] for s in range(4)}
        for s in range(4):
            if i == len(rows):
                if s in (0, 3):
                    found[s].append((0, "", ()))
                continue
            role, text = rows[i]
            must, short = marks[i]

            def more(cost, letter, turn, rest):
                found[s].append((cost + rest[0], letter + rest[1], turn + rest[2]))

            more(3, "D", (), best[i + 1, s])
            if not must:
                if role[:1] in after[s]:
                    more(short, "K", ((role, text),), best[i + 1, after[s][role[:1]]])
                initial = FOLLOWS[s]
                more(2 + short, "R", (({"u": "user", "a": "assistant"}[initial], text),), best[i + 1, after[s][initial]])
        for _ in range(3):
            for s in range(4):
                initial = FOLLOWS[s]
                for cost, audit, turns in found[after[s][initial]][:]:
                    found[s].append((2 + cost, "I" + audit, (({"u": "user", "a": "assistant"}[initial], ""), *turns)))
            found = {s: sorted(set(v))[:1] for s, v in found.items()}
        for s in range(4):
            best[i, s] = found[s][0]
    return best[0, 0]


def facts(rows):
    """Counts of one conversation: (turn, role, text) in order."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts, seen = [0, 0, 0], set()
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        if body == "":
            counts[0] += 1
        elif (role, text) in seen:
            counts[1] += 1
        elif body[-1] not in ".!?":
            counts[2] += 1
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    return gaps, *counts, sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def plain_repair(rows, ids):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        by[conv].append((turn is not None, turn or 0, digest, turn, role, text))
    out = {}
    for conv in set(ids) | set(by):
        ordered = [r[3:] for r in sorted(by[conv])]
        cost, audit, turns = cheapest([(r, t) for _, r, t in ordered])
        text = "\n".join(f"{r}:{t}" for r, t in turns)
        out[conv] = (*facts(ordered), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def plain_damage(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def as_dict(frame):
    return {r[0]: tuple(r)[1:] for r in frame.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_tables_equal_single_steps():
    tables = repair.Tables(block=3)
    draw = random.Random(5)
    for _ in range(200):
        symbols = np.array([draw.randrange(9) for _ in range(draw.randrange(12))], np.int64)
        at = 0
        for s in symbols[::-1].tolist():
            at = int(tables.one[at, s])
        assert tables.borders(symbols, 0)[-1] == at


@pytest.mark.parametrize("block", [1, 2, 4])
def test_audits_equal_all_edits(block):
    tables = repair.Tables(block)
    for n in range(6):
        draw = random.Random(n)
        for _ in range(150):
            rows = [(draw.choice(["system", "user", "assistant", "tool"]), draw.choice(["a.", "b", "c?", "", "d!"])) for _ in range(n)]
            seen, marks = set(), bytearray()
            for role, text in rows:
                code = "sua".find(role[0]) % 4
                code |= repair.BLANK if not text else repair.REPEATED if (role, text) in seen else 0 if text[-1] in ".!?" else repair.TRUNCATED
                seen.add((role, text))
                marks.append(code)
            edits, _ = tables.trace(repair.as_symbols(bytes(marks)), 0, 0, True)
            if rows:
                assert edits == cheapest(rows)[1], rows


def test_damaged_conversations(spark, sf):
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    damaged = repair.damage(given)
    assert sorted(map(str, plain_damage(rows))) == sorted(str(tuple(r)) for r in damaged.collect())
    want = plain_repair(plain_damage(rows), {r[0] for r in rows})
    assert as_dict(repair.audits(repair.repair(damaged, given))) == want


def test_awkward_turns(spark):
    given = spark.createDataFrame([(*r, "x") for r in TURNS], FIELDS + ", digest string")
    want = plain_repair(TURNS, [r[0] for r in TURNS])
    assert as_dict(repair.audits(repair.repair(given))) == want
    rows = repair.repair(given).where("edit is not null").collect()
    assert sum(r.edit != "I" for r in rows) == len(TURNS)
    assert repair.repair(given.limit(0)).count() == 0


def test_conversations_without_turns_left(spark):
    given = spark.createDataFrame([(7, 0, "user", "x.")], FIELDS)
    found = as_dict(repair.audits(repair.repair(given.limit(0), given)))
    assert found == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_a_conversation_over_many_tasks(spark):
    draw = random.Random(3)
    rows = [(9, t, draw.choice(["system", "user", "assistant", "tool"]), draw.choice(["a.", "b", "", f"{t}!", f"{t}"])) for t in range(9500)]
    given = spark.createDataFrame(rows, FIELDS)
    found = as_dict(repair.audits(repair.repair(given)))[9]
    marks, seen = bytearray(), set()
    for _, _, role, text in rows:
        code = "sua".find(role[0]) % 4
        code |= repair.BLANK if not text else repair.REPEATED if (role, text) in seen else 0 if text[-1] in ".!?" else repair.TRUNCATED
        seen.add((role, text))
        marks.append(code)
    edits, _ = repair.Tables().trace(repair.as_symbols(bytes(marks)), 0, 0, True)
    assert found[:5] == facts([(t, r, x) for _, t, r, x in rows])
    assert found[6] == edits


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    paths = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 4
        paths[conv] = tuple(r[3:] for r in sorted(own.get(conv - conv % 20, []))[:h] + sorted(own[conv])[h:])
    members, below, out = defaultdict(list), defaultdict(list), {}
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    for node in sorted(members, key=len, reverse=True):
        inside = members[node]
        words = len(re.findall(prefix_trie.WORD, node[-1][1])) if node else 0
        ends = ",".join(map(str, sorted(c for c in inside if len(paths[c]) == len(node))))
        out[node] = (
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(below[node]),
            sum(out[b][5] for b in below[node]) or 1, sum(out[b][6] for b in below[node]) + (len(inside) - 1) * words,
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


def nodes(spark, rows, partitions=4):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        given = spark.createDataFrame([(*r, "x") for r in rows], FIELDS + ", path string")
        found = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_lists(given))).drop("turn")
        return sorted((tuple(r) for r in found.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_awkward_turns(spark):
    assert nodes(spark, TURNS) == plain_trie(TURNS)
    given = spark.createDataFrame(TURNS, FIELDS).limit(0)
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_lists(given))).count() == 0


def test_trie_of_given_conversations(spark, sf):
    given = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in given.collect()]
    assert nodes(spark, rows) == plain_trie(rows)


def test_trie_over_many_shards(spark):
    draw = random.Random(8)
    rows = [
        (c, t, "user", "the first turn" if t == 0 and c % 3 else draw.choice(["a b", "c", "d e f", ""]))
        for c in range(300) for t in range(draw.randrange(1, 7))
    ]
    assert nodes(spark, rows, partitions=23) == plain_trie(rows)


def test_blocks_of_one_range_and_copies(monkeypatch):
    draw = random.Random(2)
    paths = sorted({b"".join(bytes([draw.randrange(3)]) * 16 for _ in range(draw.randrange(9))) for _ in range(200)})
    block = [(p, [1] * (len(p) // 16), 1, i, "x") for i, p in enumerate(paths)]
    whole = {(r[0], r[1]): r for r in prefix_trie.block_nodes(block)}
    prefixes = {p[: 16 * d] for p in paths for d in range(len(p) // 16 + 1)}
    assert len(whole) == len(prefixes)
    border = [r for r in whole.values() if r[-2] is not None]
    assert {r[-2] for r in border} == set(prefix_trie.prefixes(paths[0])) | set(prefix_trie.prefixes(paths[-1]))


def test_medians_reach_every_place():
    for n in itertools.chain(range(20), [1000]):
        assert sorted(prefix_trie.medians(n)) == list(range(n))
