"""Token ids, packing, token files and token counts against the tokenizers library itself."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from awkward_rows import AWKWARD, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import grammar, packing, token_counts
from gridloom.llm.columns import Encoder, Store, flat, kept, pieces, words

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def reference(name):
    found = Tokenizer.from_file(P.path(name))
    found.encode_special_tokens = True
    return found


@pytest.mark.parametrize("name", FILES)
def test_ids_and_spans_equal_those_of_whole_texts(name):
    texts = [t for _, t in AWKWARD if t is None or len(t) < 5000] + [prose(k, 200) for k in range(20)] + ["it's O'Neil, x.y", "\xa0 \xa0a", "x,́ y"]
    encoder, whole = Encoder(P.path(name)), reference(name).encode_batch([t or "" for t in texts], add_special_tokens=False)
    ids, rows, start, end = encoder(pa.array(texts), with_spans=True)
    plain, plain_rows = encoder(pa.array(texts))
    for k, found in enumerate(whole):
        a, b = rows[k], rows[k + 1]
        assert ids[a:b].tolist() == found.ids == plain[plain_rows[k] : plain_rows[k + 1]].tolist()
        assert list(zip(start[a:b].tolist(), end[a:b].tolist())) == found.offsets


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB 'é.,!\n\t\xa0 ́s1<|>", max_size=12), min_size=1, max_size=5))
def test_ids_of_odd_texts(texts):
    for name in FILES:
        ids, rows = Encoder(P.path(name))(pa.array(texts))
        for k, found in enumerate(reference(name).encode_batch(texts, add_special_tokens=False)):
            assert ids[rows[k] : rows[k + 1]].tolist() == found.ids


@pytest.mark.parametrize("with_spans", [False, True])
def test_a_full_cache_keeps_the_pieces_in_use(monkeypatch, with_spans):
    monkeypatch.setitem(kept(f"pieces {P.path(FILES[0])} {with_spans}"), "store", Store())
    learn, learnt = Encoder._learn, []
    monkeypatch.setattr(Encoder, "_learn", lambda self, store, new, spans: (learnt.append([p.strip() for p in new]), learn(self, store, new, spans)))
    encoder = Encoder(P.path(FILES[0]), cache=3)
    first = encoder(pa.array(["aa bb cc dd ee"]), with_spans)
    encoder(pa.array(["aa bb zzz bb"]), with_spans)
    assert learnt[1:] == [["zzz"]]
    again = encoder(pa.array(["aa bb cc dd ee"]), with_spans)
    assert all((a == b).all() for a, b in zip(first, again))


def test_rules_of_rules_expand_to_their_ids():
    rules, sizes = np.array([[1, 2], [10, 3], [11, 11], [4, 10]]), np.array([2, 3, 6, 3])
    need = grammar.reached(10, rules, np.array([5, 12]))
    assert need.tolist() == [True, True, True, False]
    text, begin = grammar.expansions(10, rules, sizes, need)
    assert grammar.expand(np.array([5, 12, 10]), 10, sizes, text, begin).tolist() == [5, 1, 2, 3, 1, 2, 3, 1, 2]
    text, begin = grammar.expansions(10, rules[:0], sizes[:0], need[:0])
    assert not len(text) and not len(begin)


def test_words_of_rows_do_not_run_together():
    rows, codes, distinct = words(pa.array(["ab", "cd ef", None, "", "ab"]))
    assert rows.tolist() == [0, 1, 1, 4] and [distinct[int(c)].as_py() for c in codes] == ["ab", "cd", "ef", "ab"]


def test_pieces_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 10, None, "y" * 100, "", "z"]})
    assert sum((p.column("text").to_pylist() for p in pieces([batch], "text", 20)), []) == batch.column("text").to_pylist()
    assert flat(batch.column("text").slice(2, 3))[1].tolist() == [0, 100, 100, 101]


def check_pieces(rows, texts, length):
    tokenizer = reference("byte_bpe_50k.json")
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append(r)
    for members in used.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    whole = sorted((i is not None, i or 0, t or "") for i, t in texts)
    ids = {t: tokenizer.encode(t, add_special_tokens=False).ids + [0] for _, _, t in whole}
    assert sum(r.length for r in rows) == sum(len(ids[t]) for _, _, t in whole)
    for r in rows:
        candidates = [ids[t or ""] for i, t in texts if i == r.doc_id]
        assert any(zlib.crc32(np.array(c[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for c in candidates)
        assert r.length <= length and (r.piece == 0 or r.length == length)


def test_packing_of_awkward_documents(awkward, nothing):
    path = P.path("byte_bpe_50k.json")
    rows = packing.pack_documents(awkward, path, length=128).collect()
    check_pieces(rows, AWKWARD, 128)
    assert packing.pack_documents(nothing, path).count() == 0


def test_packing_needs_hardly_more_than_the_least(spark):
    draw = np.random.default_rng(3)
    sizes = np.minimum(draw.lognormal(6.5, 1, 20_000).astype(int) + 1, 2048)
    parts = spark.createDataFrame([(i, 0, 0, int(s), 0) for i, s in enumerate(sizes)], packing.PIECES)
    used = packing.pack(parts).select("sequence_id").distinct().count()
    assert used <= 1.01 * np.ceil(sizes.sum() / 2048)


def test_best_fit_takes_the_fullest_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert bins.put(4) == (0, 0) and bins.put(7) == (1, 0)  # free: 6 and 3
    assert bins.put(3) == (1, 7)  # the fuller one
    assert bins.put(8) == (2, 0) and bins.put(9) == (3, 0)  # three open: the one with 1 free closes
    assert bins.put(1) == (2, 8)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=40), min_size=1, max_size=6))
def test_grammar_round_trip(documents):
    ids = np.concatenate([np.array(d, "<u4") for d in documents])
    ends = np.cumsum([len(d) for d in documents])
    base, rules, sizes, symbols, places = grammar.compress(ids, ends, per_round=6, least=2)
    text, begin = grammar.expansions(base, rules, sizes, np.ones(len(rules), bool))
    assert [len(t) for t in np.split(text, begin[1:])] == sizes.tolist() or not len(sizes)
    for k, d in enumerate(documents):
        part = symbols[places[k - 1] if k else 0 : places[k]].astype(np.int64)
        assert grammar.expand(part, base, sizes, text, begin).tolist() == d


def test_grammar_shrinks_repeats():
    ids = np.tile(np.arange(8, dtype="<u4"), 4000)
    assert len(grammar.compress(ids, np.array([len(ids)]))[3]) <= len(ids) / 8 + 1


def test_token_files_of_awkward_documents(spark, awkward, nothing, tmp_path):
    path, tokenizer = P.path("word_bpe_49k.json"), reference("word_bpe_49k.json")
    grammar.write(awkward, str(tmp_path / "t"), path, shard_tokens=500)
    found = sorted(grammar.digest(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    want = {}
    for i, t in AWKWARD:
        want.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    at = 0
    for r in found:
        ids = next(x for x in want[r.doc_id] if zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        want[r.doc_id].remove(ids)
        assert r.start == at and r.n_tokens == len(ids)
        at += len(ids)
    assert not any(want.values())
    order = [r.doc_id for r in found]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert grammar.store(nothing, path).count() == 0
    # one document out of a shard
    shard = max(spark.read.schema(grammar.SHARD).parquet(str(tmp_path / "t")).collect(), key=lambda s: s.n_docs).asDict()
    assert [x.tolist() for x in grammar.decode(shard, 1, 2)] == [x.tolist() for x in grammar.decode(shard)][1:2]
    for doc, ids in enumerate(grammar.decode(shard)):
        for first, behind in ((0, len(ids)), (0, 1), (3, 9), (len(ids) - 2, len(ids)), (len(ids), len(ids) + 5), (2, 2)):
            first = max(first, 0)
            assert grammar.decode_range(shard, doc, first, behind).tolist() == ids[first:behind].tolist()


def plain_counts(fields, rule):
    """Sections and counts of one row, token by token."""
    whole = "\n".join(f or "" for f in fields)
    out, at = [], 0
    for k, f in enumerate(fields):
        for n, line in enumerate((f or "").split("\n") if k == len(fields) - 1 else [f or ""]):
            out.append([k, n, at, len(line), 0, 0])
            at += len(line) + 1
    for a, b in reference("byte_bpe_50k.json").encode(whole, add_special_tokens=False).offsets:
        b = max(b, a + 1)
        covered = [min(b, s[2] + s[3]) - max(a, s[2]) for s in out]
        touched = [j for j, c in enumerate(covered) if c > 0]
        if not touched:
            j = max(j for j, s in enumerate(out) if s[2] <= a)
        else:
            j = touched[0] if rule == "first" else max(touched, key=lambda j: (covered[j], -j))
        out[j][4] += 1
        out[j][5] += len(touched) > 1
    return out


@pytest.mark.parametrize("rule", ["first", "most"])
def test_token_counts(spark, awkward, nothing, rule):
    fields = ("source", "lang", "text")
    got = token_counts.count(awkward, P.path("byte_bpe_50k.json"), fields, rule).collect()
    want = []
    for i, t in AWKWARD:
        want += [(i, fields[k], n, a, size, tokens, crossing) for k, n, a, size, tokens, crossing in plain_counts(("src", "en", t), rule)]
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts.count(nothing, P.path("byte_bpe_50k.json")).count() == 0


def test_a_long_copied_passage_becomes_few_symbols(monkeypatch):
    draw = np.random.default_rng(5)
    passage = draw.integers(0, 50_000, 100)
    ids = np.concatenate([np.concatenate([passage, draw.integers(0, 50_000, 1)]) for _ in range(2000)]).astype(np.uint32)
    ends = np.array([40_000, len(ids)])
    base, rules, sizes, symbols, places = grammar.compress(ids, ends)
    assert sizes.max() >= 100 and len(symbols) < len(ids) / 40
    symbols = symbols.astype(np.int64)
    pairs = (symbols[:-1] << 32 | symbols[1:])[np.delete(np.arange(len(symbols) - 1), places[0] - 1)]
    assert np.unique(pairs, return_counts=True)[1].max() < 8
    monkeypatch.setattr(grammar, "BLOCK", 512)
    shard = grammar._shard(0, 0, pa.array([1, 2]), ids, ends).to_pylist()[0]
    assert len(shard["block_ends"]) > 16
    assert [d.tolist() for d in grammar.decode(shard)] == [ids[:40_000].tolist(), ids[40_000:].tolist()]
    assert grammar.decode_range(shard, 1, 70_123, 70_456).tolist() == ids[110_123:110_456].tolist()
