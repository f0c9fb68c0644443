"""Fertility rules, quality classifier and licence scan."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from awkward_rows import AWKWARD, prose

from gridloom.llm import fertility, licences, quality

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
WORD = r"[^\x20\x09-\x0D]+"


def plain_base(text):
    found = re.findall(WORD, text or "")
    windows = Counter(zip(found, found[1:], found[2:]))
    inside = [False] * len(found)
    for i in range(len(found) - 2):
        if windows[tuple(found[i : i + 3])] > 1:
            inside[i : i + 3] = [True] * 3
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(inside)


def test_base_counts_and_verdicts(spark, awkward, nothing):
    got = fertility.rules(awkward, BYTES, PIECES).collect()
    assert len(got) == len(AWKWARD)
    want = Counter((i, *plain_base(t)) for i, t in AWKWARD)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert fertility.rules(nothing, BYTES, PIECES).count() == 0


def test_fertility_measures_of_one_text(spark):
    import sentencepiece

    text = "The 漢字 ☃ word word."
    row = fertility.measure(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), BYTES, PIECES).first()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = [i for w in text.split() for i in model.encode(w)]
    shares = [n / len(ids) for n in Counter(ids).values()]
    assert row.n_tokens == len(ids) and row.script == "Latin"
    assert math.isclose(row.token_entropy, -sum(p * math.log2(p) for p in shares))
    assert math.isclose(row.byte_share, sum(map(model.is_byte, ids)) / len(ids))
    assert math.isclose(row.chars_per_piece_token, sum(map(len, text.split())) / len(ids))


def test_bands_reject_other_text_and_keep_the_usual(spark):
    rows = [(i, prose(i, 120), "en") for i in range(300)]
    odd = [(1000 + i, " ".join("#%$&@!*" for _ in range(i + 60)) + prose(i, 60), "en") for i in range(5)]
    got = fertility.rules(spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string"), BYTES, PIECES).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert len(kept & set(range(300))) >= 298 and not kept & set(range(1000, 1005))


def labelled(n=240):
    good = [(i, prose(i, 60 + i % 90)) for i in range(n)]
    bad = [(n + i, " ".join(w.upper() + "!!" for w in prose(n + i, 50).split())) for i in range(n // 2)]
    bad += [(2 * n + i, " ".join(f"{w} |" for w in prose(2 * n + i, 50).split())) for i in range(n // 2)]
    return [(i, t, 1) for i, t in good] + [(i, t, 0) for i, t in bad]


def test_quality_scores_of_held_out_rows(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    for i, _, q in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.7)
    right = [got[i].predicted == q for i, _, q in rows if got[i].held_out]
    assert np.mean(right) >= 0.98
    # labels of held-out rows change nothing
    turned = spark.createDataFrame([(i, 1 - q if got[i].held_out else q) for i, _, q in rows], "doc_id bigint, quality int")
    again = {r.doc_id: r.score for r in quality.classify(docs, turned).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_quality_of_awkward_documents(spark, awkward, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 0), (9, 0), (7, 0), (8, 1)], "doc_id bigint, quality int")
    got = quality.classify(awkward, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in AWKWARD)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert quality.classify(nothing, labels).count() == 0
    # one class only: its share
    one = spark.createDataFrame([(4, 1)], "doc_id bigint, quality int")
    assert len({r.score for r in quality.classify(awkward, one).collect()}) == 1
    model = quality.train(awkward, labels)
    assert quality.keep(awkward, model, 0.0).count() == len(AWKWARD) and quality.keep(awkward, model, 0.0).columns == awkward.columns


def test_descent_reaches_the_optimum_of_the_hinge_loss():
    draw = np.random.default_rng(0)
    x, w = draw.normal(size=(60, 5)), draw.normal(size=5)
    y = np.where(x @ w + draw.normal(size=60) * 0.3 > 0, 1.0, -1.0)
    c = np.full(60, 0.5)
    indptr = np.arange(0, 301, 5)
    found = quality.descend(indptr, np.tile(np.arange(5), 60), x.ravel(), y, c, 5, passes=300)

    def loss(v):
        return 0.5 * v @ v + (c * np.maximum(0, 1 - y * (x @ v))).sum()

    assert all(loss(found) <= loss(found + draw.normal(size=5) * s) + 1e-9 for s in (0.3, 0.03, 0.003) for _ in range(200))


def test_fit_copies_no_indicators():
    draw = np.random.default_rng(3)
    rows = [np.unique(draw.integers(0, 1 << quality.BITS, 2000)) for _ in range(400)]
    good = np.arange(400) % 3 == 0
    rows = [np.union1d(r, np.arange(20) + 100 * g).astype(np.int32) for r, g in zip(rows, good)]
    features, ends = np.concatenate(rows), np.cumsum([len(r) for r in rows])
    tracemalloc.start()
    model = quality.fit(ends, features, good.astype(float))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_000_000  # a handful of weights per indicator; one number more per entry of the sample would be 6 MB each
    scores = model.scores(np.repeat(np.arange(400), np.diff(ends, prepend=0)), features, 400)
    assert ((scores > 0.5) == good).mean() > 0.9


def test_indicators_are_distinct_and_see_repeats():
    rows, features = quality.indicators(pa.array(["a b a b", None, "x x x x"]))
    assert len(set(zip(rows.tolist(), features.tolist()))) == len(rows) and set(rows.tolist()) == {0, 2}


def test_licences(spark, awkward, nothing):
    plain = [(i, prose(i, 150)) for i in range(30)]
    texts = [
        (100, prose(1, 20) + "\nReleased under the MIT License.", "mit", ["mit"]),
        (101, "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", "apache", ["apache", "proprietary"]),
        (102, "The prisoner was released under the bridge.", "none", []),
        (103, None, "none", []), (104, "", "none", []),
        (105, "THIS WORK IS LICENSED UNDER A CREATIVE COMMONS ATTRIBUTION 4.0 INTERNATIONAL LICENSE", "cc-by", ["cc-by"]),
    ]
    docs = spark.createDataFrame(plain + [(i, t) for i, t, *_ in texts], "doc_id bigint, text string")
    model = licences.train(docs, sample=20)
    found = licences.scan(docs, model)
    got = {r.doc_id: r for r in found.collect()}
    for i, t, licence, families in texts:
        assert set(got[i].families) == set(families) and (got[i].licence == licence or licence == "apache")
        assert got[i].n_paragraphs == (0 if t is None else t.count("\n") + 1)
    assert all(got[i].licence == "none" for i, _ in plain)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Arrow", "NestedLoop", "Cartesian"))
    assert licences.scan(nothing, model).count() == 0
    assert licences.scan(awkward, model).count() == len({(i, t) for i, t in AWKWARD})
    assert licences.train(nothing).families[0] == "none"


def test_wrapped_and_dual_licences(spark):
    """Notices over several lines, with comment marks, and paragraphs that name two licences."""
    bsd = [
        "Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions",
        "are met:", "",
    ]
    lgpl = "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published"
    texts = [
        (1, "\n".join(bsd), ["bsd"]), (2, prose(3, 30) + "\n\n" + "\n".join(f" * {x}" for x in bsd) + "\n" + prose(4, 30), ["bsd"]),
        (3, "Licensed under the MIT license or Apache License, Version 2.0", ["apache", "mit"]), (4, lgpl, ["lgpl"]),
        (5, "Licensed under CC BY-SA 4.0.", ["cc-by-sa"]), (6, "Licensed under the\n#\nMIT license.", []),
    ]
    plain = [(100 + i, prose(i, 150)) for i in range(30)]
    docs = spark.createDataFrame(plain + [(i, t) for i, t, _ in texts], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licences.scan(docs, licences.train(docs, sample=20)).collect()}
    assert {i: got[i].families for i, _, f in texts if f} == {i: f for i, _, f in texts if f}
    assert got[1].n_unknown == 0 and got[3].licence in ("apache", "mit") and got[6].licence != "mit"


def test_licence_scores_equal_a_plain_sum(spark):
    text = "Licensed under the MIT license."
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    model = licences.train(docs, sample=5)
    words = re.findall(r"[a-z0-9]+", text.lower())
    grams = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    weights = dict(model.terms)
    margins = [b + sum(weights[g][k] for g in grams if g in weights) for k, b in enumerate(model.intercepts)]
    raised = [math.exp((m - max(margins)) / model.temperature) for m in margins]
    row = licences.scan(docs, model).first()
    assert math.isclose(row.probability, 1 - raised[0] / sum(raised), abs_tol=1e-5)


def test_verdicts_equal_plain_bands(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    paths = BYTES, PIECES
    measured = fertility.measure(docs, *paths).toPandas()
    rated = measured[measured.n_words >= 50]
    got = {r.doc_id: (r.base_failed, r.kept) for r in fertility.rules(docs, *paths).collect()}

    def band(rows, m):
        values = np.sort(rows[m].dropna().to_numpy())
        if not len(values):
            return None
        low, mid, high = (values[max(math.ceil(q * len(values)) - 1, 0)] for q in (0.25, 0.5, 0.75))
        least = 0.005 if m == "byte_share" else 0.01 * mid
        return np.array([mid, max(1.4826 * (mid - low), least), max(1.4826 * (high - mid), least)])

    for r in measured.itertuples():
        outside = False
        for m in fertility.MEASURES:
            value = getattr(r, m)
            lang, script = rated[rated.lang == r.lang], rated[rated.script == r.script]
            own, other = band(lang, m), band(script, m)
            if other is None or value is None or np.isnan(value):
                continue
            share = len(lang) / (len(lang) + 200)
            mid, down, up = other if own is None else share * own + (1 - share) * other
            spread = max(1, (300 / max(r.n_words, 1)) ** 0.5)
            outside |= value - mid < -3.5 * spread * down or value - mid > 6 * spread * up
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert got[r.doc_id] == (failed, not failed and not outside), r
