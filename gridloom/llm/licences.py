"""Licence scan of paragraphs: a trained n-gram classifier with an unknown class, confirmed by template comparison.

A paragraph is a block of lines without an empty one between them (comment marks alone are empty); the block as a whole, so that
wrapped notices are seen, and each of its lines are scored. ``n_paragraphs`` counts lines. Words are runs of ASCII letters and digits in lower case. Features are the word n-grams (one
to three words) of the licence templates and of the look-alikes, without those made of common words only. A
multinomial logistic regression with an L1 part is fitted on templates, cut-down variants of them, look-alikes, and a
bounded sample of paragraphs. Its probabilities are made sharper or softer by one temperature fitted on
held-back rows, and the least probability that counts is chosen on the held-back rows without a licence. A
family stands if enough n-grams of one of its templates are in the paragraph, so one paragraph may name several; of templates that hold
most of each other's n-grams (as CC BY and CC BY-SA) only the closest stands. What looks like a
licence but matches no template is unknown.

A paragraph without any word that makes a feature has no feature at all, so only the others are scored; nothing is lost by that.
All work on the table is column functions, joins with the small weight tables, and sums.

Defined results: NULL and empty texts have no paragraph with a licence; rows that repeat ``doc_id`` and text are one document, rows that
share only the ``doc_id`` or have NULL are told apart by their text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NONE = "none"
# Notices by which each family is known.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "Released under the GNU GPL, version 2 or later."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "Licensed under the Mozilla Public License 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("public-domain", "This work is dedicated to the public domain under CC0 1.0."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright by the author. All rights reserved. No part of this text may be reproduced without permission."),
    ("proprietary", "This document is confidential and proprietary; unauthorized copying is prohibited."),
]
# Sentences that use the same words and hold no licence.
LOOK_ALIKES = [
    "He got his driving licence in May.", "The bar lost its license to sell beer.", "A fishing license costs ten dollars.",
    "The general said the public was safe.", "The public library is open to all.", "All seats were reserved in advance.",
    "Version 2.0 of the game was released on Friday.", "The prisoner was released under supervision.", "The apache helicopter landed.",
    "She studied at MIT for three years.", "Human rights are universal.", "You can use this recipe for free.", "He works as a free software consultant.",
    "The work is done under pressure.", "Copyright law is complex.", "The creative commons room is on the second floor.", "A copy of the report was obtained.",
    "Permission was granted by the mayor.", "The terms of the treaty are public.", "Source: the national office of statistics.", "See the file for details.",
    "This work was supported by a grant.", "The mozilla festival was a success.", "Licensed plumbers only.", "The domain of the function is public knowledge.",
]


@dataclass
class Model:
    """Weight per term and family as small tables, intercepts, temperature, least probability, and template sizes."""

    families: list[str]
    terms: list[tuple[str, list[float]]]
    intercepts: list[float]
    temperature: float
    least: float
    cues: list[str]
    template_terms: list[tuple[str, int, str]]
    template_sizes: dict[int, int]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def grams(column: Column, longest: int = 3) -> Column:
    """Distinct n-grams of an array of words."""
    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.size(column) - (n - 1))
        joined = F.transform(places, lambda i: F.array_join(F.slice(column, i, n), " "))
        return F.when(F.size(column) >= n, joined).otherwise(F.array().cast("array<string>"))

    parts = [of(n) for n in range(1, longest + 1)]
    return F.array_distinct(F.concat(*parts))


def _rows(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small table from literals."""
    kind = names.replace(" ", ":").replace(",:", ",")
    named = [dict(zip([c.split()[0] for c in names.split(", ")], row)) for row in rows]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(named)), f"array<struct<{kind}>>")))


def paragraphs(docs: DataFrame) -> DataFrame:
    split = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row"),
        F.posexplode(F.split("text", "\n", -1)).alias("place", "paragraph"),
    )
    return split.select("doc_id", "row", "place", words(F.col("paragraph")).alias("words"))


def units(docs: DataFrame) -> DataFrame:
    """Blocks between empty lines and, of blocks of several lines, each line: document, number of the block, words."""
    blocks = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row"),
        F.posexplode(F.split("text", r"\n(?:[^\p{L}\p{N}\n]*+\n)+", -1)).alias("place", "block"),
    )
    lines = F.split("block", "\n", -1)
    parts = F.when(F.size(lines) > 1, F.concat(F.array("block"), lines)).otherwise(F.array("block"))
    return blocks.select("doc_id", "row", "place", F.posexplode(parts).alias("unit", "text")).select("doc_id", "row", "place", "unit", words(F.col("text")).alias("words"))


def akin(model: Model, confirm: float) -> list[list[int]]:
    """For each template the places of those of other families that it confirms, or that confirm it, whatever the text."""
    family = {k: f for _, k, f in model.template_terms}
    numbers = sorted(model.template_sizes)
    terms = {k: {t for t, n, _ in model.template_terms if n == k} for k in numbers}
    shared = [[len(terms[a] & terms[b]) >= confirm * max(min(len(terms[a]), len(terms[b])), 1) for b in numbers] for a in numbers]
    return [[j for j, b in enumerate(numbers) if shared[i][j] and family.get(a) != family.get(b)] for i, a in enumerate(numbers)]


def examples(docs: DataFrame, sample: int) -> DataFrame:
    """Labelled word lists: cut-down templates, look-alikes, and lines of at most ``sample`` documents that share no three words
    in a row with a template."""
    spark = docs.sparkSession
    known = _rows(spark, [(f, t) for f, t in TEMPLATES], "family string, text string").select("family", words(F.col("text")).alias("words"))
    cut = known.select(
        "family", "words", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("head"),
    ).select("family", "words", "head", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tail")).where(
        (F.size("words") - F.col("head") - F.col("tail") >= 3) & ((F.col("head") + F.col("tail")) * 3 <= F.size("words"))
    )
    variants = cut.select("family", F.expr("slice(words, head + 1, size(words) - head - tail)").alias("words"))
    alike = _rows(spark, [(t,) for t in LOOK_ALIKES], "text string").select(F.lit(NONE).alias("family"), words(F.col("text")).alias("words"))
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample).distinct()
    few = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    seen = known.select(F.explode(grams(F.col("words"))).alias("term")).where(F.size(F.split("term", " ")) == 3)
    threes = [r["term"] for r in seen.distinct().collect()]  # of the templates
    lines = paragraphs(few).where((F.size("words") > 0) & ~F.arrays_overlap(grams(F.col("words")), F.array(*map(F.lit, sorted(threes)))))
    lines = lines.orderBy(F.xxhash64("words")).limit(20 * sample).select(F.lit(NONE).alias("family"), "words", F.lit(1.0).alias("weight"))
    written = variants.union(alike).select("*", F.lit(8.0).alias("weight"))
    return written.union(lines)


def train(docs: DataFrame, sample: int = 100, common: float = 0.01, alpha: float = 0.0003) -> Model:
    """Fits the classifier on at most ``20 * sample`` paragraphs besides the templates; small jobs when called."""
    rows = examples(docs, sample).select("family", "words", "weight", grams(F.col("words")).alias("terms"))
    rows = rows.withColumn("held", F.pmod(F.xxhash64("family", "words"), F.lit(5)) == 0).coalesce(2).cache()
    try:
        texts = [(f, t) for f, t in TEMPLATES] + [(NONE, t) for t in LOOK_ALIKES]
        spelled = _rows(docs.sparkSession, texts, "family string, text string").select("family", words(F.col("text")).alias("words"))
        spelled = [(r["family"], r["words"], r["terms"]) for r in spelled.select("family", "words", grams(F.col("words")).alias("terms")).collect()]
        lines = rows.where("weight = 1")
        total = lines.count()
        usual = sorted({w for _, ws, _ in spelled for w in ws})
        often = {
            r["w"]
            for r in lines.select(F.explode(F.array_distinct("words")).alias("w")).where(F.col("w").isin(usual))
            .groupBy("w").count().where(F.col("count") > common * total + 2).collect()
        }
        cues = [w for w in usual if w not in often]
        cue = set(cues)
        terms = sorted({t for _, _, ts in spelled for t in ts if cue & set(t.split())})
        vector = CountVectorizerModel.from_vocabulary(terms, "terms", "features")
        vector.setBinary(True)
        families = [NONE, *dict.fromkeys(f for f, _ in TEMPLATES)]
        label = F.coalesce(*(F.when(F.col("family") == f, F.lit(float(k))) for k, f in enumerate(families)))
        ready = vector.transform(rows).withColumn("label", label)
        fitted = LogisticRegression(
            family="multinomial", regParam=alpha, elasticNetParam=0.2, maxIter=60, standardization=False, weightCol="weight"
        ).fit(ready.where(~F.col("held")))
        matrix = fitted.coefficientMatrix.toArray()
        weights = [(t, [float(v) for v in matrix[:, k]]) for k, t in enumerate(terms) if abs(matrix[:, k]).max() > 1e-6]
        model = Model(
            families, weights, [float(v) for v in fitted.interceptVector.toArray()], 1.0, 0.5, cues,
            [(t, k, f) for k, (f, _, ts) in enumerate(spelled) if f != NONE for t in ts if cue & set(t.split())],
            {k: sum(1 for t in ts if cue & set(t.split())) for k, (f, _, ts) in enumerate(spelled) if f != NONE},
        )
        _calibrate(model, rows.where("held"))
        return model
    finally:
        rows.unpersist()


def _margins(scored: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """Sum of weights per family, for rows with ``terms``."""
    table = _weights(scored.sparkSession, model)
    sums = [F.sum(F.coalesce(F.get("weight", k), F.lit(0.0))).alias(f"_m{k}") for k in range(len(model.families))]
    exploded = scored.select(*keys, F.explode("terms").alias("term"))
    summed = exploded.join(F.broadcast(table), "term").groupBy(*keys).agg(*sums)  # one row per term of the templates
    return summed.select(*keys, F.array(*(F.col(f"_m{k}") + b for k, b in enumerate(model.intercepts))).alias("margins"))


def _weights(spark: SparkSession, model: Model) -> DataFrame:
    return _rows(spark, [(t, w) for t, w in model.terms], "term string, weight array<double>")


def probabilities(margins: Column, temperature: Column | float) -> Column:
    top = F.array_max(margins)
    raised = F.transform(margins, lambda m: F.exp((m - top) / temperature))
    total = F.aggregate(raised, F.lit(0.0), lambda a, b: a + b)
    return F.transform(raised, lambda v: v / total)


def _calibrate(model: Model, held: DataFrame) -> None:
    """Temperature with the best likelihood of the held-back rows; least probability above what those without a licence reach."""
    rows = held.select(F.xxhash64("family", "words").alias("id"), "family", "terms").dropDuplicates(["id"])
    scored = rows.join(_margins(rows, ["id"], model), "id")
    number = F.array_position(F.array(*map(F.lit, model.families)), F.col("family")).cast("int")
    tried = scored.select("*", F.explode(F.array(*(F.lit(0.25 * 1.25**k) for k in range(14)))).alias("t"))
    loss = tried.groupBy("t").agg(F.avg(-F.log(F.greatest(F.element_at(probabilities(F.col("margins"), F.col("t")), number), F.lit(1e-12)))).alias("loss"))
    best = loss.orderBy("loss", "t").first()
    if best is not None:
        model.temperature = float(best["t"])
    chance = 1 - F.get(probabilities(F.col("margins"), model.temperature), 0)
    high = scored.where(F.col("family") == NONE).agg(F.max(chance).alias("p")).first()["p"]
    bare = [math.exp((m - max(model.intercepts)) / model.temperature) for m in model.intercepts]
    nothing = 1 - bare[0] / sum(bare)  # a paragraph without any feature must stay without a licence
    model.least = max(min(max(0.5, float(high or 0.0)), 0.9), nothing + 1e-9)


def scan(docs: DataFrame, model: Model, confirm: float = 0.6) -> DataFrame:
    """One row per document: ``n_paragraphs``, the licence of the surest paragraph (``none`` without one, ``unknown`` if none is
    confirmed), its probability and similarity to a template, all confirmed families, and the number of unknown paragraphs."""
    spark = docs.sparkSession
    every = units(docs)
    cue = F.array(*map(F.lit, model.cues))
    keys = ["doc_id", "row", "place", "unit"]
    # every term of a template or look-alike, with its weights and the templates that hold it: a table of the model's size
    holders: dict[str, list[int]] = {}
    for term, template, _ in model.template_terms:
        holders.setdefault(term, []).append(template)
    zero = [0.0] * len(model.families)
    weights = {t: [round(v, 9) for v in w] for t, w in model.terms}
    table = _rows(
        spark, [(t, weights.get(t, zero), holders.get(t, [])) for t in sorted({*weights, *holders})], "term string, weight array<double>, templates array<int>"
    )
    # only n-grams that the table holds become rows
    told = sorted({*weights, *holders})
    held = F.filter(grams(F.col("words")), lambda g: g.isin(told))
    scored = every.where(F.arrays_overlap("words", cue)).select(*keys, F.explode(held).alias("term"))
    numbers = sorted(model.template_sizes)
    sums = [F.sum(F.get("weight", k)).alias(f"_m{k}") for k in range(len(model.families))]
    hits = [F.sum(F.array_contains("templates", k).cast("int")).alias(f"_t{k}") for k in numbers]
    summed = scored.join(F.broadcast(table), "term").groupBy(*keys).agg(*sums, *hits)
    margins = F.array(*(F.col(f"_m{k}") + b for k, b in enumerate(model.intercepts)))
    family_of = {k: f for _, k, f in model.template_terms}
    similar = [
        F.greatest(F.lit(0.0), F.lit(0.0), *(F.col(f"_t{k}") / model.template_sizes[k] for k in numbers if family_of.get(k) == f)) for f in model.families
    ]
    close = F.array(*(F.when(F.lit(model.template_sizes[k] > 0), F.col(f"_t{k}") / max(model.template_sizes[k], 1)).otherwise(0.0) for k in numbers))
    rated = summed.select(*keys, probabilities(margins, model.temperature).alias("p"), F.array(*similar).alias("similar"), close.alias("close"))
    licence = F.slice("p", 2, len(model.families) - 1)
    rated = rated.select(*keys, "p", "similar", "close", F.array_position(licence, F.array_max(licence)).cast("int").alias("best"))
    rated = rated.withColumn("probability", 1 - F.get("p", 0)).where(F.col("probability") >= model.least)
    names, others = F.array(*map(F.lit, model.families)), akin(model, confirm)
    near = F.array(*(F.array(*map(F.lit, o)) if o else F.array().cast("array<int>") for o in others))
    owner = F.array(*(F.lit(model.families.index(family_of.get(k, NONE))) for k in numbers))

    def rank(i: Column) -> Column:
        return F.struct((F.get(owner, i) == F.col("best")).alias("best"), F.get("close", i).alias("close"), F.get("p", F.get(owner, i)).alias("p"), (-i).alias("i"))

    sure = F.filter(F.sequence(F.lit(0), F.lit(len(numbers) - 1)), lambda i: F.get("close", i) >= confirm)
    rated = rated.withColumn("sure", sure)
    rated = rated.withColumn("sure", F.filter("sure", lambda i: ~F.exists("sure", lambda j: F.array_contains(F.get(near, i), j) & (rank(j) > rank(i)))))
    # the classifier's family if it stands, else the closest of those that do
    lead = F.coalesce(F.get(owner, F.negative(F.array_max(F.transform("sure", rank))["i"])), F.col("best"))
    rated = rated.withColumn("lead", lead).withColumn("confirmed", F.size("sure") > 0)
    shown = F.struct("confirmed", "probability", F.get("similar", F.col("lead")).alias("similarity"), F.when(F.col("confirmed"), F.get(names, F.col("lead"))).otherwise("unknown").alias("licence"))
    blocks = rated.select("doc_id", "row", "place", "confirmed", shown.alias("shown"), F.array_distinct(F.transform("sure", lambda i: F.get(names, F.get(owner, i)))).alias("family")).groupBy("doc_id", "row", "place").agg(
        F.max("confirmed").alias("confirmed"), F.max("shown").alias("shown"), F.array_distinct(F.flatten(F.collect_set("family"))).alias("family")
    )
    found = blocks.select(
        "doc_id", "row", F.lit(0).cast("bigint").alias("n"), "shown", "family", (~F.col("confirmed")).cast("int").alias("unknown"),
    )
    whole = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row"),
        F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("bigint").alias("n"),
        F.lit(None).cast(found.schema["shown"].dataType).alias("shown"), F.array().cast("array<string>").alias("family"), F.lit(0).alias("unknown"),
    )
    out = whole.union(found).groupBy("doc_id", "row").agg(
        F.max("n").alias("n_paragraphs"), F.max("shown").alias("shown"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("family")))).alias("families"), F.sum("unknown").alias("n_unknown")
    )
    return out.select(
        "doc_id", "n_paragraphs", F.coalesce("shown.licence", F.lit(NONE)).alias("licence"), F.round("shown.probability", 6).alias("probability"),
        F.round("shown.similarity", 6).alias("similarity"), "families", "n_unknown",
    )
