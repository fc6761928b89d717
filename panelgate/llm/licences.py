"""Licence scan of paragraphs, in DataFrame functions and Spark ML alone.

A logistic regression over sparse word n-grams tells licence families from each other
and from other text. It is trained here, on varied licence notices and a bounded
sample of paragraphs; its probabilities are calibrated on notices held out, and the
bound above which a family is believed on notices of families it never saw. Unknown
is a class of its own, trained on some notices of other families; what looks like a
licence without reaching the bound, or without resembling a template of its family,
is unknown too.

A paragraph is a run of up to ``WINDOW`` neighbouring lines, so a notice is found on one
line of prose as well as wrapped over several; of runs that overlap the best one counts.
"""

import re

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgate.llm.common import materialize

# Notices and opening sentences of the licence families.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License.",
        "This project is distributed under the terms of the Apache Software License 2.0.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
        "Released under the 3-clause BSD License.",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
        "International License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or any later version.",
        "Licensed under the GPL v3.",
    ],
    "LGPL-3.0": [
        "This library is free software; you can redistribute it under the terms of the GNU Lesser "
        "General Public License.",
        "Licensed under the LGPL v3.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright by the authors. All rights reserved. No part may be reproduced without "
        "written permission.",
    ],
}

# Notices of families outside the list, which must come out as unknown.
FOREIGN = [
    "Licensed under the Eclipse Public License 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Released under the Artistic License 2.0.",
    "This software is provided under the zlib license.",
    "Licensed under the ISC License.",
    "Licensed under the Open Database License.",
]

FAMILIES = sorted(TEMPLATES)
NONE = len(FAMILIES)  # class of other text
UNKNOWN = NONE + 1  # class of licences outside the list

# Production parameters: bounds of the sample of other text (documents, lines of each),
# varied copies of a notice, longest n-gram, the share of a template's word pairs that
# confirms a prediction, and lines of a paragraph.
OTHER_DOCS, OTHER_LINES, VARIANTS, LONGEST, CONFIRMED, WINDOW = 400, 20, 24, 3, 0.6, 5


WORD_PATTERN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def grams(words: Column, longest: int = LONGEST) -> Column:
    """The distinct n-grams of an array of words, words joined by spaces."""
    return F.array_distinct(F.concat(*[_runs(words, n) for n in range(1, longest + 1)]))


def _runs(words, n):
    """All runs of ``n`` neighbouring words; without ``n`` words a sequence would count down."""
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    joined = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))


def paragraphs(text: Column) -> Column:
    return F.split(text, r"\n")


class Classifier:
    """Weights, word list, temperature and bound; small and the same size for any corpus."""

    def __init__(self, spark, vocabulary, weights, bias):
        self.spark, self.vocabulary, self.bias = spark, vocabulary, bias
        self.words = sorted({w for g in vocabulary for w in g.split(" ")})
        self.weights, self.temperature, self.bound = weights, 1.0, 0.5

    def table(self) -> DataFrame:
        rows = [(g, [float(x) for x in self.weights[:, i]]) for i, g in enumerate(self.vocabulary)]
        return self.spark.createDataFrame(rows, "gram string, weight array<double>")

    def scores(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Per ``keys`` the array ``score`` of all classes; ``rows`` has ``grams``."""
        hit = rows.select(*keys, F.explode("grams").alias("gram")).join(
            F.broadcast(self.table()), "gram"
        )
        sums = hit.groupBy(*keys).agg(*[
            F.sum(F.get("weight", F.lit(c))).alias(f"s{c}") for c in range(UNKNOWN + 1)
        ])
        joined = rows.select(*keys).join(sums, keys, "left")
        return joined.select(*keys, F.array(*[
            F.coalesce(f"s{c}", F.lit(0.0)) + F.lit(float(b)) for c, b in enumerate(self.bias)
        ]).alias("score"))


def probabilities(score: Column, temperature) -> Column:
    top = F.array_max(score)
    exps = F.transform(score, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    return F.transform(exps, lambda x: x / total)


def _notices(spark) -> DataFrame:
    """``(label, variant, words)``: the notices with some of their words left out.

    Which words go follows from a hash. Labels count the families; every other foreign
    notice is of the class unknown, the rest, labelled -1, stays unseen for the bound.
    """
    rows = [(FAMILIES.index(f), t) for f in FAMILIES for t in TEMPLATES[f]]
    rows += [(-1 if i % 2 else UNKNOWN, t) for i, t in enumerate(FOREIGN)]
    base = spark.createDataFrame(rows, "label int, template string").coalesce(1)
    each = base.select("label", "template", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("variant"))
    kept = F.filter(words_of(F.col("template")), lambda w: (F.col("variant") == 0) | (
        F.pmod(F.xxhash64(w, "template", "variant"), F.lit(12)) != 0))
    return each.select("label", "variant", kept.alias("words"))


def train(docs: DataFrame) -> Classifier:
    """Classifier from the notices and at most ``OTHER_DOCS * OTHER_LINES`` paragraphs.

    The sampled documents are the first by a hash of the id; paragraphs that resemble
    a template or mention a licence are left out, as their class is not known. Without documents the notices alone
    make the classifier.
    """
    spark = docs.sparkSession
    # A share of the hashes that holds some four times the sample: the exact first ones
    # are then sorted out of few rows, whatever the number of partitions.
    share = min(1.0, 4 * OTHER_DOCS / max(docs.count(), 1))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    few = docs.filter(F.col("text").isNotNull() & (place <= F.lit(min(int(share * 2**63), 2**63 - 1))))
    sample = few.select("doc_id", "text", place.alias("place")).orderBy(
        "place", "doc_id").limit(OTHER_DOCS)
    lines = sample.select(F.explode(F.slice(paragraphs(F.col("text")), 1, OTHER_LINES)).alias("line"))
    other = lines.select(words_of(F.col("line")).alias("words")).filter(F.size("words") > 0)
    alike = F.greatest(*[similarity(F.col("words"), f) for f in FAMILIES])
    mentioned = F.exists("words", lambda w: w.startswith("licen") | w.startswith("copyright"))
    other = materialize(other.filter((alike < CONFIRMED) & ~mentioned).coalesce(1), "other")
    notices = materialize(_notices(spark), "notices")
    seen = notices.select(F.explode("words").alias("w")).distinct()
    common = other.select(F.explode("words").alias("w")).groupBy("w").count()
    # Words of the notices, a bounded list, and how often other text has them.
    uses = {r.w: r["count"] for r in common.join(seen, "w", "left_semi").collect()}
    found = notices.select(F.explode(grams(F.col("words"))).alias("g")).groupBy("g").count()
    vocabulary = sorted(r.g for r in found.filter("count >= 3").collect())
    data = notices.filter("label >= 0").select("label", "variant", "words").union(
        other.select(F.lit(NONE), F.pmod(F.xxhash64("words"), F.lit(VARIANTS)).cast("int"), "words")
    ).select("label", "variant", grams(F.col("words")).alias("grams"))
    held_out = F.col("variant") % 4 == 3
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    counter.setBinary(True)
    fitted = LogisticRegression(
        family="multinomial", regParam=0.001, elasticNetParam=0.2, maxIter=60,
    ).fit(counter.transform(data.filter(~held_out).coalesce(1)).select("label", "features"))
    weights, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    used = abs(weights).max(axis=0) > 0
    model = Classifier(
        spark, [g for g, u in zip(vocabulary, used) if u], weights[:, used], bias
    )
    _calibrate(model, data.filter(held_out), notices.filter("label < 0"))
    model.words = _telling_words(model, uses)
    return model


def _telling_words(model, uses):
    """Words without any of which a paragraph is other text, whatever else it holds.

    Other text starts ahead of every licence by the difference of the biases. The n-grams
    of the commonest words are set aside as long as all of them together cannot make that
    up for any licence, at the model's temperature; of each gram that is left the word that
    other text uses least is a telling one.
    """
    licence = np.arange(len(model.bias)) != NONE
    gains = np.clip(model.weights - model.weights[NONE], 0, None)[licence]
    ahead = model.bias[NONE] - model.bias[licence] - model.temperature * np.log(licence.sum())
    spent, words = np.zeros(len(ahead)), set()
    rarest = [min(g.split(" "), key=lambda w: (uses.get(w, 0), w)) for g in model.vocabulary]
    for i in sorted(range(len(rarest)), key=lambda i: (-uses.get(rarest[i], 0), model.vocabulary[i])):
        if (spent + gains[:, i] <= ahead).all():
            spent = spent + gains[:, i]
        elif gains[:, i].any():
            words.add(rarest[i])
    return sorted(words)


def _calibrate(model, held_out, foreign):
    """Temperature of the least log loss on held-out rows, bound from foreign notices."""
    numbered = held_out.withColumn("row", F.monotonically_increasing_id())
    numbered = materialize(numbered, "held-out")
    scored = model.scores(numbered, ["row", "label"])
    tried = scored.crossJoin(F.broadcast(model.spark.createDataFrame(
        [(t / 4,) for t in range(1, 17)], "temperature double"
    )))  # sixteen rows: every score is tried at each temperature
    chance = F.get(probabilities(F.col("score"), F.col("temperature")), F.col("label"))
    loss = tried.groupBy("temperature").agg(F.avg(-F.log(F.greatest(chance, F.lit(1e-12)))).alias("loss"))
    model.temperature = loss.orderBy("loss", "temperature").head()[0]
    strange = materialize(foreign.select(
        F.monotonically_increasing_id().alias("row"), grams(F.col("words")).alias("grams")
    ), "foreign")
    best = F.array_max(F.slice(probabilities(F.col("score"), F.lit(model.temperature)), 1, NONE))
    seen = model.scores(strange, ["row"]).agg(F.percentile(best, F.lit(0.9))).head()[0]
    model.bound = min(max(seen or 0.5, 0.5), 0.9)


def similarity(words: Column, family: str) -> Column:
    """Largest share of a template's neighbouring word pairs that the words contain."""
    pairs = _runs(words, 2)
    shares = [F.lit(0.0)]
    for template in TEMPLATES[family]:
        own = re.findall(WORD_PATTERN, template.lower())
        wanted = sorted({" ".join(own[i : i + 2]) for i in range(len(own) - 1)})
        known = F.array(*[F.lit(w) for w in wanted])
        shares.append(F.size(F.array_intersect(known, pairs)) / len(wanted))
    return F.greatest(*shares, F.lit(0.0))


def _windows(rows: DataFrame, words: list[str], longest: int = WINDOW) -> DataFrame:
    """Runs of up to ``longest`` lines: ``row, doc_id, paragraph, size, text, words``.

    ``rows`` has ``row, doc_id, text``. A run begins and ends with a line that holds one of
    ``words`` and has no line without a word inside.
    """
    known = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    lines = rows.select("row", "doc_id", F.posexplode(paragraphs(F.col("text"))).alias("line", "text"))
    lines = lines.withColumn("words", words_of(F.col("text")))
    lines = lines.withColumn("telling", F.arrays_overlap("words", known))
    after = Window.partitionBy("row").orderBy("line")
    runs = []
    whole = F.lit(True)
    for size in range(1, longest + 1):
        nth = [lambda c, i=i: F.lead(c, i).over(after) if i else F.col(c) for i in range(size)]
        whole = whole & (F.size(nth[-1]("words")) > 0)
        runs.append(F.when(whole & nth[-1]("telling"), F.struct(
            F.lit(size).alias("size"),
            F.array_join(F.array(*[n("text") for n in nth]), "\n").alias("text"),
            F.concat(*[n("words") for n in nth]).alias("words"),
        )))
    found = lines.select(
        "row", "doc_id", "line", "telling", F.array_compact(F.array(*runs)).alias("runs")
    ).filter("telling")
    return found.select("row", "doc_id", F.col("line").alias("paragraph"), F.inline("runs"))


def _best_of_overlapping(scored: DataFrame) -> DataFrame:
    """The paragraphs that are the best ones at each of their lines."""
    best = Window.partitionBy("row", "at").orderBy(
        (F.col("family") == "unknown").cast("int"), F.col("template_share").desc(),
        F.col("size"), F.col("probability").desc(), "paragraph",
    )
    lines = F.sequence(F.col("paragraph"), F.col("paragraph") + F.col("size") - 1)
    placed = scored.select("*", F.explode(lines).alias("at"))
    first = placed.withColumn("first", F.row_number().over(best) == 1)
    kept = first.groupBy("row", "paragraph", "size").agg(F.every("first").alias("first"))
    kept = kept.filter("first").select("row", "paragraph", "size")
    return scored.join(kept, ["row", "paragraph", "size"], "left_semi")


def findings(docs: DataFrame, model: Classifier) -> tuple[DataFrame, DataFrame]:
    """All rows as ``(row, doc_id)``, and their licence paragraphs.

    Paragraphs: ``row, doc_id, paragraph`` (its first line)``, size`` (lines)``, family,
    probability, template_share, text``; ``family`` is ``unknown`` where the bound or the
    template comparison is missed. A paragraph begins and ends with a line that holds one of
    the model's words; lines without one are other text.
    """
    known = F.array(*[F.lit(w) for w in model.words]).cast("array<string>")
    text = F.coalesce(F.col("text"), F.lit(""))
    located = materialize(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"),
        F.when(F.arrays_overlap(words_of(text), known), text).alias("text"),
    ), "licence-texts")
    # Written down in between: a filter on the grams would else be evaluated below them,
    # and the words be looked for again at every use of a lambda's argument.
    units = _windows(located.filter(F.col("text").isNotNull()), model.words)
    units = materialize(units, "licence-windows")
    # Grams outside the vocabulary have no weight: only the others are written.
    weighted = F.array(*[F.lit(g) for g in model.vocabulary]).cast("array<string>")
    units = units.withColumn("grams", F.array_intersect(grams(F.col("words")), weighted))
    units = materialize(units, "licence-grams").filter(F.size("grams") > 0)
    keys = ["row", "paragraph", "size"]
    scored = units.drop("grams").join(model.scores(units, keys), keys)
    chances = probabilities(F.col("score"), F.lit(model.temperature))
    scored = scored.withColumn("chances", chances).withColumn(
        "best", F.array_max(F.slice("chances", 1, NONE))
    ).filter(F.get("chances", F.lit(NONE)) < 0.5)
    place = F.array_position(F.slice("chances", 1, NONE), F.col("best"))
    share = F.lit(0.0)
    for i, family in enumerate(FAMILIES):
        share = F.when(F.col("place") == i + 1, similarity(F.col("words"), family)).otherwise(share)
    named = scored.withColumn("place", place).withColumn("template_share", share)
    sure = (F.col("best") >= model.bound) & (F.col("template_share") >= CONFIRMED)
    family = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.col("place").cast("int"))
    named = named.select(
        "row", "doc_id", "paragraph", "size", F.when(sure, family).otherwise("unknown").alias("family"),
        F.round("best", 6).alias("probability"), F.round("template_share", 6).alias("template_share"),
        "text",
    )
    return located.select("row", "doc_id"), _best_of_overlapping(materialize(named, "licences"))


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, licence, licences, n_paragraphs``.

    ``licences`` lists the families of the document's licence paragraphs in name order,
    ``licence`` is the one of the most probable paragraph, the earliest of equals;
    both are empty without any. Null and empty texts have none, equal rows are reported
    alike, once for each, an empty table gives none. Texts are read whole, however long,
    and columns other than ``doc_id`` and ``text`` not at all, whatever their names.
    """
    rows, found = findings(docs, train(docs))
    first = Window.partitionBy("row").orderBy(
        (F.col("family") == "unknown").cast("int"), F.col("probability").desc(), "paragraph"
    )
    ranked = found.withColumn("nth", F.row_number().over(first))
    by_row = ranked.groupBy("row").agg(
        F.max(F.when(F.col("nth") == 1, F.col("family"))).alias("licence"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licences"),
        F.count("*").alias("n_paragraphs"),
    )
    return rows.join(by_row, "row", "left").select(
        "doc_id", F.coalesce("licence", F.lit("")).alias("licence"),
        F.coalesce("licences", F.lit("")).alias("licences"),
        F.coalesce("n_paragraphs", F.lit(0).cast("long")).alias("n_paragraphs"),
    )
