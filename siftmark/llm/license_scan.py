"""Licence scan: a trained paragraph classifier, confirmed against templates.

Paragraphs are lines. Sparse word n-grams feed a multinomial logistic regression over
licence families and an *unknown* class: two and three words in any paragraph, in those
of at most ``SHORT`` words also single licence names and how many words no template has.
It is trained on word windows of the templates below, on notices that only name a
licence, and as unknown on word pairs of the templates, names among foreign words,
notices of other names and every paragraph of the corpus without a licence's triple. These
are counted by their features (most have none), so training reads a row per set of
features; together they weigh ``CORPUS_WEIGHT`` rows at most. The probability from which a
family is accepted is calibrated on held-out rows, so that at most ``FALSE_SHARE`` of the
unknown ones pass. A prediction is confirmed when the paragraph
and a template of the family share enough three-word runs, one of them of that family
alone, or when the paragraph is a notice with a name of the family and little else.

N-grams are those of the templates and notices that have a telling word (one that is not
a function word). A paragraph without such a pair and without a name has no feature of a
licence, so it is left out before scoring; that changes no result.

Null and empty texts have no paragraphs. Repeated rows give repeated findings. An
empty corpus gives no findings. All steps are DataFrame functions and Spark ML.
"""

from __future__ import annotations

import json
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

UNKNOWN = "unknown"
#: What all paragraphs of the corpus weigh in training and calibration, in template rows.
CORPUS_WEIGHT = 2000
FALSE_SHARE = 0.01
LEAST_PROBABILITY = 0.5
LEAST_SHARED = 0.5
WHOLE_WEIGHT = 10
#: Words of a paragraph that may name its licence by a single word, and the share of them
#: that must be a name or belong to a notice.
SHORT = 10
LEAST_NAMED = 0.75

# Wordings of licence notices, by family.
TEMPLATES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL-3.0 license.",
        "under the terms of the GNU Affero General Public License as published by the Free "
        "Software Foundation",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
        "file except in compliance with the License. You may obtain a copy of the License at",
        "Released under the Apache-2.0 license.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
        "International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GPL-3.0 license.",
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL-2.1 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without "
        "restriction",
        "The software is provided as is, without warranty of any kind, express or implied",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
        "This document is confidential and proprietary. Reproduction without written permission "
        "is prohibited.",
    ],
    "public-domain": [
        "This work is released into the public domain.",
        "Released under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
}
# Names and identifiers of licences, by family.
NAMES = {
    "agpl": ["AGPL", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "GNU AGPL",
             "GNU Affero General Public License", "GNU Affero General Public License v3"],
    "apache-2.0": ["Apache-2.0", "Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0"],
    "bsd": ["BSD", "BSD-2-Clause", "BSD-3-Clause", "2-Clause BSD", "3-Clause BSD", "New BSD"],
    "cc-by": ["CC BY", "CC BY 4.0", "CC-BY-3.0"],
    "cc-by-nc": ["CC BY-NC", "CC BY-NC 4.0", "CC-BY-NC-3.0"],
    "cc-by-sa": ["CC BY-SA", "CC BY-SA 4.0", "CC-BY-SA-3.0"],
    "gpl": ["GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GPL-2.0-only", "GPL-3.0-or-later",
            "GNU GPL", "GNU General Public License", "GNU General Public License v2",
            "GNU General Public License v3"],
    "lgpl": ["LGPL", "LGPLv3", "LGPL-2.1", "LGPL-3.0", "LGPL-2.1-or-later", "GNU LGPL",
             "GNU Lesser General Public License"],
    "mit": ["MIT"],
    "mpl-2.0": ["MPL", "MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License"],
    "public-domain": ["CC0", "CC0-1.0", "CC0 1.0 Universal", "Unlicense"],
}
# Forms of notices; names that belong to no family here; telling names.
FORMS = [
    "{}", "License: {}", "Licence: {}", "{} License", "SPDX-License-Identifier: {}",
    "This code is {} licensed.", "Licensed under {}.", "Licensed under the {}.",
    "Released under the {} license.", "Available under the {}.", "License {}",
]
OTHER_NAMES = ["ISC", "EUPL-1.2", "Zlib", "Artistic 2.0", "WTFPL", "Ms-PL", "Example"]
NAME_WORDS = (
    "affero agpl agplv3 apache bsd cc cc0 gpl gplv2 gplv3 lesser lgpl lgplv3 mit mozilla mpl nc "
    "unlicense"
).split()

# Template words that tell nothing on their own.
FUNCTION_WORDS = (
    "0 1 2 3 4 a all and any are as at be by can express file following form forms free in into "
    "is it kind may met not obtain obtaining of or person provided redistribute sa source "
    "subject that the this to under use v version with without work you"
).split()


def words_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring words, joined by spaces."""
    count = F.size(words) - (n - 1)
    return F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(words, i, n), " ")
        ),
    ).otherwise(F.array().cast("array<string>"))


def _telling(runs: Column) -> Column:
    dull = F.array(*map(F.lit, FUNCTION_WORDS))
    return F.filter(runs, lambda r: F.size(F.array_except(F.split(r, " "), dull)) > 0)


def _split(text: str) -> list[str]:
    """:func:`words_of` of a template."""
    return re.findall("[a-z0-9]+", text.lower())


def _literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


_FORM_WORDS = sorted({w for form in FORMS for w in _split(form)} | {"v2", "v3"})
_KNOWN_WORDS = sorted(
    {w for held in (TEMPLATES, NAMES) for texts in held.values() for t in texts for w in _split(t)}
    | set(_FORM_WORDS)
)
_FOREIGN = ["+1", "+2", "+3"]


def _constant(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """The fixed ``rows`` as a one-task DataFrame of JVM expressions."""
    held = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1, numPartitions=1).select(F.inline(held))


def _notices() -> list[tuple[str, list[str]]]:
    """family, words of every form with every name."""
    return [(f, _split(form.format(n))) for f in NAMES for n in NAMES[f] for form in FORMS]


def _named(words: Column) -> Column:
    """In a short paragraph its telling names and how many words (up to three) are foreign."""
    names = F.transform(F.array_intersect(words, _literals(NAME_WORDS)), lambda w: F.concat(F.lit("="), w))
    foreign = F.least(F.lit(3), F.size(F.array_except(words, _literals(_KNOWN_WORDS))))
    count = F.when(foreign > 0, F.array(F.concat(F.lit("+"), foreign.cast("string"))))
    none = F.array().cast("array<string>")
    return F.when(F.size(words) <= SHORT, F.concat(names, F.coalesce(count, none))).otherwise(none)


def features_of(words: Column) -> Column:
    return F.array_distinct(F.concat(_runs(words, 2), _runs(words, 3), _named(words)))


def templates(spark: SparkSession) -> DataFrame:
    """family, words of every template; one row each."""
    rows = [F.struct(F.lit(f).alias("family"), F.lit(t).alias("t")) for f in TEMPLATES for t in TEMPLATES[f]]
    held = spark.range(1, numPartitions=1).select(F.explode(F.array(*rows)).alias("r"))
    return held.select("r.family", words_of(F.col("r.t")).alias("words"))


def _windows(known: DataFrame) -> DataFrame:
    """Every run of at least three words that starts or ends a template, and the whole."""
    n = F.size("words")
    cuts = F.sequence(F.lit(3), n)
    heads = F.transform(cuts, lambda k: F.slice("words", 1, k))
    tails = F.transform(cuts, lambda k: F.slice("words", n - k + 1, k))
    return known.select("family", F.explode(F.array_union(heads, tails)).alias("words"))


def _pairs(known: DataFrame) -> DataFrame:
    """Neighbouring template words on their own, which name no licence yet."""
    places = F.sequence(F.lit(1), F.size("words") - 1)
    pairs = F.transform(places, lambda i: F.slice("words", i, 2))
    found = known.select(F.lit(UNKNOWN).alias("family"), F.explode(pairs).alias("words")).distinct()
    return found.where(~F.arrays_overlap("words", _literals(NAME_WORDS)))


def _without_licence() -> list[list[str]]:
    """Notices of other names, and every telling name among foreign words."""
    others = [_split(form.format(name)) for form in FORMS for name in OTHER_NAMES]
    filler = ["foreign", "filler", "wording", "elsewhere"]
    among = [[w, *filler[:n]] for w in NAME_WORDS for n in (1, 2, 3, 4)]
    return others + among + [[*x[1:], x[0]] for x in among]


def _runs_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)}


def _vocabulary() -> list[str]:
    """Telling pairs and triples of templates and notices, names, counts of foreign words."""
    whole = [_split(t) for texts in TEMPLATES.values() for t in texts] + [w for _, w in _notices()]
    dull = set(FUNCTION_WORDS)
    runs = {r for words in whole for r in _runs_of(words) if set(r.split()) - dull}
    return sorted(runs | {"=" + w for w in NAME_WORDS} | set(_FOREIGN))


def _of_families(spark: SparkSession) -> DataFrame:
    """family, of_family (words of its templates), own (runs of no other), names."""
    runs = {
        f: set().union(
            *(_runs_of(_split(t)) for t in TEMPLATES[f]), *(_runs_of(w) for g, w in _notices() if g == f)
        )
        for f in TEMPLATES
    }
    rows = [
        {
            "family": f,
            "of_family": [_split(t) for t in TEMPLATES[f]],
            "own": sorted(runs[f] - set().union(*(r for g, r in runs.items() if g != f))),
            "names": [_split(n) for n in NAMES.get(f, [])],
        }
        for f in TEMPLATES
    ]
    return _constant(
        spark,
        rows,
        "family: string, of_family: array<array<string>>, own: array<string>,"
        " names: array<array<string>>",
    )


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, paragraph (line number from 0), words of every line with a word."""
    # The words are made before the lines are dealt out: a filter on the words of a
    # line can then not be moved below and work them out once per use.
    lines = F.transform(F.split(F.col(text), "\n"), words_of)
    found = docs.select(F.col(key), F.posexplode(lines).alias("paragraph", "words"))
    return found.where(F.size("words") > 0)


def shared_runs(words: Column, template: Column) -> Column:
    """Share of three-word runs (of the shorter side) that both have, 0 to 1."""
    ours, theirs = F.array_distinct(_runs(words, 3)), F.array_distinct(_runs(template, 3))
    least = F.least(F.size(ours), F.size(theirs))
    both = F.size(F.array_intersect(ours, theirs))
    return F.when(least > 0, both / least).otherwise(F.lit(0.0))


def _fifth(words: Column) -> Column:
    return F.pmod(F.xxhash64(words), F.lit(5)) == 0


def unknown_features(
    docs: DataFrame, key: str, text: str, vocabulary: list[str], cue_words: Column
) -> DataFrame:
    """features (sorted, of the vocabulary), held_out, n: every paragraph without a triple."""
    words, triples = F.col("words"), F.array(*[F.lit(v) for v in vocabulary if v.count(" ") == 2])
    # Only lines with a telling word have runs of the vocabulary; of the others names and
    # counts are all there is.
    held = F.array_intersect(features_of(words), F.array(*map(F.lit, vocabulary)))
    found = paragraphs(docs, key, text).select(
        F.when(F.arrays_overlap(words, cue_words), held).otherwise(_named(words)).alias("features"),
        _fifth(words).alias("held_out"),
    )
    counted = found.select(F.array_sort("features").alias("features"), "held_out")
    counted = counted.groupBy("features", "held_out").agg(F.count("*").alias("n"))
    return counted.where(~F.arrays_overlap("features", triples))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph that names a licence.

    Returns key, paragraph, family, probability, similarity (to the family's nearest
    template) and confirmed.
    """
    spark = docs.sparkSession
    known = templates(spark)
    classes = [UNKNOWN, *TEMPLATES]
    vocabulary = _vocabulary()
    pairs = F.array(*[F.lit(v) for v in vocabulary if v.count(" ") == 1])
    cues = {w for v in vocabulary for w in v.split(" ") if v not in _FOREIGN}
    cues = sorted({w.removeprefix("=") for w in cues} - set(FUNCTION_WORDS))
    cue_words = F.array(*map(F.lit, cues))
    plain = materialize(unknown_features(docs, key, text, vocabulary, cue_words), "license_unknown")
    each = max(1.0, (plain.agg(F.sum("n").alias("n")).first().n or 0) / CORPUS_WEIGHT)
    rows = _windows(known).unionByName(_pairs(known))
    # Whole notices are learned in any case, and count more than cuts of them.
    made = _notices() + [(UNKNOWN, words) for words in _without_licence()]
    fixed = [{"family": f, "words": words} for f, words in made]
    whole = known.unionByName(_constant(spark, fixed, "family: string, words: array<string>"))
    whole = whole.withColumn("weight", F.lit(float(WHOLE_WEIGHT)))
    rows = rows.withColumn("weight", F.lit(1.0)).unionByName(whole)
    rows = rows.select(
        "weight",
        "family",
        features_of(F.col("words")).alias("features"),
        (_fifth(F.col("words")) & (F.col("weight") == 1)).alias("held_out"),
        F.lit(round(each)).cast("long").alias("n"),
    ).unionByName(
        plain.select(
            (F.col("n") / each).alias("weight"), F.lit(UNKNOWN).alias("family"), "features", "held_out", "n"
        )
    )
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("family")).cast("double")
    rows = rows.withColumn("label", place - 1)
    rows = materialize(rows.coalesce(2), "license_training")
    vector = CountVectorizerModel.from_vocabulary(
        vocabulary, inputCol="features", outputCol="vector", minTF=0.0
    ).setBinary(True)
    model = LogisticRegression(
        featuresCol="vector",
        labelCol="label",
        weightCol="weight",
        family="multinomial",
        regParam=0.002,
        maxIter=40,
    ).fit(vector.transform(rows.where(~F.col("held_out"))))

    def scored(df: DataFrame) -> DataFrame:
        chances = vector_to_array("probability")
        found = model.transform(vector.transform(df)).withColumn("chances", chances)
        licences = F.slice("chances", 2, len(classes) - 1)
        return found.withColumn("best", F.array_max(licences)).withColumn(
            "family", F.element_at(
                F.array(*map(F.lit, classes[1:])),
                F.array_position(licences, F.array_max(licences)).cast("int"),
            )
        ).drop("chances", "vector", "rawPrediction", "probability", "prediction")

    limit = (
        scored(rows.where(F.col("held_out") & (F.col("label") == 0)))
        .agg(F.percentile("best", F.lit(1 - FALSE_SHARE), F.col("n")).alias("p"))
        .first()
        .p
    )
    limit = max(LEAST_PROBABILITY, limit or 0.0)

    telling = docs.select(F.col(key), F.col(text)).where(
        F.arrays_overlap(F.split(F.lower(F.col(text)), "[^a-z0-9]+"), cue_words)
    )
    candidates = (
        paragraphs(telling, key, text)
        .where(F.arrays_overlap("words", cue_words))
        .where(
            F.arrays_overlap(_runs(F.col("words"), 2), pairs)
            | ((F.size("words") <= SHORT) & F.arrays_overlap("words", _literals(NAME_WORDS)))
        )
        .withColumn("features", features_of(F.col("words")))
    )
    # Written, so that the later filter on the score does not work them out again.
    candidates = materialize(candidates, "license_candidates")
    found = scored(candidates).where(F.col("best") >= limit)
    words = F.col("words")
    own = F.arrays_overlap(F.concat(_runs(words, 2), _runs(words, 3)), F.col("own"))
    similar = F.array_max(F.transform("of_family", lambda t: shared_runs(words, t)))
    shown = F.size(F.array_intersect(F.array_distinct(words), F.flatten(F.array(F.flatten("names"), _literals(_FORM_WORDS)))))
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    by_name = F.exists(
        "names", lambda n: F.contains(line, F.concat(F.lit(" "), F.array_join(n, " "), F.lit(" ")))
    )
    named = F.when(
        (F.size(words) <= SHORT) & by_name, shown / F.size(F.array_distinct(words))
    ).otherwise(F.lit(0.0))
    similarity = F.greatest(F.coalesce(similar, F.lit(0.0)), named)
    confirmed = ((similar >= LEAST_SHARED) & own) | (named >= LEAST_NAMED)
    nearest = F.broadcast(_of_families(spark))  # bounded by the templates
    return found.join(nearest, "family").select(
        key,
        F.col("paragraph").cast("long").alias("paragraph"),
        "family",
        F.round("best", 6).alias("probability"),
        F.round(similarity, 6).alias("similarity"),
        confirmed.alias("confirmed"),
    )
