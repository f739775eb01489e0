"""License scans by a trained paragraph classifier, in DataFrame expressions and MLlib only.

Features are the word bigrams of the templates and other training texts below, but for pairs of common words, and the
words that at least SHARED licences among them use. A text is read as one sequence of words, so wrapping doesn't matter,
and its paragraphs are its passages: runs of features with at most GAP words between one and the next. A multinomial logistic regression with an L1 penalty is trained on

* the templates of each family, whole, cut and mixed with other words;
* licences of no family (OTHERS): class ``unknown``;
* near misses (NEAR_MISSES), single features, and passages of the corpus that no template is found in: class ``none``.

The probability of any licence, 1 - p(none), is calibrated on texts and corpus passages that weren't trained on: the
threshold is the one with the highest Youden's J. A passage above it is of the predicted family if at least CONFIRM of
some template of the family is found in it, else of ``unknown``. Of a passage that holds several licences, other families
of which a template is found nearly whole (WHOLE) are reported too.

Every distinct passage of the corpus that no template is found in is trained on or calibrated with, by its hash. Those that
are trained on weigh at most NEGATIVES texts together, so that licences count alike in corpora of any size; the threshold
follows from the counts of all others between the scores of licences. All rows and whole texts are covered. Texts are read
once: passages are few and are checkpointed before the fit.

Edge cases: a null or empty text has no passages and no licences; long texts are read whole; rows that share a doc_id
and a text are reported once; a null doc_id is reported as null; upper case counts as lower case; equal probabilities go
to the first class in order; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed

#: Most weight of all trained passages of the corpus together, in texts.
NEGATIVES = 2000
#: Shares of a template that confirm a prediction, and that count without one; most words between features of a passage.
CONFIRM, WHOLE, GAP = 0.7, 0.95, 12
#: Licences that a word occurs in if it is a feature by itself.
SHARED = 4

TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
        "The Software is provided AS IS, without warranty of any kind, express or implied, including but "
        "not limited to the warranties of merchantability, fitness for a particular purpose and "
        "noninfringement.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the "
        "License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the "
        "GNU Lesser General Public License",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission",
        "This software is provided by the copyright holders and contributors AS IS and any express or "
        "implied warranties are disclaimed.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
        "License.",
    ),
    "CC0": (
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring"
        " rights to this work.",
    ),
    "proprietary": (
        "All rights reserved.",
        "This material may not be published, broadcast, rewritten or redistributed without permission.",
    ),
}

#: Licences of no family above. Every third is kept for calibration.
OTHERS = (
    "Licensed under the zlib License.",
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "Distributed under the Artistic License 2.0, see the file LICENSE for the terms.",
    "Permission to use this material is granted under the terms of the Open Data Commons License.",
    "Released under the PostgreSQL License.",
    "This product may be used under the terms of the license agreement that comes with it.",
    "Subject to the terms of the Common Development and Distribution License, version 1.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Everyone is permitted to copy and distribute verbatim copies of this license document.",
    "Font software licensed under the SIL Open Font License, Version 1.1.",
    "Distributed under the Python Software Foundation License.",
    "You are free to use, modify and distribute this code under the license of its authors.",
    "Use of this software is governed by the license in the file COPYING.",
    "Permission to copy and modify this software for any purpose with or without fee is hereby granted.",
    "Released under the Academic Free License 3.0.",
    "By using the program you agree to the terms of this license.",
    "This is free software released into the public domain by its author under no license.",
    "Licensed under the Blue Harbour Community License.",
    "The code is made available under the Microsoft Public License.",
    "Licensed by the authors under the Green Meadow Terms of Use.",
    "Distributed under the W3C Software Notice and License.",
    "Distributed under the Tall Tree License.",
    "This file is provided under the Quiet Water License.",
)
#: Texts that speak like a licence and are none. Every third is kept for calibration.
NEAR_MISSES = (
    "She was licensed by the harbour office to sail in the bay.",
    "The driver lost his license on the way to the town.",
    "All seats are reserved for members of the club.",
    "They asked for permission to enter the garden of the house.",
    "All rights reserved for guests of the hotel, said the sign.",
    "The terms of the peace were read under the old tree.",
    "A copyright holder may go to court over a song.",
    "The general public was not let in without a ticket.",
    "Without warranty the used car was cheap.",
    "He was granted permission by the king to hunt.",
    "The fishing licence costs ten crowns a year.",
    "The public domain of the state is large.",
    "Under the terms of the will the farm went to the sons.",
    "The new license plates are blue and white.",
    "Poetic license lets a writer bend the facts.",
    "Every right reserved to the crown was named in the act.",
    "The software of the machine was written in a year.",
    "The conditions for a license to sell wine are strict.",
    "It is permitted to swim in the lake provided that the flag is green.",
    "A version of the story was published and broadcast by the station.",
    "The teacher gave written permission to use the library.",
    "Seats with all rights reserved for the founders of the town.",
    "The lake has all rights reserved for its fishers.",
    "They held a permit with rights reserved to sell bread.",
)
NONE, UNKNOWN = "none", "unknown"
_COMMON = frozenset(
    "a all an and any any are as at be been but by for from given has have he her his if in into is it its may me more "
    "my new no nor not of on one only or other our over see she shall should so than that the their them they this to under "
    "up us was we were what when which who will with without would you your".split()
)
_WORDS = "[^a-z0-9]+"


def _words_of(text: str) -> list[str]:
    return [x for x in re.split(_WORDS, text.lower()) if x]


def pairs_of(text: str) -> list[str]:
    """The bigrams of a text that can be features."""
    w = _words_of(text)
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if not {a, b} <= _COMMON]


def features_of(text: str) -> list[str]:
    """The features of a text."""
    return sorted(({*pairs_of(text), *_words_of(text)}) & set(vocabulary()))


def _parts(texts: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Texts to train on, and those kept for calibration."""
    return [t for i, t in enumerate(texts) if i % 3 < 2], [t for i, t in enumerate(texts) if i % 3 == 2]


@lru_cache(maxsize=1)
def vocabulary() -> list[str]:
    """All features, in order."""
    licences = [t for family in TEMPLATES.values() for t in family] + _parts(OTHERS)[0]
    used = Counter(w for t in licences for w in set(_words_of(t)) - _COMMON)
    pairs = {p for t in licences + _parts(NEAR_MISSES)[0] for p in pairs_of(t)}
    return sorted(pairs | {w for w, n in used.items() if n >= SHARED and w.isalpha()})


def passages(docs: DataFrame, vocab: list[str]) -> DataFrame:
    """The passages of ``docs`` (doc_id, text): doc_id, place (its first word, from 0), n_words, and grams, its features."""
    words = docs.select("doc_id", F.xxhash64("text").alias("text"), F.array_remove(F.split(F.lower("text"), _WORDS), "").alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))
    each = lambda grams, known: F.filter(
        F.transform(grams, lambda g, i: F.when(g.isin(known), F.struct(i.alias("i"), g.alias("gram")))), lambda x: x.isNotNull()
    )
    found = F.concat(each(F.col("w"), [g for g in vocab if " " not in g]), each(pairs, [g for g in vocab if " " in g]))
    hits = words.select("doc_id", "text", F.explode(found).alias("hit")).select("doc_id", "text", "hit.i", "hit.gram")
    by = Window.partitionBy("doc_id", "text").orderBy("i")
    starts = hits.withColumn("starts", F.coalesce(F.col("i") - F.lag("i").over(by) > GAP, F.lit(True)).cast("int"))
    numbered = starts.withColumn("passage", F.sum("starts").over(by))
    grouped = numbered.groupBy("doc_id", "text", "passage").agg(F.min("i").alias("place"), F.max(F.col("i") + F.size(F.split("gram", " "))).alias("end"), F.sort_array(F.collect_set("gram")).alias("grams"))
    return grouped.select("doc_id", "place", (F.col("end") - F.col("place")).alias("n_words"), "grams")


def _found(grams: Column, texts: tuple[str, ...]) -> Column:
    """The greatest share of a template's features in a passage."""
    sets = [sorted(set(pairs_of(t))) for t in texts]
    return F.greatest(F.lit(0.0), F.lit(0.0), *(F.size(F.array_intersect(grams, F.array(*map(F.lit, s)))) / len(s) for s in sets))


def _variants(text: str) -> list[str]:
    words = text.split()
    cut = [" ".join(words[: len(words) * 2 // 3]), " ".join(words[len(words) // 3 :])] if len(words) > 12 else []
    return [text, *cut]


def _halves(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The features (grams) of all distinct passages in which no template is confirmed: to train on, and for calibration."""
    known = F.greatest(F.lit(0.0), *(_found(F.col("grams"), texts) for texts in (*TEMPLATES.values(), _parts(OTHERS)[0])))
    plain = checkpointed(found.select("grams").distinct().filter(known < CONFIRM))
    half = F.pmod(F.xxhash64("grams"), F.lit(2))
    return plain.filter(half == 0), plain.filter(half == 1)


class LicenseModel:
    """Classes in order, the fitted regression over the vocabulary, and the calibrated threshold."""

    def __init__(self, names: list[str], vocab: list[str], regression: LogisticRegressionModel, threshold: float):
        self.names, self.vocab, self.regression, self.threshold = names, vocab, regression, threshold

    @classmethod
    def fit(cls, spark: SparkSession, found: DataFrame | None = None) -> LicenseModel:
        """Trained on the texts above and all passages ``found``."""
        names, vocab = [NONE, UNKNOWN, *sorted(TEMPLATES)], vocabulary()
        rows = [(float(names.index(name)), features_of(v)) for name, texts in TEMPLATES.items() for t in texts for v in _variants(t)] * 5
        rows += [(1.0, features_of(v)) for t in _parts(OTHERS)[0] for v in _variants(t)] * 5
        rows += [(0.0, features_of(t)) for t in _parts(NEAR_MISSES)[0]] * 5 + [(0.0, [g]) for g in vocab]
        train = spark.createDataFrame([(*r, 1.0) for r in rows], "label double, grams array<string>, weight double")
        kept = None
        if found is not None:
            trained, kept = _halves(found)
            weight = min(1.0, NEGATIVES / max(1, trained.count()))
            train = train.unionByName(trained.select(F.lit(0.0).alias("label"), "grams", F.lit(weight).alias("weight")))
        regression = LogisticRegression(family="multinomial", regParam=1e-4, elasticNetParam=1.0, maxIter=60, standardization=False, weightCol="weight")
        fitted = regression.fit(_counted(train, vocab))
        model = cls(names, vocab, fitted, 0.5)
        sure = [features_of(t) for t in _parts(OTHERS)[1]] + [features_of(t) for texts in TEMPLATES.values() for t in texts]
        none = [features_of(t) for t in _parts(NEAR_MISSES)[1]]
        tests = spark.createDataFrame([(1, g) for g in sure] + [(0, g) for g in none], "licence int, grams array<string>")
        model.threshold = model.calibrated(tests, kept)
        return model

    def calibrated(self, tests: DataFrame, kept: DataFrame | None = None) -> float:
        """The threshold with the highest Youden's J over ``tests`` (licence 0 or 1, grams) and passages ``kept`` (grams) without a licence."""
        scores = [(r.p, r.licence) for r in self.scored(tests).select("licence", (1 - F.col("p")[0]).alias("p")).collect()]
        counts = [1] * len(scores)
        if kept is not None:
            # J rises from one passage to the next up to the score of a licence, so the last one below each is enough, with their count.
            cuts = F.array(*map(F.lit, sorted({p for p, y in scores if y})))
            at = self.scored(kept).select((1 - F.col("p")[0]).alias("p"))
            between = at.groupBy(F.size(F.filter(cuts, lambda c: c <= F.col("p"))).alias("k")).agg(F.max("p").alias("p"), F.count(F.lit(1)).alias("n")).collect()
            scores, counts = scores + [(r.p, 0) for r in between], counts + [r.n for r in between]
        return best_threshold(scores, counts)

    def scored(self, found: DataFrame) -> DataFrame:
        """``found`` with p, the probabilities of all classes."""
        return self.regression.transform(_counted(found, self.vocab)).withColumn("p", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")


def best_threshold(scores: list[tuple[float, int]], counts: list[int] | None = None) -> float:
    """The midpoint between neighbouring scores with the highest Youden's J, the lowest of equal ones, within 0.05 and 0.95."""
    ranked = sorted((p, y, n) for (p, y), n in zip(scores, counts or [1] * len(scores), strict=True))
    total = max(1, sum(n * y for _, y, n in ranked)), max(1, sum(n * (1 - y) for _, y, n in ranked))
    best, at, below = 0.0, 0.5, [0, 0]
    for (p, y, n), (after, *_) in zip(ranked, [*ranked[1:], (1.0, 0, 0)], strict=False):
        below[y] += n
        j = below[0] / total[1] - below[1] / total[0]
        if after > p and j > best + 1e-12:
            best, at = j, (p + after) / 2
    return min(0.95, max(0.05, at))


def _counted(rows: DataFrame, vocab: list[str]) -> DataFrame:
    """``rows`` with the vector of the features that are there."""
    return CountVectorizerModel.from_vocabulary(vocab, inputCol="grams", outputCol="features", binary=True).transform(rows)


def judged(found: DataFrame, model: LicenseModel) -> DataFrame:
    """Per passage with a licence and family: the columns of ``found`` but grams, family, probability and match."""
    likely = model.scored(found).filter(1 - F.col("p")[0] >= model.threshold)
    best = F.array_position("p", F.array_max(F.slice("p", 2, len(model.names) - 1))) - 1
    share = F.array(F.lit(0.0), F.lit(0.0), *(_found(F.col("grams"), TEMPLATES[n]) for n in model.names[2:]))
    shares = likely.withColumn("best", best.cast("int")).withColumn("share", share)
    sure = F.when(F.get("share", F.col("best")) >= CONFIRM, F.col("best")).otherwise(F.lit(1))
    # A passage may hold templates of several families; one of them is the prediction, or none.
    others = F.filter(F.sequence(F.lit(2), F.lit(len(model.names) - 1)), lambda i: (F.get("share", i) >= WHOLE) & (F.col("best") != i))
    several = F.array_distinct(F.concat(F.when((sure == 1) & (F.size(others) > 0) & (F.col("best") != 1), F.array().cast("array<int>")).otherwise(F.array(sure)), F.when(F.col("best") == 1, F.array().cast("array<int>")).otherwise(others)))
    each = shares.withColumn("k", F.explode(several))
    names = F.array(*map(F.lit, model.names))
    return each.select(
        *(c for c in found.columns if c != "grams"),
        F.get(names, F.col("k")).alias("family"),
        F.round(F.when(F.col("k") == 1, 1 - F.col("p")[0]).otherwise(F.get("p", F.col("k"))), 6).alias("probability"),
        F.round(F.get("share", F.when(F.col("k") == 1, F.col("best")).otherwise(F.col("k"))), 6).alias("match"),
    )


def scan(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """Per licence found: doc_id, place (its first word, from 0), n_words, family, probability, match (share of a template)."""
    found = checkpointed(passages(docs.select("doc_id", "text"), model.vocab if model else vocabulary()))
    return judged(found, model or LicenseModel.fit(docs.sparkSession, found))
