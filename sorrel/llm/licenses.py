"""Licence scans with a trained paragraph classifier, in DataFrame operations only.

Texts are split into paragraphs: lines, and runs of lines for notices that are
broken into lines.  A paragraph's words and word pairs,
those that occur in the licence templates, are a sparse vector; a multinomial
logistic regression gives the licence family or ``none``.  A second, binary
regression on the margin between the two best classes gives the calibrated
probability that the prediction holds; it is fitted on notices the classifier
has not seen, among them notices of other licences.  Below one half a
paragraph is ``unknown``: it reads like a licence notice, but no family is
certain.  A prediction is confirmed by comparison with the family's templates:
the largest share of a template's word pairs that stands in the paragraph.

Training rows are the templates below, shortened and mixed by rules, and at
most ``prose`` ordinary documents of at most ``prose_chars`` characters, those
with the smallest hashed text, whose paragraphs share no run of three words
with a template.  Paragraphs without any word of the templates are ``none``
without a model.

Null and empty texts have no paragraph; repeated rows and null keys give rows of
their own, an empty table gives no row, and of classes with equal scores the one whose name
sorts last is the prediction.  Other columns are left out.  The classifier's rows and templates are bounded; every paragraph of
every text is classified.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from sorrel.plans.staging import stage

NONE, UNKNOWN = "none", "unknown"
# Share of a template's word pairs that confirms a family.
CONFIRMED = 0.6

# Notices of each licence family.
TEMPLATES = {
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Released under the GNU AGPL v3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This software is distributed under the Apache License 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-clause BSD license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Available under the Creative Commons Attribution license.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under a Creative Commons non-commercial license.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc0": (
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This is free and unencumbered work released into the public domain.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the GNU GPL v3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the GNU LGPL v3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
# Notices of no family above, for calibration.
OTHERS = (
    "Licensed under the Eclipse Public License, Version 2.0.",
    "Released under the zlib License.",
    "Licensed under the Boost Software License, Version 1.0.",
    "This work is licensed under the European Union Public Licence, version 1.2.",
    "This software is proprietary and may not be distributed without written permission.",
    "All rights reserved. No part of this work may be reproduced without permission of the publisher.",
    "Licensed under a commercial license agreement; see the terms and conditions.",
    "Use of this file is subject to the terms of the Artistic License 2.0.",
    "This library is licensed under the Common Development and Distribution License, version 1.1.",
)
# Words put around notices in training rows.
LEAD = ("", "copyright 2020 the authors", "note", "see", "all files here are", "the data set is", "unless stated otherwise")


class Model(NamedTuple):
    """A fitted scanner: vocabulary, classifier, calibration and its class names."""

    vocabulary: list[str]
    classifier: LogisticRegressionModel
    calibration: LogisticRegressionModel
    classes: list[str]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_runs(tokens: Column, n: int) -> Column:
    """Runs of ``n`` words joined by a blank."""
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def word_list(text: str) -> list[str]:
    """The words of a fixed notice, as :func:`words` splits them."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def pairs_of(tokens: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False)]


# Words too common to tell a notice by themselves.
COMMON = frozenset("the of to a and or in is be this that it you all by can as with for on at may not use any an from no are if".split())


def telling_words() -> list[str]:
    """Words of the templates without the common ones."""
    return sorted({w for texts in TEMPLATES.values() for t in texts for w in word_list(t)} - COMMON)


def vocabulary() -> list[str]:
    """Telling words and all word pairs of the templates."""
    return sorted({*telling_words(), *(p for texts in TEMPLATES.values() for t in texts for p in pairs_of(word_list(t)))})


def _augmented(text: str) -> list[str]:
    """A notice with leads, and with single words left out."""
    tokens = word_list(text)
    out = [" ".join([lead, *tokens]).strip() for lead in LEAD]
    skipped = range(0, len(tokens), 2) if len(tokens) > 6 else ()
    return out + [" ".join(tokens[:k] + tokens[k + 1 :]) for k in skipped]


def training_rows() -> list[tuple[str, str, bool]]:
    """``(text, family, held)``; held rows calibrate, with other licences as ``unknown``."""
    rows = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            rows += [(row, family, n % 3 == 2) for n, row in enumerate(_augmented(text))]
    for text in OTHERS:
        rows += [(row, UNKNOWN, True) for row in _augmented(text)]
    return rows


def line_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, w)``: the words of every line of a text."""
    return docs.select(F.col(key).alias("id"), F.transform(F.split(F.col(text), "\n"), lambda line: words(line)).alias("w"))


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, paragraph, words)`` of every line that has words."""
    rows = line_words(docs, key, text).select("id", F.posexplode("w").alias("paragraph", "words"))
    return rows.filter(F.size("words") > 0)


def near_units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, row, paragraph, lines, words)``: lines with a telling word, and runs of such lines.

    A run is what a notice broken into lines looks like: lines with a telling word that follow
    each other, with at most one line without one, and no line without words, between them.
    Lines are cut into words once, inside the arrays.
    """
    telling = F.array(*map(F.lit, telling_words()))

    def told(x: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), F.arrays_overlap(x, telling).alias("told"))

    numbers = F.transform(F.filter(F.transform("w", told), lambda x: x["told"]), lambda x: x["i"])
    rows = line_words(docs, key, text).select("id", F.monotonically_increasing_id().alias("row"), "w", numbers.alias("near"))

    def goes_on(j: Column) -> Column:
        gap = F.get("near", j) - F.get("near", j - 1)
        return (gap == 1) | ((gap == 2) & (F.size(F.get("w", F.get("near", j) - 1)) > 0))

    every = F.when(F.size("near") > 0, F.sequence(F.lit(0), F.size("near") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("starts", F.filter(every, lambda j: (j == 0) | ~goes_on(j)))

    def run(j: Column, n: Column) -> Column:
        last = F.coalesce(F.get("starts", n + 1), F.size("near")) - 1
        return F.struct(F.get("near", j).alias("first"), (F.get("near", last) - F.get("near", j) + 1).alias("lines"))

    runs = F.filter(F.transform("starts", run), lambda r: r["lines"] > 1)
    single = F.transform("near", lambda i: F.struct(i.alias("first"), F.lit(1).alias("lines")))
    units = rows.withColumn("u", F.explode(F.concat(single, runs)))
    return units.select(
        "id", "row", F.col("u.first").alias("paragraph"), F.col("u.lines").alias("lines"),
        F.flatten(F.slice("w", F.col("u.first") + 1, F.col("u.lines"))).alias("words"),
    )


def with_features(rows: DataFrame, known: list[str]) -> DataFrame:
    """Adds ``pairs`` and the sparse vector ``features`` of the known words and pairs."""
    paired = rows.withColumn("pairs", word_runs(F.col("words"), 2)).withColumn("_grams", F.concat("words", "pairs"))
    model = CountVectorizerModel.from_vocabulary(known, inputCol="_grams", outputCol="features", minTF=1.0)
    model.setBinary(True)
    return model.transform(paired).drop("_grams")


def with_prediction(rows: DataFrame, classifier: LogisticRegressionModel, classes: list[str]) -> DataFrame:
    """Adds ``family`` (the best class) and ``margin`` to the second best."""
    scored = classifier.transform(rows).withColumn("_raw", vector_to_array("rawPrediction"))
    named = F.transform("_raw", lambda x, i: F.struct(x.alias("s"), F.get(F.array(*map(F.lit, classes)), i).alias("c")))
    ranked = scored.withColumn("_ranked", F.sort_array(named, asc=False))
    return ranked.withColumn("family", F.col("_ranked")[0]["c"]).withColumn(
        "margin", F.col("_ranked")[0]["s"] - F.col("_ranked")[1]["s"]
    ).drop("_raw", "_ranked", "rawPrediction", "probability", "prediction")


def fit(docs: DataFrame, text: str = "text", prose: int = 150, prose_chars: int = 8000) -> Model:
    """A model from the templates and a bounded sample of ordinary paragraphs."""
    spark = docs.sparkSession
    known, classes = vocabulary(), [NONE, *TEMPLATES]
    threes = sorted({" ".join(t[i : i + 3]) for x in TEMPLATES.values() for t in map(word_list, x) for i in range(len(t) - 2)})
    told = spark.createDataFrame(training_rows(), "line string, class string, held boolean")
    told = told.select(words(F.col("line")).alias("words"), "class", "held")
    plain = docs.select(F.col(text).alias("text")).filter(F.length("text") <= prose_chars).orderBy(F.xxhash64("text"), "text").limit(prose)
    plain = paragraphs(plain.withColumn("id", F.lit(0)), "id", "text").filter(
        ~F.arrays_overlap(word_runs(F.col("words"), 3), F.array(*map(F.lit, threes)))
    ).select("words", F.lit(NONE).alias("class"), (F.pmod(F.xxhash64("words"), F.lit(3)) == 0).alias("held"))
    rows = stage(told.unionByName(plain).coalesce(1), "notices")
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("class")).cast("double") - 1
    vectors = with_features(rows, known).withColumn("label", number)
    classifier = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60, featuresCol="features", labelCol="label")
    model = classifier.fit(vectors.filter(~F.col("held") & (F.col("label") >= 0)).select("features", "label"))
    checked = with_prediction(vectors.filter("held"), model, classes)
    calibration = checked.filter(F.col("family") != NONE).select(
        array_to_vector(F.array("margin")).alias("m"), (F.col("family") == F.col("class")).cast("double").alias("label")
    )
    return Model(known, model, LogisticRegression(regParam=0.001, maxIter=60, featuresCol="m").fit(calibration), classes)


def template_share(pairs: Column, family: str) -> Column:
    """Largest share of the word pairs of one of the family's templates that is among ``pairs``."""
    lists = [sorted(set(pairs_of(word_list(t)))) for t in TEMPLATES[family]]
    return F.greatest(F.lit(0.0), *(F.size(F.array_intersect(pairs, F.array(*map(F.lit, p)))) / len(p) for p in lists))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """``(key, paragraph, lines, family, probability, template_share, confirmed)``.

    One row for every paragraph whose best class is a licence: ``family`` is its
    name, or ``unknown`` if the calibrated probability is below one half;
    ``paragraph`` is its first line.  A run of lines is reported, in place of its lines, if it is
    confirmed and none of its lines is.
    """
    model = model or fit(docs, text)
    near = near_units(docs, key, text)
    found = with_prediction(with_features(near, model.vocabulary), model.classifier, model.classes).filter(F.col("family") != NONE)
    calibrated = model.calibration.transform(found.withColumn("m", array_to_vector(F.array("margin"))))
    shares = F.coalesce(*(F.when(F.col("family") == c, template_share(F.col("pairs"), c)) for c in TEMPLATES))
    told = calibrated.select(
        "id", "row", "paragraph", "lines", "family", vector_to_array("probability")[1].alias("probability"), shares.alias("template_share")
    )
    sure = F.col("probability") >= 0.5
    judged = told.withColumn("confirmed", sure & (F.col("template_share") >= CONFIRMED)).withColumn("end", F.col("paragraph") + F.col("lines"))
    # Lines and runs of one text meet in a window; only what looks like a licence is shuffled.
    text_of = Window.partitionBy("row")
    certain = judged.filter((F.col("lines") == 1) | F.col("confirmed")).withColumns({
        "single": F.collect_list(F.when(F.col("confirmed") & (F.col("lines") == 1), F.col("paragraph"))).over(text_of),
        "runs": F.collect_list(F.when(F.col("lines") > 1, F.struct("paragraph", "end"))).over(text_of),
    })

    def plain(run: Column) -> Column:
        return ~F.exists("single", lambda i: (i >= run["paragraph"]) & (i < run["end"]))

    covered = F.exists("runs", lambda r: (F.col("paragraph") >= r["paragraph"]) & (F.col("paragraph") < r["end"]) & plain(r))
    kept = certain.filter(F.when(F.col("lines") > 1, plain(F.struct("paragraph", "end"))).otherwise(~covered))
    return kept.select(
        F.col("id").alias(key), F.col("paragraph").cast("long").alias("paragraph"), F.col("lines").cast("long").alias("lines"),
        F.when(F.col("probability") >= 0.5, F.col("family")).otherwise(UNKNOWN).alias("family"), "probability", "template_share", "confirmed",
    )
