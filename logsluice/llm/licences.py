"""Find licence notices: a trained paragraph classifier, confirmed by comparison with templates. Built-in functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.llm.common import checkpointed, let, text_or_empty

# Usual wordings of licence notices, by family.
TEMPLATES = {
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc0": (
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "reserved": ("All rights reserved.", "Copyright. All rights reserved."),
}
UNKNOWN = "unknown"

TOKEN = r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"
#: Documents from which paragraphs of the unknown class are taken, and paragraphs in all.
SAMPLE_DOCS = 2_000
SAMPLE_PARAGRAPHS = 4_000
#: Sampled paragraphs amid which each template is shown.
AMID = 40
#: Template words in more than this share of sampled paragraphs say nothing and are no features.
COMMON = 0.005
TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def grams(words: Column) -> Column:
    """Words and pairs of neighbours."""

    def both(w: Column) -> Column:
        firsts = F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))
        return F.concat(w, F.transform(firsts, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))))

    return let(words, both)


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("template")) for a, b in rows]))
    return spark.range(1, numPartitions=1).select(both.alias("x")).select("x.*", tokens(F.col("x.template")).alias("words"))


def _paragraphs(docs: DataFrame) -> DataFrame:
    """``(*, paragraph, line)`` of each line of documents with ``_text``."""
    return docs.select("*", F.posexplode(F.split("_text", "\n", -1)).alias("paragraph", "line")).drop("_text")


def _ways(texts: DataFrame, openings: list[str], reach: int) -> DataFrame:
    """``(*, paragraph, line, words, scored, next)`` of each line of ``_text`` with a word: once with ``scored`` its own words and, if a
    template may begin in it (it has the first two words of one, or ends in a first word), once with its words and the ``reach``
    that follow it, however many lines these are on; then ``next`` has the numbers and lengths of those lines. Marks are no
    words, so those of comments fall away."""
    lines = F.transform(F.split("_text", "\n", -1), lambda x, i: F.struct(i.alias("paragraph"), x.alias("line"), tokens(x).alias("words")))
    none = F.lit(None).cast("array<struct<paragraph:int,n:int>>")

    def both(held: Column) -> Column:
        def opens(words: Column) -> Column:
            pairs = F.transform(words, lambda w, k: F.concat_ws(" ", w, F.get(words, k + 1)))
            return F.arrays_overlap(pairs, F.array(*map(F.lit, openings)))

        def ways(x: Column, i: Column) -> Column:
            alone = F.struct(x.alias("x"), x["words"].alias("scored"), none.alias("next"))

            def joined(after: Column) -> Column:
                # Each line has a word, so that ``reach`` lines hold as many words at least.
                words = F.concat(x["words"], F.slice(F.flatten(F.transform(after, lambda y: y["words"])), 1, reach))
                ahead = F.transform(after, lambda y: F.struct(y["paragraph"].alias("paragraph"), F.size(y["words"]).alias("n")))
                return F.array(alone, F.struct(x.alias("x"), words.alias("scored"), ahead.alias("next")))

            return F.when(opens(x["words"]), let(F.slice(held, i + 2, reach), joined)).otherwise(F.array(alone))

        return F.flatten(F.transform(held, ways))

    rows = texts.select("*", F.explode(let(F.filter(lines, lambda x: F.size(x["words"]) > 0), both)).alias("_h")).drop("_text")
    return rows.select("*", "_h.x.*", "_h.scored", "_h.next").drop("_h")


def _examples(templates: DataFrame, sample: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Training rows ``(family, words, fold)``: templates whole, less each word, and amid other text; the unknown class is
    sampled paragraphs, every feature by itself, and beginnings of templates too short to tell."""
    less_one = templates.select(
        "family", F.explode(F.transform(F.sequence(F.lit(1), F.size("words")), lambda k: F.concat(
            F.slice("words", 1, k - 1), F.slice("words", k + 1, F.size("words"))))).alias("words"))
    around = [F.array(*map(F.lit, r["words"][:12])) for r in sample.orderBy("h").limit(AMID).collect()]
    amid = F.explode(F.array(*around, F.array().cast("array<string>"))).alias("around")
    mixed = templates.select("family", "words", amid).select("family", F.concat("around", "words").alias("words"))
    lone = templates.sparkSession.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, vocabulary))).alias("gram"))
    lone = lone.select(F.lit(UNKNOWN).alias("family"), F.split("gram", " ").alias("words"))
    short = templates.select(F.lit(UNKNOWN).alias("family"), F.slice("words", 1, 2).alias("words")).where(F.size("words") > 0)
    rows = mixed.union(less_one).union(lone).union(short)
    rows = rows.union(sample.select(F.lit(UNKNOWN).alias("family"), "words"))
    return rows.where(F.size("words") > 0).withColumn("fold", F.pmod(F.xxhash64("family", "words"), F.lit(5)))


@dataclass(frozen=True)
class Classifier:
    """Families, features, the fitted models that count these and weigh them, and the temperature of the probabilities."""

    families: list[str]
    vocabulary: list[str]
    vectors: CountVectorizerModel
    fitted: LogisticRegressionModel
    temperature: float

    def graded(self, rows: DataFrame, words: str) -> DataFrame:
        """Add ``_p``, the calibrated probability of each family, by the words in an array; the models run in the JVM on sparse vectors."""
        met = self.fitted.transform(self.vectors.transform(rows.withColumn("_grams", grams(F.col(words)))))
        powers = let(vector_to_array(F.col("_raw")), lambda raw: let(F.array_max(raw), lambda most: F.transform(
            raw, lambda x: F.exp((x - most) / F.lit(self.temperature)))))
        shares = let(powers, lambda p: let(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(p, lambda x: x / total)))
        return met.withColumn("_p", shares).select(*rows.columns, "_p")


def train(docs: DataFrame) -> Classifier:
    """The classifier, from templates and a bounded sample of ``_text``.

    Features are words and pairs of words of the templates that are rare in the sample. The temperature that
    makes the probabilities of a fifth of the examples, held out, most likely calibrates them.
    """
    spark = docs.sparkSession
    templates = checkpointed(_templates(spark))
    every = max(1, docs.count() // SAMPLE_DOCS)
    chosen = docs.where(F.pmod(F.xxhash64("_text"), F.lit(every)) == 0)
    lines = checkpointed(
        _paragraphs(chosen.select("_text")).select(tokens(F.col("line")).alias("words"), F.xxhash64("line").alias("h"))
    )
    texts = [row["words"] for row in templates.select("words").collect()]
    known = F.lit(False)
    for words in texts:
        wanted = F.array(*map(F.lit, sorted(set(words))))
        both = F.size(F.array_intersect(F.col("words"), wanted))
        # A line of a template in its usual wrapping has few of the template's words, but hardly any others.
        known |= (both >= 0.7 * len(set(words))) | ((both >= 4) & (both >= 0.7 * F.size(F.array_distinct("words"))))
    sample = checkpointed(lines.where(F.size("words") > 0).where(~known).orderBy("h").limit(SAMPLE_PARAGRAPHS))
    found = templates.select(F.explode(grams(F.col("words"))).alias("gram")).distinct()
    met = sample.select(F.explode(F.array_distinct(grams(F.col("words")))).alias("gram"))
    # Templates are few, so what they hold may be broadcast.
    seen = met.join(F.broadcast(found), "gram", "left_semi").groupBy("gram").count()
    most = max(1, int(COMMON * sample.count()))
    rare = found.join(seen, "gram", "left").where(F.coalesce("count", F.lit(0)) <= most)
    vocabulary = sorted(r["gram"] for r in rare.select("gram").collect())
    families = [*sorted(TEMPLATES), UNKNOWN]

    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    rows = _examples(templates, sample, vocabulary).select(label.alias("label"), grams(F.col("words")).alias("_grams"), "fold")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "_grams", "_features").setBinary(True)
    data = checkpointed(vectors.transform(rows))
    fitted = LogisticRegression(
        featuresCol="_features", rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction",
        family="multinomial", regParam=1e-4, maxIter=60,
    ).fit(data.where("fold > 0"))

    logits = fitted.transform(data.where("fold = 0")).select("label", vector_to_array("_raw").alias("raw"))
    held = logits.withColumn("t", F.explode(F.array(*map(F.lit, TEMPERATURES))))
    loss = F.log(F.aggregate("raw", F.lit(0.0), lambda s, x: s + F.exp((x - F.array_max("raw")) / F.col("t")))) - (
        F.get("raw", F.col("label").cast("int")) - F.array_max("raw")
    ) / F.col("t")
    best = held.groupBy("t").agg(F.avg(loss).alias("loss")).orderBy("loss", "t").first()
    return Classifier(families, vocabulary, vectors, fitted, best["t"] if best else 1.0)


def licence_paragraphs(
    docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", sure: float = 0.5, alike: float = 0.8
) -> DataFrame:
    """Places that read like licence notices: ``keys, paragraph, line, family, probability, template, similarity``.

    A place is a line, by its number in ``paragraph``. It is looked at if it has any feature of the classifier; without one the intercepts
    alone decide, for the unknown class. It is scored by itself and, as notices are wrapped, joined with the words after it, as many as the longest template
    has. ``family`` is the most probable one if it has ``sure`` or more and a template of it is there (``alike`` of its words and pairs or
    more, its ``similarity``). Joined, the line must hold a part of the template; the lines that hold the rest of it, and have no features
    but the template's, are not returned again. If all families together have ``sure`` for the line by itself, but none is confirmed either way, it is
    ``unknown``. Others are not returned.

    Null and empty texts have no paragraphs; repeated rows give repeated results; an empty table
    gives no rows. Columns other than ``keys`` are not looked at. Every line of every text is read.
    """
    own = F.struct(*[F.col(f"`{k}`") for k in keys]).alias("_keys")
    rows = docs.select(own, text_or_empty(text).alias("_text"))
    model = train(rows)
    families, vocabulary = model.families, model.vocabulary
    # A text without any of these words has no feature: single words, and the first of pairs without one.
    alone = {g for g in vocabulary if " " not in g}
    pairs = [g.split(" ") for g in vocabulary if " " in g]
    needed = sorted(alone | {a for a, b in pairs if a not in alone and b not in alone})
    with_any = rows.where(F.arrays_overlap(tokens(F.col("_text")), F.array(*map(F.lit, needed))))
    held = [re.findall(r"[^\W_]+(?:[.+-][^\W_]+)*", t.lower()) for texts in TEMPLATES.values() for t in texts]
    openings = sorted({" ".join(words[:2]) for words in held} | {words[0] for words in held})
    ways = _ways(with_any.withColumn("_text_id", F.monotonically_increasing_id()), openings, max(map(len, held)))
    ways = ways.where(F.arrays_overlap(grams(F.col("words")), F.array(*map(F.lit, vocabulary))))
    known = F.slice("_p", 1, len(families) - 1)
    # What reads like any family: few rows, and from here on only these.
    found = checkpointed(
        model.graded(ways, "scored").where(F.lit(1.0) - F.element_at("_p", len(families)) >= sure).select(
            "_keys", "_text_id", "paragraph", "line", "words", "scored", "next", F.col("next").isNotNull().alias("is_joined"),
            F.array_max(known).alias("probability"),
            F.element_at(F.array(*map(F.lit, families)), F.array_position(known, F.array_max(known)).cast("int")).alias("_best"),
        )
    )
    wording = F.struct("template", F.col("words").alias("words"), F.array_distinct(grams(F.col("words"))).alias("grams"))
    wordings = _templates(rows.sparkSession).groupBy(F.col("family").alias("_family")).agg(F.collect_list(wording).alias("_wordings"))
    compared = F.transform("_wordings", lambda t: F.struct(
        (F.size(F.array_intersect(t["grams"], F.col("_grams"))) / F.size(t["grams"])).alias("similarity"),
        t["template"].alias("template"), t["words"].alias("words"), t["grams"].alias("grams")))
    # Templates are few, so they may be broadcast.
    matched = (
        found.withColumn("_grams", grams(F.col("scored")))
        .join(F.broadcast(wordings), F.col("_best") == F.col("_family"))
        .select(*found.columns, F.array_max(compared).alias("_m"))
    )
    confirmed = (F.col("probability") >= sure) & (F.col("_m.similarity") >= alike)
    without = grams(F.slice("scored", F.size("words") + 1, F.size("_m.words") - 1))
    begins = F.size(F.array_intersect(F.col("_m.grams"), without)) / F.size("_m.grams") < F.col("_m.similarity")
    features = F.array_intersect(grams(F.col("words")), F.array(*map(F.lit, vocabulary))).alias("features")
    ways = matched.withColumn("_sure", confirmed).where(~F.col("is_joined") | (F.col("_sure") & begins)).select("*", features)
    of = F.struct(*[c for c in ways.columns if c not in ("_text_id", "paragraph", "scored")])
    order = F.when(F.col("_sure"), F.col("is_joined").cast("int")).otherwise(2)
    places = checkpointed(ways.groupBy("_text_id", "paragraph").agg(F.min_by(of, order).alias("_w")).select("_text_id", "paragraph", "_w.*"))
    # How many words of the template are left after the line, and which lines these take.
    left = F.size("_m.words") - F.size(F.filter("words", lambda w: F.array_contains(F.col("_m.words"), w)))
    before = F.transform("next", lambda x, i: F.struct(
        x["paragraph"].alias("paragraph"), F.aggregate(F.slice("next", 1, i), F.lit(0), lambda n, y: n + y["n"]).alias("before")))
    last = F.coalesce(F.array_max(F.transform(F.filter(before, lambda x: x["before"] < left), lambda x: x["paragraph"])), F.col("paragraph"))
    starts = places.where("_sure and is_joined").select("_text_id", F.struct("paragraph", last.alias("last"), F.col("_m.grams").alias("held"), "features").alias("x"))
    # In turn, each that is no part of the one before.

    def in_turn(found: Column) -> Column:
        def part(x: Column, y: Column) -> Column:
            return F.coalesce((x["paragraph"] <= y["last"]) & (F.size(F.array_except(x["features"], y["held"])) == 0), F.lit(False))

        return F.aggregate(found, F.slice(found, 1, 0), lambda done, x: F.when(part(x, F.get(done, F.size(done) - 1)), done).otherwise(F.concat(done, F.array(x))))

    rest = starts.groupBy(F.col("_text_id").alias("_of")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    rest = rest.select("_of", F.explode(let(F.col("xs"), in_turn)).alias("_s"))
    same = (F.col("_text_id") == F.col("_of")) & (F.col("paragraph") > F.col("_s.paragraph")) & (F.col("paragraph") <= F.col("_s.last"))
    goes = (~F.col("_sure") | F.col("is_joined")) & (F.size(F.array_except("features", "_s.held")) == 0)
    return places.join(rest, same & goes, "left_anti").select(
        "_keys.*", "paragraph", "line", F.when(F.col("_sure"), F.col("_best")).otherwise(F.lit(UNKNOWN)).alias("family"),
        "probability", "_m.template", "_m.similarity",
    )
