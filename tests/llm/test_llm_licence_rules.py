"""Licence scans against a plain version that uses the weights of the fitted classifier, and on odd rows."""

import math
import re

import pytest
from odd import ROWS, odd
from pyspark.sql import functions as F

from logsluice.llm.common import text_or_empty
from logsluice.llm.licences import TEMPLATES, licence_paragraphs, train

PROSE = [f"The {i} way of telling that rivers and hills are quiet in the morning of day {i}, as a book says" for i in range(60)]
NOTICES = [
    "Released under the MIT License.", "x\n# Licensed under the Apache License,\n# Version 2.0.\ny", "Licensed under CC BY-NC 4.0. And more.",
    "All rights reserved.", "The license of my neighbour's dog is reserved, said the Free Software man.", "GNU General Public License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files",
    "You may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Licensed under the Zebra Stripes License, Version 9.",
]


def words_of(text):
    return re.findall(r"[^\W_]+(?:[.+-][^\W_]+)*", text.lower())


def grams_of(words):
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def share(template, words):
    own = set(grams_of(words_of(template)))
    return len(own & set(grams_of(words))) / len(own)


def plain(model, text, sure=0.5, alike=0.8):
    """Family of each line that is found by itself, and lines that may begin a wrapped notice with what they confirm."""
    weights = model.fitted.coefficientMatrix.toArray()
    start = list(model.fitted.interceptVector)
    place = {g: k for k, g in enumerate(model.vocabulary)}
    openings = {tuple(words_of(t)[:n]) for ts in TEMPLATES.values() for t in ts for n in (1, 2)}
    reach = max(len(words_of(t)) for ts in TEMPLATES.values() for t in ts)

    def judge(words):
        met = {place[g] for g in grams_of(words) if g in place}
        raw = [s + sum(w[k] for k in met) for s, w in zip(start, weights)]
        powers = [math.exp((x - max(raw)) / model.temperature) for x in raw]
        p = [x / sum(powers) for x in powers]
        if 1 - p[-1] < sure:
            return None
        k = max(range(len(p) - 1), key=lambda k: (p[k], -k))
        similarity, template = max((share(t, words), t) for t in TEMPLATES[model.families[k]])
        return model.families[k], p[k] >= sure and similarity >= alike, template, similarity

    lines = [(n, words_of(x)) for n, x in enumerate(text.split("\n")) if words_of(x)]
    out = {}
    for at, (n, words) in enumerate(lines):
        if not any(g in place for g in grams_of(words)):
            continue
        alone = judge(words)
        if alone and alone[1]:
            out[n] = alone[0]
            continue
        pairs = {tuple(words[i : i + 2]) for i in range(len(words))}
        joined = judge(words + [w for _, more in lines[at + 1 :] for w in more][:reach]) if pairs & openings else None
        if joined and joined[1]:
            rest = [w for _, more in lines[at + 1 :] for w in more][: len(words_of(joined[2])) - 1]
            if share(joined[2], rest) < joined[3]:
                out[n] = joined[0]
                continue
        if alone:
            out[n] = "unknown"
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"Some words here {i}.\n{p}\nand more of it.", "en", "a") for i, p in enumerate(PROSE)]
    rows += [(1000 + k, f"{PROSE[k]}\n{x}\n{PROSE[k + 1]}", "en", "a") for k, x in enumerate(NOTICES)]
    return odd(spark, rows).cache(), rows


def test_lines_are_those_of_the_plain_version(spark, corpus):
    frame, rows = corpus
    model = train(frame.select(text_or_empty("text").alias("_text")))
    wanted = {(k, n): family for k, text, *_ in rows for n, family in plain(model, text).items()}
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in licence_paragraphs(frame).collect()}
    # Lines that hold the rest of a wrapped notice are not given again.
    assert got.items() <= wanted.items()
    assert {k for k in wanted if k not in got} <= {(1000 + k, n) for k, x in enumerate(NOTICES) for n in range(2, 2 + x.count("\n"))}
    named = {k: f for k, f in got.items() if f != "unknown"}
    assert named == {(1000, 1): "mit", (1001, 2): "apache-2.0", (1002, 1): "cc-by-nc", (1003, 1): "reserved", (1006, 1): "mit", (1007, 1): "apache-2.0"}


def test_probabilities_are_calibrated(spark, corpus):
    """Held-out lines: those of known families get them, and prose is left to the unknown class."""
    frame, _ = corpus
    model = train(frame.select(text_or_empty("text").alias("_text")))
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [("unknown", f"{p} it was said {n}") for n, p in enumerate(PROSE)]
    texts = spark.createDataFrame(rows, "family string, text string").withColumn("words", F.split(F.lower("text"), "[^a-z0-9.+-]+"))
    best = model.graded(texts, "words").select("family", "_p").collect()
    right = [model.families[max(range(len(r["_p"])), key=lambda k: r["_p"][k])] == r["family"] for r in best]
    assert sum(right) / len(right) > 0.9
    loss = sum(-math.log(max(r["_p"][model.families.index(r["family"])], 1e-9)) for r in best) / len(best)
    assert loss < 0.5 and all(abs(sum(r["_p"]) - 1) < 1e-9 for r in best)


def test_the_plan_stays_small(spark, corpus):
    plan = licence_paragraphs(corpus[0])._jdf.queryExecution().toString()
    assert len(plan) < 100_000


def test_odd_rows(spark):
    rows = [*ROWS, *ROWS[-1:], (None, "Released under the MIT License.\n" * 3, None, None)]
    out = licence_paragraphs(odd(spark, rows), keys=("doc_id", "words", "key")).collect()
    found = sorted(((r["doc_id"] or 0, r["paragraph"]) for r in out if r["family"] == "mit"))
    assert found == [(-5, 1), (-5, 1), (0, 0), (0, 1), (0, 2)] and all(r["key"] == "own key" for r in out)
