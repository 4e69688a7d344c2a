"""Sharding, mixing, quality rules and licence scans: the operators made of built-in functions."""

import zlib
from collections import Counter, defaultdict

import pytest
from odd import CLASHING, LONG, ROWS, odd, words
from oracle import compare, connect
from pyspark.sql import functions as F

from logsluice.llm.common import bucket
from logsluice.llm.licences import licence_paragraphs
from logsluice.llm.mixing import mix, mixing_plan, source_targets
from logsluice.llm.quality_rules import base_figures, keep_good, quality_rules
from logsluice.llm.queries import ORACLES, QUERIES
from logsluice.llm.sharding import byte_size, shard_by_bytes, write_shards


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("operator", [
    lambda d: shard_by_bytes(d.withColumn("size", byte_size())), mix, quality_rules, licence_paragraphs,
])
def test_no_python_in_the_plan(spark, operator):
    plan = plan_of(operator(odd(spark)))
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_shards_are_contiguous_gapless_and_even(spark, tmp_path):
    docs = odd(spark).withColumn("size", byte_size())
    out = shard_by_bytes(docs, 4).collect()
    assert len(out) == len(ROWS)
    # Null keys come first, then ascending; slots count from 0 in each shard.
    order = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    keys = [r["doc_id"] for r in order]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    slots = defaultdict(list)
    for r in order:
        slots[r["shard"]].append(r["slot"])
    assert all(s == list(range(len(s))) for s in slots.values())
    total, before = sum(r["size"] for r in order), 0
    for r in order:
        assert r["shard"] == min(3, 4 * (2 * before + r["size"]) // (2 * total))
        before += r["size"]
    assert {r["size"] for r in out if r["text"] is None or r["text"] == ""} == {1}
    assert all(r["_row"] == "own _row" and r["key"] == "own key" for r in out)
    write_shards(shard_by_bytes(docs, 4).drop("words"), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(ROWS)


def test_shards_of_equal_rows_stay_even(spark):
    rows = spark.range(4000).select(F.lit(7).alias("doc_id"), F.lit(10).alias("size"))
    counts = Counter(r["shard"] for r in shard_by_bytes(rows, 8).collect())
    assert set(counts.values()) == {500}


def test_empty_tables(spark):
    docs = odd(spark, [])
    assert shard_by_bytes(docs.withColumn("size", byte_size())).count() == 0
    assert mix(docs).count() == 0
    assert quality_rules(docs).count() == 0 and keep_good(docs).count() == 0
    assert licence_paragraphs(docs).count() == 0


def test_targets_stop_at_three_times_and_share_the_rest(spark):
    sizes = {"a": 1000, "b": 10, "c": 10, "d": 500, None: 0}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(rows).collect()}
    order = ["a", "b", "c", "d", None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1520.0, {}
    while True:  # share, fix what is above, share again
        free = [s for s in order if s not in fixed]
        left = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if left * weight[s] > 3 * sizes[s]]
        if not above:
            break
        fixed |= {s: 3.0 * sizes[s] for s in above}
    expected = fixed | {s: left * weight[s] for s in free}
    assert got == pytest.approx(expected)


def test_mix_takes_whole_rates_and_a_hashed_rest(spark):
    docs = odd(spark)
    plan = mixing_plan(docs).collect()
    assert len(plan) == len(ROWS)
    for r in plan:
        assert r["size"] == len(words(r["text"]))
        rate = r["target"] / r["source_size"] if r["source_size"] else 1
        assert int(rate) <= r["copies"] <= int(rate) + 1 and r["copies"] <= 3
    taken = mix(docs)
    assert set(taken.columns) == set(docs.columns)
    assert taken.count() == sum(r["copies"] for r in plan)
    assert {r["size"] for r in taken.select("size").distinct().collect()} == {"own size"}
    assert sorted(map(str, mix(docs).collect())) == sorted(map(str, mix(docs).collect()))
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("w " * 10).alias("text"), F.when(F.col("id") < 12_000, "big").otherwise("small").alias("source"))
    by = {r["source"]: r for r in mixing_plan(many).groupBy("source").agg(F.sum(F.expr("size * copies")).alias("taken"), F.first("target").alias("target")).collect()}
    for r in by.values():
        assert r["taken"] == pytest.approx(r["target"], rel=0.03)


def brute_figures(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    counts = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))


def test_figures_against_brute_force(spark):
    texts = [r[1] for r in ROWS] + ["a b c d e f g h " * 3, "x\nx\n\n \nx", "### a | b", "a a a a a a a a a", "a b c d e f g h i a b c d e f g h"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in rows.select("text", base_figures().alias("f")).collect():
        f = r["f"]
        got = (f["n_words"], f["word_chars"], f["n_symbols"], f["lines"]["n_lines"], f["lines"]["n_dup_lines"], f["n_repeat_words"])
        assert got == brute_figures(r["text"]), (r["text"] or "")[:60]


def test_buckets_are_close_and_monotone(spark):
    rows = spark.range(200_000).select("id", bucket(F.col("id")).alias("b")).collect()
    assert all(r["b"] <= r["id"] < r["b"] + max(1, r["b"] / 31) for r in rows)
    assert all(a["b"] <= b["b"] for a, b in zip(rows, rows[1:]))


def test_rules_adapt_to_language_and_source(spark):
    def text(i, symbol):
        return " ".join(f"{symbol}w{i}x{k}" for k in range(40))

    # In the source "code" a symbol with every word is usual, in "news" it is not.
    rows = [(i, text(i, "#"), "en", "code") for i in range(300)] + [(i, text(i, ""), "en", "news") for i in range(300, 600)]
    rows += [(900, text(900, "#"), "en", "news"), (901, "too short", "en", "news"), (902, None, None, None)]
    kept = {r["doc_id"] for r in keep_good(odd(spark, rows)).collect()}
    assert kept == set(range(600))
    out = keep_good(odd(spark, rows)).first()
    assert out["quality"] == "own quality"


def test_repeats_are_judged_by_what_is_usual_in_the_source(spark):
    def text(i, share):
        """100 words, ``share`` of them in a passage found twice."""
        half = [f"again{i}x{k}" for k in range(share // 2)]
        rest = [f"own{i}x{k}" for k in range(100 - 2 * len(half))]
        return " ".join(half + rest + half)

    shares = (16, 20, 24, 28)
    rows = [(i, text(i, 0), "en", "clean") for i in range(400)] + [(1000 + k, text(1000 + k, s), "en", "clean") for k, s in enumerate(shares)]
    rows += [(2000 + i, text(2000 + i, shares[i % 4] if i % 2 else 0), "en", "full") for i in range(400)]
    out = {r["doc_id"]: r["quality"] for r in quality_rules(odd(spark, [r for r in rows]).drop("quality")).collect()}
    assert not any(q["base_failed"] for q in out.values())
    assert [out[1000 + k]["n_repeat_words"] for k in range(4)] == list(shares)
    assert not any(out[1000 + k]["kept"] for k in range(4))
    assert all(out[i]["kept"] for i in range(400)) and all(out[2000 + i]["kept"] for i in range(400))


def test_sql_of_odd_rows(spark, tmp_path):
    rows = [(k, *r[1:4]) for k, r in enumerate(ROWS)]
    docs = odd(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").toPandas()
    docs.to_parquet(tmp_path / "documents.parquet", index=False)
    for name in ("op2_quality_rules", "op7_shard_by_bytes", "op8_mix_sources", "op11_fingerprints"):
        assert compare(QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), ORACLES[name]) is None, name


def test_odd_rows_get_verdicts(spark):
    out = quality_rules(odd(spark)).collect()
    assert len(out) == len(ROWS)
    for r in out:
        n, *_, repeats = brute_figures(r["text"])
        assert r["quality"]["base_failed"] == (n < 20 or 100 * repeats > 30 * n)
        assert not (r["quality"]["base_failed"] and r["quality"]["kept"])
    assert all(r["fp"] == "own fp" for r in out) and set(CLASHING) <= set(out[0].asDict()) and LONG


LICENCES = {
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "reserved": "All rights reserved.",
}


def test_licences_are_found_and_others_left_alone(spark):
    prose = [f"The {i} way of saying that rights and software are free to copy under version {i} of this work" for i in range(60)]
    rows = [(i, f"Some words here {i}.\n{p}\nand more of it.", "en", "a") for i, p in enumerate(prose)]
    rows += [(1000 + k, f"{prose[k]}\n{line}\n{prose[k + 1]}", "en", "a") for k, line in enumerate(LICENCES.values())]
    rows += [(2000, "Licensed under the Zebra Stripes License, Version 9.", "en", "a"), (2001, None, None, None), (2002, "", None, None)]
    found = {(r["doc_id"], r["paragraph"]): r["family"] for r in licence_paragraphs(odd(spark, rows)).collect()}
    assert {found.pop((1000 + k, 1)) and k: family for k, family in enumerate(LICENCES)} == dict(enumerate(LICENCES))
    assert set(found) <= {(2000, 0)} and set(found.values()) <= {"unknown"}


def test_crc_of_the_query(spark):
    text = "é and more"
    assert spark.range(1).select(F.crc32(F.lit(text))).first()[0] == zlib.crc32(text.encode())
