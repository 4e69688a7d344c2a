"""The Kneser-Ney model against a plain version in dictionaries, and its verdicts."""

import math
import random
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from odd import ROWS, odd
from pyspark.sql import functions as F

from logsluice.llm import kneser_ney as K
from logsluice.llm import word_model as W

SF_DIR = "/root/testdata/sf0.001"


def discounts(counts):
    n = {k: sum(c == k for c in counts) for k in (1, 2, 3, 4)}
    if not (n[1] and n[2]):
        return [0, 0.5, 0.75, 0.75]
    y = n[1] / (n[1] + 2 * n[2])
    return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) if n[k] else 0.75 for k in (1, 2, 3)]


def plain_limits(rows, trusted, spread=3.0, least=0.25, enough=20):
    """Per document ``highest`` and ``kept``, from its language, words and perplexity."""
    groups = defaultdict(list)
    for key, lang, n, perplexity in rows:
        if key in trusted and n:
            size = min(n.bit_length(), 10)
            for by in ((lang, size), (lang, "all"), ("all", size), ("all", "all")):
                groups[by].append(math.floor(math.log(perplexity) * 1000 + 1e-7))

    def limit(found):
        found = sorted(found)
        q1, q3 = (found[math.ceil(len(found) * q) - 1] / 1000 for q in (0.25, 0.75))
        return q3 + spread * max(q3 - q1, least)

    out = {}
    for key, lang, n, perplexity in rows:
        size = min(n.bit_length(), 10)
        ways = [by for by in ((lang, size), (lang, "all"), ("all", size)) if len(groups[by]) >= enough]
        usual = limit(groups[(ways or [("all", "all")])[0]])
        out[key] = (usual, n > 0 and math.log(perplexity) <= usual)
    return out


def test_limits_and_verdicts_against_lists(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    trusted = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1").select("doc_id")
    out = K.classify(docs, trusted).collect()
    keys = {r["doc_id"] for r in trusted.collect()}
    wanted = plain_limits([(r["doc_id"], r["lang"], r["n_words"], r["perplexity"]) for r in out], keys)
    for r in out:
        usual, kept = wanted[r["doc_id"]]
        assert math.log(r["highest"]) == pytest.approx(usual, abs=0.0021 * 4)
        assert r["kept"] == kept or abs(math.log(r["perplexity"]) - usual) < 0.01


def test_a_thin_class_takes_the_limit_of_its_language(spark):
    r = random.Random(3)
    common = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(r.choice(common) for _ in range(r.randint(70, 120))), "en", "a") for i in range(300)]
    rows += [(1000, " ".join(f"q{k}z" for k in range(400)), "en", "a"), (1001, " ".join(r.choice(common) for _ in range(400)), "en", "a")]
    rows += [(2000, "odd w1 w2", "en", "a")]  # one short trusted text says nothing of short texts
    docs = odd(spark, rows)
    out = {x["doc_id"]: x for x in K.classify(docs, docs.where("doc_id < 300 or doc_id = 2000").select("doc_id")).collect()}
    assert not out[1000]["kept"] and out[1001]["kept"] and out[1000]["highest"] == out[1001]["highest"] == out[2000]["highest"]


def test_junk_goes_and_clean_text_stays(spark):
    r = random.Random(1)
    common = [f"w{i}" for i in range(200)]

    def clean(n):
        return " ".join(r.choice(common) if r.random() < 0.8 else "".join(r.choice("abcde") for _ in range(7)) for _ in range(n))

    rows = [(i, clean(r.randint(60, 400)), "en", "a") for i in range(500)]
    rows += [(1000 + i, " ".join(f"{x.upper()}!!" for x in clean(100).split()), "en", "a") for i in range(10)]
    rows += [(2000 + i, " ".join([f"again{i}"] * 80), "en", "a") for i in range(10)]
    docs = odd(spark, rows)
    kept = {x["doc_id"] for x in K.classify(docs, docs.where("doc_id < 300").select("doc_id")).where("kept").collect()}
    assert len(kept & set(range(500))) >= 497 and not kept - set(range(500))


def test_odd_rows(spark):
    docs = odd(spark)
    out = K.classify(docs, docs.where("doc_id in (1, 2, 8)").select("doc_id")).collect()
    assert len(out) == len(ROWS)
    for x in out:
        assert (x["perplexity"] is None) == (x["n_words"] == 0) and not (x["n_words"] == 0 and x["kept"])
    nothing = K.classify(docs, docs.where("doc_id = 77").select("doc_id"))
    assert all(x["kept"] and x["perplexity"] is None for x in nothing.collect())
    assert K.classify(odd(spark, []), docs.select("doc_id")).count() == 0
    # Labels are broadcast only up to a number of rows; joined by a shuffle the result is the same.
    few = docs.where("doc_id in (1, 2, 8)").select("doc_id")
    limit, K.LABELS_BROADCAST = K.LABELS_BROADCAST, 0
    try:
        again = K.classify(docs, few).collect()
    finally:
        K.LABELS_BROADCAST = limit
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_packed_pairs_spell_each_word_once():
    r = np.random.default_rng(5)
    words = np.unique(r.integers(0, 1 << 64, 900, dtype=np.uint64, endpoint=False))
    pair = r.permutation(np.unique(r.integers(0, len(words) ** 2, 50_000)))
    first, second, n = words[pair // len(words)], words[pair % len(words)], r.integers(1, 1 << 40, len(pair))
    packed = W.pack_pairs(first, second, n % 5 + 1)
    word, f, s, counts = W.unpack_pairs(packed)
    assert set(zip(word[f].tolist(), word[s].tolist(), counts.tolist())) == set(zip(first.tolist(), second.tolist(), (n % 5 + 1).tolist()))
    assert len(packed) < 5 * len(pair)  # two words of 8 bytes each took 16
    assert sorted(W.unpack_pairs(W.pack_pairs(first, second, n))[3].tolist()) == sorted(n.tolist())
    assert all(len(x) == 0 for x in W.unpack_pairs(W.pack_pairs(first[:0], second[:0], n[:0])))


def test_pairs_and_words_are_sent_to_a_shard_once(spark):
    docs = odd(spark)
    figures, held = W.train(docs.select(K.text_or_empty("text").alias("text")))
    rows = docs.select(docs.doc_id.alias("key"), "lang", F.lit(True).alias("trusted"), K.text_or_empty("text").alias("text"))
    plan = W.score(rows, figures, held)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # to the shards, and back to the documents


def plain_surprises(texts, trusted):
    """Of each text the mean negative logarithm of its words' and its end's probability; ``trusted``: which texts make the model."""
    def pairs(text):
        words = ["<", *text.split(), ">"]
        return Counter(zip(words, words[1:]))

    seen = Counter()
    for text, good in zip(texts, trusted):
        seen.update(pairs(text) if good else {})
    total, ends, kinds = Counter(), Counter(s for _, s in seen), defaultdict(Counter)
    for (f, _), n in seen.items():
        total[f] += n
        kinds[f][min(n, 3)] += 1
    off, low = discounts(list(seen.values())), discounts(list(ends.values()))
    unseen = sum(low[min(n, 3)] for n in ends.values()) / len(seen) / (len(ends) + 1)
    out = []
    for text, good in zip(texts, trusted):
        logs = 0.0
        for (f, s), n in pairs(text).items():
            left = sum(off[k] * m for k, m in kinds[f].items()) / total[f] if total[f] else 1.0
            lower = (ends[s] - low[min(ends[s], 3)]) / len(seen) + unseen
            count = max(seen[f, s] - n * good, 0)
            logs += n * math.log(left * lower + (max(count - off[min(count, 3)], 0) / total[f] if total[f] else 0))
        out.append(-logs / (len(text.split()) + 1))
    return out


def zipf_texts(n, words, seed, vocabulary=20_000):
    r = np.random.default_rng(seed)
    return [" ".join(f"w{k}" for k in np.minimum(r.zipf(1.3, words), vocabulary)) for _ in range(n)]


@pytest.mark.parametrize("frequent", [0, 3, 100, 1 << 17])
def test_surprises_against_dictionaries_however_words_are_spelt(spark, monkeypatch, frequent):
    texts = [*zipf_texts(60, 120, 4), "", "no word of these is held", "w1 w1 w1", "w1 unheard w2", "w19999 unheard", "w1"]
    trusted = [k % 3 == 0 and k < 60 for k in range(len(texts))]
    wanted = plain_surprises(texts, trusted)
    monkeypatch.setattr(W, "FREQUENT", frequent)
    rows = spark.createDataFrame([(k, "en", good, text) for k, (good, text) in enumerate(zip(trusted, texts))], "key long, lang string, trusted boolean, text string")
    rows = rows.repartition(3, "key")
    figures, held = W.train(rows.where("trusted"))
    assert len(figures.frequent) <= frequent and (len(figures.pairs) > 0) == (frequent > 0)
    full = replace(figures.filter, held=np.full_like(figures.filter.held, 255), size=np.maximum(figures.filter.size, 8))
    # Nor does it matter which pairs every task knows, or whether the filter lets all words pass.
    for some in (figures, replace(figures, pairs=figures.pairs[:0], times=figures.times[:0], filter=full)):
        out = {x["key"]: x for x in W.score(rows, some, held).collect()}
        assert len(out) == len(texts)
        for k, text in enumerate(texts):
            assert out[k]["n_words"] == len(text.split()) and out[k]["surprise"] == pytest.approx(wanted[k], abs=1e-5)


def test_what_documents_ask_for_is_small(spark):
    texts = zipf_texts(600, 500, 7, 1_000_000)
    rows = spark.createDataFrame([(k, "en", k % 3 == 0, text) for k, text in enumerate(texts)], "key long, lang string, trusted boolean, text string")
    figures, held = W.train(rows.where("trusted"))
    batch = pa.RecordBatch.from_pydict({"key": range(600), "lang": ["en"] * 600, "trusted": [k % 3 == 0 for k in range(600)], "text": texts, "row": range(600)})
    asked = [x for part in W._ask(figures, 4)(iter([batch])) for x in part.column("data").to_pylist() if x is not None]
    assert asked and sum(map(len, asked)) < 2 * 600 * 501  # 3.4 bytes for a pair when all were asked for by 64-bit keys


def test_the_filter_loses_no_word():
    r = np.random.default_rng(2)
    words = np.unique(r.integers(int(W.RARE), 1 << 64, 20_000, dtype=np.uint64, endpoint=False))
    held, others = words[::2], words[1::2]
    shard = W.word_shards(held, 7)
    for most, passes in ((1 << 20, 0.06), (64, 1.0)):
        found = W.Filter.of({k: W.word_filter(held[shard == k], most) for k in range(6)}, 7)
        assert (found.may_hold(held) == (shard < 6)).all() and found.may_hold(others).mean() <= passes
    assert not W.Filter.of({}, 3).may_hold(words).any() and not len(found.may_hold(words[:0]))
