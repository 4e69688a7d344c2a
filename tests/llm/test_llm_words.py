"""The Kneser-Ney model over all words against a plain version in dictionaries."""

import math
from collections import Counter, defaultdict

import pytest
from odd import odd, words
from test_llm_model import SF_DIR, discounts

from logsluice.llm import kneser_ney as K


def plain_ids(text):
    return ["<start>", *words(text), "<end>"]


def plain_scores(docs, trusted):
    texts = {k: t or "" for k, t in docs}
    pairs = Counter()
    for k in trusted:
        ids = plain_ids(texts[k])
        pairs.update(zip(ids, ids[1:]))
    total, kinds, ends = Counter(), defaultdict(Counter), Counter()
    for (u, v), c in pairs.items():
        total[u] += c
        kinds[u][min(c, 3)] += 1
        ends[v] += 1
    off, low = discounts(pairs.values()), discounts(ends.values())
    n_ends = sum(ends.values())
    low_left = sum(low[min(c, 3)] for c in ends.values()) / n_ends
    out = {}
    for k, text in texts.items():
        ids = plain_ids(text)
        own = Counter(zip(ids, ids[1:])) if k in trusted else Counter()
        log = 0.0
        for u, v in zip(ids, ids[1:]):
            lower = max(ends[v] - low[min(ends[v], 3)], 0) / n_ends + low_left / (len(ends) + 1)
            c = max(pairs[u, v] - own[u, v], 0)
            left = sum(off[n] * m for n, m in kinds[u].items()) / total[u] if total[u] else 1.0
            log += math.log((max(c - off[min(c, 3)], 0) / total[u] if total[u] else 0) + left * lower)
        out[k] = math.exp(-log / (len(ids) - 1)) if words(text) else None
    return out


def test_perplexity_of_all_words_against_dictionaries(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    trusted = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1").select("doc_id")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    keys = {r["doc_id"] for r in trusted.collect()} & {k for k, _ in rows}
    expected = plain_scores(rows, keys)
    got = {r["doc_id"]: r["perplexity"] for r in K.classify(docs, trusted).collect()}
    assert got.keys() == expected.keys()
    for k, p in got.items():
        assert p == pytest.approx(expected[k], rel=1e-5), k


def test_every_trusted_word_is_learned(spark):
    # Over 20,000 words, all equally frequent and of one shape; then the same words in the same pairs, and others.
    def text(i, letter):
        return " ".join(f"{letter}{'abcdefghij'[i % 10]}{'x' * (i // 10 % 10)}y{'z' * (i // 100)}k{'q' * k}" for k in range(40))

    rows = [(i + copy * 1000, text(i, "m"), "en", "a") for i in range(600) for copy in range(2)]
    rows += [(5000, text(7, "m"), "en", "a"), (5001, text(7, "n"), "en", "a")]
    docs = odd(spark, rows)
    found = {r["doc_id"]: r["perplexity"] for r in K.classify(docs, docs.where("doc_id < 5000").select("doc_id")).collect()}
    assert found[5000] < 3 and found[5001] > 1000


def test_repeated_words_are_learned_as_pairs(spark):
    rows = [(i, "0 0 0 0 ha ha " * 5 + f"end{i}", "en", "a") for i in range(40)] + [(100, "0 0 0 0 ha ha " * 5, "en", "a"), (101, "0 ha 0 ha " * 8, "en", "a")]
    docs = odd(spark, rows)
    found = {r["doc_id"]: r["perplexity"] for r in K.classify(docs, docs.where("doc_id < 100").select("doc_id")).collect()}
    assert found[100] < 4 and found[100] < found[101]
