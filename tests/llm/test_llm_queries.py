"""The registered queries against SQL, and the pipeline's stages against what they must do."""

from collections import Counter

import corpus_pipeline
import pytest
from odd import ROWS, odd, words
from oracle import compare, connect
from test_llm_groups import brute_repeats, fingerprint, roots
from test_llm_native import brute_figures

from logsluice.llm.mixing import mixing_plan
from logsluice.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_each_document(spark, name):
    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    rows = QUERIES[name](spark, SF_DIR).select("doc_id").collect()
    assert len({r[0] for r in rows}) == n


def test_registered_names():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(x.startswith(f"op{n}_") for x in names) == 1 for n in range(1, 14)) and "pipeline" in names


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = ["quality rules", "SimHash near-dedup", "suffix-array dedup", "mixing", "best-fit packing"]
    assert [name for name, _ in corpus_pipeline.STAGES] == names
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or after.dtypes == docs.dtypes
        kept.append([r.asDict() for r in docs.collect()])
        docs = after
    kept.append([r.asDict() for r in docs.collect()])
    start, good, single, cut, mixed, packed = kept
    # Quality: texts are untouched, those that fail the base are gone.
    texts = {r["doc_id"]: r["text"] for r in start}
    assert all(texts[r["doc_id"]] == r["text"] for r in good)
    for r in start:
        n, *_, repeats = brute_figures(r["text"])
        if n < 20 or 100 * repeats > 30 * n:
            assert r["doc_id"] not in {g["doc_id"] for g in good}
    # Near-duplicates: the smallest id of each group.
    order = sorted(good, key=lambda r: r["doc_id"])
    prints = [fingerprint(r["text"]) for r in order]
    near = [(i, j) for i, a in enumerate(prints) for j in range(i) if (a ^ prints[j]).bit_count() <= 2]
    expected = {order[i]["doc_id"] for i in roots(len(order), near)}
    assert Counter(r["doc_id"] for r in single) == Counter(expected)
    # Repeats: what is left of each text.
    gone = brute_repeats([(r["doc_id"], r["text"].encode()) for r in sorted(single, key=lambda r: r["doc_id"])], 100)
    assert {r["doc_id"] for r in cut} == expected
    for r in cut:
        assert len(r["text"]) == r["n_chars"] and 0 <= len(r["text"].encode()) - (gone[r["doc_id"]][0] - gone[r["doc_id"]][1]) <= 6 * gone[r["doc_id"]][2]
    # Mixing: as often as planned.
    plan = {r["doc_id"]: r["copies"] for r in mixing_plan(spark.read.parquet(str(tmp_path / "2"))).collect()}
    assert Counter(r["doc_id"] for r in mixed) == Counter({k: n for k, n in plan.items() if n})
    # Packing: all words of all copies.
    assert sum(r["n_words"] for r in packed) == sum(len(words(r["text"])) for r in mixed)


def test_stages_bear_odd_and_no_rows(spark):
    for rows in (ROWS, []):
        docs = odd(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR).checkpoint()
        assert bool(rows) == bool(docs.count())
