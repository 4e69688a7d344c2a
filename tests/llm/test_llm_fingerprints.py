"""One-permutation MinHash against sets and a plain version, and rows with the rows after them."""

import struct
import zlib

import pytest
import xxhash
from odd import CLASHING, LONG, OTHER, PROSE, ROWS, odd, words
from pyspark.sql import functions as F

from logsluice.llm.minhash import BINS, LOOKS, NO_WORD, factors, fingerprint, fingerprints, likeness
from logsluice.llm.successors import with_next


def xxh(value):
    return xxhash.xxh64_intdigest(struct.pack("<q", value), 42) % (1 << 63)


def plain(text):
    """Digits of a fingerprint, bin by bin."""
    sums = [zlib.crc32(w.encode()) % NO_WORD for w in words(text)]
    if not sums:
        return "0" * BINS
    runs = [sums[i : i + 5] for i in range(max(1, len(sums) - 4))]
    least = {}
    for run in runs:
        h = xxh(sum(c * f for c, f in zip(run + [NO_WORD] * 5, factors(5))))
        least[h >> 55] = min(h, least.get(h >> 55, h))
    out = []
    for i in range(BINS):
        order = [i, *[xxh(i * LOOKS + k) % BINS for k in range(LOOKS)], *sorted(least, key=lambda b: xxh(i * BINS + b) >> 4)]
        out.append(next(least[b] for b in order if b in least) % 16)
    return "".join(f"{d:x}" for d in out)


def test_fingerprints_are_those_of_the_plain_version(spark):
    out = fingerprints(odd(spark)).withColumn("hex", F.lower(F.hex("fingerprint"))).collect()
    assert len(out) == len(ROWS) and all(r["fp"] == "own fp" for r in out) and set(CLASHING) <= set(out[0].asDict())
    for r in out:
        assert r["hex"] == plain(r["text"]), (r["text"] or "")[:40]
    assert {r["hex"] for r in out if not words(r["text"])} == {"0" * BINS}
    assert len({r["hex"] for r in out if r["text"] == PROSE}) == 1 and LONG
    assert fingerprints(odd(spark, [])).count() == 0
    with pytest.raises(ValueError):
        factors(8)


def test_an_old_column_of_that_name_is_replaced(spark):
    rows = spark.createDataFrame([(PROSE, "old")], "text string, fingerprint string")
    assert fingerprints(rows).first()["fingerprint"] == bytes.fromhex(plain(PROSE))


@pytest.mark.parametrize("length", [12, 60, 600])
def test_likeness_estimates_the_share_of_common_shingles(spark, length):
    rows = []
    for i in range(240):
        own = [f"w{i}x{k}" for k in range(length)]
        cut = length * (i % 12) // 12
        rows.append((" ".join(own), " ".join(own[:cut] + [f"v{i}x{k}" for k in range(length - cut)])))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("near"))
    errors = []
    for r in got.collect():
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(length - 4)} for t in (r["a"], r["b"]))
        errors.append(r["near"] - len(a & b) / len(a | b))
        assert 0 <= r["near"] <= 1
    assert abs(sum(errors) / len(errors)) < 0.02
    assert sum(e * e for e in errors) / len(errors) < 0.1**2


def test_likeness_at_the_ends(spark):
    rows = [(PROSE, PROSE, 1.0), (None, "", 1.0), (None, PROSE, 0.0), (OTHER, " \n", 0.0), ("one", "one", 1.0)]
    got = spark.createDataFrame(rows, "a string, b string, near double")
    for r in got.select("near", likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("got")).collect():
        assert r["got"] == r["near"]


def test_no_python_and_one_shuffle_of_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = with_next(fingerprints(docs), F.struct("text", "fingerprint"), lambda a, b: F.struct(likeness(a["fingerprint"], b["fingerprint"]).alias("near")))
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def followers(spark, keys, ranges):
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "doc_id long, n long").repartition(3)
    out = with_next(rows, F.struct("n"), lambda a, b: F.struct(a["n"].alias("n"), b["n"].alias("after")), ranges=ranges)
    return {r["n"]: r["after"] for r in out.collect()}


@pytest.mark.parametrize("ranges", [1, 3, 7])
@pytest.mark.parametrize("keys", [[5], [3, 1, 2], [None, -4, 9, 0], [*range(100, 0, -1)], [7] * 40 + [1, 9] + [None] * 30, []])
def test_each_row_meets_the_next(spark, keys, ranges):
    after = followers(spark, keys, ranges)
    assert len(after) == len(keys) and set(after.values()) == set(range(len(keys)))
    order, at = [], next((n for n, k in enumerate(keys) if k == min((k is not None, k or 0) for k in keys)[1] or k is None), None)
    while at is not None and len(order) < len(keys):
        order.append(keys[at])
        at = after[at]
    sought = sorted(keys, key=lambda k: (k is not None, k or 0))
    turned = [sought[i:] + sought[:i] for i in range(len(sought) or 1)]
    assert order in turned


def test_one_key_is_spread_over_ranges(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 12_000, 7).otherwise(F.col("id")).cast("long").alias("doc_id"), F.col("id").alias("n"))
    from logsluice.llm.successors import in_ranges

    sizes = [r["count"] for r in in_ranges(rows, "doc_id", 16).groupBy("_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
