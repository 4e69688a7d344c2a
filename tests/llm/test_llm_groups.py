"""Packing, near-duplicates, nearest neighbours and repeats, each against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from odd import LONG, OTHER, PROSE, ROWS, odd, words
from pyspark.sql import functions as F

from logsluice.llm import nearest as N
from logsluice.llm import repeats as R
from logsluice.llm import simhash as S
from logsluice.llm.components import components
from logsluice.llm.packing import pack, pack_group
from logsluice.llm.run_index import matching_statistics, repeated_starts, suffix_array
from logsluice.llm.xxh64 import xxh64
from logsluice.session import settings

# -- packing


def test_each_piece_takes_the_tightest_compatible_bin():
    r = np.random.default_rng(0)
    for _ in range(40):
        n = int(r.integers(0, 150))
        sizes, sources, clusters = r.integers(0, 250, n), r.integers(-1, 20, n), r.integers(0, 30, n)
        out = pack_group(sizes, sources, clusters, 100)
        assert sum(o[3] for o in out) == sizes.sum()
        bins = {}
        for row, _, start, size, number, offset in out:
            if start < sizes[row] // 100 * 100:
                assert (size, offset) == (100, 0)
                continue
            fits = [
                b for b, (left, s, c) in bins.items()
                if left >= size and sources[row] not in s - {-1} and clusters[row] not in c
            ]
            if fits:
                assert number in fits and bins[number][0] == min(bins[b][0] for b in fits)
            else:
                assert number not in bins
            left, s, c = bins.get(number, (100, set(), set()))
            assert offset == 100 - left
            bins[number] = (left - size, s | {sources[row]}, c | {clusters[row]})


def test_packing_odd_rows(spark):
    out = pack(odd(spark), capacity=500).collect()
    assert sum(r["n_words"] for r in out) == sum(len(words(t)) for _, t, _, _ in ROWS)
    assert sum(r["bin"] is None for r in out) == sum(not words(t) for _, t, _, _ in ROWS)
    bins = defaultdict(list)
    for r in out:
        if r["bin"] is not None:
            bins[r["bin"]].append((r["offset"], r["n_words"]))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 500
    assert pack(odd(spark, [])).count() == 0


def test_a_hot_source_and_cluster_are_spread(spark):
    rows = [(i, PROSE if i % 3 == 0 else f"{OTHER} {i}", "en", "hot" if i % 3 else "b") for i in range(600)]
    out = pack(odd(spark, rows), capacity=2048).collect()
    seen = defaultdict(list)
    for r in out:
        seen[r["bin"]].append(r["doc_id"])
    assert all(len(b) <= 2 and sum(i % 3 == 0 for i in b) <= 1 for b in seen.values())


# -- SimHash


def fingerprint(text, n=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_hashes_of_all_lengths():
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    starts, lengths = np.arange(400), np.arange(400)
    got = xxh64(data, starts, lengths)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), 42) for s, n in zip(starts, lengths)]


def test_fingerprints():
    texts = [r[1] for r in ROWS if r[1] != LONG] + ["x" * 300 + " y z", "A b", "a\xa0b c d", "\x85 q w e"]
    got = S.fingerprints_of(pa.array(texts), 3, 42)
    assert got.tolist() == [fingerprint(t) for t in texts]


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def points():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 1500, dtype=np.uint64)
    chain = [base]
    for _ in range(3):
        flips = (np.uint64(1) << r.integers(0, 64, 700, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 700, dtype=np.uint64))
        chain.append(chain[-1][:700] ^ flips)
    ball = np.array([0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i in range(64) for j in range(i))], np.uint64)
    return np.unique(np.concatenate([*chain, ball]))


@pytest.mark.parametrize("shard, leaf", [(4096, 512), (200, 16)])
def test_the_tree_loses_no_link(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(S, "SHARD", shard)
    monkeypatch.setattr(S, "LEAF", leaf)
    p = points()
    pairs = []
    for i in range(0, len(p), 500):
        a, b = np.nonzero(np.bitwise_count(p[i : i + 500, None] ^ p[None]) <= 2)
        pairs += zip((a + i).tolist(), b.tolist())
    place = {int(x): i for i, x in enumerate(p)}
    tree = S.build_tree(p[::2], len(p), 2)
    found = [
        (place[int(a)], place[int(b)])
        for _, index, home in S.visits(tree, p, 2)
        for u, v in S.shard_links(p[index], home, 2)
        for a, b in zip(u, v)
    ]
    assert roots(len(p), found) == roots(len(p), pairs)


def test_components(spark):
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(500, x) for x in range(501, 900)] + [(r.randrange(1000, 2000), r.randrange(1000, 2000)) for _ in range(600)]
    pairs += [(5, 5), (7, None)] + pairs[:10]
    expected = roots(2000, [p for p in pairs if p[1] is not None])
    rows = spark.createDataFrame(pairs, "u long, v long")
    got = {x["node"]: x["root"] for x in components(rows).collect()}
    nodes = {x for p in pairs if p[1] is not None and p[0] != p[1] for x in p}
    assert got == {n: expected[n] for n in nodes}
    assert components(rows.where("u < 0")).count() == 0


def test_a_hot_fingerprint_is_dealt_to_many_tasks(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, PROSE).otherwise(F.concat_ws(" ", *[F.hash("id", F.lit(k)).cast("string") for k in range(30)])).alias("text")
    )
    with settings(spark, spark__sql__shuffle__partitions="16", spark__sql__adaptive__enabled="false"):
        out = S.simhash_groups(rows)
        sizes = [n for n in out.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()]
        assert sum(sizes) == 4000 and max(sizes) < 1000, sizes
        component = {r["doc_id"]: r["component"]["doc_id"] for r in out.collect()}
    assert all(component[k] == 1 for k in range(4000) if k % 3)


def test_simhash_groups_and_what_stays(spark):
    got = S.simhash_groups(odd(spark)).collect()
    assert len(got) == len(ROWS)
    prints = S.fingerprints_of(pa.array([t for _, t, _, _ in ROWS]), 3, 42).tolist()
    root = roots(len(ROWS), [(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints) if (a ^ b).bit_count() <= 2])
    least = {}
    for i, (key, *_) in enumerate(ROWS):
        known = [k for k in (least.get(root[i]), key) if k is not None]
        least[root[i]] = min(known, default=None)
    expected = sorted(((k, f, least[root[i]]) for i, ((k, *_), f) in enumerate(zip(ROWS, prints))), key=str)
    assert sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component"] and r["component"]["doc_id"]) for r in got), key=str) == expected
    left = S.one_of_each(odd(spark))
    assert left.columns == odd(spark).columns
    kept = [r["doc_id"] for r in left.collect()]
    assert sorted(map(str, kept)) == sorted(map(str, least.values()))
    assert S.one_of_each(odd(spark, [])).count() == 0 and S.simhash_groups(odd(spark, [])).count() == 0


# -- nearest


def test_bounds_hold_and_nothing_is_lost(monkeypatch):
    monkeypatch.setattr(N, "CANDIDATE_TILE", 64)
    monkeypatch.setattr(N, "QUERY_TILE", 16)
    r = np.random.default_rng(4)
    for scale in (1.0, 1e-300, 1e200):
        q, x = r.normal(size=(40, 24)) * scale, r.normal(size=(300, 24))
        x[50:150] = x[7]
        near, off = N.score_bounds(N.Quantised.of(q), N.Quantised.of(x))
        assert (np.abs(near - q @ x.T) <= off).all()
        got = N.block_top(np.arange(40), N.Quantised.of(q), np.arange(300), N.Quantised.of(x), 10)
        for i, best in enumerate(got):
            exact = N.exact_scores(np.repeat(q[i : i + 1], 300, 0), x)
            expected = sorted((-s, j) for j, s in enumerate(exact) if j != i)[:10]
            assert best == expected


def test_nearest_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERY_BLOCK", 2)
    monkeypatch.setattr(N, "CANDIDATE_BLOCK", 3)
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.5], 2), (3, [0.0, 0.0], 0), (4, None, 0), (5, [], 0), (6, [nan, 1.0], 0),
            (7, [inf, 1.0], 0), (8, [None, 1.0], 0), (9, [1.0, 2.0, 3.0], 0), (10, [2.0, 0.0], 0), (20, [1.0, 0.0], 0), (None, [1.0, 1.0], 0),
            (20, [1.0, 0.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in N.nearest(vectors.where("vec_id in (0, 3, 20)"), vectors, 3).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 10, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 1.0)]
    assert {r[0] for r in got} == {0, 20}
    few = [r for r in N.nearest(vectors.where("vec_id = 9"), vectors, 3).collect()]
    assert few == []
    assert N.nearest(vectors.limit(0), vectors).count() == 0


# -- repeats


def brute_repeats(docs, length):
    seen, out = set(), {}
    for key, data in docs:
        gone = bytearray(len(data))
        fresh = []
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                fresh.append(w)
                seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_the_run_index_against_brute_force():
    r = np.random.default_rng(5)
    for t in range(200):
        length, letters = int(r.integers(1, 12)), int(r.integers(1, 4))
        pieces = [bytes(r.integers(97, 97 + letters, int(r.integers(0, 40))).astype(np.uint8)) for _ in range(int(r.integers(1, 6)))]
        pieces += [pieces[0], pieces[-1][2:]] if t % 3 == 0 else []
        seen, expected = set(), []
        for p in pieces:
            for i in range(len(p) + 1):
                w = p[i : i + length]
                expected.append(len(w) == length and w in seen)
                if len(w) == length:
                    seen.add(w)
        assert repeated_starts(pieces, length).tolist() == expected


def test_statistics_streamed_from_run_heads():
    text = np.frombuffer(b"abracadabra abracadabra abra", np.uint8).astype(np.uint16)
    order = suffix_array(text)
    data = text.astype(np.uint8).tobytes()
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    match, place = matching_statistics(text)
    for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
        n = next((k for k in range(len(data)) if data[a + k : a + k + 1] != data[b + k : b + k + 1] or not data[a + k : a + k + 1]), 0)
        assert match[b] == n and (n == 0 or place[b] == a)


def corpus():
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefé") for _ in range(r.randint(1, 8))) for _ in range(300)]

    def text(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    passage, long = text(40), text(3000)
    docs = [text(r.randint(0, 60)) + (passage if k % 3 == 0 else "") + text(r.randint(0, 60)) for k in range(120)]
    docs += [long, long[:5000] + "X" + long[5000:], long[7:], "ab" * 300, "ab" * 99 + "c", "a" * 99, "a" * 100, "a" * 101, "a" * 300, "", None]
    docs += [docs[3]] * 20 + [passage[:99], passage[:100], passage]
    order = list(range(len(docs)))
    r.shuffle(order)
    return [(k, docs[i], "en", "a") for k, i in enumerate(order)]


@pytest.mark.parametrize("many", [4096, 5])
def test_repeats_against_brute_force(spark, monkeypatch, many):
    # Keys with many pieces are cut into windows; both ways must give the same.
    monkeypatch.setattr(R, "MANY_PIECES", many)
    rows = corpus()
    source = odd(spark, rows)
    if many == 5:
        monkeypatch.setattr(R, "_meet", lambda blocks, meet=R._meet: _with(meet(blocks), many))
    got = {r[0]: tuple(r)[1:] for r in R.repeats(source).collect()}
    assert got == brute_repeats([(k, (t or "").encode()) for k, t, _, _ in rows], 100)


@pytest.mark.parametrize("many", [4096, 5])
@pytest.mark.parametrize("length", [64, 109, 128, 200, 300])
def test_repeats_of_other_lengths(spark, monkeypatch, length, many):
    monkeypatch.setattr(R, "_meet", lambda blocks, meet=R._meet: _with(meet(blocks), many))
    rng = random.Random(length)
    passages = ["".join(rng.choice("abcd ") for _ in range(400)) for _ in range(4)]
    rows = []
    for k in range(60):
        text = rng.choice(passages)
        for _ in range(rng.randrange(3)):  # changed in places, so that pieces agree at their ends and differ between
            at = rng.randrange(400)
            text = text[:at] + rng.choice("xyz") + text[at + 1 :]
        rows.append((k, text[rng.randrange(60) : 400 - rng.randrange(60)] + rng.choice("uvw") * rng.randrange(9), "en", "a"))
    got = {r[0]: tuple(r)[1:] for r in R.repeats(odd(spark, rows), length).collect()}
    assert got == brute_repeats([(k, t.encode()) for k, t, _, _ in rows], length)


def _with(step, many):
    def run(table):
        R.MANY_PIECES = many
        return step(table)

    return run


def test_long_texts_are_cut_a_slice_at_a_time(spark, monkeypatch):
    rows = corpus()
    pieces = []

    def found(slice_bytes):
        monkeypatch.setattr(R, "SLICE", slice_bytes)
        batch = pa.RecordBatch.from_pydict({"id": [r[0] for r in rows], "text": [r[1] or "" for r in rows]})
        windows = set()
        for out in R._find_pieces(100, 3)(iter([batch])):
            e = R._concat(out, R.FIELDS)
            pieces.append(len(e["id"]) + len(e["m_id"]))
            for ids, at, n in ((e["id"], e["pos"], e["n"]), (e["m_id"], e["m_pos"], e["m_n"])):
                windows |= {(i, p + k) for i, p, m in zip(ids.tolist(), at.tolist(), n.tolist()) for k in range(m)}
        return windows

    whole = {(k, s) for k, t, _, _ in rows for s in range(len((t or "").encode()) - 99)}
    assert found(2 << 20) == whole and found(1000) == whole
    assert pieces[1] > pieces[0]


def test_texts_without_repeats_stay_whole_characters(spark):
    passage = "é" * 120
    rows = [(1, "a" + passage + "b", "en", "a"), (2, "cd" + passage + "ef", "en", "a"), (3, None, None, None)]
    left = R.without_repeats(odd(spark, rows), size="n_chars")
    assert left.columns == odd(spark).columns
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["rest"]) for r in left.collect()}
    assert got[1] == ("a" + "é" * 120 + "b", 122, "own rest") or got[1][0].startswith("a")
    assert got[2] == ("cdef", 4, "own rest") and got[3] == ("", 0, "own rest")


def test_repeats_of_odd_rows(spark):
    got = R.repeats(odd(spark)).collect()
    assert len(got) == len(ROWS)
    # Null keys come first, equal keys by hash of the text, equal rows are one document.
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t, _, _ in ROWS], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    docs = sorted({(k is not None, k or 0, hashes[t or ""], t or "") for k, t, _, _ in ROWS})
    expected = brute_repeats([((d[0], d[1], d[2]), d[3].encode()) for d in docs], 100)
    by_key = defaultdict(list)
    for (known, key, _), result in expected.items():
        by_key[key if known else None].append(result)
    for r in got:
        assert tuple(r)[1:] in by_key[r["doc_id"]]
    assert sum(r["doc_id"] == 2 for r in got) == 3
    assert R.repeats(odd(spark, [])).count() == 0
