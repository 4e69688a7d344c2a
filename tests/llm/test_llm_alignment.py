"""Alignment of two tokenizers against bytes and plain counting."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import LONG, ROWS, odd

from logsluice.llm import alignment
from logsluice.llm.alignment import _load, align, _Parts, align_ids, groups_text, link_counts, parts_of
from logsluice.llm.queries import BYTES_AND_PIECES, op12_alignment

TRICKY = ["a  b", " lead", "trail ", "a\r\n\r\nb  ", "ﬁ① é日本😀", "a▁b", "<s>x</s> <|endoftext|> <0x41> <unk>", " x​", "\t\ta b", "x\x00y", "it's 12345!!"]


def spans(sizes):
    ends = list(accumulate(sizes))
    return list(zip([0, *ends], ends))


def cut(total, rng):
    places = sorted(rng.sample(range(1, total), rng.randrange(total))) if total > 1 else []
    return [b - a for a, b in zip([0, *places], [*places, total])]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 40), st.integers())
def test_groups_and_links_of_any_cuts(total, seed):
    rng = random.Random(seed)
    a, b = (cut(total, rng), cut(total, rng)) if total else ([], [])
    a_ends, b_ends, link_a, link_b = align_ids(np.array(a, np.int64), np.array(b, np.int64))
    ends_a, ends_b = list(accumulate(a)), list(accumulate(b))
    a_ends, b_ends, link_a, link_b = (x.tolist() for x in (a_ends, b_ends, link_a, link_b))
    assert [ends_a[k - 1] for k in a_ends] == [ends_b[k - 1] for k in b_ends] == sorted(set(ends_a) & set(ends_b))
    overlap = [(i, j) for i, (s, e) in enumerate(spans(a)) for j, (u, v) in enumerate(spans(b)) if max(s, u) < min(e, v)]
    assert sorted(zip(link_a, link_b)) == overlap and len(link_a) == len(a) + len(b) - len(a_ends)


def test_text_of_groups():
    none = np.zeros(0, np.int64)
    assert groups_text(*map(np.array, ([1, 2, 3], [4, 5, 6], [2, 3], [1, 3]))) == "1,2|4;3|5,6" and groups_text(none, none, none, none) == ""


def brute(texts):
    """The query's columns but the id, for each text."""
    a_tok, b_tok, a_bytes, b_bytes, *_ = _load(BYTES_AND_PIECES)
    found, held = [], Counter()
    for text in texts:
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        if text and any(b"".join(t[i] for i in ids) != (" " + text).encode() for t, ids in ((a_bytes, a), (b_bytes, b))):
            a, b = [], []
        sa, sb = spans([len(a_bytes[i]) for i in a]), spans([len(b_bytes[i]) for i in b])
        links, j = [], 0
        for i, (s, e) in enumerate(sa):
            while j and sb[j - 1][1] > s:
                j -= 1
            while j < len(sb) and sb[j][0] < e:
                if sb[j][1] > s:
                    links.append((a[i], b[j]))
                j += 1
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x) for x, (u, v) in zip(ids, sp) if start < v <= end) for ids, sp in ((a, sa), (b, sb))))
            start = end
            if len(ends) > 5000:
                break
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        found.append((len(a), len(b), len(ends), links, sha if len(ends) <= 5000 else None))
        held.update(set(links))
    highest = defaultdict(int)
    for (a, _), n in held.items():
        highest[a] = max(highest[a], n)
    return [
        (n_a, n_b, n_groups, len(links), sum(held[x] == highest[x[0]] for x in links), sum(held[x] for x in links), sha)
        for n_a, n_b, n_groups, links, sha in found
    ]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_against_plain_counting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    wanted = dict(zip([r["doc_id"] for r in docs], brute([r["text"] for r in docs])))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op12_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert {k: v[:6] for k, v in got.items()} == {k: v[:6] for k, v in wanted.items()}
    assert all(v[6] in (None, got[k][6]) for k, v in wanted.items())


@pytest.mark.parametrize("links", [1, 500, 4_000_000])
def test_odd_rows_and_slices_of_any_size(spark, monkeypatch, links):
    monkeypatch.setattr(alignment, "LINKS_IN_SLICE", links)
    rows = [*ROWS, *[(100 + k, t, "en", "a") for k, t in enumerate(TRICKY)]]
    got = link_counts(odd(spark, rows), BYTES_AND_PIECES, ("doc_id", "size", "text")).collect()
    wanted = brute([r[1] for r in rows])
    assert Counter((r["doc_id"], r["text"], r["n_best"], r["count_sum"]) for r in got) == Counter(
        (r[0], r[1], w[4], w[5]) for r, w in zip(rows, wanted)
    )
    assert {r["size"] for r in got} == {"own size"} and LONG
    assert sum(w[0] == 0 for w in wanted) == 3  # null, empty, and one that has the mark of a space
    none = link_counts(odd(spark, []), BYTES_AND_PIECES)
    assert none.count() == 0 and none.columns == ["doc_id", "n_best", "count_sum"]


def whole(texts):
    a_tok, b_tok, a_bytes, b_bytes, *_ = _load(BYTES_AND_PIECES)
    for text in texts:
        ids = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
        same = all(b"".join(t[i] for i in x) == (" " + text).encode() for t, x in zip((a_bytes, b_bytes), ids))
        yield ids if same and text else ([], [])


def check(met, texts):
    """Ids are those of whole texts, and ends and links those that plain alignment of these gives."""
    got = [column.to_pylist() for column in met.of_texts(texts)]
    _, _, _, _, a_size, b_size = _load(BYTES_AND_PIECES)
    for k, (a, b) in enumerate(whole(texts)):
        assert (got[0][k], got[1][k]) == (a, b), texts[k][:80]
        plain = align_ids(a_size[np.array(a, np.int64)], b_size[np.array(b, np.int64)])
        assert [column[k] for column in got[2:6]] == [x.tolist() for x in plain]
        assert got[6][k] == groups_text(np.array(a, np.int64), np.array(b, np.int64), *plain[:2])


@pytest.mark.parametrize("remembered, size", [(0, 50), (200_000, 256 << 10)])
def test_parts_have_the_ids_of_whole_texts(monkeypatch, remembered, size):
    monkeypatch.setattr(alignment, "REMEMBERED", remembered)
    monkeypatch.setattr(alignment, "BYTES_IN_CALL", size)
    texts = [LONG[:20_000], " ".join(TRICKY * 30), "  ".join(TRICKY), "nospace" * 3000, *TRICKY, "", " "]
    assert all(" ".join(parts_of(t)) == t for t in texts)
    met = _Parts(BYTES_AND_PIECES)
    check(met, texts)
    check(met, texts[::-1])


def test_no_letter_is_joined_across_a_single_space():
    letters = [chr(c) for c in [*range(0x3400), *range(0xF900, 0x10000), *range(0x1F300, 0x1F700), 0xAC00, 0x4E00, 0xE000] if not 0xD800 <= c < 0xE000]
    texts = [f"x {c}y {c} z{c} 1 '{c}" for c in letters]
    check(_Parts(BYTES_AND_PIECES), texts)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n'a1.éİß▁\u0307\u00a0\u2003\u200b日<>|"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_has_the_ids_of_the_whole(text):
    check(_Parts(BYTES_AND_PIECES), [text, "", text + " x"])


def test_alignment_names_the_groups(spark):
    row = align(odd(spark, [(1, "Unbelievable tokenizations, naïve 日本", "en", "a")]), BYTES_AND_PIECES).first()
    _, _, a_bytes, b_bytes, *_ = _load(BYTES_AND_PIECES)
    start = (0, 0)
    for end in zip(row["a_ends"], row["b_ends"]):
        a = b"".join(a_bytes[i] for i in row["a_ids"][start[0] : end[0]])
        assert a == b"".join(b_bytes[i] for i in row["b_ids"][start[1] : end[1]]) and a
        start = end
    assert start == (len(row["a_ids"]), len(row["b_ids"]))


def test_groups_of_many_texts_are_spelt_together():
    a_ids, b_ids = np.array([5, 6, 7, 8]), np.array([1, 2, 3, 4, 9])
    a_ends, b_ends = np.array([1, 3, 4]), np.array([2, 3, 5])
    assert groups_text(a_ids, b_ids, a_ends, b_ends) == "5|1,2;6,7|3;8|4,9"
    assert groups_text(a_ids, b_ids, a_ends, b_ends, np.array([1, 3])).split("\n") == ["5|1,2", "6,7|3;8|4,9"]
