"""Repair of conversations against plain search, and the grammar it shares its work through."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import product as combos

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsluice.llm import conversations
from logsluice.llm.conversations import repair
from logsluice.llm.grammar import IDENTITY, MUST_GO, N_SYMBOLS, best, matrices, re_pair, symbol
from logsluice.llm.queries import damaged, op13_repair

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, size string, position string, conv string, verdict string"


def spelt(code, rules):
    if code < N_SYMBOLS:
        return [code]
    return [x for part in rules[code - N_SYMBOLS] for x in spelt(part, rules)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), max_size=12))
def test_grammar_gives_back_what_it_was_made_of(sequences):
    short, rules = re_pair(sequences)
    assert [[x for code in s for x in spelt(code, rules)] for s in short] == [list(s) for s in sequences]
    pairs = defaultdict(int)
    for s in short:
        last = -2
        for i, pair in enumerate(zip(s, s[1:])):
            if pair[0] != pair[1] or last < i - 1:
                pairs[pair] += 1
                last = i if pair[0] == pair[1] else -2
    assert all(n < 2 for n in pairs.values())


def plain(codes):
    """Cost and letters of the cheapest edits, by trying all that end in each state, row by row."""
    after = {0: {1: "u"}, 1: {1: "u"}}
    states = {"": (0, "")}  # what is kept ends in "", s, u or a

    def insert(states):
        for _ in range(2):
            for state, (cost, letters) in list(states.items()):
                to = "a" if state == "u" else "u"
                states[to] = min(states.get(to, (10**9, "")), (cost + 2, letters + "I"))
        return states

    assert after
    for code in codes:
        kind, cut_off = divmod(code - 1, 2)
        new = {}
        for state, (cost, letters) in insert(states).items():
            to = "a" if state == "u" else "u"
            ways = [(state, cost + 3, "D")]
            if code != MUST_GO:
                ways.append((to, cost + 2 + cut_off, "R"))
                if kind == 0 and state == "" or kind in (1, 2) and "ua"[kind - 1] == to:
                    ways.append(("s" if kind == 0 else to, cost + cut_off, "K"))
            for end, total, letter in ways:
                new[end] = min(new.get(end, (10**9, "")), (total, letters + letter))
        states = new
    states = insert(states)
    return min(states[s] for s in ("", "a") if s in states)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, N_SYMBOLS - 1), max_size=12), min_size=1, max_size=5))
def test_matrices_find_the_cheapest_edits(sequences):
    for codes, matrix in zip(sequences, matrices(sequences)):
        cost, audit = best(matrix[0])
        assert (cost, audit.text()) == plain(codes)


def test_every_short_sequence():
    sequences = [list(c) for n in range(4) for c in combos(range(N_SYMBOLS), repeat=n)]
    assert [(c, a.text()) for c, a in (best(m[0]) for m in matrices(sequences))] == [plain(s) for s in sequences]
    assert matrices([[]])[0] == IDENTITY and symbol("", False) == symbol("t", False) != symbol("s", False)


def words(text):
    return text.strip(BLANKS)


def judged(rows):
    """The columns of the query for the rows of one conversation, in order of their turns."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts, codes, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
    for _, role, text in rows:
        cut_off = bool(words(text)) and words(text)[-1] not in ".!?"
        fault = "blank" if not words(text) else "duplicate" if (role, text) in seen else "truncated" if cut_off else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        codes.append(MUST_GO if fault in ("blank", "duplicate") else symbol(role[:1], cut_off))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = plain(codes)
    lines, at, last = [], 0, ""
    for letter in audit:
        _, role, text = rows[at] if letter != "I" and at < len(rows) else (0, "", "")
        at += letter != "I"
        if letter == "D":
            continue
        if letter in "RI":
            role = "assistant" if last == "u" else "user"
        lines.append(f"{role}:{text}")
        last = role[:1]
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *counts.values(), illegal, cost, audit, sha)


def expected(rows, times=lambda conv, turn: 1):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
        by_conv[conv] += [((turn is not None, turn or 0), digest, turn, role, text)]
    return {c: judged([r[2:] for r in sorted(rs, key=lambda r: r[:2])]) for c, rs in by_conv.items()}


def got(frame):
    shas, verdicts, lines = {}, {}, defaultdict(list)
    for r in frame.collect():
        if r["verdict"] is not None:
            verdicts[r["conv"]] = tuple(r["verdict"])
        else:
            lines[r["conv"]].append((r["position"], f"{r['role']}:{r['text']}"))
    for c in verdicts:
        shas[c] = hashlib.sha256("\n".join(x for _, x in sorted(lines[c])).encode()).hexdigest()
    return {c: (*v, shas[c]) for c, v in verdicts.items()}


def random_rows(seed, n, convs):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \t", None, "What?", "cut off", "Line.\nNext!  ", "é…", "a:b.", "x" * 5000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "u", "assistant"]
    return [
        (rng.choice(convs), rng.choice([None, *range(-3, n // len(convs) + 3)]), rng.choice(roles), rng.choice(texts), "s", "p", "c", "v")
        for _ in range(n)
    ]


@pytest.mark.parametrize("chunk", [3, 50, 8192])
def test_repair_of_odd_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rows = random_rows(chunk, 400, [None, -1, *range(40)]) + [(77, t, "user", "Same.", "s", "p", "c", "v") for t in [1] * 9 + [2]]
    rows += [(88, None, None, None, "s", "p", "c", "v")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(repair(frame)) == expected([r[:4] for r in rows])
    assert got(repair(spark.createDataFrame([], SCHEMA))) == {}


def test_one_conversation_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", 64)
    rows = [(1, t, *x[2:]) for t, x in enumerate(random_rows(5, 1500, [1]))] + random_rows(6, 60, [0, 2, 3])
    assert got(repair(spark.createDataFrame(rows, SCHEMA).repartition(7))) == expected([r[:4] for r in rows])


def test_repaired_rows_take_turns(spark):
    rows = random_rows(9, 300, list(range(30)))
    out = defaultdict(list)
    for r in repair(spark.createDataFrame(rows, SCHEMA)).where("verdict IS NULL").collect():
        out[r["conv"]].append((r["position"], (r["role"] or " ")[0], r["edit"]))
    for lines in out.values():
        roles = "".join(x for _, x, _ in sorted(lines))
        roles = roles.removeprefix("s")
        assert roles == "ua" * (len(roles) // 2) and roles


def test_query_against_plain_search(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    rows = []
    for r in source:
        case = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        role, text = "user" if case == 4 else r["role"], r["text"]
        text = "" if case == 1 else text.translate({ord(c): None for c in ".!?"}) if case == 2 else text
        rows += [(r["conv_id"], r["turn"], role, text)] * {0: 0, 3: 2}.get(case, 1)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    wanted = {r["conv_id"]: empty for r in source} | expected(rows)
    assert {r[0]: tuple(r)[1:] for r in op13_repair(spark, "/root/testdata/sf0.001").collect()} == wanted


def test_a_conversation_whose_rows_are_all_gone(spark):
    frame = spark.createDataFrame([(5, 1, "user", "Hi.", 0), (6, 1, "user", "Hi.", 2), (6, 2, None, None, 1)], "conv_id long, turn long, role string, text string, times int")
    out = got(repair(frame, times="times"))
    assert out[5] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and out[6][:3] == (0, 1, 1)
    nulls = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert damaged(nulls).first()["times"] in (0, 1, 2) and F
