"""Repair of conversations whose roles don't take turns, at the least cost.

A conversation is rows of a role and a text by turn. Blank rows and rows seen before must go; others may stay, change
their role to user or assistant, or go; and empty rows may be put in, so that an optional system row is followed by
user and assistant in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.llm.common import checkpointed, running_totals
from logsluice.llm.grammar import IDENTITY, MUST_GO, STATES, Entry, Rope, best, matrices, product, symbol

#: Rows of conversations that are compressed together.
CHUNK = 8_192
NAMES = ("user", "assistant")
LEGAL = {"su", "ua", "au"}

VERDICT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [T.StructField("audit", T.StringType())]
)
_PIECE = """start long, n_turns long, low long, high long, blank long, duplicate long, truncated long, illegal long,
    head string, tail string, costs array<long>, audits array<string>"""
_NUMBERS = ("blank", "duplicate", "truncated", "illegal")


# -- pieces of conversations, a chunk of rows at a time


def _piece(rows: list[dict]) -> tuple[dict, tuple[int, ...]]:
    """What is counted of some rows of one conversation, and their symbols."""
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    out = dict.fromkeys(_NUMBERS, 0) | {
        "conv": rows[0]["conv"], "start": rows[0]["m_before"], "n_turns": len(set(turns)),
        "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
        "head": rows[0]["initial"], "tail": rows[-1]["initial"],
    }
    codes: list[int] = []
    before = None
    for r in rows:
        n, initial = r["m"], r["initial"]
        if before is not None and before + initial not in LEGAL:
            out["illegal"] += 1
        out["illegal"] += n - 1  # the same role twice
        before = initial
        if r["blank"]:
            out["blank"] += n
            codes += [MUST_GO] * n
        elif r["is_first"]:
            out["duplicate"] += n - 1
            out["truncated"] += r["cut_off"]
            codes += [symbol(initial, r["cut_off"])] + [MUST_GO] * (n - 1)
        else:
            out["duplicate"] += n
            codes += [MUST_GO] * n
    return out, tuple(codes)


def _pieces(chunk: pa.Table) -> pa.Table:
    """Rows of ``_PIECE`` for a chunk. Equal symbol sequences are worked out once, and others share the rules of one grammar.

    A piece that does not open its chunk begins its conversation, and needs only the ways from the first state.
    """
    rows = sorted(chunk.to_pylist(), key=lambda r: r["m_before"])
    parts: list[list[dict]] = []
    for r in rows:
        if not parts or parts[-1][0]["conv"] != r["conv"]:
            parts.append([])
        parts[-1].append(r)
    read = [_piece(part) for part in parts]
    distinct = list(dict.fromkeys(codes for _, codes in read))
    ways = dict(zip(distinct, matrices(distinct)))
    for n, (piece, codes) in enumerate(read):
        entries = [x for row in ways[codes][: 1 if n else STATES] for x in row]
        piece["costs"] = [x and x[0] for x in entries]
        piece["audits"] = [x and x[1].text() for x in entries]
    names = ["conv", "start", "n_turns", "low", "high", *_NUMBERS, "head", "tail", "costs", "audits"]
    kinds = [chunk.schema.field("conv").type, *[pa.int64()] * 8, pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
    return pa.table({c: pa.array([p[c] for p, _ in read], k) for c, k in zip(names, kinds)})


class _Joined:
    """The pieces of one conversation, taken in order."""

    def __init__(self) -> None:
        self.row: list[Entry | None] = list(IDENTITY[0])
        self.numbers = dict.fromkeys(_NUMBERS, 0)
        self.turns, self.low, self.high, self.tail = 0, None, None, None

    def take(self, piece: dict) -> None:
        entries = [None if c is None else (c, Rope(a)) for c, a in zip(piece["costs"], piece["audits"])]
        matrix = [entries[i : i + STATES] for i in range(0, len(entries), STATES)]
        matrix += [[None] * STATES for _ in range(STATES - len(matrix))]
        self.row = product([self.row], matrix)[0]
        for c in _NUMBERS:
            self.numbers[c] += piece[c]
        if self.tail is not None and self.tail + piece["head"] not in LEGAL:
            self.numbers["illegal"] += 1
        self.tail = piece["tail"]
        self.turns += piece["n_turns"] - (self.high is not None and piece["low"] == self.high)
        self.low = piece["low"] if self.low is None else self.low
        self.high = piece["high"] if piece["high"] is not None else self.high

    def verdict(self) -> dict:
        cost, audit = best(self.row)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, **self.numbers, "cost": cost, "audit": audit.text()}


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current = joined = None

    def out(conv, joined: _Joined, kind: pa.DataType) -> pa.RecordBatch:
        verdict = joined.verdict()
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], kind), pa.array([verdict], pa.struct([(f.name, pa.string() if f.name == "audit" else pa.int64()) for f in VERDICT]))],
            names=["conv", "verdict"],
        )

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv").type
        for piece in batch.to_pylist():
            if joined is None or piece["conv"] != current:
                if joined is not None:
                    yield out(current, joined, kind)
                current, joined = piece["conv"], _Joined()
            joined.take(piece)
    if joined is not None:
        yield out(current, joined, kind)


# -- rows after repair


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each conversation as the letters of its audit say, then a row with its verdict.

    A conversation's verdict comes before its rows. Nothing is held but the letters and one batch, however long it is.
    """
    nothing = {f.name: "" if f.name == "audit" else 0 for f in VERDICT}
    open_, conv, verdict, letters, at, position, last = False, None, nothing, "", 0, 0, ""
    out: dict[str, list] = {c: [] for c in ("conv", "position", "edit", "role", "text", "verdict")}
    kind = None

    def put(edit: str | None, role: str | None, text: str | None, closing: dict | None = None) -> None:
        nonlocal position, last
        for name, value in zip(out, (conv, position, edit, role, text, closing)):
            out[name].append(value)
        position += 1
        last = role[:1] if role else ""

    def insertions() -> None:
        nonlocal at
        while at < len(letters) and letters[at] == "I":
            put("I", NAMES[last == "u"], "")
            at += 1

    def close() -> None:
        insertions()
        put(None, None, None, verdict)

    def flush() -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(),
                 pa.struct([(f.name, pa.string() if f.name == "audit" else pa.int64()) for f in VERDICT])]
        done = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))
        for values in out.values():
            values.clear()
        return done

    for batch in batches:
        kind = batch.schema.field("conv").type
        columns = [batch.column(c).to_pylist() for c in ("conv", "verdict", "times", "role", "text")]
        for key, found, times, role, text in zip(*columns):
            if not open_ or key != conv:
                if open_:
                    close()
                open_, conv, verdict, letters, at, position, last = True, key, nothing, "", 0, 0, ""
            if found is not None:
                verdict, letters = found, found["audit"]
                continue
            for _ in range(times):
                insertions()
                edit, at = letters[at], at + 1
                if edit == "K":
                    put(edit, role, text)
                elif edit == "R":
                    put(edit, NAMES[last == "u"], text)
        if out["conv"]:
            yield flush()
    if open_:
        close()
        yield flush()


def repair(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: str | None = None
) -> DataFrame:
    """The repaired rows of every conversation, and after them a row with its ``verdict``.

    Rows returned: ``conv, position, edit, role, text, verdict``. ``edit`` is K for a row kept, R for one whose
    role was changed, I for one put in; rows deleted are not there. The last row of a conversation has nothing but ``conv``,
    ``position`` and the verdict: ``gaps`` in its turns, rows ``blank``, ``duplicate`` and ``truncated`` by their first fault,
    ``illegal`` neighbours, the least ``cost`` and its ``audit``. A conversation's rows lie together, in order of ``position``,
    in one partition.

    ``times`` names a column that says how often a row occurs; a conversation all of whose rows occur 0 times
    gets zeros. ``turn`` must be a whole number. Null is a conversation like others; null turns come first; null roles and texts count
    as one space; rows of one turn follow each other by a digest of role and text, so that equal ones are neighbours.
    Columns of other names don't matter. An empty table gives no rows.

    Rows are counted in a global order and compressed in chunks of ``CHUNK``, wherever conversations begin and end, so a long
    conversation is worked on in as many tasks as it has chunks; its matrices are multiplied in order afterwards. What meets in one task
    of one conversation are its letters, and its rows one batch at a time.
    """
    def or_space(name: str):
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    n_times = F.lit(1) if times is None else F.coalesce(F.col(f"`{times}`").cast("int"), F.lit(0))
    named = conversations.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), or_space(role).alias("role"), or_space(text).alias("text"),
        n_times.alias("times"),
    ).withColumn("digest", F.md5(F.concat(F.char_length("role"), F.lit(":"), "role", "text")))
    end = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    groups = checkpointed(
        named.where("times > 0").groupBy("conv", "turn", "digest").agg(
            F.sum("times").alias("m"), F.min(F.substring("role", 1, 1)).alias("initial"),
            F.min(end == "").alias("blank"), F.min(~end.isin(".", "!", "?")).alias("cut_off"),
        )
    )
    firsts = groups.groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(
        F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first")
    )
    marked = groups.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).withColumn(
        "is_first", F.col("first.turn").eqNullSafe(F.col("turn"))
    )
    # Very often repeated rows are cut, so that a chunk is bounded in rows.
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {CHUNK}"))).alias("part")
    cut = marked.select("conv", "turn", "digest", "m", "initial", "blank", "cut_off", "is_first", part).select(
        "conv", "turn", "digest", "part", "initial", "blank", "cut_off", (F.col("is_first") & (F.col("part") == 0)).alias("is_first"),
        F.least(F.lit(CHUNK).cast("long"), F.col("m") - F.col("part") * CHUNK).alias("m"),
    )
    placed = running_totals(cut, ["conv", "turn", "digest", "part"], ["m"]).select(
        F.expr(f"m_before div {CHUNK}").alias("chunk"), "conv", "turn", "m_before", "m", "initial", "blank", "cut_off", "is_first"
    )
    key = f"conv {conversations.schema[conv].dataType.simpleString()}"
    pieces = placed.groupBy("chunk").applyInArrow(_pieces, f"{key}, {_PIECE}")
    verdict = f"verdict {VERDICT.simpleString()}"
    verdicts = pieces.repartition("conv").sortWithinPartitions("conv", "start").mapInArrow(_join_pieces, f"{key}, {verdict}")
    none = F.lit(None)
    rows = named.select("conv", none.cast(VERDICT).alias("verdict"), F.lit(1).alias("kind"), "turn", "digest", "times", "role", "text")
    heads = verdicts.select("conv", "verdict", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("digest"),
                            F.lit(0).alias("times"), none.cast("string").alias("role"), none.cast("string").alias("text"))
    return (
        rows.unionAll(heads)
        .repartition("conv")
        .sortWithinPartitions("conv", "kind", "turn", "digest")
        .mapInArrow(_repaired, f"{key}, position long, edit string, role string, text string, {verdict}")
    )
