"""Edits of conversations as products of min-plus matrices over a Re-Pair grammar.

A row of a conversation is a symbol: its role's initial and its fault. The states are what the roles kept so far end
in. A symbol's matrix has, for each pair of states, the least cost of taking the row from one to the other, insertions before
it included, and the letters of those edits; of edits as cheap, the least by ASCII. The matrix of a row of symbols is
the product of theirs, so one that a grammar's rule stands for is worked out once, however often the rule occurs.

Of two ways as cheap, none's letters begin the other's: both have a letter for each row and cost the same, so the longer one
would have insertions more and cost more. Hence the least letters of a product are made of the least letters of its parts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

#: States: nothing kept, last a system row at the start, last a user row, last an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
ACCEPTED = (NOTHING, ASSISTANT)

#: Symbols: a row that must go, or the initial (system, user, assistant, other) and whether the text is cut off.
MUST_GO = 0
INITIALS = "sua"
N_SYMBOLS = 9


def symbol(initial: str, cut_off: bool) -> int:
    at = INITIALS.find(initial) if initial else -1
    return 1 + 2 * (at if at >= 0 else len(INITIALS)) + cut_off


class Rope:
    """Letters put together from two ropes, spelt out when they are first compared."""

    __slots__ = ("_left", "_right", "_text")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None):
        self._text, self._left, self._right = text, left, right

    def text(self) -> str:
        if self._text is None:
            parts, todo = [], [self]
            while todo:
                rope = todo.pop()
                if rope._text is not None:
                    parts.append(rope._text)
                else:
                    todo += (rope._right, rope._left)
            self._text, self._left, self._right = "".join(parts), None, None
        return self._text


Entry = tuple[int, Rope]
Matrix = list[list[Entry | None]]


def cheaper(a: Entry | None, b: Entry | None) -> Entry | None:
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1] is b[1] or a[1].text() <= b[1].text() else b


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        line: list[Entry | None] = [None] * STATES
        for k, x in enumerate(row):
            if x is None:
                continue
            for j, y in enumerate(b[k]):
                if y is None or (line[j] is not None and x[0] + y[0] > line[j][0]):
                    continue
                line[j] = cheaper(line[j], (x[0] + y[0], Rope(None, x[1], y[1])))
        out.append(line)
    return out


def _matrix(steps: Iterable[tuple[int, int, int, str]]) -> Matrix:
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for start, end, cost, letters in steps:
        out[start][end] = cheaper(out[start][end], (cost, Rope(letters)))
    return out


_NEXT = [(NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)]
IDENTITY = _matrix((s, s, 0, "") for s in range(STATES))
#: Any number of insertions; more than two never pay.
INSERTIONS = _matrix(
    [(s, s, 0, "") for s in range(STATES)]
    + [(a, b, 2, "I") for a, b in _NEXT]
    + [(a, ASSISTANT, 4, "II") for a in (NOTHING, SYSTEM)]
)


def _edits(code: int) -> Matrix:
    delete = [(s, s, 3, "D") for s in range(STATES)]
    if code == MUST_GO:
        return _matrix(delete)
    kind, cut_off = divmod(code - 1, 2)
    keep = {0: [(NOTHING, SYSTEM)], 1: [x for x in _NEXT if x[1] == USER], 2: [(USER, ASSISTANT)]}.get(kind, [])
    return _matrix(
        delete + [(a, b, cut_off, "K") for a, b in keep] + [(a, b, 2 + cut_off, "R") for a, b in _NEXT]
    )


ROWS = [product(INSERTIONS, _edits(code)) for code in range(N_SYMBOLS)]


def re_pair(sequences: Sequence[Sequence[int]]) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """The sequences with their commonest neighbours replaced by new symbols, again and again until no two neighbours occur
    twice; and the pair that each new symbol (``N_SYMBOLS`` and up) stands for."""
    line: list[int] = []
    for sequence in sequences:
        line += sequence
        line.append(-1)  # joins with nothing
    after, before = list(range(1, len(line) + 1)), list(range(-1, len(line) - 1))
    places: dict[tuple[int, int], set[int]] = {}
    changed: set[tuple[int, int]] = set()

    def add(i: int) -> None:
        j = after[i] if i >= 0 else len(line)
        if j < len(line) and line[i] >= 0 and line[j] >= 0:
            places.setdefault((line[i], line[j]), set()).add(i)
            changed.add((line[i], line[j]))

    def remove(i: int) -> None:
        j = after[i] if i >= 0 else len(line)
        if j < len(line):
            places.get((line[i], line[j]), set()).discard(i)

    for i in range(len(line)):
        add(i)
    rules: list[tuple[int, int]] = []
    queue = [(-len(where), pair) for pair, where in places.items()]
    heapq.heapify(queue)
    while queue:
        count, pair = heapq.heappop(queue)
        where = places.get(pair, set())
        if len(where) < 2:
            continue
        if len(where) < -count:
            heapq.heappush(queue, (-len(where), pair))
            continue
        new = N_SYMBOLS + len(rules)
        rules.append(pair)
        changed.clear()
        for i in sorted(places.pop(pair)):
            j = after[i]
            if line[i] != pair[0] or j >= len(line) or line[j] != pair[1]:
                continue  # overlaps the one before
            remove(before[i])
            remove(j)
            line[i], line[j] = new, -2
            after[i] = after[j]
            if after[j] < len(line):
                before[after[j]] = i
            add(before[i])
            add(i)
        for other in changed:
            heapq.heappush(queue, (-len(places[other]), other))
    out: list[list[int]] = [[]]
    i = 0
    while i < len(line):
        if line[i] == -1:
            out.append([])
        else:
            out[-1].append(line[i])
        i = after[i]
    return out[:-1], rules


def matrices(sequences: Sequence[Sequence[int]]) -> list[Matrix]:
    """The matrix of each sequence. Rules are worked out from the bottom up, once for all sequences."""
    short, rules = re_pair(sequences)
    known = list(ROWS)
    for a, b in rules:
        known.append(product(known[a], known[b]))
    out = []
    for sequence in short:
        total = IDENTITY
        for code in sequence:
            total = product(total, known[code])
        out.append(total)
    return out


def best(row: Sequence[Entry | None]) -> Entry:
    """The cheapest way from the first row of a product over a whole conversation to an accepted end."""
    ends = product([list(row)], INSERTIONS)[0]
    found = None
    for state in ACCEPTED:
        found = cheaper(found, ends[state])
    assert found is not None  # deleting every row is always a way
    return found
