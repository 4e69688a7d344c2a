"""Simple-8b: whole numbers packed into 64-bit words whose top four bits say how.

Anh and Moffat, "Index compression using 64-bit words" (2010). Selectors 0 to 13 pack many narrow
or few wide numbers; selector 15 is an escape: the next word holds one number of up to 64 bits as it is. Numbers
are packed in blocks, each beginning a new word, so that the word at which each block
begins lets blocks be coded, and decoded, side by side in array operations.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format: numbers in a word, and bits of each, by selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15

BLOCK = 1024
_PAD = max(COUNTS)
_TOP = np.uint64(60)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    lengths = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
    return lengths.astype(np.uint8)


def _window_maxima(bits: np.ndarray) -> dict[int, np.ndarray]:
    """By count: the largest of that many numbers of a row from each place on; none follow the row's end."""
    found = {1: bits}

    def joined(a: int, b: int) -> np.ndarray:
        out = found[a].copy()
        np.maximum(out[:, :-a], found[b][:, a:], out=out[:, :-a])
        return out

    for count, a in ((2, 1), (3, 2), (4, 2), (5, 4), (6, 4), (7, 4), (8, 4), (10, 8), (12, 8), (15, 8), (20, 12), (30, 15), (60, 30)):
        found[count] = joined(a, count - a)
    return found


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The words, and for each block the word at which it begins, with the number of words at the end."""
    values = np.asarray(values, dtype=np.uint64)
    n, rows = len(values), -(-len(values) // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    grid = np.zeros((rows, block + _PAD), np.uint64)
    full = np.zeros(rows * block, np.uint64)
    full[:n] = values
    grid[:, :block] = full.reshape(rows, block)
    bits = _bit_lengths(grid)
    selector = np.full(grid.shape, ESCAPE, np.uint8)
    maxima = _window_maxima(bits)
    for s in range(len(COUNTS) - 1, -1, -1):
        selector[maxima[COUNTS[s]] <= BITS[s]] = s
    count = np.array([*COUNTS, 0, 1], np.int64)[selector]

    ends = np.full(rows, block)
    ends[-1] = n - (rows - 1) * block
    begins = np.zeros(grid.shape, bool)
    row, at = np.arange(rows), np.zeros(rows, np.int64)
    while len(row):
        begins[row, at] = True
        at = at + count[row, at]
        more = at < ends[row]
        row, at = row[more], at[more]

    row, at = np.nonzero(begins)
    chosen = selector[row, at]
    wide = chosen == ESCAPE
    size = 1 + wide.astype(np.int64)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s, (c, b) in enumerate(zip(COUNTS, BITS)):
        mine = np.nonzero(chosen == s)[0]
        if len(mine):
            taken = grid[row[mine][:, None], at[mine][:, None] + np.arange(c)]
            taken <<= np.arange(c, dtype=np.uint64) * np.uint64(b)
            words[place[mine]] = np.bitwise_or.reduce(taken, axis=1) | (np.uint64(s) << _TOP)
    words[place[wide]] = np.uint64(ESCAPE) << _TOP
    words[place[wide] + 1] = grid[row[wide], at[wide]]
    in_row = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(in_row)])


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` numbers of these words; ``offsets`` as ``encode`` gave them, or those of some blocks on end."""
    rows = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64)
    words = words[offsets[0] : offsets[-1]]
    starts = np.asarray(offsets[:-1]) - offsets[0]
    selector = (words >> _TOP).astype(np.int64)
    # In a run of words that look like escapes every other one is a number that an escape announces.
    looks = selector == ESCAPE
    index = np.arange(len(words))
    run_start = np.maximum.accumulate(np.where(looks, -1, index)) + 1
    escape = looks & ((index - run_start) % 2 == 0)
    raw = np.concatenate([[False], escape[:-1]])
    count = np.where(raw, 0, np.array([*COUNTS, 0, 1])[selector])
    before = np.cumsum(count) - count
    row = np.repeat(np.arange(rows), np.diff(offsets))
    place = row * (block + _PAD) + before - before[starts][row]
    grid = np.zeros(rows * (block + _PAD), np.uint64)
    for s, (c, b) in enumerate(zip(COUNTS, BITS)):
        mine = np.nonzero((selector == s) & ~raw)[0]
        if len(mine):
            shifts = np.arange(c, dtype=np.uint64) * np.uint64(b)
            mask = np.uint64((1 << b) - 1)
            grid[place[mine][:, None] + np.arange(c)] = (words[mine][:, None] >> shifts) & mask
    grid[place[escape]] = words[np.nonzero(escape)[0] + 1]
    return grid.reshape(rows, block + _PAD)[:, :block].reshape(-1)[:n]
