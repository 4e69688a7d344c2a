"""A run-length index of a repetitive text: which of its strings of a given length also begin earlier.

The suffixes are sorted, and the Burrows-Wheeler transform, the byte before each, falls into few runs where
the text repeats itself. Only at the first suffix of each run the suffix before it and the length of their match
are kept (the sampled run ends of an r-index; Gagie, Navarro and Prezza, 2018, and for the matches Karkkainen, Kempa and Puglisi, 2016).
Within a run both follow from the sample before: one place further in the text the match is one shorter and its place one
further. So one pass over the text streams the matching statistics of every place from the samples.
"""

from __future__ import annotations

import numpy as np

#: Symbols in the first sort key: seven of nine bits.
FIRST = 7


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``symbols`` (0 to 511), by doubling the compared length of those still tied."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64) + np.uint64(1), np.zeros(FIRST, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(FIRST):
        key = (key << np.uint64(9)) | padded[k : k + n]
    order = np.argsort(key).astype(np.int64)
    changes = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    # A suffix's rank is the place of the first of those it is tied with, so ranks of others stay as they are.
    rank_sorted = np.maximum.accumulate(np.where(changes, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = rank_sorted + 1
    length = FIRST
    while True:
        tied = ~changes
        tied[:-1] |= ~changes[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        mine = order[places]
        second = rank[np.minimum(mine + length, n)]
        key = (rank[mine].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(key)
        order[places] = mine[by]
        key = key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        changes[places] = new
        first = np.maximum.accumulate(np.where(new, places, 0))
        rank[order[places]] = first + 1
        length *= 2


def _match_lengths(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols agree from places ``a`` and ``b`` on."""
    n = len(symbols)
    length = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    step = 16
    padded = np.concatenate([symbols, np.full(step, 600, symbols.dtype)])
    while len(active):
        x, y = a[active] + length[active], b[active] + length[active]
        inside = np.minimum(n - x, n - y)
        x, y = np.minimum(x, n), np.minimum(y, n)
        same = padded[x[:, None] + np.arange(step)] == padded[y[:, None] + np.arange(step)]
        agree = np.minimum(np.where(same.all(1), step, np.argmin(same, axis=1)), inside)
        length[active] += agree
        active = active[agree == step]
    return length


def matching_statistics(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the length of its match with the suffix sorted before its own, and the place of that."""
    n = len(symbols)
    order = suffix_array(symbols)
    transform = symbols[order - 1]
    heads = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1]]))
    at = order[heads]
    partner = np.where(heads > 0, order[heads - 1], 0)
    match = np.zeros(len(heads), np.int64)
    match[1:] = _match_lengths(symbols, at[1:], partner[1:])
    # The suffix whose preceding symbol wraps around is a sample of its own.
    wrap = np.flatnonzero(order == 0)
    for k in np.concatenate([wrap, wrap + 1]):
        if 0 < k < n and not (heads == k).any():
            at, partner = np.append(at, order[k]), np.append(partner, order[k - 1])
            match = np.append(match, _match_lengths(symbols, order[k : k + 1], order[k - 1 : k]))
    sample = np.full(n, -1, np.int64)
    sample[at] = np.arange(len(at))
    nearest = np.maximum.accumulate(np.where(sample >= 0, np.arange(n), 0))
    which = sample[nearest]
    ahead = np.arange(n) - nearest
    return np.maximum(match[which] - ahead, 0), partner[which] + ahead


def repeated_starts(pieces: list[bytes], length: int) -> np.ndarray:
    """Over all pieces on end, each followed by one place: whether ``length`` bytes from here also begin earlier.

    Strings lie within a piece; earlier is by the order of the pieces, then by place.
    """
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16) + 1
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    text[ends] = 0
    n = len(text)
    valid = np.zeros(n + 1, np.int32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    some = ends - starts >= length
    np.add.at(valid, starts[some], 1)
    np.add.at(valid, ends[some] - length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    match, place = matching_statistics(text)
    joined = valid & (match >= length)
    # Strings that are equal follow each other in the order of the suffixes: walk to the first of them, and compare with the least.
    head = np.where(joined, place, np.arange(n))
    while True:
        further = head[head]
        if (further == head).all():
            break
        head = further
    least = np.arange(n)
    np.minimum.at(least, head[valid], np.flatnonzero(valid))
    return valid & (least[head] < np.arange(n))
