"""XXH64 of many byte strings at once, as array operations."""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed values of XXH64.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)

#: Longer strings are hashed one by one by the library.
LONGEST = 256


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(state, lane):
    return _turn(state + lane * P2, 31) * P1


def _same_length(at8: np.ndarray, at4: np.ndarray, data: np.ndarray, starts: np.ndarray, n: int, seed: np.uint64):
    place = 0
    if n >= 32:
        first = np.array([seed + P1 + P2, seed + P2, seed, seed - P1], np.uint64)
        v = [np.full(len(starts), x, np.uint64) for x in first]
        while place + 32 <= n:
            v = [_round(x, at8[starts + (place + 8 * k)]) for k, x in enumerate(v)]
            place += 32
        h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
        for x in v:
            h = (h ^ _round(np.uint64(0), x)) * P1 + P4
    else:
        h = np.full(len(starts), seed + P5, np.uint64)
    h += np.uint64(n)
    while place + 8 <= n:
        h = _turn(h ^ _round(np.uint64(0), at8[starts + place]), 27) * P1 + P4
        place += 8
    if place + 4 <= n:
        h = _turn(h ^ (at4[starts + place].astype(np.uint64) * P1), 23) * P2 + P3
        place += 4
    while place < n:
        h = _turn(h ^ (data[starts + place].astype(np.uint64) * P5), 11) * P1
        place += 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    return h ^ (h >> np.uint64(32))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """The unsigned hashes of ``data[start : start + length]``. Strings are worked on by length, all of one at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at8 = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    at4 = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(np.minimum(lengths, LONGEST + 1).astype(np.uint16), kind="stable")
    ordered = lengths[order]
    with np.errstate(over="ignore"):
        bounds = np.flatnonzero(np.diff(ordered)) + 1
        for group in np.split(order, bounds) if len(order) else []:
            n = int(lengths[group[0]])
            if n > LONGEST:
                out[group] = [xxhash.xxh64_intdigest(data[s : s + k].tobytes(), seed) for s, k in zip(starts[group], lengths[group])]
            else:
                out[group] = _same_length(at8, at4, padded, starts[group], n, np.uint64(seed))
    return out
