"""The word pair model of ``kneser_ney``, over all words of the trusted text.

A word is its 64-bit hash, or a small number if a sample shows it among the most frequent; that only chooses how words are spelt and
where pairs meet, not what comes out. A pair belongs to a shard by its rare word (its first, if both are), a pair of frequent words by a hash of
the two. The logarithm of a pair's probability falls into parts: what its first word leaves to the lower order, how probable that word is
there (as against a word never seen), and what is gained if the pair was seen. So a document's score is the sum of what its pairs
find in their shards, and no task holds figures of all words. Of frequent words, and of a bounded number of their most frequent pairs, every task has
the figures; what a document holds of these is added up where it is read. A bounded Bloom filter of the rare words that the model holds tells most pairs
that it cannot hold; those are not asked for.

Between tasks travel packed arrays: from each slice of documents to each shard the slice's other pairs, and back to the slice what they add
to its documents' scores. No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.llm.arrow import pack_planes, text_bytes, text_slices, unpack_planes
from logsluice.llm.common import checkpointed, shuffle_partitions
from logsluice.llm.xxh64 import xxh64

SLICE = 8 << 20

#: Numbers of a text's start and end.
START, END = np.uint64(1), np.uint64(2)

#: Trusted texts looked at for frequent words, and how many words and pairs of them every task knows.
SAMPLE, FREQUENT, KNOWN_PAIRS = 15_000, 1 << 17, 1 << 20

#: Bits of the filter for each rare word, and at most; a filter that is too small lets words pass that the model does not hold.
BITS, MOST_BITS = 8, 1 << 27

#: Frequent words, the start and the end have numbers below this, rare words' hashes are above.
RARE = np.uint64(1 << 32)

ABOUT = pa.struct([("key", pa.int64()), ("lang", pa.string()), ("trusted", pa.bool_()), ("n", pa.int64()), ("sum", pa.int64())])
TRAVELS = "part long, base long, data binary"
ASKS = TRAVELS + ", about array<struct<key: long, lang: string, trusted: boolean, n: long, sum: long>>"
#: What a row that meets others in a shard holds: pairs and their counts, figures of words, or what documents ask for.
PAIRS, WORDS, ASKED = range(3)
#: Logarithms are added up in whole units, so that sums do not depend on who adds what first.
UNIT = 2.0**-24
#: What a row of words has if it is no answer of another shard: the shard's own rare words, its frequent ones, or its part of the filter.
OWN, OF_FREQUENT, FILTER = -1, -2, -3
FIVE = ("<i8",) * 5


# -- words and pairs to keys


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = first * np.uint64(0x9E3779B97F4A7C15) + ((second << np.uint64(23)) | (second >> np.uint64(41)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    data, at = text_bytes(words)
    hashes = xxh64(data, at[:-1], np.diff(at))
    return np.where(hashes < RARE, hashes + RARE, hashes)


def numbered(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Frequent words by their numbers, which follow those of start and end, others as they are."""
    if not len(frequent):
        return hashes
    order = np.argsort(frequent)
    place = np.minimum(np.searchsorted(frequent, hashes, sorter=order), len(frequent) - 1)
    number = order[place]
    return np.where(frequent[number] == hashes, number.astype(np.uint64) + END + np.uint64(1), hashes)


def text_pairs(texts: pa.Array, frequent: np.ndarray = np.zeros(0, np.uint64)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of neighbours, the first and the second, with the text of each; a start and an end belong to each text."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    # White space at either end of a text leaves empty words.
    coded = words.flatten().dictionary_encode()
    which = coded.indices.to_numpy()
    empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    real = ~empty[which] if len(empty) else np.zeros(0, bool)
    ids = numbered(word_hashes(coded.dictionary), frequent)[which[real]] if len(empty) else np.zeros(0, np.uint64)
    bounds = np.concatenate([[0], np.cumsum(real)])[words.offsets.to_numpy() - words.offsets[0].as_py()]
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n), dtype="<i4"), n + 1)
    first = np.insert(ids, bounds[:-1], START)
    second = np.append(first[1:], END)
    second[(bounds[:-1] + np.arange(len(n)) - 1)[1:]] = END
    return first, second, owner


def _leading(keys: np.ndarray, shards: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def pair_shards(first: np.ndarray, second: np.ndarray, shards: int) -> np.ndarray:
    """A rare word has all pairs that it begins, and those in which it follows a frequent one, in its own shard."""
    rare = np.where(first >= RARE, first, second)
    return _leading(np.where(rare >= RARE, rare, pair_keys(first, second)), shards)


def word_shards(words: np.ndarray, shards: int) -> np.ndarray:
    return _leading(np.where(words >= RARE, words, pair_keys(words, words)), shards)


def _shards(spark: SparkSession) -> int:
    """Half the partitions of a shuffle: a document has an answer from each shard, so few shards are few answers."""
    return max(1, shuffle_partitions(spark) // 2)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Shards that occur, and the places of each, in order."""
    order = np.argsort(shard, kind="stable")
    first = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for a, b in zip(first, [*first[1:], len(order)]):
        yield int(shard[order[a]]), order[a:b]


def _home(base: int, shards: int) -> int:
    """The shard that what is known of a slice's documents goes by; their numbers begin alike, so they are hashed."""
    return ((base * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 33) % shards


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _spelt(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps of the words and of the pairs, and the pairs' order. Each word is spelt once; a pair is its words' places among them, as a step from the last."""
    word, at = np.unique(np.concatenate([first, second]), return_inverse=True)
    pair = at[: len(first)].astype(np.uint64) * np.uint64(len(word)) + at[len(first) :].astype(np.uint64)
    order = np.argsort(pair)
    return _steps(word), _steps(pair[order]), order


def pack_pairs(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs, no two alike, with their counts."""
    words, pairs, order = _spelt(first, second)
    return pack_planes(words, pairs, n[order].astype("<u8"))


def _places(steps: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, second = np.divmod(np.cumsum(pairs, dtype=np.uint64), np.uint64(max(len(steps), 1)))
    return np.cumsum(steps, dtype=np.uint64), first.astype(np.int64), second.astype(np.int64)


def unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words in order, the places of the pairs' first and second words among them, and the pairs' counts."""
    steps, pairs, n = unpack_planes(data, ("<u8", "<u8", "<u8"))
    return *_places(steps, pairs), n.astype(np.int64)


def _units(logs: np.ndarray) -> np.ndarray:
    return np.rint(logs / UNIT).astype(np.int64)


def _sum_of(who: np.ndarray, units: np.ndarray, docs: int = 0) -> np.ndarray:
    return np.bincount(who, weights=units, minlength=docs).astype("<i8")


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of runs, one run after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"data": pa.binary(), "known": pa.binary()}
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(n, pa.int64())) for x, n in zip(columns, names)], names)


# -- the model


def _discounts(counts_of_counts: list[int]) -> np.ndarray:
    """What is taken off counts of 0, 1, 2, and 3 or more, from how many there are of 1, 2, 3 and 4."""
    n = [0.0, *map(float, counts_of_counts)]
    if not (n[1] and n[2]):
        return np.array([0, 0.5, 0.75, 0.75])
    y = n[1] / (n[1] + 2 * n[2])
    off = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.75 for k in (1, 2, 3)]
    return np.array([0, *(min(max(d, 0.05), k - 0.05) for d, k in zip(off, (1, 2, 3)))])


def _bits(words: np.ndarray, size: np.ndarray | int) -> Iterator[np.ndarray]:
    for k in (1, 2, 3):
        yield (pair_keys(words, np.uint64(k)) % np.maximum(size, 1).astype(np.uint64)).astype(np.int64)


def word_filter(words: np.ndarray, most: int) -> bytes:
    """A Bloom filter of about ``most`` bits at most."""
    held = np.zeros(8 + min(BITS * len(words), most) // 8 * 8, bool)
    for bit in _bits(words, np.int64(len(held))):
        held[bit] = True
    return np.packbits(held, bitorder="little").tobytes()


@dataclass
class Filter:
    """The shards' filters on end, and of each shard where its own begins and how many bits it has."""

    held: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, parts: dict[int, bytes], shards: int) -> Filter:
        size = np.array([8 * len(parts.get(k, b"")) for k in range(shards)], np.int64)
        held = np.frombuffer(b"".join(parts.get(k, b"") for k in range(shards)) or b"\0", np.uint8)
        return cls(held, np.cumsum(size) - size, size)

    def may_hold(self, words: np.ndarray) -> np.ndarray:
        """False only if no rare word like that is in the model."""
        shard = _leading(words, len(self.size))
        found = self.size[shard] > 0
        for bit in _bits(words, self.size[shard]):
            bit = np.where(found, bit + self.start[shard], 0)
            found &= (self.held[bit >> 3] >> (bit & 7)) & 1 > 0
        return found


@dataclass
class Figures:
    """What every task knows: discounts, and of the lower order its own, its size, and the share of a word never seen; the frequent words
    in the order of their numbers, by number the figures of each, keys in order, with counts, of their most frequent pairs, and the filter of rare words."""

    discounts: np.ndarray
    low: np.ndarray
    ends: int
    unseen: float
    frequent: np.ndarray
    of: list[np.ndarray]
    pairs: np.ndarray
    times: np.ndarray
    filter: Filter

    def left(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (self.discounts[1] * b + self.discounts[2] * c + self.discounts[3] * d) / np.maximum(a, 1)

    def lower(self, ends: np.ndarray) -> np.ndarray:
        return (ends - self.low[np.minimum(ends, 3)]) / self.ends + self.unseen

    def value(self, of: list[np.ndarray]) -> np.ndarray:
        """What words add of themselves, given their figures."""
        with np.errstate(divide="ignore"):
            left = np.where(of[0] > 0, np.log(self.left(*of[:4])), 0.0)
            return (left + np.where(of[4] > 0, np.log(self.lower(of[4]) / self.unseen), 0.0)).astype("<f4")

    def gain(self, count: np.ndarray, own: np.ndarray, total: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """What pairs add that were seen ``count`` times, ``own`` of them in the text that is judged."""
        count = np.maximum(count - own, 0)
        return np.log1p(np.maximum(count - self.discounts[np.minimum(count, 3)], 0) / total / rest)


def _some_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in text_slices(batch, "text", SLICE):
            word, n = np.unique(text_pairs(some.column("text"))[0], return_counts=True)
            often = np.sort(np.argsort(-n, kind="stable")[: min(FREQUENT, int((n > 1).sum()))])
            yield _batch([(pack_planes(_steps(word[often]), n[often].astype("<u8")),)], ["data"])


def frequent_words(trusted: DataFrame, n: int) -> np.ndarray:
    """Hashes of the most frequent words of a bounded sample of the ``n`` texts, the most frequent first."""
    rows = trusted.select("text").sample(min(1.0, SAMPLE / n), seed=9).mapInArrow(_some_words, "data binary").collect()
    if not rows:
        return np.zeros(0, np.uint64)
    steps, n = zip(*[unpack_planes(x["data"], ("<u8", "<u8")) for x in rows])
    word, inverse = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in steps]), return_inverse=True)
    times = np.bincount(inverse, weights=np.concatenate(n))
    often = np.argsort(-times, kind="stable")
    return word[often[word[often] >= RARE]][:FREQUENT]


def _count_pairs(shards: int, frequent: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, "text", 2 * SLICE):
                first, second, _ = text_pairs(some.column("text"), frequent)
                _, place, n = np.unique(pair_keys(first, second), return_index=True, return_counts=True)
                first, second = first[place], second[place]
                out = [(shard, pack_pairs(first[m], second[m], n[m])) for shard, m in _by_shard(pair_shards(first, second, shards))]
                yield _batch(out, ["part", "data"])

    return run


def _sum_pairs(shards: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        parts = [(word[f], word[s], n) for word, f, s, n in map(unpack_pairs, table.column("data").to_pylist())]
        first, second, n = (np.concatenate(x) for x in zip(*parts))
        key, place, inverse = np.unique(pair_keys(first, second), return_index=True, return_inverse=True)
        first, second, n = first[place], second[place], np.bincount(inverse, weights=n).astype("<i8")
        # Pairs of frequent words are dealt by a hash, so all shards have a like part of the most frequent.
        often = np.flatnonzero((first < RARE) & (second < RARE) & (n > 1))
        often = np.sort(often[np.argsort(-n[often], kind="stable")][: KNOWN_PAIRS // shards])
        known = pack_pairs(first[often], second[often], n[often])
        row = (table.column("part")[0].as_py(), pack_pairs(first, second, n), known, *[int((n == k).sum()) for k in (1, 2, 3, 4)])
        return pa.Table.from_batches([_batch([row], ["part", "data", "known", "n1", "n2", "n3", "n4"])])

    return run


def _word_figures(shards: int) -> Callable:
    """Of each shard's words, to the words' shards: counts and kinds of pairs a word begins, and number of those it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist()):
                word, f, s, n = unpack_pairs(data)
                sums = [np.bincount(f, weights=x, minlength=len(word)).astype("<i8") for x in (n, n == 1, n == 2, n >= 3)]
                sums.append(np.bincount(s, minlength=len(word)).astype("<i8"))
                out = [(shard, part, pack_planes(_steps(word[m]), *[x[m] for x in sums])) for shard, m in _by_shard(word_shards(word, shards))]
                yield _batch(out, ["part", "base", "data"])

    return run


def _sum_words(shards: int) -> Callable:
    return lambda table: _sums_of_words(table, shards)


def _sums_of_words(table: pa.Table, shards: int) -> pa.Table:
    """All figures of a shard's words, of the frequent ones by themselves; to each other shard of pairs, those of the rare ones it has, in its order."""
    asked = [unpack_planes(x, ("<u8", *FIVE)) for x in table.column("data").to_pylist()]
    words = [np.cumsum(x[0], dtype=np.uint64) for x in asked]
    word, inverse = np.unique(np.concatenate(words), return_inverse=True)
    sums = [np.bincount(inverse, weights=np.concatenate([x[k] for x in asked])).astype("<i8") for k in range(1, 6)]
    ends, part = sums[4], table.column("part")[0].as_py()
    whole = (int(ends.sum()), int((ends > 0).sum()), *[int((ends == k).sum()) for k in (1, 2, 3, 4)])
    n = int(np.searchsorted(word, RARE))
    rows = [(part, at, pack_planes(_steps(word[m]), *[x[m] for x in sums]), *of) for at, m, of in
            ((OWN, slice(n, None), whole), (OF_FREQUENT, slice(n), [0] * 6))]
    rows.append((part, FILTER, word_filter(word[n:], MOST_BITS // shards), *[0] * 6))
    start = 0
    for base, own in zip(table.column("base").to_pylist(), words):
        mine = inverse[start : start + len(own)][own >= RARE]
        if base != part and len(mine):
            rows.append((base, part, pack_planes(*[x[mine] for x in sums]), *[0] * 6))
        start += len(own)
    return pa.Table.from_batches([_batch(rows, ["to", "at", "data", "ends", "kinds", "n1", "n2", "n3", "n4"])])


def _own_words(words: pa.Table) -> tuple[np.ndarray, list[np.ndarray], dict[int, bytes]]:
    """A shard's own rare words in order, their figures, and what other shards answer."""
    replies = dict(zip(words.column("base").to_pylist(), words.column("data").to_pylist()))
    if OWN not in replies:
        return np.zeros(0, np.uint64), [np.zeros(0, "<i8")] * 5, replies
    step, *of = unpack_planes(replies.pop(OWN), ("<u8", *FIVE))
    return np.cumsum(step, dtype=np.uint64), of, replies


def _held_pairs(figures: Figures, shards: int, pairs: pa.Table, own: np.ndarray, of_own: list[np.ndarray], replies: dict[int, bytes]) -> tuple[np.ndarray, ...]:
    """A shard's pairs: sorted keys with the count, that of the first word, and the probability if unseen."""
    if not len(pairs):
        return np.zeros(0, "<u8"), np.zeros(0, "<i8"), np.zeros(0, "<i8"), np.zeros(0, "<f4")
    word, f, s, n = unpack_pairs(pairs.column("data")[0].as_py())
    rare = int(np.searchsorted(word, RARE))
    here = rare + np.flatnonzero(word_shards(word[rare:], shards) == pairs.column("part")[0].as_py())
    away = np.setdiff1d(np.arange(rare, len(word)), here)
    answers = [unpack_planes(replies[k], FIVE) for k in sorted(replies)]
    of = [np.zeros(len(word), "<i8") for _ in range(5)]
    for k in range(5):
        of[k][:rare] = figures.of[k][word[:rare].astype(np.int64)]
        of[k][here] = of_own[k][np.searchsorted(own, word[here])]
        of[k][away] = np.concatenate([x[k] for x in answers]) if answers else 0
    key = pair_keys(word[f], word[s])
    rest = figures.left(*of[:4])[f] * figures.lower(of[4])[s]
    order = np.argsort(key)
    return key[order], n[order], of[0][f][order], rest[order].astype("<f4")


def train(trusted: DataFrame) -> tuple[Figures | None, DataFrame | None]:
    """The model of the texts in column ``text``: figures for all words, and the rows that make up its shards. No text, no model."""
    shards = _shards(trusted.sparkSession)
    if not (texts := trusted.count()):
        return None, None
    frequent = frequent_words(trusted, texts)
    counted = trusted.select("text").mapInArrow(_count_pairs(shards, frequent), "part long, data binary")
    counts = checkpointed(counted.groupBy("part").applyInArrow(_sum_pairs(shards), "part long, data binary, known binary, n1 long, n2 long, n3 long, n4 long"))
    asked = counts.select("part", "data").mapInArrow(_word_figures(shards), TRAVELS)
    words = checkpointed(asked.groupBy("part").applyInArrow(_sum_words(shards), "to long, at long, data binary, ends long, kinds long, n1 long, n2 long, n3 long, n4 long"))
    of = [F.sum(f"n{k}").alias(f"n{k}") for k in (1, 2, 3, 4)]
    pairs, ends = counts.agg(*of).first(), words.agg(*of, F.sum("ends").alias("ends"), F.sum("kinds").alias("kinds")).first()
    low = _discounts(list(ends[:4]))
    taken = low[1] * ends["n1"] + low[2] * ends["n2"] + low[3] * (ends["kinds"] - ends["n1"] - ends["n2"])
    by_number = [np.zeros(len(frequent) + 3, "<i8") for _ in range(5)]
    for row in words.where(F.col("at") == OF_FREQUENT).select("data").collect():
        step, *figures = unpack_planes(row["data"], ("<u8", *FIVE))
        for sums, x in zip(by_number, figures):
            sums[np.cumsum(step).astype(np.int64)] = x
    held_words = {x["to"]: bytes(x["data"]) for x in words.where(F.col("at") == FILTER).select("to", "data").collect()}
    known = [(pair_keys(word[f], word[s]), n) for word, f, s, n in (unpack_pairs(x["known"]) for x in counts.select("known").collect())]
    key, times = (np.concatenate(x) for x in zip(*known))
    order = np.argsort(key)
    # All words never seen are one more word.
    unseen = taken / ends["ends"] / (ends["kinds"] + 1)
    times = times[order].astype(np.min_scalar_type(times.max(initial=0)))
    figures = Figures(_discounts(list(pairs)), low, ends["ends"], unseen, frequent, by_number, key[order], times, Filter.of(held_words, shards))
    held = counts.select("part", F.lit(OWN).cast("long").alias("base"), "data", F.lit(PAIRS).alias("kind"))
    return figures, held.union(words.where(F.col("at") >= OWN).select("to", "at", "data", F.lit(WORDS)))


# -- scores


def _known_here(figures: Figures, first: np.ndarray, second: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs every task knows, and their places among those."""
    place = np.minimum(np.searchsorted(figures.pairs, key), max(len(figures.pairs) - 1, 0))
    if not len(figures.pairs):
        return np.zeros(len(key), bool), place
    return (figures.pairs[place] == key) & (first < RARE) & (second < RARE), place


def _settled(figures: Figures, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Pairs that the model cannot hold, by the filter, if their first word is frequent or not held either: no shard knows more of them."""
    settled = np.zeros(len(first), bool)
    rare, after = first >= RARE, (first < RARE) & (second >= RARE)
    settled[rare] = ~figures.filter.may_hold(first[rare])
    settled[after] = ~figures.filter.may_hold(second[after])
    return settled


def _ask(figures: Figures, shards: int) -> Callable:
    value = figures.value(figures.of)
    left, lower = figures.left(*figures.of[:4]), figures.lower(figures.of[4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, "text", 2 * SLICE):
                base = some.column("row")[0].as_py()
                # Trusted documents come first, so that their number says which they are.
                trusted = some.column("trusted").to_numpy(zero_copy_only=False)
                some = some.take(pa.array(np.argsort(~trusted, kind="stable")))
                first, second, owner = text_pairs(some.column("text"), figures.frequent)
                n_pairs, n_trusted = np.bincount(owner, minlength=some.num_rows), int(trusted.sum())
                key = pair_keys(first, second)
                order = np.argsort(key, kind="stable")
                key, who = key[order], owner[order]
                at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (who[1:] != who[:-1])))
                n = np.diff(at, append=len(key))
                key, who, order = key[at], who[at], order[at]
                heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                owners, first, second = np.diff(heads, append=len(key)), first[order[heads]], second[order[heads]]
                here, place = _known_here(figures, first, second, key[heads])
                # What every task knows is added up at once: words' own figures, and what known pairs add.
                added = here | _settled(figures, first, second)
                f, s, m, often = first[added], second[added], _runs(heads[added], owners[added]), owners[added]
                itself = np.where(f < RARE, value[np.where(f < RARE, f, 0).astype(np.int64)], 0) + np.where(s == END, value[int(END)], 0)
                sums = _sum_of(who[m], n[m] * np.repeat(_units(itself), often), some.num_rows)
                f, s, m, often = first[here].astype(np.int64), second[here].astype(np.int64), _runs(heads[here], owners[here]), owners[here]
                times, rest = figures.times[place[here]].astype(np.int64), (left[f] * lower[s]).astype("<f4")
                gain = figures.gain(np.repeat(times, often), (who[m] < n_trusted) * n[m], np.repeat(figures.of[0][f], often), np.repeat(rest, often))
                sums += _sum_of(who[m], n[m] * _units(gain), some.num_rows)
                there, out = np.flatnonzero(~added), []
                for shard, m in _by_shard(pair_shards(first[there], second[there], shards)):
                    m = there[m]
                    words, pairs, order = _spelt(first[m], second[m])
                    m = m[order]
                    mine = _runs(heads[m], owners[m])
                    step = np.diff(who[mine], prepend=0)
                    start = np.cumsum(owners[m]) - owners[m]
                    step[start] = who[mine[start]]
                    out.append((shard, base, pack_planes(words, pairs, owners[m].astype("<u4"), step.astype("<u4"), n[mine].astype("<u4"), np.array([n_trusted], "<u4"))))
                rows = _batch(out, ["part", "base", "data"])
                yield rows.append_column("about", pa.nulls(rows.num_rows, pa.list_(ABOUT)))
                about = pa.StructArray.from_arrays([some.column(c) for c in ("key", "lang", "trusted")] + [pa.array(n_pairs), pa.array(sums)], fields=list(ABOUT))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_home(base, shards)]), pa.array([base]), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(about)], pa.int32()), about)],
                    ["part", "base", "data", "about"],
                )

    return run


def _gains(figures: Figures, shards: int) -> Callable:
    value = figures.value(figures.of)

    def run(table: pa.Table) -> pa.Table:
        pairs, words, asked = (table.filter(pc.equal(table.column("kind"), kind)).drop_columns("kind") for kind in (PAIRS, WORDS, ASKED))
        if not len(asked):
            return asked
        own, of_own, replies = _own_words(words)
        keys, times, total, rest = _held_pairs(figures, shards, pairs, own, of_own, replies)
        own_value = figures.value(of_own)
        sums = []
        for data in asked.column("data").to_pylist():
            if data is None:
                sums.append(None)
                continue
            steps, pair, owners, who, n, trusted = unpack_planes(data, ("<u8", "<u8", "<u4", "<u4", "<u4", "<u4"))
            word, f, s = _places(steps, pair)
            start = np.cumsum(owners, dtype=np.int64) - owners
            who = np.cumsum(who, dtype=np.int64)
            who -= np.repeat(np.append(0, who[start[1:] - 1]), owners)
            # The first word is frequent, or this is its shard.
            rare = int(np.searchsorted(word, RARE))
            of_word = np.zeros(len(word), "<f4")
            of_word[:rare] = value[word[:rare].astype(np.int64)]
            if len(own):
                place = np.minimum(np.searchsorted(own, word[rare:]), len(own) - 1)
                of_word[rare:] = np.where(own[place] == word[rare:], own_value[place], 0)
            itself = of_word[f] + np.where(word[s] == END, value[int(END)], 0)
            key = pair_keys(word[f], word[s])
            place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            met = keys[place] == key if len(keys) else np.zeros(len(key), bool)
            n, units, some = n.astype(np.int64), np.repeat(_units(itself), owners), np.repeat(met, owners)
            place = np.repeat(place, owners)[some]
            # A trusted document is judged by what the others hold, as one that is not in the model would be.
            units[some] += _units(figures.gain(times[place], (who[some] < int(trusted[0])) * n[some], total[place], rest[place]))
            sum_of = _sum_of(who, n * units)
            owner = np.flatnonzero(sum_of)
            sums.append(pack_planes(np.diff(owner, prepend=0).astype("<u4"), sum_of[owner]))
        return asked.set_column(asked.schema.get_field_index("data"), "data", pa.array(sums, pa.binary()))

    return run


def _add_up(figures: Figures) -> Callable:
    unseen = float(np.log(figures.unseen))

    def run(table: pa.Table) -> pa.Table:
        about = next(x for x in table.column("about") if x.is_valid).values
        n = about.field("n").to_numpy()
        total = about.field("sum").to_numpy().copy()
        for data in table.column("data").to_pylist():
            if data is not None:
                step, units = unpack_planes(data, ("<u4", "<i8"))
                total[np.cumsum(step)] += units
        columns = {c: about.field(c) for c in ("key", "lang", "trusted")}
        return pa.table({**columns, "n_words": pa.array(n - 1), "surprise": pa.array(-unseen - total * UNIT / n)})

    return run


def score(docs: DataFrame, figures: Figures, known: DataFrame) -> DataFrame:
    """``key, lang, trusted, n_words, surprise`` of documents ``(key, lang, trusted, text)``.

    ``surprise`` is the mean negative logarithm of the probability of a text's words and its end; perplexity is its exponential.
    """
    shards = _shards(docs.sparkSession)
    rows = docs.select("key", "lang", "trusted", "text", F.monotonically_increasing_id().alias("row"))
    asked = rows.mapInArrow(_ask(figures, shards), ASKS)
    both = asked.withColumn("kind", F.lit(ASKED)).unionByName(known, allowMissingColumns=True)
    met = both.groupBy("part").applyInArrow(_gains(figures, shards), ASKS)
    return met.groupBy("base").applyInArrow(_add_up(figures), "key long, lang string, trusted boolean, n_words long, surprise double")
