"""Near-duplicates by SimHash: fingerprints, exact pairs from a vantage-point tree over shards, components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsluice.llm.arrow import text_bytes, text_slices
from logsluice.llm.common import checkpointed, shuffle_partitions, text_or_empty
from logsluice.llm.components import components
from logsluice.llm.xxh64 import xxh64

#: Fingerprints, about, that the tree of shards is fitted on (at least, at most), those meant to live in a shard, and the fewest of the
#: sample there. The sample grows with the table up to two million, 16 MB.
SAMPLE = 20_000
MOST_SAMPLED = 2_000_000
SHARD = 4_096
LEAST_IN_SAMPLE = 32
#: Shards are searched by trees of their own down to so many fingerprints, which are compared with each other.
LEAF = 512
CANDIDATES = 8

_LUT = np.arange(256, dtype=np.uint8)
_LUT[65:91] += 32
_LUT[[9, 10, 11, 12, 13, 32]] = 32


# -- fingerprints


def _shingles(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with single spaces between words, and of each shingle its start, length and text."""
    data = _LUT[data]
    word = data != 32
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    first = first[:-1]
    before = np.concatenate([[False], word[:-1]])
    begins = word & (~before | first)
    ends = word & np.concatenate([~word[1:] | first[1:], [True]]) if len(word) else word
    kept = word | (before & ~word)
    place = np.cumsum(kept, dtype=np.int64) - 1
    where = np.flatnonzero(begins)
    start, end = place[where], place[np.flatnonzero(ends)] + 1
    of_text = np.searchsorted(where, at)
    words = np.diff(of_text)
    text = np.repeat(np.arange(len(words)), words)
    index = np.arange(len(where))
    nth = index - of_text[text]
    opens = (nth + n <= words[text]) | (nth == 0)
    index, text = index[opens], text[opens]
    last = np.minimum(index + n, of_text[text + 1]) - 1
    return data[kept], start[index], end[last] - start[index], text


def fingerprints_of(texts: pa.Array, shingle: int, seed: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints; 0 for texts without words."""
    data, at = text_bytes(texts)
    out = np.zeros(len(texts), np.uint64)
    if not len(data):
        return out
    compact, start, length, text = _shingles(data, at, shingle)
    votes = np.zeros((len(texts), 64), np.int64)
    step = 1 << 17
    for i in range(0, len(start), step):
        hashes = xxh64(compact, start[i : i + step], length[i : i + step], seed)
        owner = text[i : i + step]
        runs = np.flatnonzero(np.diff(owner, prepend=-1))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes[owner[runs]] += np.add.reduceat(bits, runs, axis=0, dtype=np.int32)
    n = np.bincount(text, minlength=len(texts))
    chosen = votes * 2 > n[:, None]
    return np.packbits(chosen, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprints(
    docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """``keys`` and ``fp``, the SimHash of each whole text as a (signed) 64-bit number.

    A to Z are lower-cased; words are divided by ASCII white space; features are XXH64 of runs of ``shingle``
    words, repeats included (of all words where there are fewer). A bit is 1 if it is set in over half of them.
    Null texts and texts without words have 0.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keys).dtypes) + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, "__text", 2 << 20):
                fp = fingerprints_of(some.column("__text"), shingle, seed)
                columns = [some.column(c) for c in keys] + [pa.array(fp.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "fp"])

    return docs.select(*keys, text_or_empty(text).alias("__text")).mapInArrow(run, schema)


# -- the tree


@dataclass
class Node:
    """Fingerprints nearer than ``radius`` to ``vantage`` are left, the others right. A shard's node has its number only."""

    vantage: np.uint64 = np.uint64(0)
    radius: int = 0
    left: Node | None = None
    right: Node | None = None
    shard: int = -1


def _split(points: np.ndarray, reach: int) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that halve the points and leave few within ``reach`` of the border."""
    best = None
    for vantage in points[:: max(1, len(points) // CANDIDATES)][:CANDIDATES]:
        distance = np.bitwise_count(points ^ vantage)
        upto = np.cumsum(np.bincount(distance, minlength=65 + reach))
        for radius in np.unique(np.quantile(distance, [0.4, 0.5, 0.6], method="lower")).astype(int) + 1:
            left = upto[radius - 1]
            if 0 < left < len(points):
                near = left - (upto[radius - reach - 1] if radius > reach else 0)
                cost = near + abs(2 * left - len(points))
                if best is None or cost < best[0]:
                    best = (cost, vantage, radius)
    return best and best[1:]


def build_tree(sample: np.ndarray, n: int, reach: int) -> Node:
    """A tree whose shards hold about ``SHARD`` of ``n`` fingerprints, as far as the sample can tell."""
    shards = 0

    def grow(points: np.ndarray) -> Node:
        nonlocal shards
        share = n * len(points) / max(1, len(sample))
        found = _split(points, reach) if share > SHARD and len(points) >= 2 * LEAST_IN_SAMPLE else None
        if found is None:
            shards += 1
            return Node(shard=shards - 1)
        near = np.bitwise_count(points ^ found[0]) < found[1]
        return Node(found[0], found[1], grow(points[near]), grow(points[~near]))

    return grow(sample)


def _sides(points: np.ndarray, home: np.ndarray, vantage: np.uint64, radius: int, reach: int):
    """Which points look left and right, and which of them live there.

    Two points within ``reach`` of each other differ by at most that in their distance to the vantage point. So
    a guest looks wherever that bound allows. Of a pair that lives on both sides, the left one
    visits the right; that is enough.
    """
    distance = np.bitwise_count(points ^ vantage).astype(np.int64)
    inside = distance < radius
    left = np.where(home, inside, distance - reach < radius)
    right = distance + reach >= radius
    return left, home & inside, right, home & ~inside


def visits(tree: Node, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each shard that some of the points live in or visit, which they are, and whether they live there."""
    waiting = [(tree, np.arange(len(points)), np.ones(len(points), bool))]
    while waiting:
        node, index, home = waiting.pop()
        if not len(index):
            continue
        if node.left is None:
            yield node.shard, index, home
            continue
        left, lives_left, right, lives_right = _sides(points[index], home, node.vantage, node.radius, reach)
        waiting.append((node.left, index[left], lives_left[left]))
        waiting.append((node.right, index[right], lives_right[right]))


def shard_links(points: np.ndarray, home: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join all points of a shard within ``reach`` of a point living there, and no others.

    Not every pair is given: within what is compared at a time, each point is linked to the least that it
    reaches, so the number of links is at most that of the points.
    """
    if not home.any() or len(points) < 2:
        return
    if home.sum() > LEAF:
        found = _split(points[home], reach)
        if found is not None:
            left, lives_left, right, lives_right = _sides(points, home, *found, reach)
            if left.sum() < len(points) or right.sum() < len(points):
                yield from shard_links(points[left], lives_left[left], reach)
                yield from shard_links(points[right], lives_right[right], reach)
                return
    living = np.flatnonzero(home)
    for i in range(0, len(living), LEAF):
        some = points[living[i : i + LEAF]]
        for j in range(0, len(points), 4 * LEAF):
            others = points[j : j + 4 * LEAF]
            a, b = np.nonzero(np.bitwise_count(others[:, None] ^ some[None, :]) <= reach)
            differ = others[a] != some[b]
            a, b = a[differ], b[differ] + len(others)
            if len(a):
                both = np.concatenate([others, some])
                label = np.arange(len(both))
                while True:
                    new = label.copy()
                    least = np.minimum(label[a], label[b])
                    np.minimum.at(new, a, least)
                    np.minimum.at(new, b, least)
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                moved = np.flatnonzero(both != both[label])
                yield both[moved], both[label[moved]]


def fingerprint_links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``(u, v)`` that connect exactly the distinct fingerprints ``fp`` connected at ``max_bits`` or fewer.

    ``distinct`` should be checkpointed. A bounded sample of it shapes the tree, whose leaves are the
    shards; every fingerprint lives in one and visits those in which its neighbours may live.
    """
    n = distinct.count()
    # Hashes choose a share of about that size, whatever the number of partitions.
    size = min(max(SAMPLE, 2 * LEAST_IN_SAMPLE * n // SHARD), MOST_SAMPLED)
    chosen = F.pmod(F.xxhash64("fp"), F.lit(1 << 31)) < int(min(1.0, size / max(1, n)) * (1 << 31))
    sample = np.sort(distinct.where(chosen).select("fp").toPandas()["fp"].to_numpy(np.int64))
    tree = build_tree(np.random.default_rng(0).permutation(sample).view(np.uint64), n, max_bits)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, index, home in visits(tree, points, max_bits):
                yield pa.RecordBatch.from_pydict(
                    {"shard": np.full(len(index), shard), "fp": points[index].view(np.int64), "home": home}
                )

    def compare(table: pa.Table) -> pa.Table:
        points = table.column("fp").to_numpy().view(np.uint64)
        found = list(shard_links(points, table.column("home").to_numpy(), max_bits))
        u, v = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (zip(*found) if found else ((), ())))
        return pa.table({"u": u, "v": v})

    placed = distinct.select("fp").mapInArrow(assign, "shard long, fp long, home boolean")
    return placed.groupBy("shard").applyInArrow(compare, "u long, v long")


# -- groups


def simhash_groups(
    docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """``keys``, ``fp`` and ``component``: the smallest ``keys`` (as a struct) of all documents within reach.

    Texts with equal fingerprints are one node, whatever their number; nodes link at ``max_bits``
    or fewer differing bits. No group of documents is gathered: only distinct fingerprints are compared. Null keys count as smallest
    only if no key is set; repeated rows share their group; an empty table gives no rows. Null and empty texts have fingerprint zero and
    are a group; a very long text is read whole, in slices. Columns other than ``keys`` and ``text`` are not looked at; keys must not be called
    ``fp``, ``component`` or begin with ``_pa``.
    """
    marked = checkpointed(fingerprints(docs, keys, text, shingle))
    key = F.when(F.col(keys[0]).isNotNull(), F.struct(*keys))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n")))
    roots = components(fingerprint_links(distinct, max_bits))
    linked = checkpointed(roots.join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "first"))
    lowest = linked.groupBy("root").agg(F.min("first").alias("lowest"))
    of_linked = linked.join(lowest, "root").select("fp", "lowest")
    component = distinct.join(of_linked, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component"))
    # A fingerprint of more documents than a task's share is dealt to as many tasks as it has shares; there are at most as many such as tasks.
    share = max(1, distinct.agg(F.sum("n")).first()[0] or 0) // shuffle_partitions(docs.sparkSession) + 1
    hot = F.broadcast(distinct.where(F.col("n") > share).select("fp", F.ceil(F.col("n") / share).alias("_parts")))
    part = F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1)))
    dealt = marked.join(hot, "fp", "left").withColumn("_part", part).drop("_parts")
    each = component.join(hot, "fp", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1)))
    return dealt.join(each.drop("_parts"), ["fp", "_part"]).drop("_part")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each group the one with the smallest key stays.

    Of rows with the same key and text one stays. Rows with a null key stay only where no other
    of their group has one; which of them, the hash of the text decides.
    """
    hashed = docs.select(F.col(key).alias("_key"), F.xxhash64(text_or_empty(text)).alias("_hash"), F.col(text).alias("_text"))
    groups = simhash_groups(hashed, ("_key", "_hash"), "_text", **options)
    keyed = groups.where("component is not null").select(F.col("component._key").alias("k"), F.col("component._hash").alias("h"))
    bare = groups.where("component is null").groupBy("fp").agg(F.min("_hash").alias("h")).select(F.lit(None).cast(keyed.schema["k"].dataType).alias("k"), "h")
    stay = keyed.union(bare).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.xxhash64(text_or_empty(text)).alias("_hash"))
    met = rows.join(stay, F.col("_key").eqNullSafe(F.col("k")) & (F.col("_hash") == F.col("h")))
    nth = F.row_number().over(Window.partitionBy("k", "h").orderBy(F.xxhash64("_row")))
    return met.withColumn("_nth", nth).where("_nth = 1").select("_row.*")
