"""Document fingerprints by one-permutation MinHash, natively.

The hashes of a text's word shingles are dealt into bins by their leading bits, and a bin keeps the low bits of its
least hash. A bin without a hash borrows from another: it looks at bins in an order of its own, which depends on
nothing but its number, and takes the first that has one. So two texts borrow alike where their empty bins are alike,
and the share of equal bins stays an unbiased measure of likeness (optimal densification).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import WORD, let

#: Bins of a fingerprint and bits kept of each: a hexadecimal digit a bin.
BINS = 256
BITS = 4
#: Looks at single bins before all that hold a hash are ranked.
LOOKS = 8

_POSITIVE = (1 << 63) - 1
_LOW = (1 << BITS) - 1
_BIN_SHIFT = 63 - (BINS.bit_length() - 1)
#: Stands for a word that a short text does not have; words have numbers of 31 bits.
NO_WORD = 1 << 31


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _hash(value: Column) -> Column:
    return F.xxhash64(value).bitwiseAND(_long(_POSITIVE))


def _bin(h: Column) -> Column:
    return F.shiftright(h, _BIN_SHIFT).cast("int")


def _digit(h: Column) -> Column:
    return F.substring(F.lit("0123456789ABCDEF"), h.bitwiseAND(_long(_LOW)).cast("int") + 1, F.lit(1))


def factors(words: int) -> list[int]:
    """Odd numbers of 29 bits, one for each place in a shingle; a sum of their products with words' numbers fits 63 bits."""
    if not 1 <= words <= 7:
        raise ValueError("a shingle has one to seven words")
    return [pow(48271, k + 9, 1 << 29) | 1 for k in range(words)]


def shingle_hashes(text: Column, words: int = 5) -> Column:
    """A hash of 63 bits of each run of ``words`` words; of all words, if there are fewer; none without a word.

    A word's number is made of 31 bits of its CRC-32, a shingle's of the products of these with fixed factors; the XXH64 of
    that is its hash.
    """

    def hashes(sums: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(sums) - words, F.lit(0)))
        return F.transform(places, lambda i: _hash(reduce(
            lambda a, b: a + b, [F.coalesce(F.get(sums, i + k), _long(NO_WORD)) * _long(by) for k, by in enumerate(factors(words))]
        )))

    sums = F.transform(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.crc32(w).bitwiseAND(_long(NO_WORD - 1))
    )
    return let(sums, lambda s: F.when(F.size(s) == 0, F.array().cast("array<bigint>")).otherwise(hashes(s)))


def _least(hashes: Column) -> Column:
    """The least hash of each bin that has one, by bin."""
    return let(
        F.sort_array(hashes),
        lambda s: F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1)))),
    )


def _digits(least: Column) -> Column:
    """A digit for each bin, null where it is empty."""
    none = F.lit(None).cast("string")

    def with_gap(h: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(_bin(F.get(least, i - 1)))
        return F.concat(F.array_repeat(none, _bin(h) - before - 1), F.array(_digit(h)))

    tail = F.array_repeat(none, F.lit(BINS - 1) - _bin(F.get(least, F.size(least) - 1)))
    return F.flatten(F.concat(F.transform(least, with_gap), F.array(tail)))


def _filled(least: Column, digits: Column) -> Column:
    """The digits on end, with those of empty bins borrowed."""

    def look(i: Column, k: int) -> Column:
        return F.get(digits, _hash(i * LOOKS + k).bitwiseAND(_long(BINS - 1)).cast("int"))

    def first_by_rank(i: Column) -> Column:
        ranked = F.transform(
            least, lambda h: _hash(i * BINS + _bin(h)).bitwiseAND(_long(_POSITIVE - _LOW)).bitwiseOR(h.bitwiseAND(_long(_LOW)))
        )
        return _digit(F.array_min(ranked))

    bins = F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long"))
    return F.array_join(
        F.transform(
            bins,
            lambda i: F.coalesce(F.get(digits, i.cast("int")), *[look(i, k) for k in range(LOOKS)], first_by_rank(i)),
        ),
        "",
    )


def fingerprint(text: Column, words: int = 5) -> Column:
    """The fingerprint of a text: ``BINS`` times ``BITS`` bits, packed as binary.

    Null and empty texts, and those of white space alone, give zeros. Equal texts give equal fingerprints.
    """
    digits = let(
        shingle_hashes(F.coalesce(text.cast("string"), F.lit("")), words),
        lambda h: F.when(F.size(h) == 0, F.lit("0" * BINS)).otherwise(
            let(_least(h), lambda m: let(_digits(m), lambda d: _filled(m, d)))
        ),
    )
    return F.unhex(digits)


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard similarity of the shingles of two texts, from their fingerprints.

    Bins that differ agree in ``BITS`` bits by chance once in ``2 ** BITS``; the share of equal bins is corrected for
    that. Two texts without words are alike (1), and neither is like any other (0).
    """

    def differing(k: int) -> Column:
        def word(x: Column) -> Column:
            return F.conv(F.hex(F.substring(x, 8 * k + 1, 8)), 16, -10).cast("long")

        def marked(x: Column) -> Column:
            any_bit = x
            for shift in range(1, BITS):
                any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, shift))
            return F.bit_count(any_bit.bitwiseAND(_long(0x1111111111111111))).cast("int")

        return let(word(a).bitwiseXOR(word(b)), marked)

    zeros = F.unhex(F.lit("0" * BINS))
    different = differing(0)
    for k in range(1, BINS * BITS // 64):
        different = different + differing(k)
    by_chance = 1 / (1 << BITS)
    share = F.lit(float(BINS)) - different.cast("double")
    corrected = F.greatest(F.lit(0.0), (share - F.lit(BINS * by_chance)) / F.lit(BINS * (1 - by_chance)))
    return F.when(a == b, F.lit(1.0)).when((a == zeros) | (b == zeros), F.lit(0.0)).otherwise(corrected)


def fingerprints(docs: DataFrame, text: str = "text", words: int = 5) -> DataFrame:
    """All rows with their ``fingerprint``; an old column of that name is replaced.

    A row is handled by itself, in the stage that reads it: no shuffle, and nothing kept between rows. Null texts
    count as empty, repeated rows get the same fingerprint, an empty table gives no rows, and other columns are kept
    whatever their names. A very long text takes memory for eight bytes a shingle.
    """
    return docs.withColumn("fingerprint", fingerprint(F.col(f"`{text}`"), words))
