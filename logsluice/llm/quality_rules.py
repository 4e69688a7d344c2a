"""Quality rules whose thresholds come from quantile sketches of each language and source.

Everything is built-in functions: the figures of a text are array expressions within its row, so no word is
shuffled; the sketches are counts by bucket, which Spark adds up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsluice.llm.common import WORD, bucket, checkpointed, if_small, let, text_or_empty

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: What counts as a figure: a whole number for each text, scaled so that buckets are fine enough.
FIGURES = {
    "symbols": "n_symbols * 10000 div greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines * 10000 div greatest(n_lines, 1)",
    "repeats": "n_repeat_words * 10000 div greatest(n_words, 1)",
    "stutter": "n_stutters * 10000 div greatest(n_words, 1)",
    "word_length": "word_chars * 1000 div greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Rule:
    """A figure must not be above its 90 % quantile by more than ``spread`` times that quantile's distance from the median, or
    times ``least`` where that is larger (most texts may have the same figure). ``low``: nor as far below the 10 % quantile."""

    figure: str
    spread: float
    least: int
    low: bool = False


RULES = (
    Rule("symbols", 3.0, 100),
    Rule("dup_lines", 3.0, 800),
    Rule("repeats", 3.0, 480),
    Rule("stutter", 3.0, 100),
    Rule("word_length", 3.0, 100, low=True),
)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words of a text that lie in a run of ``window`` words found at two or more places in it.

    Runs are compared by 64-bit hashes. Only texts whose hashes are not all distinct are looked at
    closely: hashes are sorted with their places, those equal to a neighbour kept, and each place in turn
    covers up to ``window`` words, less what the next one covers.
    """

    def hashes(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window))
        )

    def covered(places: Column) -> Column:
        ends = F.transform(
            places,
            lambda p, i: F.when(i + 1 < F.size(places), F.least(F.lit(window), F.get(places, i + 1) - p)).otherwise(
                F.lit(window)
            ),
        )
        return F.aggregate(ends, F.lit(0).cast("long"), lambda total, n: total + n)

    def places(sorted_pairs: Column) -> Column:
        def hash_at(i: Column) -> Column:
            return F.get(sorted_pairs, i)["h"]

        kept = F.filter(
            sorted_pairs,
            lambda x, i: (F.coalesce(hash_at(i + 1) == x["h"], F.lit(False)))
            | (F.coalesce(F.when(i > 0, hash_at(i - 1)) == x["h"], F.lit(False))),
        )
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def closely(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(let(pairs, places), covered)

    def from_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(closely(h))

    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(
        let(words, lambda w: let(hashes(w), from_hashes))
    )


def base_figures(text: str = "text") -> Column:
    """Of a text: numbers of words, of characters and symbols in them, of words that repeat the one
    before, of lines with a word, of such lines that repeat an earlier one, and of words in repeated
    windows. Null counts as empty."""
    whole = text_or_empty(text)
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def figures(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.size(F.filter(words, lambda x, i: (i > 0) & (F.get(words, i - 1) == x))).cast("long").alias("n_stutters"),
            let(lines, lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            )).alias("lines"),
            repeated_words(words).alias("n_repeat_words"),
        )

    return let(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), figures)


def sketches(figures: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts by language, source, figure and bucket, over all rows whose ``base_failed`` is false."""
    long = figures.where(~F.col("base_failed")).select(
        "lang", "source",
        F.explode(F.create_map(*[x for r in rules for x in (F.lit(r.figure), F.expr(FIGURES[r.figure]))])).alias("figure", "value"),
    )
    return long.groupBy("lang", "source", "figure", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``q10``, ``q50``, ``q90`` and ``n`` of each figure and ``keys``, from merged sketches."""
    merged = counts.groupBy(*keys, "figure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "figure")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    return ranked.groupBy(*keys, "figure").agg(
        *[F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("bucket"))).alias(f"q{q}") for q in (10, 50, 90)],
        F.max("all").alias("n"),
    )


def thresholds(counts: DataFrame, rules: tuple[Rule, ...] = RULES, enough: int = 200) -> DataFrame:
    """``lowest`` and ``highest`` allowed value by language, source and figure.

    A language's source with fewer than ``enough`` texts takes the quantiles of its language, and a
    language with fewer those of all texts; the sketches are merged for that.
    """
    own = quantiles(counts, ["lang", "source"])
    lang = quantiles(counts, ["lang"]).select(F.col("lang").alias("l"), F.col("figure").alias("f"), F.struct("q10", "q50", "q90", "n").alias("by_lang"))
    every = quantiles(counts, []).select(F.col("figure").alias("e"), F.struct("q10", "q50", "q90", "n").alias("by_all"))
    chosen = (
        own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("figure") == F.col("f")))
        .join(every, F.col("figure") == F.col("e"))
        .withColumn("q", F.when(F.col("n") >= enough, F.struct("q10", "q50", "q90", "n")).when(
            F.col("by_lang.n") >= enough, F.col("by_lang")).otherwise(F.col("by_all")))
    )
    limits = F.create_map(*[
        x for r in rules for x in (F.lit(r.figure), F.struct(
            F.lit(r.spread).alias("spread"), F.lit(r.least).alias("least"), F.lit(r.low).alias("low")))
    ])
    rule = F.element_at(limits, F.col("figure"))

    def reach(distance: Column) -> Column:
        return rule["spread"] * F.greatest(distance, rule["least"])

    return chosen.select(
        "lang", "source", "figure",
        F.when(rule["low"], F.col("q.q10") - reach(F.col("q.q50") - F.col("q.q10"))).otherwise(F.lit(-1.0)).alias("lowest"),
        (F.col("q.q90") + reach(F.col("q.q90") - F.col("q.q50"))).alias("highest"),
    )


def _judged(
    docs: DataFrame, rules: tuple[Rule, ...], enough: int, text: str, lang: str, source: str, carried: list[str]
) -> DataFrame:
    """Each row as a struct ``_row`` of the columns ``carried``, and its ``quality``."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row"), F.col(lang).cast("string").alias("lang"),
        F.col(source).cast("string").alias("source"), base_figures(text).alias("f"),
    )
    figures = checkpointed(
        rows.select("_row", "lang", "source", "f.n_words", "f.word_chars", "f.n_symbols", "f.n_stutters", "f.lines.*", "f.n_repeat_words")
        .withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
    )
    limits = thresholds(checkpointed(sketches(figures, rules)), rules, enough)
    by_group = if_small(checkpointed(
        limits.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(
            F.map_from_entries(F.collect_list(F.struct("figure", F.struct("lowest", "highest")))).alias("limits"))
    ))
    within = F.lit(True)
    for r in rules:
        limit, value = F.element_at("limits", F.lit(r.figure)), F.expr(FIGURES[r.figure])
        within &= (value >= limit["lowest"]) & (value <= limit["highest"])
    numbers = ["n_words", "word_chars", "n_symbols", "n_stutters", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = figures.join(
        by_group, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left"
    )
    kept = (~F.col("base_failed") & F.coalesce(within, F.lit(True))).alias("kept")
    return judged.select("_row", F.struct(*numbers, kept).alias("quality"))


def quality_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, enough: int = 200,
    text: str = "text", lang: str = "lang", source: str = "source", carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """Judge every text: adds a struct ``quality`` with the figures, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 20 words, or over 30 % of them in repeated windows of eight. ``kept``:
    not so, and every figure within the thresholds of its language and source, which adapt to what
    is usual there (see ``Rule``). The thresholds come from all texts that did not fail the base.

    Null texts count as empty and fail the base; null languages and sources are groups like others;
    repeated rows count as often as they occur and get equal verdicts. An empty table gives no rows. The columns in ``carry`` (all
    by default) are kept; an old ``quality`` is replaced. Rows are checkpointed once with their figures, so texts are read once.
    """
    carried = [c for c in carry or docs.columns if c != "quality"]
    return _judged(docs, rules, enough, text, lang, source, carried).select("_row.*", "quality")


def keep_good(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, enough: int = 200,
    text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns."""
    judged = _judged(docs, rules, enough, text, lang, source, docs.columns)
    return judged.where("quality.kept").select("_row.*")
