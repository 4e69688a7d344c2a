"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model (``word_model``) is of word pairs and holds all words of the trusted text (Chen and Goodman, "An empirical study of smoothing
techniques for language modeling", 1999). Limits by language and length come from mergeable sketches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsluice.llm.common import checkpointed, if_small, text_or_empty
from logsluice.llm.word_model import score, train

#: Labelled rows that may be broadcast; more are joined by a shuffle.
LABELS_BROADCAST = 2_000_000


def surprise_sketch(scores: DataFrame) -> DataFrame:
    """Counts of trusted documents by language, length class and ``bucket``, a thousandth of their ``surprise``.

    Short texts vary more, so texts are classed by the number of binary digits of their length, up to ten.
    """
    trusted = scores.where("trusted and n_words > 0")
    return trusted.groupBy("lang", "class", F.floor(F.col("surprise") * 1000).alias("bucket")).agg(F.count("*").alias("n"))


def usual_limits(counts: DataFrame, by: list[str], spread: float, least: float) -> DataFrame:
    """The highest usual ``surprise`` of each group ``by`` and how many documents say so, from merged counts."""
    merged = counts.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by)  # buckets only, whose number is bounded
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "all": F.sum("n").over(group)})

    def quantile(share: float):
        return F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("bucket"))) / 1000

    quartiles = ranked.groupBy(*by).agg(quantile(0.25).alias("q1"), quantile(0.75).alias("q3"), F.max("all").alias("n"))
    reach = spread * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
    return quartiles.select(*by, (F.col("q3") + reach).alias("highest"), "n").where("n > 0")


def classify(
    docs: DataFrame, trusted_keys: DataFrame, spread: float = 3.0, least: float = 0.25, enough: int = 20,
    key: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """Judge every document by its perplexity: ``doc_id, lang, n_words, perplexity, highest, kept``.

    The model is trained on all documents whose key is in the first column of ``trusted_keys``; those are then judged without
    their own counts of pairs. ``kept``: the mean surprise is at most what is usual for trusted documents of the language and
    length class: the third quartile plus ``spread`` times the distance of the quartiles (or ``least``, if that is
    more). Classes with fewer than ``enough`` trusted documents take the quartiles of their language, languages with fewer those
    of the length class, and classes with fewer those of all; the sketches are merged for that.

    Texts without words (null ones too) have null perplexity and are not kept. Null languages are a group. A null key is never
    trusted; repeated rows count as often as they occur; without any trusted text nothing can be judged, and
    everything is kept with null perplexity. An empty table gives no rows; other columns are not looked at.
    """
    ids = trusted_keys.toDF("_trusted").where("_trusted is not null").distinct()
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(lang).cast("string").alias("lang"), text_or_empty(text).alias("text"))
    ids = checkpointed(ids)
    few = ids.limit(LABELS_BROADCAST + 1).count() <= LABELS_BROADCAST
    marked = rows.join(F.broadcast(ids) if few else ids, F.col("key") == F.col("_trusted"), "left")
    marked = marked.select("key", "lang", "text", F.col("_trusted").isNotNull().alias("trusted"))
    if not few:  # a task that is repeated must see its rows in the same order
        marked = marked.sortWithinPartitions("key", F.xxhash64("text", "lang"))
    model, counts = train(marked.where("trusted"))
    if model is None:
        return rows.select(
            F.col("key").alias(key), "lang", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
            *[F.lit(None).cast("double").alias(c) for c in ("perplexity", "highest")], F.lit(True).alias("kept"),
        )
    length_class = F.least(F.length(F.bin("n_words")), F.lit(10))
    scores = checkpointed(score(marked, model, counts).withColumn("class", length_class))
    counts = checkpointed(surprise_sketch(scores))
    of = {tuple(by): if_small(checkpointed(usual_limits(counts, by, spread, least))) for by in (["lang", "class"], ["lang"], ["class"], [])}
    judged = scores
    found = []
    for n, (by, limits) in enumerate(of.items()):
        named = limits.select(*[F.col(c).alias(f"_{c}{n}") for c in by], F.col("highest").alias(f"_h{n}"), F.col("n").alias(f"_n{n}"), F.lit(1).alias(f"_one{n}"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}{n}")) for c in by] or [F.lit(1) == F.col(f"_one{n}")]
        judged = judged.join(named, same, "left")
        found.append(F.col(f"_h{n}") if not by else F.when(F.col(f"_n{n}") >= enough, F.col(f"_h{n}")))
    judged = judged.withColumn("usual", F.coalesce(*found))
    words = F.col("n_words") > 0
    return judged.select(
        F.col("key").alias(key), "lang", "n_words", F.when(words, F.exp("surprise")).alias("perplexity"),
        F.exp("usual").alias("highest"), (words & (F.col("surprise") <= F.col("usual"))).alias("kept"),
    )
