"""Mix sources to target weights by repeating documents, natively."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import checkpointed, if_small, n_words, running_totals


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Targets for ``(source, source_size)`` rows: adds ``target``.

    Sources, by code point with null last, get ``weights`` in turn, again and again. All sizes together are shared out
    by weight; a target stops at ``cap`` times its source's size, and the excess is shared again by
    weight among the others until none is above. That is the level at which
    ``sum(least(cap * size, level * weight))`` meets the total: with sources sorted by
    ``cap * size / weight`` those that stop come first, so running totals find the level at once.
    Expects ``cap`` >= 1, else all targets stop below the total.
    """
    ranked = running_totals(
        sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], ["source_size"], "_rank"
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    limits = (
        ranked.withColumn("_weight", weight)
        .withColumn("_limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_ratio", F.col("_limit") / F.col("_weight"))
        .select("source", "source_size", "_rank", "_weight", "_limit", "_ratio")
    )
    total, weight_sum = limits.agg(F.sum("source_size").cast("double"), F.sum("_weight")).first()
    if not total:
        return limits.select("source", "source_size", F.lit(0.0).alias("target"))
    levels = checkpointed(
        running_totals(limits, ["_ratio", "_rank"], ["_limit", "_weight"]).withColumn(
            "_level", (F.lit(total) - F.col("_limit_before")) / (F.lit(weight_sum) - F.col("_weight_before"))
        ).withColumn("_stops", F.col("_weight") * F.col("_level") >= F.col("_limit"))
    )
    level = levels.where(~F.col("_stops")).agg(F.min_by("_level", "_index")).first()[0]
    share = F.col("_limit") if level is None else F.when(F.col("_stops"), F.col("_limit")).otherwise(
        F.col("_weight") * F.lit(level)
    )
    return levels.select("source", "source_size", share.alias("target"))


def _planned(docs: DataFrame, weights: Sequence[float], cap: float, seed: int, key: str, text: str, source: str) -> DataFrame:
    """Each row as a struct ``_row``, with ``size, source_size, target, copies``."""
    rows = docs.select(
        F.struct("*").alias("_row"), F.col(source).alias("_source"), F.col(key).alias("_key"), n_words(text).alias("size")
    )
    sizes = checkpointed(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size")))
    targets = if_small(checkpointed(source_targets(sizes, weights, cap)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    hashed = F.md5(F.concat(F.lit(f"mix-{seed}-"), F.coalesce(F.col("_key").cast("string"), F.lit("null"))))
    unit = F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    copies = F.floor("_rate") + (unit < F.col("_rate") - F.floor("_rate")).cast("long")
    return (
        rows.join(targets, F.col("_source").eqNullSafe(F.col("source")), "left")
        .withColumn("_rate", rate)
        .select("_row", "size", "source_size", "target", copies.cast("long").alias("copies"))
    )


def mixing_plan(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: int = 0,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """How often the mix takes each document: adds ``size``, ``source_size``, ``target`` and ``copies``.

    Sizes are words. A source's rate is its target over its size. A document is taken floor(rate)
    times, and once more if a number in [0, 1) hashed from ``seed`` and its key is below the rest
    of the rate; so the same call always gives the same mix, and no document is taken more than ``cap``
    times. A source without any word is kept as it is (rate 1).

    Null texts have size 0; null is a source like others; documents with equal keys share their number, and
    so do all with a null key. An empty table gives no rows. Other columns are kept; old ones
    of the four names are replaced.
    """
    plain = docs.drop("size", "source_size", "target", "copies")
    return _planned(plain, weights, cap, seed, key, text, source).select("_row.*", "size", "source_size", "target", "copies")


def mix(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: int = 0,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The mixed corpus: each document as often as ``mixing_plan`` says, numbered by ``copy`` from 0.

    Columns are those of ``docs`` and ``copy`` (an old one is replaced); odd rows are handled as in ``mixing_plan``.
    """
    plan = _planned(docs.drop("copy"), weights, cap, seed, key, text, source).where("copies > 0")
    number = F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1))
    return plan.select("_row", number.alias("copy")).select("_row.*", "copy")
