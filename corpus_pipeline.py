"""From raw documents to packed training sequences, stage by stage.

Every stage takes all rows of the one before, whatever their texts: null and empty ones, very long ones and repeated rows; an empty
table goes through as one. What becomes of such rows is said at each stage. Null keys, languages and sources are groups like
others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logsluice.llm.common import table
from logsluice.llm.mixing import mix
from logsluice.llm.packing import pack
from logsluice.llm.quality_rules import keep_good
from logsluice.llm.repeats import without_repeats
from logsluice.llm.simhash import one_of_each
from logsluice.session import scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. Null, empty and other texts of under 20 words go; repeated rows share their verdict."""
    return keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates by SimHash, the document with the smallest id.

    Of repeated rows one stays. Texts without words, null ones too, are near-duplicates of each other. A null id stays only where its group has no other.
    """
    return one_of_each(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents less every string of 100 bytes that also begins earlier; ``n_chars`` counts what is left.

    Null texts become empty, and a text all of which is repeated does, too; their rows stay.
    """
    return without_repeats(docs, size="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as its source's target asks for: not at all, once or up to three times. Texts without words count nothing
    towards a target and are taken as often as others of their source."""
    return mix(docs).drop("copy")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's words lie in sequences of equal length. Documents without words get one row without a
    sequence; longer ones than a sequence are cut and go on in others."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Fingerprints, repeated bytes and bins have no SQL form here; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
