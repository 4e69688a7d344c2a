"""Documents that operators must bear: nulls, empty and long texts, ties, repeated rows, names that clash."""

from pyspark.sql import types as T

CLASHING = ("size", "shard", "slot", "copy", "copies", "target", "quality", "fp", "id", "rest", "part", "row", "key", "_row", "_key", "words", "n")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHING],
    ]
)

PROSE = " ".join(f"word{i % 97} goes{i % 13} on{i % 7}" for i in range(60))
OTHER = " ".join(f"quite{i} different{i * 7 % 31} text{i % 5}" for i in range(50))
LONG = " ".join(f"long{i * i % 1009} one{i}" for i in range(30_000))

ROWS = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (2, OTHER, None, "b"),
    (3, None, "en", None),
    (4, "", None, None),
    (5, " \t\n\x0b\x0c\r ", "fr", "b"),
    (6, "one", "fr", "c"),
    (7, "one two", "fr", "c"),
    (8, LONG, "en", "a"),
    (9, "é" * 150 + " " + "é" * 150, "fr", "c"),
    (10, "ab" * 400, "en", "b"),
    (11, PROSE.upper(), "en", "a"),
    (12, OTHER + " " + PROSE, None, "d"),
    (None, OTHER, "en", "a"),
    (None, OTHER, "en", "a"),
    (None, "nothing known", None, None),
    (-5, PROSE + "\nReleased under the MIT License.", "en", "a"),
]


def odd(spark, rows=ROWS):
    extra = tuple(f"own {c}" for c in CLASHING)
    full = [(i, t, lang, source, len(t) if t else None, *extra) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
