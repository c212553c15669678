"""A table with the awkward rows every operator must take."""

from __future__ import annotations

from pyspark.sql import types as T

LONG_WORDS = 30_000
TEXTS = [
    (1, None),
    (2, ""),
    (3, "  \n\t "),
    (4, "one"),
    (5, "The same text, twice."),
    (6, "The same text, twice."),
    (7, "repeated row"),
    (7, "repeated row"),
    (None, "no identifier"),
    (None, None),
    (8, "Überall Ärger mit \x1c Zeichen \U0001f600 und ümläuten, 漢字 0 <|endoftext|> x."),
    (9, " ".join(f"w{k % 977}" for k in range(LONG_WORDS))),
    (10, "a" * 50_000),
]
SCHEMA = T.StructType(
    [
        T.StructField("Text", T.StringType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("_text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("words", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)


def rows():
    return [
        ("clash", i, -1, t, "clash", None if i == 4 else "en", "clash", "http://h.example/1")
        for i, t in TEXTS
    ]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
