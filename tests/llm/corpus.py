"""Small tables for the corpus tests."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

#: Columns whose names operators use inside; they must not matter.
CLASHING = ("node", "digest", "tokens", "score", "kept", "start", "digests", "_key", "grp", "x0", "count",
            "_id", "_source", "_end", "_kept", "_row", "row", "spans", "_domain", "_language", "_whole", "hub")

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards box in a quiet garden at dawn"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    texts = [
        (1, PROSE, "en", "src1"),
        (2, PROSE, "en", "src1"),
        (3, None, "en", "src2"),
        (4, "", "de", "src2"),
        (5, " \n\t ", None, "src2"),
        (6, "word", "en", None),
        (7, words(7, 60_000), "fr", "src3"),
        (8, words(8, 120), None, None),
        (8, words(8, 120), None, None),
        (9, "x" * 300_000, "en", "src1"),
        (10, "été à l'école \U0001f600 " * 40, "fr", "src4"),
        (11, "mail bob@example.com now", "en", "src5"),
        (None, words(12, 80), "en", "src1"),
        (None, None, None, None),
    ]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in texts]


def odd_documents(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.withColumns({name: F.lit("clash") for name in CLASHING})


def empty_documents(spark):
    return odd_documents(spark).limit(0)


def documents(spark, texts: dict[int, str], lang: str = "en", source: str = "src1"):
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
