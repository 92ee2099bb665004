"""Odd documents for every operator: nulls, empty and long texts, ties, repeated rows, clashing names."""

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. It was seen again.", "en", "s0"),
    (2, "The quick brown fox jumps over the lazy dog. It was seen again.", "en", "s0"),
    (2, "The quick brown fox jumps over the lazy dog. It was seen again.", "en", "s0"),
    (3, "", "de", "s1"), (4, None, None, None), (5, " \n\t ", "de", "s1"), (None, "no id here", "fr", None),
    (None, None, None, None), (6, LONG, "en", "s0"), (7, "x" * 50_000, "en", "s0"), (8, "one", "es", "s2"), (9, "Größe ñandú 世界 😀 \x00 e\u0301", "de", "s2"),
    (10, "a b c d e a b c d e a b c d e f", "en", "s0"), (10, "another text of the same id, of some words more than ten", "en", "s0"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def odd(spark):
    """The rows with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    extra = ("_q", "_kept", "_stats", "fp", "label", "row", "key", "bucket", "shard", "slot", "ids", "_keep_i", "_row_i")
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns({c: F.lit(c) for c in extra})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
