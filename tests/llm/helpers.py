"""Small tables with the odd cases that every operator must take."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # clash with names that operators use
        T.StructField("score", T.StringType()),
        T.StructField("row", T.LongType()),
        T.StructField("shard", T.LongType()),
    ]
)


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)"""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1]) if r[1] is not None else None, "x", 1, 2) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def odd_rows():
    long_text = " ".join(f"word{i % 997} and{i % 31}" for i in range(30_000))
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, long_text),
        (5, long_text.upper()),
        (6, "Same text here, twice"),
        (7, "same TEXT here, twice"),
        (8, "é È ß combining é H̱ <|endoftext|> don't"),
        (8, "é È ß combining é H̱ <|endoftext|> don't"),
        (9, "one"),
        (None, "no id, some text"),
        (None, None),
        (10, "12345 !!! ..."),
    ]
