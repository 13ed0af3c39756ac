"""Small tables that hold the awkward cases."""

LONG = " ".join(f"long{i % 977}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "b"),
    (3, "The quick brown fox jumps over the lazy dog near the river bank today ok", "en", "a"),
    (3, "The quick brown fox jumps over the lazy dog near the river bank today ok", "en", "a"),
    (4, None, None, None),
    (5, "", "en", "b"),
    (6, " \t\n ", None, "b"),
    (7, "one two", "fr", None),
    (8, "ONE\ttwo", "fr", "c"),
    (9, LONG, "en", "c"),
    (10, LONG + " tail", "en", "é"),
    (None, "the quick brown fox jumps", "en", "a"),
    (11, "naïve café T̈est 𝔘nicode <|endoftext|> x́y a.b c., d.", "fr", "z"),
    (12, "!!! 123 ### 4.5", None, "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, rows=ROWS):
    """With columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("node", "size", "value", "segment", "place", "start", "part", "target", "score", "spans", "lang_pred"):
        df = df.withColumn(name, F.lit("clash"))
    return df
