"""Rows that every operator must bear."""

from pyspark.sql import functions as F

TRICKY = [
    (1, "The same words again and again in one text"),
    (2, "the SAME words again and again in one text"),
    (3, None),
    (4, ""),
    (5, "é Ünïcödé 漢字 \U0001f600 ß İ Σίσυφος \x1c\x85 tab\tand\nlines"),
    (6, "word " * 30_000),
    (7, "The same words again and again in one text"),
    (7, "The same words again and again in one text"),
    (None, "no id at all, but some words of its own"),
    (None, None),
    (8, "<|endoftext|> is text, isn't it?  I'll say  so 123 4567"),
    (9, "."),
    (-5, "negative ids are ids too and this text has enough words"),
]


def tricky(spark, id_col="doc_id", text_col="text"):
    """TRICKY with columns whose names clash with inner and output names, in several partitions."""
    df = spark.createDataFrame(TRICKY, f"{id_col} long, {text_col} string").repartition(3)
    for name in ("_norm", "_h", "_part", "_mid", "rn", "kept", "score", "Slot", "start", "_rid", "class_id", "_words", "_text", "a.b", "n_tokens"):
        df = df.withColumn(name, F.lit("x"))
    return df.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
