"""Tables with everything that could trip an operator."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import types as T

CLASHING = ("score", "n", "node", "group", "words", "word", "label", "x", "shingle", "ids", "rid", "range",
            "shard", "size", "rejected_by", "overlaps", "held_out", "lang_pred", "piece_ids", "decoded")

LONG = "Der lange Text hat viele Wörter und hört nicht auf. " * 4000

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away into the deep dark forest at night "
        "while the moon shines over the quiet hills."),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "word"),
    (6, LONG),
    (7, "The quick brown fox jumps over the lazy dog and runs far away into the deep dark forest at night "
        "while the moon shines over the quiet hills."),
    (7, "The quick brown fox jumps over the lazy dog and runs far away into the deep dark forest at night "
        "while the moon shines over the quiet hills."),
    (None, "A text without an id is still a text of its own with some words in it."),
    (None, None),
    (8, "12345 67890 !!! ### $$$"),
    (9, "x" * 5000),
    (2**60 + 1, "Größe, Übung und Straße 你好 \U0001f600 \x00 end"),
    (2**60 + 3, "tie tie tie tie tie tie tie tie tie tie tie tie"),
]


def documents(spark, rows=TEXTS, clashing=True):
    """(doc_id, text, lang, source, n_chars) and columns with clashing names."""
    names = CLASHING if clashing else ()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType()),
                           *(T.StructField(c, T.StringType()) for c in names)])
    data = [(i, t, None if k % 5 == 0 else "en", None, None, *("?" for _ in names))
            for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, schema)


def empty(spark):
    return documents(spark, rows=[])


def plain(df) -> pd.DataFrame:
    return pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
