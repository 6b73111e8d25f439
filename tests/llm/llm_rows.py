"""Rows the tests of this folder share."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

def prose(seed, n):
    import random

    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefgh") for _ in range(5)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, "no id here at all"), (5, "same text twice over"), (5, "same text twice over")]
