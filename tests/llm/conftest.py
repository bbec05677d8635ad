import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

BASE = " ".join(f"word{k}" for k in range(60))


def documents():
    """Nulls, empty and long texts, ties, repeated rows, exact and near copies, odd characters."""
    long = " ".join(f"w{k % 997}x{k % 13}" for k in range(30_000))
    texts = [
        (0, "Hello, world. the MIT License applies", "en", "a"), (1, None, "en", "a"), (2, "", "en", None), (3, "   \n\t ", "de", "b"),
        (4, BASE, "en", "b"), (5, BASE, "en", "c"), (6, BASE.replace("word30", "other"), "en", "c"), (7, BASE.upper(), "en", "a"), (8, BASE.replace("word5 ", "a ").replace("word40", "b"), "fr", "a"),
        (9, long, "en", "a"), (10, long + " tail", "en", None), (11, "one two three", "fr", "a"), (12, "one two three", None, "a"), (13, "one two three four", "fr", "zz"),
        (14, "été à l'école, où ça va 中文字 \x00 \u00a0 x", "fr", "é"), (15, "1234 5678 !!", "en", "a"), (16, "released under the terms of the expat or mit license", "en", "a"),
        (17, "Licensed under the Apache License, Version 2.0 general public license", "en", "a"), (17, "Licensed under the Apache License, Version 2.0 general public license", "en", "a"), (18, "<|endoftext|> a  b   c\n\n d", "en", "a"), (None, BASE, "en", "a"), (None, "nothing here", "en", None),
    ]
    more = [(100 + k, f"the cat {k % 5} sat on the mat and the dog ran away from the {k % 7} house " * (1 + k % 4), "en", f"s{k % 3}") for k in range(60)]
    more += [(200 + k, f"le chat {k % 5} est dans la maison avec le chien et les {k % 7} oiseaux " * (1 + k % 4), "fr", f"s{k % 3}") for k in range(60)]
    return [(*t, len(t[1] or "")) for t in texts + more]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns under names that operators use inside."""
    from pyspark.sql import functions as F

    more = ["size", "score", "node", "n", "root", "token", "row", "_row", "_key", "_size", "_hash", "salt", "rank", "length", "start", "train", "chosen", "_target", "u", "v"]
    return docs.select("*", *[F.lit("x").alias(c) for c in more])
