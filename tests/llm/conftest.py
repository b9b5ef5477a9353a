from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    + [T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType())]
)

LONG = " ".join(f"word{i % 977} von{i}" for i in range(20_000))
#: NULL in every column, empty and blank texts, ties, repeated rows, a very long text, a clashing column.
ODD = [
    (None, None, None, None, None, "x"),
    (1, "", "en", "b", 0, "x"),
    (2, " \n\t ", "en", None, 4, None),
    (3, None, None, "b", None, "x"),
    (4, "the same text with some words in it for all of them", "en", "b", 51, "x"),
    (4, "the same text with some words in it for all of them", "en", "b", 51, "x"),
    (5, "the same text with some words in it for all of them", "en", "a", 51, "x"),
    (6, LONG, "de", "a", len(LONG), "x"),
    (7, "a" * 50_000, "de", "a", 50_000, "x"),
    (8, "żółw 日本語 🙂 <|endoftext|> \x00 ­ end", "xx", "ż", 30, "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], DOCS)
