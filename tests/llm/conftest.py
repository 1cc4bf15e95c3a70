from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        T.StructField("k", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("score", T.MapType(T.StringType(), T.StringType())),
    ]
)


def doc_row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", None if text is None else len(text), "k", None, "line", {"a": "b"})


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang]) with columns whose names clash with the operators' own."""
    return lambda rows: spark.createDataFrame([doc_row(*r) for r in rows], DOCS)


LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white texts, a very long text, ties and repeated rows."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards brew potions"
    return [
        (1, base),
        (2, base),
        (2, base),
        (3, None),
        (4, ""),
        (5, " \n\t \n"),
        (6, LONG),
        (7, LONG + " tail"),
        (None, base + " again"),
        (8, "ÀÉ ñandú 東京 \U0001f600 x"),
        (9, "%%% !!! 123", None),
        (10, "the quick brown fox jumps over the lazy dog while seven wizards brew potion", None),
        (-5, "a"),
    ]
