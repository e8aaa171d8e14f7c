from __future__ import annotations

import pytest

CLASHING = "record string, key string, data string, size string, kept string, score string, base string, spans string, bucket string, pos string, sequence_id string, `a b` string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def rows(texts):
    return [(k, t, None, None, None, *["x"] * 12) for k, t in texts]


@pytest.fixture(scope="session")
def edge_texts():
    long_ = " ".join(f"word{k % 997} {k}" for k in range(12_000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "The same text, given twice."), (5, "The same text, given twice."),
        (6, "The same text, given twice."), (None, "no id at all"), (7, long_), (8, "é😀 日本語 ñ\x00\x1c\x85 end"), (9, "a@b.com +1 (212) 555-0100 10.0.0.1 4111 1111 1111 1111"),
        (10, "1234 !!!! ????"), (11, "x" * 50_000), (None, None),
    ]


@pytest.fixture(scope="session")
def edges(spark, edge_texts):
    """Nulls, empty and very long texts, ties, repeated rows and clashing column names."""
    return spark.createDataFrame(rows(edge_texts), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
