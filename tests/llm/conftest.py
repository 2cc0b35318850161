from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or from (doc_id, text) or (doc_id, text, source)."""

    def made(rows, schema=DOCUMENTS):
        full = []
        for i, row in enumerate(rows):
            doc_id, text, source = (i, row, "a") if row is None or isinstance(row, str) else (*row, "a")[:3]
            full.append((doc_id, text, "en", source, None if text is None else len(text)))
        return spark.createDataFrame(full, schema)

    return made


@pytest.fixture(scope="session")
def hard(make):
    """Nulls in every column, empty, repeated and very long rows, and columns of clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (0, "one two three four five six"), (1, None), (2, ""), (3, " \n\t"), (None, "no id here"),
        (5, "one two three four five six"), (5, "one two three four five six"), (7, "x" * 70_000),
        (8, long), (9, long + " end"), (10, "\N{GRINNING FACE} é 漢字 \x0b\x0c", None),
    ]
    clashing = [
        "row", "score", "fp", "hash", "chunks", "kept", "size", "target", "held_out", "u", "y", "node",
        "_document", "start", "block", "ids", "d", "word", "c", "recipe", "next", "ended",
    ]
    df = make(rows)
    for name in clashing:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(make):
    return make([])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

