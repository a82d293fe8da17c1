import random

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty texts, ties, copies and one long text."""
    draw = random.Random(4)
    passage = "".join(draw.choice("abcdé ") for _ in range(700))
    texts = [
        None, "", " ", "a", "A", "a b", "a  B\n", "a b c", "a b c", "x " * 9000, "the same line\nthe same line\n\nthe same line",
        passage, passage, "start " + passage[50:600] + " middle " + passage[100:], "日本 語 ß", "a" * 1000, "3 4.5.6.7 a@b.co +1 234 567 8901",
    ]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "a b c"), (3, "a")]


@pytest.fixture
def table(spark):
    """A table of (doc_id, text) with columns whose names clash with results and helpers."""

    def make(rows, parts=3):
        wide = [(*r, 7, "s", 1.5, "k") for r in rows]
        schema = "doc_id bigint, text string, n_words int, size string, score double, key string"
        return spark.createDataFrame(wide, schema).repartition(parts)

    return make


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string")
