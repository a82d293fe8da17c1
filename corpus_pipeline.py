"""From raw documents to token files: toxicity, near-duplicates, contamination, mixing, tokens.

Every stage takes (spark, docs, folder) and returns a DataFrame; it is written as Parquet in the shared
folder and read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import decontaminate, mixing, nearcopies, tokens, toxicity
from emberline.sources.scratch import stage
from emberline.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier trained on the labels doesn't reject."""
    return toxicity.drop_toxic(docs, table(spark, folder, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group whose five-word shingle sets have a similarity of 0.8 or more."""
    return nearcopies.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of which less than one word in twenty is in a passage of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token files of the mix, read back: place, number and checksum of each document's ids."""
    return tokens.tokenize_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: SimHash fingerprints, the classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, folder), f"pipeline-{name}")
    return docs
