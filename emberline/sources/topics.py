"""Topics, search phrases and candidate ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TOPIC_JSON = """
    topid STRING, num STRING, query STRING, title STRING,
    description STRING, narrative STRING, tokens ARRAY<STRING>
"""
TOPIC_SCHEMA = "topic_id string, query string, tokens array<string>"

# Fields of tagged topic text and the label each one may start with.
MARKUP_LABELS = {
    "num": r"Number:\s+",
    "title": r"Topic:\s+",
    "desc": r"Description:\s*",
    "narr": r"Narrative:\s*",
    "con": r"Concept\(s\):\s+",
    "smry": r"Summary:\s+",
    "dom": r"Domain:\s+",
    "fac": r"Factor\(s\):\s*",
    "def": r"Definition\(s\):\s*",
}


def unify_topics(raw: DataFrame) -> DataFrame:
    """The three topic shapes as ``(topic_id, query, tokens)``."""
    return raw.select(
        F.coalesce("topid", "num").alias("topic_id"),
        F.coalesce("query", "title").alias("query"),
        F.coalesce("tokens", F.expr("cast(array() as array<string>)")).alias("tokens"),
    )


def read_topics(spark: SparkSession, path) -> DataFrame:
    """Topics of a JSON array file."""
    return unify_topics(spark.read.schema(TOPIC_JSON).json(path, multiLine=True))


def topics_frame(spark: SparkSession, topics) -> DataFrame:
    """Topics given as ``(topic_id, query, tokens)`` tuples."""
    return spark.createDataFrame(list(topics), TOPIC_SCHEMA)


def read_keywords(spark: SparkSession, path) -> DataFrame:
    """Search phrases, one per line."""
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("phrase"))
    return lines.filter(F.length("phrase") > 0)


def read_ids(spark: SparkSession, path) -> DataFrame:
    """Ids, one per line."""
    return spark.read.text(path).select(F.trim("value").try_cast("bigint").alias("post_id")).dropna()


def parse_topic_markup(files: DataFrame, column: str = "value") -> DataFrame:
    """Tagged topic text (one file per row) to one row per topic.

    A field runs from its opening tag to the next tag; a leading label such as ``Number:`` is cut.
    """
    topic = files.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<top>(.*?)</top>"), F.lit(1))).alias("top"))
    fields = []
    for name, label in MARKUP_LABELS.items():
        body = F.trim(F.regexp_replace(F.regexp_extract("top", rf"(?s)<{name}>([^<]*)", 1), r"^\s+|\s+$", ""))
        fields.append(F.regexp_replace(body, f"^{label}", "").alias(name))
    return topic.select(*fields)


def read_topic_markup(spark: SparkSession, path) -> DataFrame:
    return parse_topic_markup(spark.read.text(path, wholetext=True))
