"""Posts assembled from the analytic test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.functions.text import extract_entities


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def posts_from_tables(spark: SparkSession, folder: str, every_event: bool = False) -> DataFrame:
    """Documents as posts, timed and attributed by the event with the same number.

    The event's type is a hashtag of the post, and so is the source of posts with a large value.  With ``every_event`` every
    event is a post: it has the text of the document whose number is the event's modulo the number of documents.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("post_id"), "text", "lang", "source")
    events = table(spark, folder, "events").select(
        F.col("event_id").alias("post_id"),
        "user_id",
        F.col("ts").cast("timestamp").alias("created_at"),
        (F.col("event_type") == "purchase").alias("is_repost"),
        F.floor(F.col("value") * 10).cast("bigint").alias("orig_repost_count"),
        "event_type",
    )
    entities = extract_entities(F.col("text"))
    own = F.when(F.col("orig_repost_count") > 300, F.array("event_type", "source")).otherwise(F.array("event_type"))
    entities["hashtags"] = F.concat(entities["hashtags"], own)
    if every_event:
        number = F.lit(max(docs.count(), 1))  # equally many events for every document, so none is a hot key
        parts = full_parts(spark)
        asked = events.withColumn("doc_id", F.pmod("post_id", number)).repartition(parts, "doc_id")
        posts = asked.join(docs.withColumnRenamed("post_id", "doc_id").repartition(parts, "doc_id"), "doc_id").drop("doc_id")
    else:
        posts = spread_small(docs).join(events, "post_id")
    return posts.select("*", *[column.alias(name) for name, column in entities.items()]).drop("event_type")


def full_parts(spark: SparkSession) -> int:
    """Number of partitions for rows that grow in the next step, so that few bytes don't end up in few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread_small(df: DataFrame) -> DataFrame:
    """Spreads a scan with fewer splits than cores; larger inputs are left as they were read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
