"""Posts from JSON lines, in files or in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The fields of a post record that the jobs use.
POST_JSON = """
    id BIGINT, text STRING, lang STRING, created_at STRING,
    user STRUCT<id: BIGINT>,
    retweeted_status STRUCT<id: BIGINT, retweet_count: BIGINT>,
    entities STRUCT<
        hashtags: ARRAY<STRUCT<text: STRING>>,
        user_mentions: ARRAY<STRUCT<screen_name: STRING>>,
        urls: ARRAY<STRUCT<url: STRING, expanded_url: STRING>>,
        media: ARRAY<STRUCT<url: STRING, expanded_url: STRING>>>,
    coordinates STRUCT<coordinates: ARRAY<DOUBLE>>
"""
# Fixed value: the record's time format without the leading weekday.
CREATED_AT_PATTERN = "MMM d HH:mm:ss Z yyyy"


def _links(array: Column) -> Column:
    return F.transform(array, lambda l: F.struct(l["url"].alias("url"), l["expanded_url"].alias("expanded")))


def parse_posts(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Decode one JSON record per row; records without an id (bad lines, notices) are dropped.

    Works on batch and streaming frames, whatever delivered the lines: files, sockets or a broker's
    ``value`` column.
    """
    p = lambda path: F.col(f"post.{path}")
    decoded = lines.select(*keep, F.from_json(F.col(column).cast("string"), POST_JSON).alias("post"))
    return decoded.filter(p("id").isNotNull()).select(
        *keep,
        p("id").alias("post_id"),
        p("text").alias("text"),
        p("lang").alias("lang"),
        F.try_to_timestamp(F.substring(p("created_at"), 5, 100), F.lit(CREATED_AT_PATTERN)).alias("created_at"),
        p("user.id").alias("user_id"),
        p("retweeted_status").isNotNull().alias("is_repost"),
        p("retweeted_status.retweet_count").alias("orig_repost_count"),
        F.transform(p("entities.hashtags"), lambda h: h["text"]).alias("hashtags"),
        F.transform(p("entities.user_mentions"), lambda m: m["screen_name"]).alias("mentions"),
        _links(p("entities.urls")).alias("urls"),
        _links(p("entities.media")).alias("media"),
        F.get(p("coordinates.coordinates"), F.lit(0)).alias("lon"),
        F.get(p("coordinates.coordinates"), F.lit(1)).alias("lat"),
    )


def read_lines(spark: SparkSession, path, partitions: int | None = None) -> DataFrame:
    """Raw lines, optionally spread over a given number of partitions."""
    lines = spark.read.text(path)
    return lines.repartition(partitions) if partitions else lines


def read_posts(spark: SparkSession, path, partitions: int | None = None) -> DataFrame:
    """Posts of JSON-lines files."""
    return parse_posts(read_lines(spark, path, partitions))


def stream_posts(spark: SparkSession, fmt: str = "text", options: dict | None = None) -> DataFrame:
    """Posts of a streaming source.

    ``fmt`` is any installed source with one record per row in ``value``. For ``kafka`` reading
    starts at the latest offsets unless the options say otherwise, and offsets live in the query's
    checkpoint.
    """
    options = dict(options or {})
    if fmt == "kafka":
        options.setdefault("startingOffsets", "latest")
        options.setdefault("failOnDataLoss", "false")
    return parse_posts(spark.readStream.format(fmt).options(**options).load())


def post_lines(posts: DataFrame) -> DataFrame:
    """The JSON record of each post, in the shape :func:`parse_posts` reads."""
    links = lambda c: F.transform(c, lambda u: F.struct(u["url"].alias("url"), u["expanded"].alias("expanded_url")))
    record = F.struct(
        F.col("post_id").alias("id"),
        "text",
        "lang",
        F.date_format("created_at", "EEE " + CREATED_AT_PATTERN).alias("created_at"),
        F.struct(F.col("user_id").alias("id")).alias("user"),
        F.when(
            F.col("is_repost"),
            F.struct(F.col("post_id").alias("id"), F.col("orig_repost_count").alias("retweet_count")),
        ).alias("retweeted_status"),
        F.struct(
            F.transform("hashtags", lambda t: F.struct(t.alias("text"))).alias("hashtags"),
            F.transform("mentions", lambda m: F.struct(m.alias("screen_name"))).alias("user_mentions"),
            links(F.col("urls")).alias("urls"),
            links(F.col("media")).alias("media"),
        ).alias("entities"),
    )
    return posts.select(F.to_json(record).alias("value"))
