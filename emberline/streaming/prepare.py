"""Stateless part of the streaming jobs and the streaming counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.conf import BurstConf
from emberline.functions.text import post_tokens
from emberline.functions.timeslice import slot_of
from emberline.operators.filters import (
    filter_lang,
    filter_min_tokens,
    filter_repost_count,
    filter_reposts,
    summary_filters,
)
from emberline.operators.matching import topic_match

PARTS = 64  # rows that hold the tokens of posts without a user


def with_delay(posts: DataFrame, delay: str) -> DataFrame:
    """Event time with a bound on lateness; later posts are dropped by stateful operators."""
    return posts.withWatermark("created_at", delay)


def stream_prepare(posts: DataFrame, topics: DataFrame, conf: BurstConf, lang: bool = False, op: str = "or") -> DataFrame:
    """One row per post and topic it matches, with tokens.  Narrow: no state, no shuffle."""
    kept = summary_filters(posts, conf, lang=lang)
    matched = topic_match(kept, topics, conf.query_threshold, op)
    return filter_min_tokens(matched.withColumn("tokens", post_tokens("summary")), conf.min_tokens)


def repost_prepare(posts: DataFrame, topics: DataFrame, conf: BurstConf, op: str = "or") -> DataFrame:
    """Popular reposts per topic, with tokens."""
    kept = filter_repost_count(filter_reposts(filter_lang(posts, conf.lang), keep=True), conf.repost_threshold)
    matched = topic_match(summary_filters(kept, conf, lang=False), topics, conf.query_threshold, op)
    return matched.withColumn("tokens", post_tokens("plain"))


def stream_counts(prepared: DataFrame, conf: BurstConf, delay: str, keys: tuple[str, ...] = ("topic_id",), timed: bool = False) -> DataFrame:
    """``(*keys, slot, token, n)``: distinct users per token over sliding minor windows.

    Two chained aggregations on event time, the first keeping each user's set of tokens per window: state has a row per user and
    window, not per token.  Posts without a user are one user, whose tokens are dealt over ``PARTS`` rows.
    In append mode a window's counts come out when the watermark passes its end; ``slot`` is the
    window's last slice, and ``timed`` adds its last instant ``at``, which stays event time.
    """
    length, step = f"{conf.minor * conf.width} seconds", f"{conf.width} seconds"
    rows = with_delay(prepared, delay).select(
        *keys, "created_at", "user_id", F.explode(F.array_distinct("tokens")).alias("token")
    )
    part = F.when(F.col("user_id").isNull(), F.pmod(F.xxhash64("token"), F.lit(PARTS))).otherwise(0).alias("part")
    own = F.collect_set(F.struct("token")).alias("own")  # a null token counts too
    users = rows.groupBy(F.window("created_at", length, step), *keys, "user_id", part).agg(own)
    per_window = users.select(F.window_time("window").alias("at"), *keys, F.explode(F.col("own.token")).alias("token"))
    counts = per_window.groupBy(F.window("at", step), *keys, "token").agg(F.count("*").alias("n"))
    at = [F.window_time("window").alias("at")] if timed else []
    return counts.select(*keys, slot_of(F.col("window.start"), conf.width).alias("slot"), "token", "n", *at)
