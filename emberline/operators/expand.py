"""Topic expansion by pseudo-relevance feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.conf import BurstConf
from emberline.functions.text import STOP_WORDS, post_tokens, with_bigrams
from emberline.operators.counts import kl_gain, unigram_model
from emberline.operators.filters import filter_lang, filter_reposts, filter_valid
from emberline.operators.matching import topic_scores
from emberline.operators.sizing import broadcast_if_small
from emberline.operators.select import top_gain, top_hashtags, top_with_ties
from emberline.sources.scratch import stage


def expansion_posts(posts: DataFrame, conf: BurstConf) -> DataFrame:
    """English originals with their expansion tokens and lower-case hashtags."""
    kept = filter_reposts(filter_valid(filter_lang(posts, conf.lang, ignore_case=False)), keep=False)
    tokens = post_tokens("plain")
    if conf.use_bigrams:
        tokens = with_bigrams(tokens)
    long_enough = F.filter(tokens, lambda t: F.length(t) >= conf.min_token_length)
    return kept.withColumn("tokens", F.transform(long_enough, lambda t: F.lower(t))).withColumn(
        "tags", F.transform("hashtags", lambda t: F.lower(t))
    )


def expand_topics(
    posts: DataFrame, topics: DataFrame, conf: BurstConf, op: str = "or", drop_stop_words: bool = False
) -> DataFrame:
    """Every topic with its number of matches and, if there are enough, an ``expanded_query``.

    The expansion holds the tokens that most distinguish a topic's best matches from all posts and
    its most frequent hashtags.  All topics are worked out in one job.
    """
    prepared = expansion_posts(posts, conf)
    scored = topic_scores(prepared, topics, op, keep=("post_id", "tokens", "tags"))
    matches = stage(scored.filter(F.col("score") > conf.match_threshold), "matches")
    totals = matches.groupBy("topic_id").agg(F.count("*").alias("matches"))
    enough = totals.filter(F.col("matches") >= conf.min_post_count).select("topic_id")
    # Few topics have all the matches: joined on the topic, whole texts' tokens would meet in as many tasks as there are topics.
    usable = matches.join(broadcast_if_small(stage(enough, "usable")), "topic_id", "left_semi")

    background = unigram_model(prepared.select(F.explode("tokens").alias("token")))
    best = top_with_ties(usable.select("topic_id", "score", "tokens"), conf.max_relevant_posts)
    foreground = unigram_model(best.select("topic_id", F.explode("tokens").alias("token")), ("topic_id",))
    terms = top_gain(kl_gain(foreground, background, ("topic_id",)), conf.max_taken_tokens)
    if drop_stop_words:
        terms = terms.filter(~F.col("token").isin(STOP_WORDS))
    tags = top_hashtags(
        usable.select("topic_id", F.explode("tags").alias("tag")), conf.min_hashtag_count, conf.max_taken_tags
    )
    # Terms by falling gain, then hashtags by falling count; both lists are short by construction.
    rank = lambda kind, value, text: F.struct(F.lit(kind).alias("kind"), (-value).alias("rank"), text.alias("text"))
    parts = terms.select("topic_id", rank(0, F.round("gain", 9), F.col("token")).alias("part")).unionByName(
        tags.select("topic_id", rank(1, F.col("n").cast("double"), F.concat(F.lit("#"), "tag")).alias("part"))
    )
    texts = F.array_distinct(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["text"]))
    expanded = parts.groupBy("topic_id").agg(F.array_join(texts, " OR ").alias("expanded_query"))
    result = topics.select("topic_id", "query").join(totals, "topic_id", "left").join(expanded, "topic_id", "left")
    return result.fillna(0, ["matches"])
