"""Row filters on posts and tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberline.conf import BurstConf


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def filter_valid(posts: DataFrame) -> DataFrame:
    return posts.filter(F.col("text").isNotNull() & (F.length("text") > 0))


def filter_lang(posts: DataFrame, lang: str = "en", ignore_case: bool = True) -> DataFrame:
    """Posts of one language; a post without language is dropped."""
    value = F.lower("lang") if ignore_case else F.col("lang")
    return posts.filter(value == (lang.lower() if ignore_case else lang))


def filter_reposts(posts: DataFrame, keep: bool) -> DataFrame:
    """Only reposts (``keep``) or no reposts at all."""
    return posts.filter(F.col("is_repost") == keep)


def filter_spam(posts: DataFrame, terms) -> DataFrame:
    """Drops posts whose lower-case text contains one of the spam terms."""
    return posts.filter(~_any(F.lower("text").contains(t) for t in terms))


def filter_entities(posts: DataFrame, max_hashtags: int, max_urls: int) -> DataFrame:
    count = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    return posts.filter((count("hashtags") <= max_hashtags) & (count("urls") <= max_urls))


def filter_min_tokens(posts: DataFrame, n: int) -> DataFrame:
    return posts.filter(F.size("tokens") >= n)


def filter_repost_count(posts: DataFrame, n: int) -> DataFrame:
    return posts.filter(F.col("orig_repost_count") >= n)


def filter_term_length(terms: DataFrame, n: int) -> DataFrame:
    """Tokens of at least ``n`` characters."""
    return terms.filter(F.length("token") >= n)


def filter_burst(scores: DataFrame, threshold: float) -> DataFrame:
    """Scores strictly above the threshold; an undefined score never passes."""
    return scores.filter(F.nanvl("score", F.lit(float("-inf"))) > threshold)


def track_gate(posts: DataFrame, phrases=(), box=None, mode: str = "or") -> DataFrame:
    """Live-stream gate: any tracked phrase in the text, and/or a point inside ``box``.

    ``box`` is (west, south, east, north).  Posts without id are dropped.  With both conditions
    given, ``mode`` combines them.
    """
    tests = []
    if phrases:
        tests.append(_any(F.lower("text").contains(p.lower()) for p in phrases))
    if box:
        west, south, east, north = box
        inside = F.col("lon").between(west, east) & F.col("lat").between(south, north)
        tests.append(F.coalesce(inside, F.lit(False)))
    posts = posts.filter(F.col("post_id").isNotNull())
    if not tests:
        return posts
    return posts.filter(_any(tests) if mode == "or" else reduce(lambda a, b: a & b, tests))


def summary_filters(posts: DataFrame, conf: BurstConf, lang: bool = True) -> DataFrame:
    """The filters every summary job starts with, cheapest first."""
    if lang:
        posts = filter_lang(posts, conf.lang)
    return filter_entities(filter_spam(filter_valid(posts), conf.spam_terms), conf.max_hashtags, conf.max_urls)
