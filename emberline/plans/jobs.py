"""End-to-end jobs composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.conf import BurstConf
from emberline.functions.text import post_tokens
from emberline.functions.timeslice import slot_of
from emberline.operators.counts import minor_counts
from emberline.operators.filters import filter_burst, filter_lang, filter_reposts, filter_valid, summary_filters
from emberline.operators.matching import assign_topics, gate_posts, keyword_match, match_any_topic, match_posts
from emberline.operators.scores import burst_scores, window_stats
from emberline.operators.select import burst_terms, select_posts
from emberline.operators.sizing import parts_for
from emberline.operators.windows import burst_ranges, slot_range
from emberline.sources.posts import parse_posts
from emberline.sources.scratch import stage

OPEN_DOMAIN = "OPEN_DOMAIN"  # fixed value: label of posts chosen without topics
SELECTED = "topic string, win bigint, post_id bigint, text string"


def own_slot(posts: DataFrame, conf: BurstConf) -> DataFrame:
    return posts.withColumn("slot", slot_of(F.col("created_at"), conf.width))


def window_counts(
    posts: DataFrame, conf: BurstConf, by: str = "user", style: str = "summary", min_tokens: int = 0, spill: bool = True
) -> tuple[DataFrame, int, int] | None:
    """Staged counts per slot and token over trailing minor windows, and their slot range.

    A post counts for its slot and the next ``minor - 1``; ``spill`` keeps slots past the last
    post.  Distinct users are counted on the union of a minor window's posts.  Posts with fewer
    than ``min_tokens`` tokens count for the range only.  None without posts.
    """
    tokens = post_tokens(style)
    prepared = own_slot(posts, conf).select("post_id", "user_id", "slot", tokens.alias("tokens"))
    if min_tokens:
        empty = F.expr("cast(array() as array<string>)")
        prepared = prepared.withColumn("tokens", F.when(F.size("tokens") >= min_tokens, F.col("tokens")).otherwise(empty))
    counts = stage(minor_counts(prepared, conf.minor, by, keep_slots=True, parts=parts_for(posts)), "counts")
    bounds = slot_range(counts)
    if bounds is None:
        return None
    lo, hi = bounds
    if not spill:
        hi -= conf.minor - 1
    return counts.filter(F.col("token").isNotNull() & (F.col("slot") <= hi)), lo, hi


def window_scores(posts: DataFrame, conf: BurstConf, emit: str, scorer: str = "regression", **counting) -> DataFrame:
    """``(win, token, score)`` of posts."""
    counted = window_counts(posts, conf, **counting)
    if counted is None:
        return posts.sparkSession.createDataFrame([], "win bigint, token string, score double")
    cells, lo, hi = counted
    return burst_scores(cells, lo, hi, conf.major, emit, scorer)


def summary_terms(posts: DataFrame, conf: BurstConf, k: int | None) -> DataFrame:
    """Staged bursting terms of the windows past the warm-up."""
    scores = window_scores(posts, conf, "warm", min_tokens=conf.min_tokens)
    return stage(burst_terms(scores, conf.burst_threshold, conf.burst_term_length, k), "terms")


def first_windows(posts: DataFrame, terms: DataFrame, conf: BurstConf) -> DataFrame:
    """First window that finds each post by one of its terms."""
    return match_posts(own_slot(posts, conf), terms, conf.major + conf.minor - 1)


def window_candidates(posts: DataFrame, terms: DataFrame, conf: BurstConf) -> DataFrame:
    """Posts found by a window's terms, in the order they are visited: windows in turn, newest
    posts first."""
    found = posts.join(first_windows(posts, terms, conf), "post_id").withColumn("tokens", post_tokens("summary"))
    found = found.filter(F.size("tokens") >= conf.min_tokens)
    pos = F.struct(F.col("win"), (-F.unix_micros("created_at")).alias("age"), F.col("post_id"))
    return found.select(F.col("post_id").alias("id"), "win", pos.alias("pos"), "created_at", "tokens")


def summarise(posts: DataFrame, terms: DataFrame, conf: BurstConf) -> DataFrame:
    """``(post_id, win)`` of the posts chosen to represent the terms' windows."""
    candidates = stage(window_candidates(posts, terms, conf), "candidates")
    chosen = select_posts(candidates, conf.sim_threshold, conf.per_window_max, "similar_first")
    return chosen.select(F.col("id").alias("post_id"), "win")


def topical_burst_summary(posts: DataFrame, topics: DataFrame, conf: BurstConf, op: str = "or") -> DataFrame:
    """``(topic, win, post_id, text)``: novel posts of bursting windows, labelled by topic."""
    kept = stage(match_any_topic(summary_filters(posts, conf), topics, 0.0, op), "topical")
    chosen = stage(summarise(kept, summary_terms(kept, conf, conf.terms_per_window), conf), "chosen")
    texts = kept.join(chosen, "post_id")
    return texts.join(assign_topics(texts, topics, "query", op), "post_id").select("topic", "win", "post_id", "text")


def open_domain_summary(posts: DataFrame, conf: BurstConf) -> DataFrame:
    """The summary without topics."""
    kept = stage(summary_filters(posts, conf), "kept")
    chosen = summarise(kept, summary_terms(kept, conf, conf.terms_per_window), conf)
    return kept.join(chosen, "post_id").select(F.lit(OPEN_DOMAIN).alias("topic"), "win", "post_id", "text")


def gated_burst_posts(posts: DataFrame, topics: DataFrame, ids: DataFrame, conf: BurstConf) -> DataFrame:
    """``(win, post_id)``: candidates that contain a bursting term, with the first such window."""
    kept = stage(keyword_match(filter_valid(filter_lang(posts, conf.lang)), topics), "kept")
    terms = summary_terms(kept, conf, None)
    gated = gate_posts(kept, ids).filter(F.size(post_tokens("summary")) >= conf.min_tokens)
    return first_windows(gated, terms, conf).select("win", "post_id")


def batch_term_scores(posts: DataFrame, topics: DataFrame, conf: BurstConf, floor: float) -> DataFrame:
    """``(date, token, score)``, date in epoch milliseconds, of scores above ``floor``."""
    kept = keyword_match(summary_filters(posts, conf), topics)
    scores = filter_burst(window_scores(kept, conf, "warm", min_tokens=conf.min_tokens), floor)
    return scores.select((F.col("win") * F.lit(conf.width * 1000)).alias("date"), "token", "score")


def batch_post_finder(posts: DataFrame, terms: DataFrame, topics: DataFrame, conf: BurstConf) -> DataFrame:
    """The summary from precomputed terms ``(date, token, score)``: ``(topic, win, post_id, text)``.

    Only posts inside the ranges around bursting dates are searched.  Topics label posts by their
    tokens.
    """
    kept = keyword_match(summary_filters(posts, conf), topics)
    slots = own_slot(kept, conf)
    bounds = slot_range(slots)
    if bounds is None:
        return posts.sparkSession.createDataFrame([], SELECTED)
    lo, hi = bounds[0], bounds[1] + conf.minor - 1
    win = F.floor(F.col("date") / (conf.width * 1000)).cast("bigint")
    dated = terms.select(win.alias("win"), "token", "score").filter(F.col("win").between(lo, hi))
    ranges = burst_ranges(filter_burst(dated, conf.burst_threshold).select(F.col("win").alias("slot")), lo, conf.major)
    chosen_terms = burst_terms(
        dated.filter(F.col("win") >= lo + conf.major), conf.burst_threshold, conf.burst_term_length, conf.terms_per_window
    )
    chosen_terms = stage(chosen_terms, "terms")
    inside = ranges.select(F.explode(F.sequence(F.col("first_slot") - (conf.minor - 1), "last_slot")).alias("slot"))
    near = stage(slots.join(inside.distinct(), "slot", "left_semi"), "near")
    chosen = stage(summarise(near, chosen_terms, conf), "chosen")
    texts = near.join(chosen, "post_id")
    return texts.join(assign_topics(texts, topics, "tokens"), "post_id").select("topic", "win", "post_id", "text")


def learn_term_scores(posts: DataFrame, conf: BurstConf, style: str = "learner") -> DataFrame:
    """``(win, token, score)`` of every token in every full window of the corpus."""
    originals = filter_reposts(filter_valid(posts), keep=False)
    return window_scores(originals, conf, "full", by="post", style=style, spill=False)


def learn_window_stats(posts: DataFrame, conf: BurstConf) -> DataFrame:
    """Distribution of those scores per window."""
    return window_stats(learn_term_scores(posts, conf, style="plain"))


def topic_corpus_filter(lines: DataFrame, topics: DataFrame, lang: str = "en") -> DataFrame:
    """Raw lines whose post is in the language and contains a topic token."""
    posts = parse_posts(lines, keep=("value",))
    return keyword_match(filter_valid(filter_lang(posts, lang)), topics).select("value")
