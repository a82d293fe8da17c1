"""Top-k selections and the choice of novel posts per window.

``row_number() <= k`` filters keep their best k rows before the shuffle (window group limit), so a
hot group does not move as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from emberline.operators.filters import filter_burst
from emberline.operators.novelty import max_similarity, token_sets
from emberline.operators.overlap import best_similarity, comparable
from emberline.operators.sizing import at_most, broadcast_if_small
from emberline.sources.scratch import stage

FEW = 20_000  # posts whose similarities are all worked out at once
HEADS = 512  # earliest sets of a scope that give first bounds


def top_per_group(df: DataFrame, keys, order, k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def top_terms(scores: DataFrame, k: int, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """Best ``k`` terms per window; scores equal to nine places are ordered by token."""
    defined = filter_burst(scores, float("-inf"))
    return best_terms(defined, k, keys)


def best_terms(scores: DataFrame, k: int, keys: tuple[str, ...]) -> DataFrame:
    return top_per_group(scores, keys, [F.round("score", 9).desc(), F.col("token")], k)


def burst_terms(scores: DataFrame, threshold: float, min_length: int, k: int | None, keys=("win",)) -> DataFrame:
    """Bursting terms of each window: long enough, above the threshold, best ``k`` if given."""
    passing = filter_burst(scores, threshold).filter(F.length("token") >= min_length)
    return passing if k is None else best_terms(passing, k, keys)


def top_with_ties(scored: DataFrame, k: int, keys: tuple[str, ...] = ("topic_id",)) -> DataFrame:
    """Rows scoring at least as high as the group's k-th best (all rows of smaller groups)."""
    kth = top_per_group(scored.select(*keys, "score"), keys, [F.desc("score")], k)
    bound = broadcast_if_small(stage(kth.groupBy(*keys).agg(F.min("score").alias("__kth")), "bounds"))  # whole rows stay where they are
    return scored.join(bound, list(keys)).filter(F.col("score") >= F.col("__kth")).drop("__kth")


def top_gain(gains: DataFrame, k: int, keys: tuple[str, ...] = ("topic_id",)) -> DataFrame:
    return top_per_group(gains, keys, [F.round("gain", 9).desc(), F.col("token")], k)


def top_hashtags(tags: DataFrame, min_count: int, k: int, keys: tuple[str, ...] = ("topic_id",)) -> DataFrame:
    """Most frequent hashtags used more than ``min_count`` times."""
    counts = tags.groupBy(*keys, "tag").agg(F.count("*").alias("n")).filter(F.col("n") > min_count)
    return top_per_group(counts, keys, [F.desc("n"), F.col("tag")], k)


def sort_output(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*columns)


def select_posts(
    candidates: DataFrame,
    threshold: float,
    k: int,
    order: str = "similar_first",
    scope: tuple[str, ...] = (),
    group: tuple[str, ...] = ("win",),
    history: DataFrame | None = None,
) -> DataFrame:
    """Posts of each group that resemble no earlier candidate too much, at most ``k`` of them.

    ``candidates`` has ``id``, ``pos``, ``created_at``, ``tokens``, the ``group`` columns and the
    ``scope`` columns inside which posts are compared.  Every candidate counts as earlier one,
    chosen or not, and so do the ``history`` rows (``id, pos, tokens``, scope), which are never
    chosen themselves.  Posts whose similarity exceeds ``threshold`` are out.  Of the rest
    ``similar_first`` takes the most similar and ``novel_first`` the least similar ones.

    Only candidates are asked for their similarity, history rows never are.  Of many candidates only those get their exact
    similarity that can be among the ``k``.
    """
    columns = [*scope, "id", "pos", "tokens"]
    compared = candidates.select(*columns)
    if history is not None:
        compared = compared.unionByName(history.select(*columns))
    sets = comparable(stage(token_sets(compared, scope), "sets"))
    posts = candidates.select("id", "created_at", *group).join(sets.select("id"), "id", "left_semi")
    if at_most(posts, FEW):
        left = _with_best(posts, sets, scope).filter(F.col("sim") <= threshold)
    elif order == "similar_first":
        left = _most_similar(posts, sets, threshold, k, scope, group)
    else:
        left = _least_similar(posts, sets, threshold, k, scope, group)
    return top_per_group(left, group, _by_similarity(order), k).select("id", *group)


def _by_similarity(order: str) -> list:
    return [F.desc("sim") if order == "similar_first" else F.asc("sim"), F.col("created_at"), F.col("id")]


def _with_best(posts: DataFrame, sets: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    return posts.join(max_similarity(posts, sets, 0.0, scope), "id", "left").fillna(0.0, ["sim"])


def _most_similar(posts: DataFrame, sets: DataFrame, threshold: float, k: int, scope: tuple[str, ...], group: tuple[str, ...]) -> DataFrame:
    """Posts up to ``threshold`` with their similarity, among them each group's ``k`` most similar ones.

    The floor is lowered until each group has ``k`` posts above it or is whole: higher floors rule out far more pairs.
    """
    asked, known = stage(posts, "asked"), None
    for floor in (threshold * 2 / 3, threshold / 3):
        best = stage(max_similarity(asked, sets, floor, scope), "best")
        found = asked.join(best, "id").filter(F.col("sim") <= threshold)
        known = stage(found if known is None else known.unionByName(found), "known")
        full = known.groupBy(*group).agg(F.count("*").alias("__n")).filter(F.col("__n") >= k)
        asked = stage(asked.join(best, "id", "left_anti").join(full, list(group), "left_anti"), "asked")
        if at_most(asked, 0):
            return known
    return known.unionByName(_with_best(asked, sets, scope).filter(F.col("sim") <= threshold).select(known.columns))


def _least_similar(posts: DataFrame, sets: DataFrame, threshold: float, k: int, scope: tuple[str, ...], group: tuple[str, ...]) -> DataFrame:
    """Posts up to ``threshold`` with their similarity, among them each group's ``k`` least similar ones.

    The earliest sets of a scope give every post a lower bound.  Some posts with low bounds are compared with all; their ``k``-th
    similarity is the most that any post of the group may have, and only posts whose bound isn't beyond it are compared too.
    """
    heads = stage(top_per_group(sets, scope, [F.col("rank")], HEADS) if scope else sets.orderBy("rank").limit(HEADS), "heads")
    bounds = sets.select("id", "node").join(best_similarity(sets, heads, 0.0, scope), "node").groupBy("id").agg(F.max("sim").alias("__low"))
    low = posts.join(bounds, "id", "left").fillna(0.0, ["__low"]).filter(F.col("__low") <= threshold)
    low = stage(low, "bounds")
    first = stage(top_per_group(low, group, [F.col("__low"), F.col("created_at"), F.col("id")], 4 * k), "first")
    exact = stage(_with_best(first, sets, scope).filter(F.col("sim") <= threshold), "exact")
    cuts = top_per_group(exact, group, _by_similarity("novel_first"), k).groupBy(*group).agg(F.max("sim").alias("__cut"), F.count("*").alias("__n"))
    rest = low.join(first.select("id").distinct(), "id", "left_anti").join(cuts.filter(F.col("__n") >= k).drop("__n"), list(group), "left")
    rest = stage(rest.filter(F.col("__cut").isNull() | (F.col("__low") <= F.col("__cut"))).drop("__cut"), "rest")
    return exact.unionByName(_with_best(rest, sets, scope).filter(F.col("sim") <= threshold))


def with_similarity(compared: DataFrame, chosen: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Exact similarity of chosen posts with the earlier rows of ``compared``.

    Chosen posts are few (at most k per group), so only their own tokens are looked up.
    """
    sets = comparable(stage(token_sets(compared.select(*scope, "id", "pos", "tokens"), scope), "sets"))
    best = max_similarity(chosen.select("id"), sets, 0.0, scope)
    return chosen.join(best, "id", "left").fillna(0.0, ["sim"])
