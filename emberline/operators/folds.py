"""Thresholds that adapt from window to window, per topic.

A threshold only ever takes the values base^(modifier^k) or base·factor^k, so its state is the whole
number k, without a bound.  Every score passes a known range of these values, found with logarithms and
checked at its border; scores are counted per window by that range, which leaves a small histogram per
window.  The fold walks over the windows of a topic, one entry per slot of the calendar, and returns the
threshold of every step.
"""

from __future__ import annotations

from math import log as ln

from pyspark.sql import Column, DataFrame, Window, functions as F

CROWD = 10  # more passing rows than this raise the threshold
ALWAYS = (1 << 31) - 1  # stands for a range without end

_STATE = "struct<level:bigint,quiet:bigint,seen:bigint,changes:array<struct<step:bigint,passing:bigint,old:bigint,new:bigint>>>"


def level_counts(rows: DataFrame, step: str, low: Column, high: Column, passes: Column) -> DataFrame:
    """``(topic_id, step, low, high, n)``: rows by the levels low <= k < high whose threshold they pass."""
    at = lambda level: F.when(passes, level).otherwise(F.lit(0)).cast("bigint")
    levels = rows.select("topic_id", F.col(step).alias("step"), at(low).alias("low"), at(high).alias("high"))
    return levels.groupBy("topic_id", "step", "low", "high").agg(F.count("*").alias("n"))


def _bordered(guess: Column, passes) -> Column:
    """The first level that ``passes`` no more, near a guess that rounding may have moved by one."""
    start = F.greatest(guess.cast("bigint") - 1, F.lit(0))
    return F.when(~passes(start), start).when(~passes(start + 1), start + 1).when(~passes(start + 2), start + 2).otherwise(start + 3)


def burst_levels(scores: DataFrame, base: float, modifier: float = 0.75, min_length: int = 4) -> DataFrame:
    """Scores counted by the thresholds base^(modifier^k) they exceed.

    Below a base of 1 the thresholds rise towards 1: a score passes the first ones, one of 1 or more all.
    From a base of 1 on they fall towards 1: a score passes all from some level on.
    """
    score = F.col("score")
    threshold = lambda k: F.pow(F.lit(base), F.pow(F.lit(modifier), k))
    passes = (F.length("token") >= min_length) & score.isNotNull() & ~F.isnan("score")
    if base == 1:
        return level_counts(scores, "win", F.lit(0), F.when(score > 1, ALWAYS).otherwise(0), passes)
    inner = F.log(F.abs(F.log(score)) / abs(ln(base))) / ln(modifier)
    if base < 1:
        first_failed = F.when(score <= base, 0).when(score >= 1, ALWAYS)
        return level_counts(scores, "win", F.lit(0), first_failed.otherwise(_bordered(F.floor(inner), lambda k: score > threshold(k))), passes)
    first_passed = F.when(score > base, 0).otherwise(_bordered(F.floor(inner), lambda k: score <= threshold(k)))
    return level_counts(scores, "win", first_passed, F.when(score > 1, ALWAYS).otherwise(first_passed), passes & (score > 1))


def _per_topic(counts: DataFrame) -> DataFrame:
    """``(topic_id, steps)``: per topic the ordered windows with their counts per level."""
    per_step = counts.groupBy("topic_id", "step").agg(F.collect_list(F.struct("low", "high", "n")).alias("counts"))
    return per_step.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("step", "counts"))).alias("steps"))


def _fold(histograms: DataFrame, next_level) -> DataFrame:
    """Changes ``(topic_id, step, passing, old, new)`` of the level."""
    start = F.expr(f"cast(struct(0, 0, 0, array()) as {_STATE})")

    def advance(state: Column, step: Column) -> Column:
        passing = F.aggregate(
            F.filter(step["counts"], lambda c: (c["low"] <= state["level"]) & (state["level"] < c["high"])),
            F.lit(0).cast("bigint"),
            lambda acc, c: acc + c["n"],
        )
        quiet = F.when(passing == 0, state["quiet"] + 1).otherwise(F.lit(0))
        seen = state["seen"] + 1
        level = next_level(state["level"], passing, quiet, seen)
        change = F.struct(
            step["step"].alias("step"), passing.alias("passing"), state["level"].alias("old"), level.cast("bigint").alias("new")
        )
        changes = F.when(level != state["level"], F.array_append(state["changes"], change)).otherwise(state["changes"])
        return F.struct(
            level.cast("bigint").alias("level"), quiet.cast("bigint").alias("quiet"), seen.cast("bigint").alias("seen"), changes.alias("changes")
        ).cast(_STATE)

    folded = F.aggregate("steps", start, advance, lambda state: state["changes"])
    return histograms.select("topic_id", F.inline(folded))


def fold_threshold(
    scores: DataFrame, base: float, modifier: float = 0.75, major: int = 30, min_length: int = 4
) -> DataFrame:
    """Changes of the burst threshold: ``(topic_id, win, bursts, old_threshold, new_threshold)``.

    ``scores`` is ``(topic_id, win, token, score)`` with all tokens of every evaluated window.  More
    than ten bursting terms raise the threshold to its power ``modifier``; no burst in the last
    3·``major`` windows lowers it again, never below ``base``.
    """
    return fold_burst_levels(burst_levels(scores, base, modifier, min_length), base, modifier, major)


def fold_burst_levels(counts: DataFrame, base: float, modifier: float = 0.75, major: int = 30) -> DataFrame:
    """The same changes from counts per level."""

    def next_level(level, passing, quiet, seen):
        up = level + 1
        ease = (quiet >= 3 * major) & (seen > 3 * major) & (level > 0)
        return F.when(passing > CROWD, up).when(ease, level - 1).otherwise(level)

    value = lambda k: F.pow(F.lit(base), F.pow(F.lit(modifier), F.col(k)))
    return _fold(_per_topic(counts), next_level).select(
        "topic_id",
        F.col("step").alias("win"),
        F.col("passing").alias("bursts"),
        value("old").alias("old_threshold"),
        value("new").alias("new_threshold"),
    )


def fold_escalation(posts: DataFrame, base: float, factor: float = 10.0, step: str = "slot") -> DataFrame:
    """Changes of the repost threshold: ``(topic_id, slot, posts, old_threshold, new_threshold)``.

    More than ten posts of a topic reaching the threshold in one batch multiply it by ``factor``.
    """
    count = F.col("orig_repost_count")
    threshold = lambda k: F.lit(float(base)) * F.pow(F.lit(float(factor)), k)
    guess = F.floor(F.log(count / float(base)) / ln(factor)) + 1
    first_failed = F.when(count < base, 0).otherwise(_bordered(guess, lambda k: count >= threshold(k)))
    counts = level_counts(posts, step, F.lit(0), first_failed, count.isNotNull())
    value = lambda k: F.lit(float(base)) * F.pow(F.lit(float(factor)), F.col(k))
    changes = _fold(_per_topic(counts), lambda level, passing, quiet, seen: F.when(passing > CROWD, level + 1).otherwise(level))
    return changes.select(
        "topic_id",
        F.col("step").alias(step),
        F.col("passing").alias("posts"),
        value("old").alias("old_threshold"),
        value("new").alias("new_threshold"),
    )


def thresholds_at(changes: DataFrame, evaluated: DataFrame, base: float, step: str = "win") -> DataFrame:
    """Threshold in force at each evaluated ``(topic_id, step)``: the last earlier change's."""
    none = F.lit(None).cast("double").alias("__new")
    marks = changes.select("topic_id", F.col(step), F.col("new_threshold").alias("__new"), F.lit(False).alias("__asked"))
    both = marks.unionByName(evaluated.select("topic_id", step, none, F.lit(True).alias("__asked")).distinct())
    earlier = Window.partitionBy("topic_id").orderBy(step).rangeBetween(Window.unboundedPreceding, -1)
    limit = F.coalesce(F.last("__new", ignorenulls=True).over(earlier), F.lit(float(base)))
    return both.withColumn("threshold", limit).filter("__asked").select("topic_id", step, "threshold")
