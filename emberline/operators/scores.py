"""Burst scores of tokens over sliding windows.

For a window of slots i = 0 … n-1 with token counts c_i, slot totals S_i and V distinct tokens the
score is |slope · R²| of the line through y_i = ln((c_i + 1) / (S_i + V)).  Only non-zero counts are
ever materialised: with a_i = ln(c_i + 1) and window constants L_i = ln(S_i + V) (centred), the sums
the regression needs split into sums over the token's own cells and constants of the window.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from emberline.operators.sizing import broadcast_if_bytes
from emberline.operators.windows import emits, regression_constants, window_table
from emberline.sources.scratch import stage

FLAT = 1e-11  # sums of squares below this are a constant series


def _regression(signed: bool) -> Column:
    """slope · R² = cxy³ / (cxx² · cyy), kept short so that filters on it still compile well."""
    n = F.col("n").cast("double")
    cxx = n * (n * n - 1) / 12
    cxy = F.col("sum_ia") - F.col("sum_il") - F.col("sum_a") * (n - 1) / 2
    cyy = F.col("sum_aal") + F.col("sum_ll") - F.col("sum_a") * F.col("sum_a") / n
    raw = F.when(F.col("n") < 2, None).when(cyy > FLAT, F.pow(cxy, F.lit(3.0)) / (cxx * cxx * cyy)).otherwise(0.0)
    return raw if signed else F.abs(raw)


# Scorers over the sums of one token and window; every one is a native expression.
SCORERS: dict[str, Callable[[], Column]] = {
    "regression": lambda: _regression(signed=False),
    "rising": lambda: _regression(signed=True),
    "average": lambda: F.col("last_n") - F.col("sum_n") / F.col("n"),
}


def _cell_sums(cells: DataFrame, place: Column, by: list[str], is_last: Column) -> DataFrame:
    a = F.ln(F.col("c") + 1)
    # One number of the window's array goes on to the sums, not the array.
    narrow = cells.withColumn("i", place).withColumn("a", a).withColumn("l", F.get("logs", F.col("i"))).drop("logs")
    return (
        narrow.groupBy(*by)
        .agg(
            F.sum("a").alias("sum_a"),
            F.sum(F.col("i") * F.col("a")).alias("sum_ia"),
            F.sum(F.col("a") * (F.col("a") - 2 * F.col("l"))).alias("sum_aal"),
            F.sum("c").alias("sum_n"),
            F.sum(F.when(is_last, F.col("c")).otherwise(0)).alias("last_n"),
        )
    )


def burst_scores(
    counts: DataFrame,
    lo: int,
    hi: int,
    major: int,
    emit: str = "full",
    scorer: str = "regression",
    keys: tuple[str, ...] = (),
    key_rows: int = 1,
) -> DataFrame:
    """``(*keys, win, token, score)`` for every token of every reported window.

    ``counts`` is ``(*keys, slot, token, n)``, read several times: pass a staged table.  The counts
    shuffle once, on the token; spreading a count over its windows and summing up again stays inside
    the partition, whose groups are bounded by the calendar.  The table of windows is broadcast
    while its size, known from the slot range (and ``key_rows``, the number of keys), allows it.
    """
    cells = counts.repartition(*keys, "token")
    windows = stage(window_table(counts, lo, hi, major, keys).filter(emits(F.col("win"), lo, hi, major, emit)), "windows")
    windows = broadcast_if_bytes(windows, (hi - lo + 1) * key_rows, 8 * major + 128)
    by = [*keys, "win"]
    last = F.least(F.col("slot") + (major - 1), F.lit(hi))
    spread = cells.select(*keys, "token", "slot", F.col("n").alias("c"), F.explode(F.sequence("slot", last)).alias("win"))
    placed = spread.join(windows.select(*by, "n", "logs"), by)
    place = F.col("n") - 1 - (F.col("win") - F.col("slot")).cast("int")
    sums = _cell_sums(placed, place, [*keys, "token", "win"], F.col("slot") == F.col("win"))
    return sums.join(windows.select(*by, "n", "sum_il", "sum_ll"), by).select(
        *keys, "win", "token", SCORERS[scorer]().alias("score")
    )


def undated_scores(counts: DataFrame, as_of: int, memory: int, scorer: str = "regression") -> DataFrame:
    """Scores of histories aligned at each token's first slot, over the last ``memory`` values.

    Totals are summed per position in the history, not per slot.
    """
    start = F.greatest(F.col("first_slot"), F.lit(as_of - memory + 1))
    first = counts.filter(F.col("slot") <= as_of).groupBy("token").agg(F.min("slot").alias("first_slot"))
    live = counts.filter(F.col("slot").between(as_of - memory + 1, as_of)).join(first, "token")
    cells = live.select(
        "token",
        F.col("n").alias("c"),
        (F.col("slot") - start).cast("int").alias("place"),
        (F.lit(as_of) - start + 1).cast("int").alias("n"),
        (F.col("slot") == as_of).alias("is_last"),
    )
    vocab = cells.agg(F.count_distinct("token").alias("vocab"))
    totals = cells.groupBy("place").agg(F.sum("c").alias("total"))
    # The history table has ``memory`` rows at most: one prefix of the positions per length.
    spread = totals.select(F.explode(F.sequence(F.col("place") + 1, F.lit(memory))).alias("n"), "place", "total")
    filled = spread.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("place", "total"))).alias("by_place"))
    lengths = filled.select(
        "n",
        F.transform(
            F.sequence(F.lit(0), F.col("n") - 1), lambda p: F.coalesce(F.element_at("by_place", p), F.lit(0))
        ).alias("totals"),
        vocab.scalar().alias("vocab"),
    )
    table = broadcast_if_bytes(regression_constants(lengths.drop("n")), memory, 8 * memory + 128)
    sums = _cell_sums(cells.join(table.select("n", "logs"), "n"), F.col("place"), ["token", "n"], F.col("is_last"))
    return sums.join(table.select("n", "sum_il", "sum_ll"), "n").select("token", SCORERS[scorer]().alias("score"))


def score_series(
    counts: DataFrame,
    lo: int,
    hi: int,
    major: int,
    scorer: Callable[[np.ndarray], np.ndarray],
    rows_per_group: int = 200_000,
) -> DataFrame:
    """Scores by a Python function of dense count series, for scorers that are no expression.

    ``scorer`` gets an array (windows × major) of one token's counts and returns one score per
    window.  Tokens are hashed into groups of bounded size, so a task holds some tokens' non-zero
    counts at a time and the calls are vectorised.
    """
    groups = max(1, counts.count() // rows_per_group + 1)

    def score_group(cells: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for token, own in cells.groupby("token", sort=False):
            slots = own["slot"].to_numpy()
            series = np.zeros(hi - lo + major, dtype="int64")
            series[slots - lo + major - 1] = own["n"].to_numpy()
            frames = np.lib.stride_tricks.sliding_window_view(series, major)
            ends = np.flatnonzero((frames != 0).any(axis=1))
            ends = ends[ends >= min(major - 1, hi - lo)]
            if len(ends):
                parts.append(pd.DataFrame({"win": ends + lo, "token": token, "score": scorer(frames[ends])}))
        return pd.concat(parts) if parts else pd.DataFrame({"win": [], "token": [], "score": []})

    bucket = F.pmod(F.xxhash64("token"), F.lit(groups))
    cells = counts.select(bucket.alias("bucket"), "slot", "token", "n")
    return cells.groupBy("bucket").applyInPandas(score_group, "win bigint, token string, score double")


def minmax_normalise(scores: DataFrame, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """Scores scaled to [0, 1] inside each window; a window without spread gives 0."""
    bounds = scores.groupBy(*keys).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low")))
    joined = scores.join(bounds, list(keys))
    return joined.select(*scores.drop("score").columns, F.coalesce(scaled, F.lit(0.0)).alias("score"))


def window_stats(scores: DataFrame) -> DataFrame:
    """Distribution of the scores per window.

    ``min`` and ``max`` start from 0, as the learned statistics do; ``true_min`` is the real one.
    """
    return scores.groupBy("win").agg(
        F.least(F.lit(0.0), F.min("score")).alias("min"),
        F.greatest(F.lit(0.0), F.max("score")).alias("max"),
        F.avg("score").alias("avg"),
        F.stddev_pop("score").alias("sigma"),
        F.min("score").alias("true_min"),
    )


def score_distribution(terms: DataFrame) -> DataFrame:
    """Minimum, median, mean and maximum over all scores of a term file."""
    terms = terms.select(F.col("score"))
    facts = terms.agg(F.count("score").alias("n"), F.min("score").alias("min"), F.avg("score").alias("mean"), F.max("score").alias("max"))
    n = facts.first().n
    median = None
    if n:
        middle = {(n - 1) // 2, n // 2}
        median = sum(value_at(terms, "score", rank) for rank in middle) / len(middle)
    return facts.select("min", F.lit(median).cast("double").alias("median"), "mean", "max")


def value_at(df: DataFrame, column: str, rank: int, buckets: int = 1024) -> float:
    """The value with ``rank`` smaller-or-equal values before it in order, exactly.

    Narrows down from bucket to bucket of a histogram: every pass is one distributed count and
    brings at most ``buckets`` rows to the driver, so nothing is sorted or held as a whole.
    """
    value = F.col(column)
    rows = df.filter(value.isNotNull())
    # Infinities and NaN (the largest) have no place in a histogram: they are counted apart.
    infinite = float("inf")
    finite = (value > -infinite) & (value < infinite)
    below, between = rows.agg(F.count_if(value == -infinite), F.count_if(finite)).first()
    if rank < below:
        return -infinite
    rank -= below
    if rank >= between:
        above = rows.agg(F.count_if(value == infinite)).first()[0]
        return infinite if rank - between < above else float("nan")
    rows = rows.filter(finite)
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        width = high / buckets - low / buckets
        place = F.least(F.floor((value / buckets - low / buckets) / width * buckets), F.lit(buckets - 1))
        inside = rows.filter(value.between(low, high)).groupBy(place.alias("b"))
        for bucket in sorted(inside.agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()):
            if rank < bucket.n:
                low, high = bucket.low, bucket.high
                break
            rank -= bucket.n
    return low
