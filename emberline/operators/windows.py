"""Slot ranges and scoring windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def slot_range(slotted: DataFrame) -> tuple[int, int] | None:
    """First and last slot as numbers; None without rows.  One aggregate row reaches the driver."""
    row = slotted.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).first()
    return None if row.lo is None else (row.lo, row.hi)


def slice_spine(spark: SparkSession, lo: int, hi: int) -> DataFrame:
    """Every slot of a range."""
    return spark.range(lo, hi + 1).select(F.col("id").alias("slot"))


def gap_fill(per_slot: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows for slots nothing was counted in, with zeros."""
    return slice_spine(per_slot.sparkSession, lo, hi).join(per_slot, "slot", "left").fillna(0)


def major_windows(spark: SparkSession, lo: int, hi: int, major: int, emit: str = "full") -> DataFrame:
    """Scoring windows as ``(win, first_slot, n)``, labelled by their last slot.

    ``full`` keeps windows of ``major`` slots (one short window if the range is shorter),
    ``warm`` those whose index in the range is at least ``major``, ``all`` also the growing ones.
    """
    first = F.greatest(F.col("slot") - (major - 1), F.lit(lo))
    wins = slice_spine(spark, lo, hi).select(
        F.col("slot").alias("win"), first.alias("first_slot"), (F.col("slot") - first + 1).alias("n")
    )
    return wins.filter(emits(F.col("win"), lo, hi, major, emit))


def emits(win, lo: int, hi: int, major: int, emit: str):
    """Whether a window's scores are reported."""
    if emit == "full":
        return win >= min(lo + major - 1, hi)
    if emit == "warm":
        return win >= lo + major
    if emit == "all":
        return F.lit(True)
    raise ValueError(f"unknown emit rule {emit!r}")


def shift_join(per_slot: DataFrame, k: int, columns: tuple[str, ...]) -> DataFrame:
    """Each slot beside the values of the slot ``k`` earlier (null where there is none)."""
    earlier = per_slot.select((F.col("slot") + k).alias("slot"), *[F.col(c).alias(f"{c}_before") for c in columns])
    return per_slot.join(earlier, "slot", "left")


def vocab_changes(counts: DataFrame, major: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per slot, by how much the number of distinct tokens in the window ending there changes.

    A token enters with an occurrence and leaves ``major`` slots after its last one, so two rows
    per occurrence replace ``major`` replicated ones.
    """
    order = Window.partitionBy(*keys, "token").orderBy("slot")
    leave = F.col("slot") + major
    stop = F.least(leave, F.coalesce(F.lead("slot").over(order), leave))
    spans = counts.select(*keys, "slot", stop.alias("stop"))
    edge = lambda at, change: F.struct(F.col(at).alias("slot"), F.lit(change).cast("bigint").alias("change"))
    edges = spans.select(*keys, F.inline(F.array(edge("slot", 1), edge("stop", -1))))
    return edges.groupBy(*keys, "slot").agg(F.sum("change").alias("change"))


def window_table(counts: DataFrame, lo: int, hi: int, major: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per window: its length ``n``, vocabulary, slot totals and regression constants.

    ``logs[i]`` is ln(total_i + vocabulary) less its mean over the window.  The frame has one row
    per slot (and key), so the ordered windows below run over the calendar, never over posts.
    """
    totals = counts.groupBy(*keys, "slot").agg(F.sum("n").alias("total"))
    changes = vocab_changes(counts, major, keys)
    if keys:
        spine = totals.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("slot"))
    else:
        spine = slice_spine(counts.sparkSession, lo, hi)
    on = [*keys, "slot"]
    per_slot = spine.join(totals, on, "left").join(changes, on, "left").fillna(0, ["total", "change"])
    order = Window.partitionBy(*keys).orderBy("slot")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    trailing = order.rowsBetween(-(major - 1), Window.currentRow)
    windows = per_slot.select(
        *keys,
        F.col("slot").alias("win"),
        F.sum("change").over(running).alias("vocab"),
        F.collect_list("total").over(trailing).alias("totals"),
    ).filter("vocab > 0")
    return regression_constants(windows)


def regression_constants(windows: DataFrame) -> DataFrame:
    """Adds ``n``, ``logs``, ``sum_il`` and ``sum_ll`` to rows with ``totals`` and ``vocab``."""
    add = lambda column: F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x)
    raw = windows.withColumn("raw", F.transform("totals", lambda s: F.ln(s + F.col("vocab"))))
    raw = raw.withColumn("n", F.size("totals")).withColumn("mean_log", add(F.col("raw")) / F.col("n"))
    centred = raw.withColumn("logs", F.transform("raw", lambda x: x - F.col("mean_log"))).drop("raw")
    return centred.select(
        "*",
        add(F.transform("logs", lambda x, i: x * i)).alias("sum_il"),
        add(F.transform("logs", lambda x: x * x)).alias("sum_ll"),
    )


def burst_ranges(burst_slots: DataFrame, lo: int, major: int) -> DataFrame:
    """Slots with bursting terms, each reaching ``major`` slots back, merged into ranges.

    The ordered window sees at most one row per slot of the calendar.
    """
    start = F.greatest(F.col("slot") - major, F.lit(lo))
    spans = burst_slots.select("slot").distinct().select(start.alias("start"), "slot")
    order = Window.orderBy("slot")
    opens = F.when(F.col("start") > F.lag("slot").over(order) + 1, 1).otherwise(0)
    numbered = spans.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order))
    return numbered.groupBy("island").agg(F.min("start").alias("first_slot"), F.max("slot").alias("last_slot")).drop("island")
