"""Counts per slot and token."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from emberline.functions.timeslice import minor_slots, slot_of

FEW = 64  # posts of a user and slot that are compared with each other


def with_slots(posts: DataFrame, width: int, minor: int = 1) -> DataFrame:
    """One row per post and slot it counts for (column ``slot``)."""
    own = slot_of(F.col("created_at"), width)
    if minor == 1:
        return posts.withColumn("slot", own)
    return posts.withColumn("slot", F.explode(minor_slots(own, minor)))


def term_counts(
    posts: DataFrame, by: str = "user", keep_slots: bool = False, keys: tuple[str, ...] = (), parts: int | None = None
) -> DataFrame:
    """Distinct users (or posts) per slot and token: ``(*keys, slot, token, n)``.

    Whole posts meet by slot and user, not single tokens: a token that an earlier post of the same user and slot has is left out
    of the later ones, and what is left is counted without telling users apart.  Users with over ``FEW`` posts in a slot are told
    apart token by token.  Posts that are dealt by slot are not shuffled again.  With ``parts`` (``parts_for``) posts and
    then uses are dealt over so many partitions.  ``keep_slots`` adds a row with a null token for slots whose posts have no
    tokens, so that the time range is not lost.
    """
    who = "user_id" if by == "user" else "post_id"
    own = F.array_distinct("tokens")
    if keep_slots:
        own = F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(None).cast("string")))
    rows = posts.select(*keys, "slot", who, own.alias("tokens"))
    rows = rows.repartition(parts, *keys, "slot", who) if parts else rows
    group = Window.partitionBy(*keys, "slot", who)
    earlier = F.flatten(F.collect_list("tokens").over(group.rowsBetween(-FEW, -1)))
    met = rows.select("*", F.count("*").over(group).alias("posts"), earlier.alias("earlier"))
    few = F.col("posts") <= FEW
    left = F.when(few & (F.size("earlier") > 0), F.array_except("tokens", "earlier")).otherwise(F.col("tokens"))
    uses = met.select(*keys, "slot", who, few.alias("few"), F.explode(left).alias("token"))
    uses = uses.repartition(parts, *keys, "slot", "token") if parts else uses
    told = F.when(F.col("few"), None).otherwise(F.col(who))
    n = F.count(F.when(F.col("few"), F.col(who))) + F.count_distinct(told)
    return uses.groupBy(*keys, "slot", "token").agg(n.alias("n"))


def minor_counts(
    posts: DataFrame, minor: int, by: str = "user", keep_slots: bool = False, keys: tuple[str, ...] = (), parts: int | None = None
) -> DataFrame:
    """``term_counts`` of posts that count for their own ``slot`` and the next ``minor - 1``.

    No post is copied: a user's use of a token holds from its slot up to the next use or the end of the minor window, which
    are two marks, +1 and -1. Marks are summed per token and slot, and a running sum over a token's slots gives the number of
    users between two marks. What is shuffled doesn't depend on ``minor``. ``parts`` is the number of partitions of uses and marks.
    """
    if minor == 1:
        return term_counts(posts, by, keep_slots, keys, parts)
    who = "user_id" if by == "user" else "post_id"
    unnest = F.explode_outer if keep_slots else F.explode
    rows = posts.select(*keys, "slot", who, unnest(F.array_distinct("tokens")).alias("token")).filter(F.col("slot").isNotNull() & F.col(who).isNotNull())
    deal = lambda df, *by: df.repartition(parts, *by) if parts else df.repartition(*by)
    uses = deal(rows, *keys, "token", who).distinct()  # dealt as the next step needs it
    end = F.col("slot") + minor
    stop = F.least(end, F.coalesce(F.lead("slot").over(Window.partitionBy(*keys, "token", who).orderBy("slot")), end))
    mark = lambda at, change: F.struct(F.col(at).alias("slot"), F.lit(change).cast("bigint").alias("change"))
    marks = uses.withColumn("stop", stop).select(*keys, "token", F.inline(F.array(mark("slot", 1), mark("stop", -1))))
    marks = deal(marks, *keys, "token") if parts else marks
    steps = marks.groupBy(*keys, "token", "slot").agg(F.sum("change").alias("change")).filter("change <> 0")
    line = Window.partitionBy(*keys, "token").orderBy("slot")
    running = steps.select(
        *keys,
        "token",
        F.col("slot").alias("first"),
        (F.lead("slot").over(line) - 1).alias("last"),
        F.sum("change").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("n"),
    )
    return running.filter("n > 0").select(*keys, F.explode(F.sequence("first", "last")).alias("slot"), "token", "n")


def slice_totals(counts: DataFrame) -> DataFrame:
    """Sum of counts per slot."""
    return counts.groupBy("slot").agg(F.sum("n").alias("total"))


def slice_profile(posts: DataFrame) -> DataFrame:
    """Posts and distinct tokens per slot."""
    tokens = posts.select("slot", F.explode(F.array_distinct("tokens")).alias("token"))
    per_token = tokens.groupBy("slot").agg(F.count_distinct("token").alias("tokens"))
    per_post = posts.groupBy("slot").agg(F.count("*").alias("posts"))
    return per_post.join(per_token, "slot", "left").fillna(0, ["tokens"])


def posts_per_slice(posts: DataFrame) -> DataFrame:
    """Size of each slot's group of posts, with its first and last post time."""
    return posts.groupBy("slot").agg(
        F.count("*").alias("posts"),
        F.count_distinct("user_id").alias("users"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
    )


def time_bounds(slotted: DataFrame) -> DataFrame:
    """First and last slot."""
    return slotted.agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))


def unigram_model(tokens: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences and log probability per token (and per ``keys``).

    The total is an aggregate of the counts, joined back on the keys: no window over all tokens.
    """
    counts = tokens.groupBy(*keys, "token").agg(F.count("*").alias("n"))
    if keys:
        joined = counts.join(counts.groupBy(*keys).agg(F.sum("n").alias("total")), list(keys))
    else:
        joined = counts.withColumn("total", counts.agg(F.sum("n")).scalar())
    return joined.select(*keys, "token", "n", (F.ln("n") - F.ln("total")).alias("log_p"))


def model_join(foreground: DataFrame, background: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Foreground tokens beside their counts and log probabilities in the background model."""
    back = background.select("token", F.col("n").alias("all_n"), F.col("log_p").alias("all_log_p"))
    return foreground.join(back, "token").select(*keys, "token", "n", "log_p", "all_n", "all_log_p")


def kl_gain(foreground: DataFrame, background: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Contribution of each foreground token to the divergence from the background model."""
    joined = model_join(foreground, background, keys)
    gain = F.exp("log_p") * (F.col("log_p") - F.col("all_log_p"))
    return joined.select(*keys, "token", "n", gain.alias("gain"))
