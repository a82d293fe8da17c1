"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's share of the mix follows its weight, up to ``max_epochs`` times its own size; what a capped
source can't take is shared again by weight (`source_targets`). Every document gets an exponential key
-ln(u) / w from a uniform number of its id and a quality weight w. A source first contributes complete
epochs; the rest of its target is filled in order of the keys, up to the document whose middle is the
last within the budget. That cut is found by sums over two levels of key buckets and an exact running
sum inside one bucket, so no task sorts a whole source; documents are then compared with their
source's cut, and no text is ever shuffled.

Defined cases: a null or blank text has size 0 and is taken with 0 words; a null source is a source of
its own, sorted last; a null id draws one fixed number; rows that agree in id and size are taken or left
together; an empty table gives an empty table; `mix` keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.llm.text import words
from emberline.operators.sizing import broadcast_if_small
from emberline.sources.scratch import stage

FINE = 1 << 20
COARSE = 1 << 10
ADDED = "size weight key bucket source_size target copies taken".split()


def uniform(doc_id: Column, seed: str = "mix") -> Column:
    """A number in (0, 1) that depends on the id and the seed only (52 bits of their MD5)."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    bits = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def quality_weight(size: Column, n_symbols: Column) -> Column:
    """Between 0 and 1: short texts and texts full of markup symbols are drawn later."""
    return (F.lit(0.5) + F.least(size, F.lit(100)) / 200.0) / (1.0 + 4.0 * n_symbols / F.greatest(size, F.lit(1)))


def with_keys(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Adds size, weight, key and the key's bucket (ascending with the key)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))
    sized = docs.drop(*ADDED).withColumn("size", F.size(words(F.col("text"))).cast("bigint"))
    return (
        sized.withColumn("weight", quality_weight(F.col("size"), symbols))
        .withColumn("key", -F.log(uniform(F.col("doc_id"), seed)) / F.col("weight"))
        .withColumn("bucket", F.least(F.floor((1.0 - F.exp(-F.col("key"))) * FINE), F.lit(FINE - 1)).cast("bigint"))
    )


def source_targets(keyed: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target): shares by weight, capped, the excess shared again until it fits.

    With the sources in order of cap / weight, the level L = (rest of the total) / (rest of the weights)
    that first doesn't exceed a source's own cap / weight is the common level of all uncapped sources.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    share = F.element_at(F.lit(list(weights)), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("share", share).withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("share"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    levels = ranked.withColumn(
        "level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("share").over(rest)
    ).withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("cap") / F.col("share") >= F.col("level"), F.col("place"))
    common = F.min_by("level", fits).over(Window.partitionBy(F.lit(1)))
    return levels.withColumn("common", common).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("common") * F.col("share")).alias("target")
    )


def _crossing(sums: DataFrame, by: str) -> DataFrame:
    """Per source the last bucket that begins within the budget, and the words before it."""
    running = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum("words").over(running), F.lit(0)) + F.col("start")
    within = sums.withColumn("begun", begun).filter(F.col("begun") <= F.col("budget"))
    return within.groupBy("source").agg(F.max(F.struct(by, "begun")).alias("last")).select(
        "source", F.col(f"last.{by}").alias(by), F.col("last.begun").alias("start")
    )


def mixing_plan(keyed: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Per source: size, target, complete epochs, and the cut up to which its documents come once more.

    ``keyed`` is read several times; pass a staged table of (doc_id, source, size, key, bucket).
    """
    coarse = (F.col("bucket") / COARSE).cast("bigint")
    targets = source_targets(keyed, weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("epochs", epochs.cast("bigint"))
    targets = stage(targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")

    def of_source(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "_source")
        return left.join(broadcast_if_small(right), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    budgets = targets.select("source", "budget")
    sums = keyed.groupBy("source", coarse.alias("coarse")).agg(F.sum("size").alias("words"))
    first = _crossing(of_source(sums.withColumn("start", F.lit(0)), budgets), "coarse")
    first = stage(of_source(first, budgets), "mix-coarse")
    inside = of_source(keyed.withColumn("_coarse", coarse), first).filter(F.col("_coarse") == F.col("coarse"))
    sums = inside.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("start").alias("start"), F.first("budget").alias("budget"))
    second = stage(of_source(_crossing(sums, "bucket").withColumnRenamed("bucket", "cut_bucket"), budgets), "mix-fine")
    last = of_source(keyed, second).filter(F.col("bucket") == F.col("cut_bucket"))
    order = Window.partitionBy("source").orderBy("key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_id", _id()).withColumn("_before", F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("start"))
    taken = last.filter(2 * F.col("_before") + F.col("size") <= 2 * F.col("budget"))
    cuts = taken.groupBy("source").agg(F.max(F.struct("key", "_id", "size")).alias("cut"))
    ends = second.select(F.col("source").alias("_s"), "cut_bucket")
    cuts = ends.join(cuts, F.col("_s").eqNullSafe(F.col("source")), "left").drop("source")
    plan = targets.drop("budget").join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return stage(plan, "mix-plan")


def _id() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))


def take(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target, copies (times the document is in the mix) and taken words."""
    per_source = plan.withColumnRenamed("source", "_source")
    own = F.struct(F.col("key"), _id().alias("_id"), F.col("size"))
    again = (F.col("bucket") < F.col("cut_bucket")) | ((F.col("bucket") == F.col("cut_bucket")) & F.coalesce(own <= F.col("cut"), F.lit(False)))
    joined = keyed.join(broadcast_if_small(per_source), F.col("source").eqNullSafe(F.col("_source")))
    copies = F.col("epochs") + F.coalesce(again, F.lit(False)).cast("bigint")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop(
        "_source", "epochs", "cut_bucket", "cut"
    )


def slim(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The staged table of ids, sources, sizes and keys that a plan is made from."""
    return stage(with_keys(docs.select("doc_id", "text", "source"), seed).drop("text", "weight"), "mix-keys")


def mix_digest(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes."""
    keyed = slim(docs)
    return take(keyed, mixing_plan(keyed, weights, max_epochs)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    plan = mixing_plan(slim(docs), weights, max_epochs)
    whole = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = take(with_keys(whole), plan).filter(F.col("copies") > 0)
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
