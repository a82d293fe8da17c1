"""Merging of term files and of feeds that report the same thing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from emberline.functions.text import strip_punct_tokens
from emberline.operators.novelty import HOT_KEY
from emberline.operators.overlap import comparable, first_pairs
from emberline.operators.sizing import at_most
from emberline.sources.scratch import stage

FEW_ENTRIES = 1_000  # rows for which far more conflicts are looked up

def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def merge_burst_terms(files) -> DataFrame:
    """Term files merged per date: of several scores for a token the first file's counts.

    ``files`` are ``(date, token, score)`` frames in order of precedence.
    """
    numbered = union_all(f.select("date", "token", "score", F.lit(i).alias("file")) for i, f in enumerate(files))
    return numbered.groupBy("date", "token").agg(F.min_by("score", "file").alias("score"))


def merge_slice_maps(per_slice: DataFrame) -> DataFrame:
    """Per-slot maps token → count, from long counts: ``(token, by_slot)``; a token's map has at
    most one entry per slot of the calendar."""
    return per_slice.groupBy("token").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("slot", "n")))).alias("by_slot")
    )


def distinct_tokens(posts: DataFrame) -> DataFrame:
    return posts.select(F.explode(F.array_distinct("tokens")).alias("token")).distinct()


def distinct_slices(slotted: DataFrame) -> DataFrame:
    return slotted.select("slot").distinct()


def merge_near_duplicates(feeds: DataFrame, threshold: float) -> DataFrame:
    """Rows a broker lets through that sees ``feeds`` in order of arrival.

    ``feeds`` is ``(arrival, feed, topic, post_id, text)``, ``arrival`` a number.  A row passes when
    its topic and id did not pass before and its text is less similar than ``threshold`` to every
    text that passed, whatever its topic.

    That is the lexicographically first maximal independent set of the conflict graph.  Similar rows are found block against
    block, so neither pairs nor keys are shuffled.  Of a row with very many conflicts only the earliest is kept, so a large group of near
    copies has about one edge per member; the rounds run over the table of edges alone.  Rows whose known conflicts all
    fell are looked up again, against what passed and what is open too.  Until the sets are compared, a token set stands as its SHA-256.
    """
    tokens = F.array_sort(F.array_distinct(strip_punct_tokens(F.col("text"))))  # no token has a space
    rows = feeds.select(F.struct("arrival", "feed", "topic", "post_id").alias("pos"), tokens.alias("tokens"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.array_join("tokens", " "), 256)))
    # Repeated deliveries, then copies under other ids.  A copy shares the fate "rejected" of the
    # first one unless the first fell to its own id, which takes an id with several texts.
    first = rows.groupBy("pos.topic", "pos.post_id", "key").agg(F.min("pos").alias("pos")).select("pos", "key")
    first = stage(first, "deliveries")
    texts = first.groupBy("pos.topic", "pos.post_id").agg(F.count("*").alias("n")).filter("n > 1")
    on = [F.col("pos.topic") == F.col("t.topic"), F.col("pos.post_id") == F.col("t.post_id")]
    several = first.join(texts.alias("t"), on, "left_semi").withColumn("several", F.lit(True))
    single = first.join(texts.alias("t"), on, "left_anti").groupBy("key").agg(F.min("pos").alias("pos"))
    sets = several.unionByName(single.withColumn("several", F.lit(False)))
    # From here on a row is a number that grows with its place in the order of arrival.
    sets = stage(sets.orderBy("pos").withColumn("id", F.monotonically_increasing_id()), "rows")
    texts = rows.select("key", "tokens").dropDuplicates(["key"]).join(sets.select("key", "id"), "key")
    texts = stage(texts.select("id", F.col("id").alias("pos"), "tokens", F.size("tokens").alias("size")), "sets")
    texts = comparable(texts).withColumn("node", F.col("id"))
    named = sets.filter("several").select("id", "pos.topic", "pos.post_id")
    passed = _first_independent(texts, stage(named, "named"), sets.select("id"), threshold)
    keys = ["arrival", "feed", "topic", "post_id"]
    return feeds.join(sets.join(passed, "id", "left_semi").select("pos.*"), keys, "left_semi").dropDuplicates(keys)


def _first_independent(sets: DataFrame, named: DataFrame, ids: DataFrame, floor: float) -> DataFrame:
    """Ids of the lexicographically first maximal independent set."""
    passed, asked = None, ids
    similar = _similar(sets, sets, floor, HOT_KEY)
    edges = _first_conflicts(similar, named, named)
    while True:
        verdicts = _decide(asked, edges, passed)
        kept = verdicts.filter("good").select("id")
        passed = kept if passed is None else stage(passed.unionByName(kept), "passed")
        asked = asked.join(verdicts, "id", "left_anti")
        if at_most(asked, 0):
            return passed
        asked = stage(asked, "undecided")
        live = passed.unionByName(asked)
        open_edges = similar.join(asked, "id", "left_semi")
        crowded = stage(open_edges.filter("more").select("id").distinct(), "crowded")
        known = open_edges.join(crowded, "id", "left_anti").join(live.withColumnRenamed("id", "other"), "other", "left_semi").select(similar.columns)
        if not at_most(crowded, 0):
            crowd = 100 * HOT_KEY if at_most(crowded, FEW_ENTRIES) else HOT_KEY
            known = known.unionByName(_similar(sets.join(crowded, "id", "left_semi"), sets.join(live, "id", "left_semi"), floor, crowd))
        similar = stage(known, "similar")
        edges = _first_conflicts(similar, named.join(asked, "id", "left_semi"), named.join(live, "id", "left_semi"))


def _similar(asked: DataFrame, present: DataFrame, floor: float, crowd: int) -> DataFrame:
    """``(id, other, more)``: conflicts of sets with earlier ones; with ``more`` later ones may exist."""
    return stage(first_pairs(asked, present, floor, crowd).withColumnRenamed("node", "id"), "similar")


def _decide(ids: DataFrame, edges: DataFrame, passed: DataFrame | None) -> DataFrame:
    """``(id, good)`` of the rows that their known conflicts decide.

    A row passes once all its conflicts have fallen and no others can exist, and falls once one of them has passed.
    """
    free = ids.join(edges.select("id").distinct(), "id", "left_anti").select("id", F.lit(True).alias("good"))
    verdicts, decided = stage(free, "verdicts"), -1
    while (count := verdicts.count()) > decided:
        known = verdicts if passed is None else verdicts.unionByName(passed.select("id", F.lit(True).alias("good")))
        met = edges.join(known.withColumnRenamed("id", "other"), "other", "left")
        facts = met.groupBy("id").agg(
            F.bool_or(F.coalesce("good", F.lit(False))).alias("hit"), F.bool_and(F.coalesce(~F.col("good"), F.lit(False)) & ~F.col("more")).alias("clear")
        )
        verdicts, decided = stage(free.unionByName(facts.filter("hit or clear").select("id", F.col("clear").alias("good"))), "verdicts"), count
    return verdicts


def _first_conflicts(similar: DataFrame, asked_named: DataFrame, present_named: DataFrame) -> DataFrame:
    """``(id, other, more)`` conflicts of the asked rows with earlier ones; ``more`` says that later ones may exist.

    They are the similar rows and the earliest row with the same id.
    """
    heads = present_named.groupBy("topic", "post_id").agg(F.min("id").alias("other"))
    met = asked_named.join(heads, ["topic", "post_id"]).filter(F.col("other") < F.col("id")).select("id", "other")
    part = similar.filter("more").select("id").unionByName(met.select("id")).distinct().withColumn("more", F.lit(True))
    edges = similar.select("id", "other").unionByName(met).distinct().join(part, "id", "left")
    return stage(edges.select("id", "other", F.coalesce("more", F.lit(False)).alias("more")), "conflicts")
