"""Streaming jobs: chained queries with tables in a shared folder between them.

Every table is partitioned by the slot or window its rows belong to, and a step replaces the partitions it
works out. A repeated batch therefore leaves the same files, the number of files depends on the calendar and not on
the number of triggers, and a step reads only the slots within its windows, however old the job is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.conf import BurstConf
from emberline.functions.similarity import jaccard
from emberline.functions.timeslice import slot_of
from emberline.operators.counts import minor_counts
from emberline.operators.filters import filter_term_length
from emberline.operators.folds import burst_levels
from emberline.operators.matching import keep_max_hits, listed_hits
from emberline.operators.novelty import max_similarity, token_sets
from emberline.operators.overlap import comparable
from emberline.operators.scores import burst_scores
from emberline.operators.select import best_terms, select_posts, top_per_group
from emberline.operators.sizing import broadcast_if_small
from emberline.operators.windows import slot_range
from emberline.sources import sinks
from emberline.sources.scratch import stage
from emberline.streaming.prepare import repost_prepare, stream_prepare
from emberline.streaming.state import decide_thresholds, keyed_state, read_histories, term_histories

COUNTS = "topic_id string, token string, n bigint, slot bigint"
PROGRESS = "first_slot bigint, last_slot bigint, closed bigint"
POSTS = "topic_id string, post_id bigint, user_id bigint, created_at timestamp, text string, tokens array<string>, own bigint, batch bigint"
LEVELS = "topic_id string, win bigint, low bigint, high bigint, n bigint"
SCORES = "topic_id string, token string, score double, win bigint"
CANDIDATES = "topic_id string, post_id bigint, created_at timestamp, text string, tokens array<string>, hits bigint, near double, win bigint"
DELIVERED = "topic_id string, post_id bigint, text string, tokens array<string>, sim double, hits bigint, win bigint"
TERMS = "topic_id string, token string, score double, threshold double, win bigint"
THRESHOLDS = "topic_id string, threshold double"
CHANGES = "topic_id string, bursts bigint, old_threshold double, new_threshold double, win bigint"


class Memory:
    """Tables of a streaming job in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def append(self, name: str, batch: int, df: DataFrame) -> None:
        """Rows that belong to a batch number; a repeated batch replaces its own."""
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def replace(self, name: str, df: DataFrame, *by: str) -> None:
        """Replaces those partitions of a table that ``df`` has rows for."""
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*by).parquet(f"{self.folder}/{name}")

    def _there(self, path: str) -> bool:
        """Whether a folder exists; answered by the storage itself, without listing anything."""
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(place)

    def _load(self, name: str, schema: str, paths: list[str]) -> DataFrame:
        found = [path for path in paths if self._there(path)]
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*found)

    def between(self, name: str, schema: str, by: str, low: int, high: int) -> DataFrame:
        """The partitions of a range of slots; no other one is listed or read."""
        return self._load(name, schema, [f"{self.folder}/{name}/{by}={slot}" for slot in range(low, high + 1)])

    def all(self, name: str, schema: str) -> DataFrame:
        return self._load(name, schema, [f"{self.folder}/{name}"])

    def of_batch(self, name: str, schema: str, batch: int) -> DataFrame:
        return self._load(name, schema, [f"{self.folder}/{name}/batch={batch}"])

    def read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        table = self.all(name, f"{schema}, batch bigint")
        return (table if before is None else table.filter(F.col("batch") < before)).drop("batch")


def start(df: DataFrame, step, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts ``step(batch, number)`` on a stream; offsets and state live in ``checkpoint``."""
    writer = df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "60 seconds"})).start()


# --- term history and scores ----------------------------------------------------------------

def keep_histories(counts: DataFrame, keep: int, width: int, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the counts of every token's last ``keep`` closed slots as keyed state.

    ``counts`` is ``stream_counts`` without keys and with its time.  What a trigger touched goes to the table ``touched``.
    """

    def step(batch: DataFrame, number: int) -> None:
        Memory(batch.sparkSession, folder).append("touched", number, batch)

    with keyed_state(counts.sparkSession):
        return start(term_histories(counts, keep, width), step, f"{folder}/checkpoint", trigger)


def term_history(spark: SparkSession, folder: str, keep: int, operator: int = 0) -> DataFrame:
    """Counts of the last ``keep`` closed slots; tokens not used in them are gone.

    ``operator`` is the number of the history among the query's stateful operators.
    """
    kept = stage(read_histories(spark, f"{folder}/checkpoint", operator), "histories")
    newest = kept.agg(F.max("slot")).scalar()
    return kept.filter(F.col("slot") > newest - keep)


def score_closed(history: DataFrame, major: int, keys: tuple[str, ...] = ("topic_id",), key_rows: int = 1) -> DataFrame:
    """Scores of the window that ends with the last closed slot."""
    bounds = slot_range(history)
    if bounds is None:
        return history.select(*keys, F.col("slot").alias("win"), "token", F.lit(0.0).alias("score"))
    hi = bounds[1]
    recent = history.filter(F.col("slot") > hi - major)
    return burst_scores(recent, max(bounds[0], hi - major + 1), hi, major, "full", keys=keys, key_rows=key_rows)


# --- the burst job --------------------------------------------------------------------------

def closed_candidates(posts: DataFrame, terms: DataFrame, conf: BurstConf) -> DataFrame:
    """Candidates of closed windows, all windows at once: ``CANDIDATES``.

    Per topic and window the posts of the minor window with most bursting terms; ``near`` is the largest similarity with an
    earlier one of them.  Of equal token sets only the earliest post is a candidate.  Nothing here depends on what was delivered.
    """
    group = ("topic_id", "win")
    slots = posts.withColumn("slot", F.col("own"))
    hits = stage(listed_hits(slots, terms, conf.minor, ("topic_id",)), "hits")
    best = broadcast_if_small(stage(keep_max_hits(hits, group), "best"))
    searched = posts.withColumn("win", F.explode(F.sequence("own", F.col("own") + (conf.minor - 1))))
    rows = searched.join(best, [*group, "post_id"]).dropDuplicates([*group, "post_id"])
    rows = stage(rows.select("*", F.struct(*group, "post_id").alias("id"), F.struct("created_at", "post_id").alias("pos")), "most-hits")
    sets = comparable(stage(token_sets(rows, group), "sets"))
    firsts = rows.join(sets.select("id"), "id", "left_semi")
    near = firsts.join(max_similarity(firsts, sets, 0.0, group), "id", "left").fillna(0.0, ["sim"])
    return near.select("topic_id", "post_id", "created_at", "text", "tokens", "hits", F.col("sim").alias("near"), "win")


def choose_closed(candidates: DataFrame, delivered: DataFrame, conf: BurstConf) -> DataFrame:
    """Posts one closed window delivers: ``(topic_id, win, post_id, text, tokens, sim, hits)``.

    Candidates that resemble a delivered post or an earlier candidate are out; the least similar ones are taken, per topic.
    """
    ids = ["topic_id", "post_id"]
    old = delivered.select("topic_id", F.col("tokens").alias("__old"))
    seen = candidates.join(old, "topic_id").groupBy(*ids).agg(F.max(jaccard(F.col("tokens"), F.col("__old"))).alias("__seen"))
    fresh = candidates.join(delivered.select(*ids), ids, "left_anti").join(seen, ids, "left").fillna(0.0, ["__seen"])
    novel = fresh.filter("__seen < 1").withColumn("sim", F.greatest("near", "__seen")).filter(F.col("sim") <= conf.sim_threshold)
    chosen = top_per_group(novel, ("topic_id",), [F.asc("sim"), F.col("created_at"), F.col("post_id")], conf.per_window_max)
    return chosen.select("topic_id", "win", "post_id", "text", "tokens", "sim", "hits")


def select_closed(
    posts: DataFrame, terms: DataFrame, delivered: DataFrame, win: int, conf: BurstConf
) -> DataFrame:
    """``choose_closed`` among the candidates of one closed window."""
    found = closed_candidates(posts, terms.filter(F.col("win") == win), conf)
    found = broadcast_if_small(stage(found, "closed-candidates"))  # delivered posts stay where they are, a topic's don't meet
    return choose_closed(found, delivered, conf)


def count_step(conf: BurstConf, folder: str, late_slots: int = 0, topics: int = 1):
    """Step of the burst job over prepared posts (one row per post and topic).

    A slot closes once a post ``late_slots`` + 1 slots later has arrived; posts that come later than that
    are not counted.  Counts and scores are worked out once per slot, from the posts of the minor window and
    the counts of the major one.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        memory = Memory(spark, folder)
        rows = batch.select("topic_id", "post_id", "user_id", "created_at", "text", "tokens").filter("created_at is not null")
        rows = rows.withColumn("own", slot_of(F.col("created_at"), conf.width)).withColumn("batch", F.lit(number).cast("bigint"))
        seen = Observation()
        memory.replace("posts", rows.observe(seen, F.min("own").alias("first"), F.max("own").alias("last")), "own", "batch")
        past = memory.of_batch("progress", PROGRESS, number - 1).first() if number else None
        added = [seen.get["first"], seen.get["last"]]
        slots = [x for x in (*added, *([past.first_slot, past.last_slot] if past else [])) if x is not None]
        if not slots:
            return memory.append("progress", number, spark.createDataFrame([(None, None, None)], PROGRESS))
        first, last = min(slots), max(slots)
        done = past.closed if past and past.closed is not None else first - 1
        closed = max(last - 1 - late_slots, done)
        if closed > done:
            near = memory.between("posts", POSTS, "own", done + 2 - conf.minor, closed)
            counted = minor_counts(near.withColumn("slot", F.col("own")), conf.minor, keys=("topic_id",))
            memory.replace("counts", counted.filter(F.col("slot").between(done + 1, closed)), "slot")
        win = max(done + 1, first + conf.major - 1)
        if win <= closed:
            low = win - conf.major + 1
            cells = memory.between("counts", COUNTS, "slot", low, closed)
            scores = burst_scores(cells, low, closed, conf.major, "full", keys=("topic_id",), key_rows=topics)
            memory.replace("scores", scores, "win")
            scores = memory.between("scores", SCORES, "win", win, closed)
            levels = burst_levels(scores, conf.burst_threshold, conf.threshold_modifier, conf.burst_term_length)
            # One file, so that the next query sees a window's counts all at once.
            memory.append("levels", number, levels.withColumnRenamed("step", "win").coalesce(1))
        memory.append("progress", number, spark.createDataFrame([(first, last, closed)], PROGRESS))

    return step


def deliver_step(conf: BurstConf, folder: str, publish: "Outputs | None" = None):
    """Step of the burst job over decided windows ``(topic_id, win, bursts, level, next_level)``.

    Terms and candidates of all windows are found in one go; only the choice among a window's candidates goes window by window,
    because each is compared with what the earlier ones delivered.
    """

    def step(batch: DataFrame, number: int) -> None:
        memory = Memory(batch.sparkSession, folder)
        decided = stage(batch, "decided")
        wins = sorted(r.win for r in decided.select("win").distinct().collect())
        if not wins:
            return
        value = lambda level: F.pow(F.lit(conf.burst_threshold), F.pow(F.lit(conf.threshold_modifier), F.col(level)))
        limits = decided.select("topic_id", "win", value("level").alias("threshold"))
        changed = decided.filter("level <> next_level")
        old, new = value("level").alias("old_threshold"), value("next_level").alias("new_threshold")
        memory.replace("changes", changed.select("topic_id", "bursts", old, new, "win"), "win")
        scores = memory.between("scores", SCORES, "win", wins[0], wins[-1])
        terms = filter_term_length(scores.join(F.broadcast(limits), ["topic_id", "win"]), conf.burst_term_length)
        terms = terms.filter(F.col("score") > F.col("threshold"))
        if conf.search_terms is not None:
            terms = best_terms(terms, conf.search_terms, ("topic_id", "win"))
        memory.replace("terms", terms.select("topic_id", "token", "score", "threshold", "win"), "win")
        terms = memory.between("terms", TERMS, "win", wins[0], wins[-1])
        searched = sorted(r.win for r in terms.select("win").distinct().collect())
        if searched:
            posts = memory.between("posts", POSTS, "own", searched[0] - conf.minor + 1, searched[-1]).drop("batch")
            memory.replace("candidates", closed_candidates(posts, terms, conf), "win")
        for win in searched:
            candidates = memory.between("candidates", CANDIDATES, "win", win, win)
            if conf.horizon is None:
                delivered = memory.all("delivered", DELIVERED).filter(F.col("win") < win)
            else:
                delivered = memory.between("delivered", DELIVERED, "win", win - conf.horizon + 1, win - 1)
            chosen = choose_closed(candidates, delivered, conf)
            memory.replace("delivered", chosen.select("topic_id", "post_id", "text", "tokens", "sim", "hits", "win").coalesce(1), "win")
        if publish:
            publish.write(memory, wins, conf)

    return step


@dataclass(frozen=True)
class Outputs:
    """Where and how a burst job publishes what it decides: one file per kind and window.

    A window that is decided again replaces its own files.
    """

    folder: str
    address: str = ""
    client: str = ""

    def write(self, memory: Memory, wins: list[int], conf: BurstConf) -> None:
        span = "win", wins[0], wins[-1]
        delivered = memory.between("delivered", DELIVERED, *span)
        rows = delivered.withColumn("topic", F.col("topic_id")).withColumn("part", F.col("win"))
        sinks.write_parts(sinks.selected_rows(rows, conf.width, "part"), f"{self.folder}/selected")
        terms = memory.between("terms", TERMS, *span).withColumn("part", F.col("win"))
        sinks.write_parts(sinks.burst_log_rows(terms, conf.width, "part"), f"{self.folder}/terms")
        changes = memory.between("changes", CHANGES, *span).withColumn("part", F.col("win"))
        sinks.write_parts(sinks.threshold_log_rows(changes, conf.width, "win", "part"), f"{self.folder}/thresholds")
        if self.address:
            payload = sinks.delivery_payload(delivered.withColumn("part", F.col("win")), self.address, self.client, "part")
            sinks.write_parts(payload, f"{self.folder}/payload")


class BurstJob:
    """The burst job's two queries: one counts and scores closed slots, the other decides and delivers.

    With a trigger that works off what is there (``availableNow``), the second starts when the first has ended.
    """

    def __init__(self, posts, topics, conf: BurstConf, folder: str, late_slots: int, trigger: dict | None, publish):
        spark = self.spark = posts.sparkSession
        self.conf, self.folder, self.trigger, self.publish = conf, folder, trigger, publish
        memory = Memory(spark, folder)
        if not memory._there(f"{folder}/levels"):  # the second query can't start on a missing folder
            memory.append("levels", -1, spark.createDataFrame([], LEVELS))
        step = count_step(conf, folder, late_slots, topics.count())
        self.queries = [start(stream_prepare(posts, topics, conf), step, f"{folder}/checkpoint/counts", trigger)]
        self.finite = bool(trigger) and (trigger.get("availableNow") or trigger.get("once"))
        if not self.finite:
            self.queries.append(self._deliver())

    def _deliver(self) -> StreamingQuery:
        reader = self.spark.readStream.schema(LEVELS).option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
        with keyed_state(self.spark):
            decided = decide_thresholds(reader.parquet(f"{self.folder}/levels"), self.conf.major)
            step = deliver_step(self.conf, self.folder, self.publish)
            return start(decided, step, f"{self.folder}/checkpoint/decisions", self.trigger)

    def awaitTermination(self) -> None:
        self.queries[0].awaitTermination()
        if self.finite and len(self.queries) == 1:
            self.queries.append(self._deliver())
        self.queries[1].awaitTermination()

    def stop(self) -> None:
        for running in self.queries:
            running.stop()


def burst_stream(
    posts: DataFrame,
    topics: DataFrame,
    conf: BurstConf,
    folder: str,
    late_slots: int = 0,
    trigger: dict | None = None,
    publish: Outputs | None = None,
) -> BurstJob:
    """Bursting terms and novel posts per topic, from a stream of posts."""
    return BurstJob(posts, topics, conf, folder, late_slots, trigger, publish)


def burst_results(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Delivered posts and bursting terms of a burst job."""
    memory = Memory(spark, folder)
    return memory.all("delivered", DELIVERED), memory.all("terms", TERMS)


def burst_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Threshold changes of a burst job, as the burst log takes them."""
    return Memory(spark, folder).all("changes", CHANGES)


# --- the repost job -------------------------------------------------------------------------

def repost_step(conf: BurstConf, folder: str):
    """Step of the repost job: per topic the batch's most reposted posts, if they are new."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        memory = Memory(spark, folder)
        topic = ("topic_id",)
        limits = memory.read("thresholds", THRESHOLDS, before=number).groupBy(*topic).agg(F.max("threshold").alias("threshold"))
        base = F.lit(float(conf.repost_threshold))
        rows = batch.join(limits, list(topic), "left").withColumn("threshold", F.coalesce("threshold", base))
        rows = stage(rows.filter(F.col("orig_repost_count") >= F.col("threshold")), "reposts")
        crowded = rows.groupBy(*topic, "threshold").agg(F.count("*").alias("n")).filter("n > 10")
        memory.append("thresholds", number, crowded.select("topic_id", (F.col("threshold") * 10).alias("threshold")))
        best = keep_max_hits(rows, topic, "orig_repost_count")
        delivered = memory.read("delivered", DELIVERED, before=number)
        fresh = best.join(delivered.select("topic_id", "post_id"), ["topic_id", "post_id"], "left_anti")
        fresh = fresh.dropDuplicates(["topic_id", "post_id"])
        ident = F.struct("topic_id", "post_id")
        fresh = stage(fresh.select("*", ident.alias("id"), F.struct(F.lit(1).alias("age"), "created_at", "post_id").alias("pos")), "fresh")
        zero = F.lit(None).cast("timestamp").alias("created_at")
        history = delivered.select("topic_id", "tokens", ident.alias("id"), F.struct(F.lit(0).alias("age"), zero, "post_id").alias("pos"))
        chosen = select_posts(fresh, conf.sim_threshold, conf.per_window_max, "novel_first", topic, topic, history)
        out = fresh.join(chosen.select("id"), "id").select(
            "topic_id",
            F.lit(number).cast("bigint").alias("win"),
            "post_id",
            "text",
            "tokens",
            F.lit(None).cast("double").alias("sim"),
            F.col("orig_repost_count").alias("hits"),
        )
        memory.append("delivered", number, out)

    return step


def repost_stream(
    posts: DataFrame, topics: DataFrame, conf: BurstConf, folder: str, trigger: dict | None = None
) -> StreamingQuery:
    """The most reposted novel posts per topic, from a stream of posts."""
    return start(repost_prepare(posts, topics, conf), repost_step(conf, folder), f"{folder}/checkpoint", trigger)
