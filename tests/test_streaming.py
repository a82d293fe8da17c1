"""The burst job on one batch, on several, repeated and restarted; keyed state and what a trigger reads and writes."""

import glob
import os


import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline.conf import BurstConf
from emberline.sources.tables import posts_from_tables
from emberline.sources.topics import topics_frame
from emberline.operators import folds
from emberline.streaming import jobs, prepare, state

FOLDER = "/root/testdata/sf0.001"
CONF = BurstConf(width=4 * 86400, minor=1, major=2, burst_threshold=0.02, per_window_max=2, spam_terms=("worthless",), max_hashtags=5)


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Posts in three files, in order of time."""
    folder = tmp_path_factory.mktemp("posts")
    posts = posts_from_tables(spark, FOLDER).cache()
    edges = [F.timestamp_seconds(F.lit(x)) for x in posts.agg(F.percentile_approx(F.unix_seconds("created_at"), [0.4, 0.7])).first()[0]]
    pieces = posts.filter(F.col("created_at") < edges[0]), posts.filter((F.col("created_at") >= edges[0]) & (F.col("created_at") < edges[1])), posts.filter(F.col("created_at") >= edges[1])
    for number, piece in enumerate(pieces):
        piece.coalesce(1).write.parquet(f"{folder}/part={number}")
    return str(folder), posts.schema


def results(spark, folder):
    delivered, terms = jobs.burst_results(spark, folder)
    changes = jobs.burst_changes(spark, folder)
    return (
        sorted(tuple(r) for r in delivered.select("topic_id", "win", "post_id").collect()),
        sorted((r.topic_id, r.win, r.token, round(r.score, 9)) for r in terms.collect()),
        sorted((r.topic_id, r.win, r.bursts, round(r.new_threshold, 9)) for r in changes.collect()),
    )


def topics(spark):
    return topics_frame(spark, [("T1", "the OR and OR thon OR ther", []), ("T2", "le OR que OR der", [])])


def run(spark, source, schema, memory, conf=CONF, publish=None):
    """Works off what is in ``source``; called again it goes on from the checkpoint."""
    job = jobs.burst_stream(spark.readStream.schema(schema).parquet(source), topics(spark), conf, memory, trigger={"availableNow": True}, publish=publish)
    job.awaitTermination()


def files(folder):
    return sorted(f.rsplit("/", 1)[0].removeprefix(folder) for f in glob.glob(f"{folder}/**/part-*", recursive=True))


@pytest.fixture(scope="module")
def whole(spark, parts, tmp_path_factory):
    """The job over all posts in one batch."""
    folder, schema = parts
    memory = str(tmp_path_factory.mktemp("whole"))
    run(spark, f"{folder}/part=*", schema, memory, publish=jobs.Outputs(f"{memory}/out", "http://broker", "me"))
    return memory


def test_batches_and_restarts_give_the_same_rows(spark, parts, whole, tmp_path):
    folder, schema = parts
    source, memory = str(tmp_path / "in"), str(tmp_path / "split")
    out = jobs.Outputs(f"{memory}/out", "http://broker", "me")
    for number in range(3):  # every part is one run of both queries, started again from their checkpoints
        spark.read.schema(schema).parquet(f"{folder}/part={number}").coalesce(1).write.mode("append").parquet(source)
        run(spark, source, schema, memory, publish=out)
    one, several = results(spark, whole), results(spark, memory)
    assert one[0] and one[1] and one == several
    assert files(f"{whole}/out") == files(f"{memory}/out")  # as many files for three triggers as for one


def test_a_repeated_batch_leaves_the_same_files(spark, parts, whole, tmp_path):
    folder, schema = parts
    memory = str(tmp_path / "again")
    prepared = jobs.stream_prepare(spark.read.schema(schema).parquet(folder), topics(spark), CONF)
    step = jobs.count_step(CONF, memory, topics=2)
    step(prepared, 0)
    before = {t: files(f"{memory}/{t}") for t in ("posts", "counts", "scores", "levels")}
    step(prepared, 0)
    assert before == {t: files(f"{memory}/{t}") for t in before}
    levels = spark.read.schema(jobs.LEVELS).parquet(f"{memory}/levels")
    value = folds.fold_burst_levels(levels.withColumnRenamed("win", "step"), CONF.burst_threshold, CONF.threshold_modifier, CONF.major)
    assert sorted((r.topic_id, r.win, r.bursts, round(r.new_threshold, 9)) for r in value.collect()) == results(spark, whole)[2]


def test_published_files(spark, whole):
    delivered, terms, changes = (len(x) for x in results(spark, whole))
    rows = {kind: spark.read.option("recursiveFileLookup", True).csv(f"{whole}/out/{kind}", escape='"').count() for kind in ("selected", "payload", "terms", "thresholds")}
    assert rows == {"selected": delivered, "payload": delivered, "terms": terms, "thresholds": changes}


def test_a_trigger_reads_its_own_slots_only(spark, parts, whole, tmp_path, monkeypatch):
    folder, schema = parts
    memory, read = str(tmp_path / "level"), []
    load = jobs.Memory._load
    monkeypatch.setattr(jobs.Memory, "_load", lambda self, name, kind, paths: read.append((name, paths)) or load(self, name, kind, paths))
    for number in range(3):
        rows = jobs.stream_prepare(spark.read.schema(schema).parquet(f"{folder}/part={number}"), topics(spark), CONF)
        jobs.count_step(CONF, memory, topics=2)(rows, number)
    assert all(name == "progress" or "=" in path.rsplit("/", 1)[1] for name, paths in read for path in paths)
    posts = [len(paths) for name, paths in read if name == "posts"]
    slots = len(os.listdir(f"{memory}/counts")) - 2
    assert sum(posts) <= slots + 3  # every slot's posts are read once
    assert jobs.Memory(spark, memory).between("posts", jobs.POSTS, "own", 1, 5).count() == 0


def test_horizon_and_search_terms_bound_the_work(spark, parts, tmp_path):
    folder, schema = parts
    memory = str(tmp_path / "few")
    run(spark, f"{folder}/part=*", schema, memory, CONF.with_(search_terms=2, horizon=1))
    _, terms = jobs.burst_results(spark, memory)
    assert max(r["count"] for r in terms.groupBy("topic_id", "win").count().collect()) <= 2


class Store:
    """A keyed state outside of Spark."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    getListState = getValueState
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    listTimers = lambda self: list(self.timers)
    registerTimer = lambda self, at: self.timers.append(at)
    deleteTimer = lambda self, at: self.timers.remove(at)

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None


def decided(processor, rows):
    frame = pd.DataFrame(rows, columns=["win", "low", "high", "n"])
    return [tuple(r)[1:] for part in processor.handleInputRows(("T",), iter([frame]), None) for r in part.itertuples(index=False)]


def test_threshold_state_rises_eases_and_ignores_repeats():
    store, processor = Store(), state.BurstThreshold(major=1)
    processor.init(store)
    assert decided(processor, [(1, 0, 1, 11), (1, 0, 0, 50)]) == [(1, 11, 0, 1)]
    assert decided(processor, [(1, 0, 1, 11)]) == []  # written twice
    assert decided(processor, [(3, 0, 1, 9), (2, 0, 2, 4)]) == [(2, 4, 1, 1), (3, 0, 1, 1)]  # in order of windows
    assert decided(processor, [(4, 0, 0, 1), (5, 0, 0, 1)]) == [(4, 0, 1, 1), (5, 0, 1, 0)]  # three quiet windows
    assert decided(processor, [(6, 0, 0, 1)]) == [(6, 0, 0, 0)] and store.value == (0, 4, 6, 6)  # not below the base


def test_term_history_is_bounded_and_dropped():
    store, processor = Store(), state.TermHistory(keep=5, width=10)
    processor.init(store)
    for slot in range(40):
        frame = pd.DataFrame({"slot": [slot], "n": [slot + 1]})
        (row,) = processor.handleInputRows(("t",), iter([frame]), None)
        assert len(store.value) <= 5 and store.timers == [(slot + 6) * 10_000] and row["kept"][0] == len(store.value)
    assert store.value == [(s, s + 1) for s in range(35, 40)]
    (row,) = processor.handleExpiredTimer(("t",), None, None)
    assert store.value is None and row["kept"][0] == 0


def test_term_history_on_a_stream(spark, parts, tmp_path):
    folder, schema = parts
    source, memory = str(tmp_path / "in"), str(tmp_path / "history")
    conf = CONF.with_(width=86400)
    for number in range(3):
        spark.read.schema(schema).parquet(f"{folder}/part={number}").coalesce(1).write.mode("append").parquet(source)
        rows = spark.readStream.schema(schema).parquet(source).withColumn("tokens", F.array("lang", "source"))
        counts = prepare.stream_counts(rows, conf, "1 day", keys=(), timed=True)
        jobs.keep_histories(counts, 4, conf.width, memory, {"availableNow": True}).awaitTermination()
    kept = jobs.term_history(spark, memory, 4)
    posts = spark.read.schema(schema).parquet(folder).withColumn("slot", F.floor(F.unix_seconds("created_at") / 86400))
    last = posts.agg(F.max("slot")).first()[0] - 2
    plain = posts.select("slot", "user_id", F.explode(F.array("lang", "source")).alias("token")).filter(F.col("slot").between(last - 3, last))
    wanted = sorted(tuple(r) for r in plain.groupBy("slot", "token").agg(F.count_distinct("user_id")).collect())
    assert sorted(tuple(r) for r in kept.collect()) == wanted
    state_rows = state.read_histories(spark, f"{memory}/checkpoint", 0).groupBy("token").count().collect()
    assert max(r["count"] for r in state_rows) <= 4


def test_counts_keep_a_row_per_user_and_window(spark, tmp_path):
    """Sets of tokens are state, with null tokens, and posts without a user, as one user, over a bounded number of rows."""
    at = lambda hour: (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=hour, minutes=5)).to_pydatetime()
    rows = [(1, at(0), ["a", "b", None]), (1, at(0), ["b", "c"]), (2, at(0), ["a"]), (None, at(0), ["a", "d"]), (None, at(0), ["d"]), (1, at(1), ["a"])]
    rows += [(3, at(0), [f"w{i}" for i in range(300)])]
    spark.createDataFrame(rows, "user_id bigint, created_at timestamp, tokens array<string>").write.parquet(f"{tmp_path}/in/part=0")
    conf = BurstConf(width=3600, minor=1)

    def work(name):
        stream = spark.readStream.schema("user_id bigint, created_at timestamp, tokens array<string>").parquet(f"{tmp_path}/in/part=*")
        counts = prepare.stream_counts(stream, conf, "0 seconds", keys=())
        with state.keyed_state(spark):
            q = counts.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
        return max(op["numRowsTotal"] for p in q.recentProgress[:1] for op in p["stateOperators"])

    assert work("first") <= 4 + 2  # users 1, 2, 3 and two tokens without a user in the first hour, user 1 in the second
    got = {(r.slot - 473352, r.token): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(0, "a"): 3, (0, "b"): 1, (0, "c"): 1, (0, "d"): 1, (0, None): 1, **{(0, f"w{i}"): 1 for i in range(300)}}
    assert {k: v for k, v in got.items() if k[0] == 0} == want
