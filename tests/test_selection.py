import random

import pytest
from pyspark.sql import functions as F

from emberline.functions.text import post_tokens
from emberline.operators import matching as M, merge, novelty as N, runs, select as L
from emberline.sources.topics import topics_frame


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def random_sets(seed, n, words=14, near=0.4):
    """Token lists with exact copies, near copies of a few sources, and unrelated ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    sets = []
    for _ in range(n):
        if sets and rng.random() < near:
            copy = list(sets[rng.randrange(min(len(sets), 3))])
            if rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            sets.append(copy)
        else:
            sets.append(rng.sample(vocabulary, rng.randint(2, 7)))
    return sets


def candidate_frame(spark, sets, wins):
    rows = [(i, i, wins[i], s) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "id bigint, pos bigint, win bigint, tokens array<string>")
    return frame.withColumn("created_at", F.timestamp_seconds("pos"))


@pytest.mark.parametrize("order", ["similar_first", "novel_first"])
@pytest.mark.parametrize("k", [3, 100])
def test_selection_equals_the_sequential_rule(spark, order, k):
    sets = random_sets(5, 60, words=30)
    wins = [i // 20 for i in range(60)]
    sims = [max([jaccard(sets[j], s) for j in range(i)], default=0.0) for i, s in enumerate(sets)]
    want = set()
    for win in set(wins):
        passing = [i for i in range(60) if wins[i] == win and sims[i] <= 0.5]
        passing.sort(key=lambda i: ((-sims[i] if order == "similar_first" else sims[i]), i))
        want |= {(i, win) for i in passing[:k]}
    chosen = L.select_posts(candidate_frame(spark, sets, wins), 0.5, k, order)
    assert {tuple(r) for r in chosen.collect()} == want


def test_history_counts_but_is_not_chosen(spark):
    frame = candidate_frame(spark, [["a", "b", "c"], ["x", "y"]], [1, 1])
    history = spark.createDataFrame([(99, -1, ["a", "b", "c", "d"])], "id bigint, pos bigint, tokens array<string>")
    assert [r.id for r in L.select_posts(frame, 0.5, 5, "novel_first", history=history).collect()] == [1]


@pytest.mark.parametrize("floor", [0.2, 0.5, 0.7])
def test_novelty_equals_brute_force(spark, floor):
    sets = random_sets(8, 70, words=25)
    frame = candidate_frame(spark, sets, [0] * 70)
    got = {r.id: r.sim for r in N.novelty(frame, floor).collect()}
    for i, s in enumerate(sets):
        best = max([jaccard(sets[j], s) for j in range(i)], default=0.0)
        assert abs(got[i] - (best if best >= floor else 0.0)) < 1e-12


def by_broker(rows, threshold):
    kept, names, texts = [], set(), []
    for arrival, feed, topic, post_id, text in sorted(rows):
        tokens = text.split(" ")
        if (topic, post_id) not in names and max([jaccard(tokens, t) for t in texts], default=0.0) < threshold:
            kept.append((arrival, feed, topic, post_id))
            names.add((topic, post_id))
            texts.append(tokens)
    return kept


@pytest.mark.parametrize("seed,crowd", [(1, 100), (2, 100), (3, 2), (4, 2), (5, 3)])
def test_merge_equals_the_broker(spark, seed, crowd, monkeypatch):
    """With few rows making a key crowded, conflicts are only known in part at first."""
    monkeypatch.setattr(merge, "HOT_KEY", crowd)
    monkeypatch.setattr(merge, "FEW_ENTRIES", 0 if crowd == 2 else 100)
    rng = random.Random(seed)
    sets = random_sets(seed, 60, words=16, near=0.5)
    rows = [(i, "f", rng.choice("ab"), rng.randint(1, 25), " ".join(s)) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "arrival bigint, feed string, topic string, post_id bigint, text string")
    got = merge.merge_near_duplicates(frame, 0.5).select("arrival", "feed", "topic", "post_id")
    assert sorted(tuple(r) for r in got.collect()) == by_broker(rows, 0.5)


def test_a_large_group_of_near_copies_has_an_edge_per_member(spark, monkeypatch):
    monkeypatch.setattr(merge, "HOT_KEY", 20)
    seen = []
    known = merge._first_conflicts
    monkeypatch.setattr(merge, "_first_conflicts", lambda *a, **k: seen.append(known(*a, **k)) or seen[-1])
    rng = random.Random(6)
    body = [f"w{i}" for i in range(30)]
    texts = [" ".join(body[:k] + [f"x{n}"] + body[k + 1 :]) for n, k in enumerate(rng.choices(range(30), k=300))]
    texts += [" ".join(f"y{n}z{i}" for i in range(8)) for n in range(50)]
    rng.shuffle(texts)
    rows = [(i, "f", "a", i, text) for i, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "arrival bigint, feed string, topic string, post_id bigint, text string")
    got = merge.merge_near_duplicates(frame, 0.5).select("arrival", "feed", "topic", "post_id")
    assert sorted(tuple(r) for r in got.collect()) == by_broker(rows, 0.5)
    assert sum(edges.count() for edges in seen) < 2 * len(rows)  # all pairs would be 45 000


def post_rows(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "post_id bigint, text string")
    none = F.expr("cast(array() as array<string>)")
    link = F.expr("cast(array() as array<struct<url:string,expanded:string>>)")
    return frame.select("*", none.alias("hashtags"), none.alias("mentions"), link.alias("urls"), link.alias("media"))


def test_substring_matches_equal_brute_force(spark):
    texts = ["The cat-walk is on", "concatenate\nthis", "in the end", "x", "", "CAT in  the hat", "tail\tcat"]
    terms = ["cat", "in the", "x", "end", "#tag", "e\nthis", "walk"]
    frame = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {tuple(r) for r in M.substring_matches(post_rows(spark, texts), frame).collect()}
    assert got == {(i, t) for i, text in enumerate(texts) for t in terms if t in text.lower()}


@pytest.mark.parametrize("op", ["or", "and"])
@pytest.mark.parametrize("bytes_", [0, 1 << 30])
def test_topic_scores(spark, op, bytes_, monkeypatch):
    monkeypatch.setattr("emberline.operators.sizing.BROADCAST_BYTES", bytes_)
    posts = post_rows(spark, ["vaccine news from here", "Vaccine vaccine vax", "the new york times", "new in york", "of the"])
    topics = topics_frame(spark, [("1", "vaccine OR vax", []), ("2", '"new york" OR times', []), ("3", "the OR of", []), ("4", None, None), ("5", "", [])])
    ids = {(r.post_id, r.topic_id) for r in M.topic_scores(posts, topics, op).collect()}
    assert ids == ({(0, "1"), (1, "1"), (2, "2")} if op == "or" else {(1, "1"), (2, "2")})


def test_topics_without_query_take_no_place(spark):
    posts = post_rows(spark, ["vaccine news"])
    topics = topics_frame(spark, [(str(i), None, []) for i in range(257)] + [("real", "news", [])])
    assert [r.topic_id for r in M.topic_match(posts, topics).collect()] == ["real"]
    assert M.topic_match(posts, topics.limit(3)).count() == 0


def test_stream_matches_any_number_of_terms(spark, tmp_path):
    post_rows(spark, ["w7 and w299", "none"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    topics = topics_frame(spark, [(f"t{i}", f"w{i}", ["w7"]) for i in range(300)])
    for found in (M.topic_match(stream, topics).select("post_id", "topic_id"), M.keyword_match(stream, topics).select("post_id")):
        query = found.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
        query.awaitTermination()
        rows = {tuple(r) for r in spark.table("found").collect()}
        assert rows in ({(0, "t7"), (0, "t299")}, {(0,)})


def test_daily_cap_is_never_exceeded(spark):
    rows = [("T", i, 86400 * (i % 2) + i) for i in range(40)]
    frame = spark.createDataFrame(rows, "topic_id string, post_id bigint, time bigint")
    got = [tuple(r) for r in runs.daily_cap(frame, 11).collect()]
    assert len(got) == 22 and {r[1] for r in got} == set(range(22))


def test_run_check_names_the_first_broken_rule(spark):
    good = "6" + "0" * 17
    lines = [
        f"MB226 {good} 1437350400 run",
        f"MB226 {good} 1437350400 run",
        f"MB225 {good} 1437350400 run",
        f"MB450 {good} 1438214400 run",
        f"MB451 {good} 1437350400 run",
        f"MB227 {good[:-1]} 1437350400 run",
        f"MB227 {good} 1437350400 other",
        "MB227 x",
        "  ",
        f"MB227 {good} 1438214399 run",
    ]
    frame = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, value string")
    got = {r.line_no: r.error for r in runs.check_run(frame, "a").collect()}
    assert got == {0: None, 1: "duplicate", 2: "unknown_topic", 3: "time", 4: "unknown_topic", 5: "unknown_id", 6: "other_tag", 7: "fields", 9: None}
    daily = [f"{d} MB226 {q} 6{i:017d} 1 1.0 run" for i, (d, q) in enumerate(
        [("20150719", "Q0"), ("20150720", "Q1"), ("20150729", "Q1"), ("20150730", "Q0"), ("2015", "Q0"), ("20160720", "Q0")])]
    frame = spark.createDataFrame(list(enumerate(daily)), "line_no bigint, value string")
    checked = runs.check_run(frame, "b")
    assert [(r.error, r.q0_warning) for r in checked.orderBy("line_no").collect()] == [
        ("day", False), (None, True), (None, False), ("day", False), ("date_format", False), ("year", False)]
    assert runs.check_caps(checked, "b", runs.RUN_RULES | {"max_rows": 0}).count() == 2


def test_first_digit_field_gates_a_run(spark):
    frame = spark.createDataFrame([(0, "T\t600000000000000001\tx"), (1, "T\t600000000000000002\tx")], "line_no bigint, value string")
    ids = spark.createDataFrame([(600000000000000002,)], "post_id bigint")
    assert [r.line_no for r in runs.gate_run(frame, ids).collect()] == [1]
