"""Work and rows that must not grow with the number of pairs, topics or uses."""

import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import counts as C, matching as M, merge, novelty as N, select as L, sizing
from emberline.sources.topics import topics_frame
from tests.test_plans import plan_of, shuffles


def test_sets_that_share_late_tokens_only_do_not_meet(spark):
    sets = [(n, n, [f"x{n}y{i}" for i in range(8)] + ["a", "b", "c", "d"]) for n in range(40)] + [(40, 40, ["k", "l"]), (41, 41, ["k", "l", "m"])]
    frame = spark.createDataFrame(sets, "id bigint, pos bigint, tokens array<string>").withColumn("size", F.size("tokens"))
    ordered = N.rare_first(frame)
    entries = N.prefix_entries(ordered, 0.25)
    assert N.meetings(entries, entries, 0.25).select("l.id", "r.id").distinct().count() == 1
    pairs = N.candidate_pairs(entries, entries, 0.25)
    assert [tuple(r) for r in N.verified(pairs, ordered).collect()] == [(41, 40, 2 / 3)]


@pytest.mark.parametrize("op", ["or", "and"])
@pytest.mark.parametrize("held", [4, 1 << 20])
def test_topics_are_scored_in_the_rows_of_posts(spark, op, held, monkeypatch):
    monkeypatch.setattr(M, "MEETINGS", held)
    draw = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(draw.choices(words, k=draw.randrange(9))) for _ in range(60)] + [None]
    tags = F.array(F.lit("W3")).cast("array<string>")
    posts = spark.createDataFrame(list(enumerate(texts)), "post_id bigint, text string").withColumn("hashtags", F.when(F.col("post_id") % 3 == 0, tags))
    topics = topics_frame(spark, [(f"t{i % 30}", f" {op} ".join(draw.sample(words + ["#w3", '"w1 w2"'], draw.randrange(1, 5))), []) for i in range(31)] + [("none", None, [])])
    found = M.topic_scores(posts, topics, op, keep=("post_id",))
    assert "Join" not in plan_of(found)  # a row per post, term and topic
    monkeypatch.setattr("emberline.operators.sizing.BROADCAST_BYTES", 0)
    looked_up = M.topic_scores(posts, topics, op, keep=("post_id",))
    rows = lambda df: sorted((r.post_id, r.topic_id, round(r.score, 9)) for r in df.collect())
    assert rows(found) == rows(looked_up) and found.columns == looked_up.columns
    assert rows(found)


def test_topics_rows_stay_where_they_are(spark):
    rows = spark.range(500).select((F.col("id") % 2).alias("topic_id"), (F.col("id") % 7).cast("double").alias("score"), F.array(F.lit("x")).alias("tokens"))
    best = L.top_with_ties(rows, 3)
    assert not shuffles(plan_of(best))  # all rows of a topic would meet in one task
    assert best.count() == 71 and {r.score for r in best.collect()} == {6.0}


def test_counts_by_parts_are_the_same(spark):
    draw = random.Random(9)
    rows = [(i // 2, draw.choice([1, 2, 3, None]), draw.choice([5, 6, 7, 9, None]), draw.sample("abcdef", draw.randrange(4))) for i in range(200)]
    posts = spark.createDataFrame(rows, "post_id bigint, user_id bigint, slot bigint, tokens array<string>")
    for count in (lambda **k: C.term_counts(posts, keep_slots=True, **k), lambda **k: C.minor_counts(posts, 3, keep_slots=True, **k)):
        known = sorted(map(str, count().collect()))
        assert sorted(map(str, count(parts=11).collect())) == known


def test_parts_follow_the_posts(spark, monkeypatch):
    monkeypatch.setattr(sizing, "POSTS", 10)
    texts = spark.range(95).select(F.col("id").alias("post_id"), F.lit("x y").alias("text"))
    assert sizing.parts_for(texts) == 10 and sizing.parts_for(texts.limit(3)) == 4


def test_rows_without_text_pass_beside_near_duplicates(spark):
    rows = [(0, "f", "a", 1, "one two three"), (1, "f", "a", 2, None), (2, "f", "b", 3, None), (3, "f", "a", 4, "one two three four"), (4, "f", "c", 5, "")]
    frame = spark.createDataFrame(rows, "arrival bigint, feed string, topic string, post_id bigint, text string")
    ordered = N.rare_first(frame.select(F.col("arrival").alias("id"), F.col("arrival").alias("pos"), F.split("text", " ").alias("tokens")).withColumn("size", F.size("tokens")))
    assert sorted(r.id for r in ordered.collect()) == [0, 3, 4]
    got = merge.merge_near_duplicates(frame, 0.5).select("arrival")
    assert sorted(r.arrival for r in got.collect()) == [0, 1, 4]


def test_near_duplicates_make_no_row_per_meeting(spark, monkeypatch):
    """Texts that share many words and aren't similar leave no row, nor do their keys meet in a join."""
    joined, known = [], N.meetings
    monkeypatch.setattr(N, "meetings", lambda *a, **k: joined.append(known(*a, **k)) or joined[-1])
    monkeypatch.setattr(merge, "meetings", N.meetings, raising=False)
    edges, conflicts = [], merge._first_conflicts
    monkeypatch.setattr(merge, "_first_conflicts", lambda *a, **k: edges.append(conflicts(*a, **k)) or edges[-1])
    draw = random.Random(2)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, "f", "a", i, " ".join(draw.sample(words, 30))) for i in range(300)]
    rows += [(300 + i, "f", "a", 300 + i, text + " again") for i, (*_, text) in enumerate(rows[:50])]
    frame = spark.createDataFrame(rows, "arrival bigint, feed string, topic string, post_id bigint, text string")
    assert sorted(r.arrival for r in merge.merge_near_duplicates(frame, 0.5).select("arrival").collect()) == list(range(300))
    assert not joined and sum(e.count() for e in edges) == 50


def test_a_closed_window_counts_its_own_slots_only(spark, tmp_path, monkeypatch):
    from emberline.plans import queries as Q

    words = [f"from thre word{i % 3} other{i % 5} more{i % 7}" for i in range(40)]
    spark.createDataFrame([(i, text, "en", "s") for i, text in enumerate(words)], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    events = spark.range(40).select(F.col("id").alias("event_id"), (F.col("id") % 9).alias("user_id"), F.timestamp_seconds(F.col("id") * 6 * 3600).alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    counted, known = [], C.term_counts
    monkeypatch.setattr(Q.C, "term_counts", lambda df, **k: counted.append(df) or known(df, **k))
    rows, terms, win = Q.window_terms(spark, str(tmp_path))
    assert win == 18 and rows.count() >= 40 and terms.filter("win <> 18").isEmpty()
    assert sorted(r.slot for r in counted[0].select("slot").distinct().collect()) == [16, 17, 18]  # all twenty before
