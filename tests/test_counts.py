"""Counts over minor windows against a count over copies, and all events as posts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from emberline.operators import counts as C
from emberline.sources.tables import posts_from_tables


def plain(rows, minor, by):
    seen = {}
    for post, user, slot, tokens in rows:
        for token in set(tokens) or {None}:
            for at in range(slot, slot + minor):
                seen.setdefault((at, token), set()).add(user if by == "user" else post)
    return sorted(((s, t or "", len(u)) for (s, t), u in seen.items()))


@pytest.mark.parametrize("minor,by", [(1, "user"), (2, "user"), (5, "post"), (30, "user")])
def test_minor_counts_equal_counts_over_copies(spark, minor, by):
    draw = random.Random(minor)
    rows = [(i, draw.randrange(6), draw.randrange(60), draw.choices("abcd", k=draw.randrange(4))) for i in range(150)]
    frame = spark.createDataFrame(rows, "post_id bigint, user_id bigint, slot bigint, tokens array<string>")
    got = C.minor_counts(frame, minor, by, keep_slots=True)
    assert sorted((r.slot, r.token or "", r.n) for r in got.collect()) == plain(rows, minor, by)
    keyed = C.minor_counts(frame.withColumn("topic_id", F.lit("T")), minor, by, keys=("topic_id",)).filter("topic_id = 'T'")
    assert sorted((r.slot, r.token, r.n) for r in keyed.collect()) == [r for r in plain(rows, minor, by) if r[1]]


def test_no_post_is_copied_for_a_wider_window(spark):
    frame = spark.createDataFrame([(1, 1, 1, ["a"])], "post_id bigint, user_id bigint, slot bigint, tokens array<string>")
    plan = lambda minor: re.sub(r"#\d+L?|plan_id=\d+|\b\d+\b", "", C.minor_counts(frame, minor)._jdf.queryExecution().executedPlan().toString())
    assert plan(2) == plan(30)


def test_every_event_is_a_post(spark):
    folder = "/root/testdata/sf0.001"
    rows = posts_from_tables(spark, folder, every_event=True)
    events = spark.read.parquet(f"{folder}/events.parquet")
    assert rows.count() == events.count() == rows.select("post_id").distinct().count()
    own = posts_from_tables(spark, folder).select("post_id", "text", "user_id", "created_at")
    assert own.exceptAll(rows.select("post_id", "text", "user_id", "created_at")).count() == 0


@pytest.mark.parametrize("by", ["user", "post"])
@pytest.mark.parametrize("keep_slots", [False, True])
def test_term_counts_equal_distinct_users_with_repeats_and_nulls(spark, by, keep_slots):
    draw = random.Random(7)
    some = lambda n: draw.choice([None, *range(n)])
    rows = [(some(90), some(4), some(5), draw.choice([None, [], draw.choices(["a", "b", "c", None], k=3)])) for _ in range(400)]
    rows += [(i % 70, 9, 9, [draw.choice("abcdefg")]) for i in range(3 * C.FEW)]  # a crowded user, posts that come again
    frame = spark.createDataFrame(rows, "post_id bigint, user_id bigint, slot bigint, tokens array<string>")
    seen = {}
    for post, user, slot, tokens in rows:
        for token in set(tokens or ([None] if keep_slots else [])):
            seen.setdefault((slot, token), set()).add(user if by == "user" else post)
    want = sorted(((s, t, len(u - {None})) for (s, t), u in seen.items()), key=lambda r: (str(r[0]), str(r[1])))
    got = C.term_counts(frame, by, keep_slots).collect()
    assert sorted(((r.slot, r.token, r.n) for r in got), key=lambda r: (str(r[0]), str(r[1]))) == want


def test_no_token_is_shuffled_for_posts_dealt_by_slot(spark):
    frame = spark.createDataFrame([(1, 1, 1, ["a"])], "post_id bigint, user_id bigint, slot bigint, tokens array<string>")
    plan = C.term_counts(frame.repartition("slot"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
