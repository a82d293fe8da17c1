"""The choice among closed windows, and the hits it is made by."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberline.conf import BurstConf
from emberline.operators import matching
from emberline.operators.matching import listed_hits, window_hits
from emberline.streaming import jobs
from emberline.streaming.jobs import Memory, POSTS, SCORES, deliver_step


@pytest.mark.parametrize("listed", [1_000, 1])
def test_listed_hits_are_window_hits(spark, monkeypatch, listed):
    """Repeated posts in a slot and in two, terms inside words, with blanks, of another topic and window."""
    rows = [("a", 1, 5, "Storm surge rising"), ("a", 1, 5, "surge again"), ("a", 1, 6, "storm"), ("b", 1, 5, "storm"), ("a", 2, 6, None), ("a", 3, 4, "restorm it")]
    posts = spark.createDataFrame(rows, "topic_id string, post_id bigint, slot bigint, text string")
    found = [("a", 6, "storm"), ("a", 6, "surge"), ("a", 6, "m sur"), ("a", 6, " "), ("b", 9, "storm"), ("a", 5, "storm")]
    terms = spark.createDataFrame(found, "topic_id string, win bigint, token string")
    monkeypatch.setattr(matching, "LISTED", listed)
    own = sorted(map(tuple, listed_hits(posts, terms, 2, ("topic_id",)).select("topic_id", "win", "post_id", "hits").collect()))
    assert own == sorted(map(tuple, window_hits(posts, terms, 2, ("topic_id",)).select("topic_id", "win", "post_id", "hits").collect()))
    assert own == [("a", 5, 1, 1), ("a", 5, 3, 1), ("a", 6, 1, 4)]


def test_windows_of_a_trigger_share_one_search(spark, tmp_path, monkeypatch):
    """Later windows are compared with what earlier ones deliver, but posts are searched once for all of them."""
    conf = BurstConf(width=60, minor=1, major=2, burst_threshold=0.1, sim_threshold=0.5, per_window_max=2)
    memory = Memory(spark, str(tmp_path))
    texts = ["storm one two", "storm three four", "storm one two", "storm five six"]
    rows = [("T", n, n, datetime(2024, 1, 1, 0, n), text, text.split(), n, 0) for n, text in enumerate(texts)]
    memory.replace("posts", spark.createDataFrame(rows, POSTS), "own", "batch")
    memory.replace("scores", spark.createDataFrame([("T", "storm", 0.9, n) for n in range(4)], SCORES), "win")
    searches = []
    monkeypatch.setattr(jobs, "closed_candidates", lambda *a, found=jobs.closed_candidates: searches.append(1) or found(*a))
    decided = spark.createDataFrame([("T", n, 1, 0, 0) for n in range(4)], "topic_id string, win bigint, bursts bigint, level bigint, next_level bigint")
    for _ in range(2):  # a repeated batch leaves the same
        deliver_step(conf, str(tmp_path))(decided, 0)
        delivered = memory.all("delivered", jobs.DELIVERED).select("win", "post_id", F.round("sim", 3)).collect()
        assert sorted(map(tuple, delivered)) == [(0, 0, 0.0), (1, 1, 0.2), (3, 3, 0.2)]
    assert len(searches) == 2


@pytest.mark.parametrize("few", [64, 0])
def test_few_terms_are_looked_for_in_the_rows(spark, monkeypatch, few):
    """The same matches either way: inside words, with blanks, over line ends, repeated and null rows; no word is shuffled for few terms."""
    rows = [(1, 5, "In the Storm"), (1, 5, "In the Storm"), (2, 5, "in\nthe rain"), (3, 6, None), (None, 6, "restorm"), (4, 7, "")]
    posts = spark.createDataFrame(rows, "post_id bigint, slot bigint, text string")
    terms = spark.createDataFrame([("storm",), ("in the",), (" ",), ("ain",), ("none",)], "term string")
    monkeypatch.setattr(matching, "FEW_TERMS", few)
    staged = []
    monkeypatch.setattr(matching, "stage", lambda df, name, stage=matching.stage: staged.append(name) or stage(df, name))
    found = matching.substring_matches(posts, terms, ("slot",)).collect()
    assert set(map(tuple, found)) == {(1, 5, "storm"), (1, 5, "in the"), (2, 5, "ain"), (None, 6, "storm")}
    assert bool(staged) == (few == 0)
