import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import folds, scores as S, windows as W

SCHEMA = "slot bigint, token string, n bigint"


def by_definition(cells, lo, hi, major, emit="full"):
    out = {}
    for win in range(lo, hi + 1):
        first = max(win - major + 1, lo)
        if emit == "full" and win < min(lo + major - 1, hi) or emit == "warm" and win < lo + major:
            continue
        tokens = {t for s, t, _ in cells if first <= s <= win}
        totals = [sum(n for s, _, n in cells if s == i) for i in range(first, win + 1)]
        for token in tokens:
            counts = [sum(n for s, t, n in cells if s == i and t == token) for i in range(first, win + 1)]
            y = np.log([(c + 1) / (s + len(tokens)) for c, s in zip(counts, totals)])
            x = np.arange(len(y))
            if len(y) < 2:
                out[win, token] = None
                continue
            cxx, cxy, cyy = np.var(x), np.mean((x - x.mean()) * (y - y.mean())), np.var(y)
            out[win, token] = 0.0 if cyy < 1e-15 else abs(cxy / cxx * cxy**2 / (cxx * cyy))
    return out


@pytest.mark.parametrize("emit", ["full", "warm"])
def test_scores_follow_the_definition(spark, emit):
    rng = np.random.default_rng(3)
    cells = [(s, t, int(rng.integers(1, 9))) for s in range(100, 112) for t in "abcde" if rng.random() < 0.5 and s != 105]
    cells += [(100, "z", 1), (111, "z", 2)]
    frame = spark.createDataFrame(cells, SCHEMA)
    got = {(r.win, r.token): r.score for r in S.burst_scores(frame, 100, 111, 4, emit).collect()}
    want = by_definition(cells, 100, 111, 4, emit)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_flat_rising_falling_and_single(spark):
    cells = [(s, t, n) for s in range(4) for t, n in (("flat", 4), ("up", 1 + 3 * s), ("down", 10 - 3 * s))]
    frame = spark.createDataFrame(cells, SCHEMA)
    score = {r.token: r.score for r in S.burst_scores(frame, 0, 3, 4).collect()}
    signed = {r.token: r.score for r in S.burst_scores(frame, 0, 3, 4, scorer="rising").collect()}
    assert score["flat"] == 0.0 and score["up"] > 0.3 and score["down"] > 0.3
    assert signed["up"] > 0 > signed["down"]
    one = S.burst_scores(frame.filter("slot = 0"), 0, 0, 4).collect()
    assert all(r.score is None for r in one)


def test_python_scorers_see_dense_series(spark):
    cells = [(0, "a", 1), (2, "a", 5), (3, "b", 2), (5, "a", 1)]
    frame = spark.createDataFrame(cells, SCHEMA)
    native = {(r.win, r.token): r.score for r in S.burst_scores(frame, 0, 5, 3, scorer="average").collect()}
    hooked = S.score_series(frame, 0, 5, 3, lambda x: x[:, -1] - x.mean(axis=1), rows_per_group=2)
    got = {(r.win, r.token): r.score for r in hooked.collect()}
    assert got.keys() == native.keys()
    assert all(abs(got[k] - native[k]) < 1e-12 for k in got)


def test_burst_ranges_keep_the_last_one(spark):
    slots = spark.createDataFrame([(12,), (13,), (30,)], "slot bigint")
    rows = sorted(tuple(r) for r in W.burst_ranges(slots, 11, 4).collect())
    assert rows == [(11, 13), (26, 30)]


def test_threshold_rises_and_eases(spark):
    crowd = [("T", 1, f"token{i}", 0.5) for i in range(11)]
    quiet = [("T", w, "token", 0.001) for w in range(2, 9)]
    frame = spark.createDataFrame(crowd + quiet, "topic_id string, win bigint, token string, score double")
    rows = sorted(tuple(r)[1:] for r in folds.fold_threshold(frame, 0.01, major=2).collect())
    assert [r[0] for r in rows] == [1, 7]
    assert rows[0][1] == 11 and abs(rows[0][3] - 0.01**0.75) < 1e-12 and abs(rows[1][3] - 0.01) < 1e-12
    at = folds.thresholds_at(folds.fold_threshold(frame, 0.01, major=2), frame.select("topic_id", "win").distinct(), 0.01)
    limits = {r.win: r.threshold for r in at.collect()}
    assert limits[1] == 0.01 and abs(limits[2] - 0.01**0.75) < 1e-12 and abs(limits[8] - 0.01) < 1e-12


def test_repost_threshold_escalates(spark):
    rows = [("T", 1, 100 + i) for i in range(11)] + [("T", 2, 500)] * 12 + [("T", 3, 1000)] * 11
    frame = spark.createDataFrame(rows, "topic_id string, slot bigint, orig_repost_count bigint")
    got = [tuple(r) for r in folds.fold_escalation(frame, 100).orderBy("slot").collect()]
    assert got == [("T", 1, 11, 100.0, 1000.0), ("T", 3, 11, 1000.0, 10000.0)]


def test_thresholds_have_no_cap(spark):
    rows = [("T", w, 10**9) for w in range(1, 41) for _ in range(11)]
    frame = spark.createDataFrame(rows, "topic_id string, slot bigint, orig_repost_count bigint")
    got = folds.fold_escalation(frame, 1, 2).orderBy("slot").collect()
    assert len(got) == 30 and got[-1].new_threshold == 2.0**30


@pytest.mark.parametrize("base", [0.01, 0.9, 1.0, 1.5])
def test_levels_are_the_thresholds_passed(spark, base):
    values = [0.001, 0.01, 0.02, 0.3, 0.9, 0.95, 0.999999, 1.0, 1.0001, 1.2, 1.5, 7.0]
    values += [(base ** (0.75**k) + base ** (0.75 ** (k + 1))) / 2 for k in range(40)]
    frame = spark.createDataFrame([("T", i, "token", v) for i, v in enumerate(values)], "topic_id string, win bigint, token string, score double")
    for r in folds.burst_levels(frame, base).collect():
        for k in range(100):
            assert (r.low <= k < r.high) == (values[r.step] > base ** (0.75**k)), (values[r.step], k)


def test_ranks_of_infinite_scores(spark):
    values = [3.0, float("inf"), -1.0, float("-inf"), float("nan"), 2.0, None]
    frame = spark.createDataFrame([(v,) for v in values], "score double")
    got = [S.value_at(frame, "score", rank) for rank in range(6)]
    assert got[:5] == [float("-inf"), -1.0, 2.0, 3.0, float("inf")] and got[5] != got[5]
