"""Similarities by blocks: against all pairs, and without a row per pair."""

import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import novelty as N, overlap, select as L


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def rows_of(seed, n):
    """(id, scope, pos, tokens) with equal positions, null scopes, empty sets, rare tokens and frequent ones."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        tokens = draw.sample([f"w{k}" for k in range(12)], draw.randrange(8)) + [f"r{draw.randrange(200)}" for _ in range(draw.randrange(3))]
        rows.append((i, draw.choice(["a", "a", "b", None]), draw.randrange(n // 2), tokens))
    return rows


@pytest.fixture(params=[(32_768, 1_024), (16, 8)])
def sizes(request, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", request.param[0])
    monkeypatch.setattr(overlap, "LEAST", request.param[1])
    monkeypatch.setattr(overlap, "CELLS", 64)
    monkeypatch.setattr(overlap, "SPARSE", 20)
    monkeypatch.setattr(overlap, "COLUMNS", 6)


@pytest.mark.parametrize("floor", [0.0, 0.4])
@pytest.mark.parametrize("scope", [(), ("scope",)])
def test_blocks_equal_all_pairs(spark, sizes, floor, scope):
    rows = rows_of(3, 120)
    frame = spark.createDataFrame(rows, "id bigint, scope string, pos bigint, tokens array<string>")
    frame = frame.withColumn("pos", F.struct("pos")).withColumn("tokens", F.array_distinct("tokens"))
    sets = overlap.comparable(frame.withColumn("size", F.size("tokens")))
    want = {}
    for i, s, p, t in rows:
        for j, s2, p2, t2 in rows:
            if p2 < p and (not scope or (s is not None and s == s2)) and jaccard(t, t2) >= floor and jaccard(t, t2) > 0:
                want[i, j] = jaccard(t, t2)
    if floor:
        assert {(r.id, r.other): r.sim for r in N.similar_pairs(sets, floor, scope).collect()} == want
    asked = sets.filter("id % 3 = 0")
    best = {i: max(sim for (a, _), sim in want.items() if a == i) for i in {a for a, _ in want} if i % 3 == 0}
    assert {r.id: r.sim for r in N.max_similarity(asked, sets, floor, scope).collect()} == best


def test_no_row_is_made_per_pair(spark, monkeypatch):
    """Sets that share frequent tokens make one row per set, not one per pair that meets."""
    seen = []
    known = N.meetings
    monkeypatch.setattr(N, "meetings", lambda *a, **k: seen.append(known(*a, **k)) or seen[-1])
    draw = random.Random(4)
    rows = [(i, i, 1, draw.sample([f"w{k}" for k in range(20)], 6)) for i in range(200)]
    frame = spark.createDataFrame(rows, "id bigint, pos bigint, win bigint, tokens array<string>").withColumn("created_at", F.timestamp_seconds("pos"))
    assert N.novelty(frame, 0.3).count() == 200
    assert L.select_posts(frame, 0.3, 5, "similar_first").count() <= 5
    assert not seen


def test_posts_without_tokens_are_new(spark):
    rows = [(1, 1, ["a"]), (2, 2, None), (3, 3, []), (4, 4, ["a"]), (5, 5, None)]
    frame = spark.createDataFrame(rows, "id bigint, pos bigint, tokens array<string>")
    assert {r.id: r.sim for r in N.novelty(frame, 0.3).collect()} == {1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0, 5: 0.0}


def test_tokens_with_equal_hashes_get_other_ones(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda token, seed: F.when(seed == 0, F.lit(7).cast("bigint")).otherwise(real(token, seed)))
    frame = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "id bigint, tokens array<string>")
    marks = [m for r in overlap.marked(frame).collect() for m in r.marks]
    assert len(set(marks)) == 3


@pytest.mark.parametrize("order", ["similar_first", "novel_first"])
@pytest.mark.parametrize("scope", [(), ("win",)])
def test_many_candidates_are_chosen_as_few_are(spark, order, scope, monkeypatch):
    """Exact similarities are only worked out for posts that can be chosen."""
    draw = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, draw.randrange(400), draw.choice([1, 2, 3, None]), draw.sample(words, draw.randrange(12))) for i in range(600)]
    frame = spark.createDataFrame(rows, "id bigint, pos bigint, win bigint, tokens array<string>").withColumn("created_at", F.timestamp_seconds("pos"))
    chosen = lambda: sorted(map(str, L.select_posts(frame, 0.3, 5, order, scope=scope).collect()))
    known = chosen()
    asked, best = [], L.max_similarity
    monkeypatch.setattr(L, "max_similarity", lambda left, sets, floor, scope: asked.append((left.count(), floor)) or best(left, sets, floor, scope))
    monkeypatch.setattr(L, "FEW", 0)
    monkeypatch.setattr(L, "HEADS", 60)
    assert chosen() == known and known
    assert sum(n for n, floor in asked if not floor) < 300  # all candidates before


def test_a_side_compared_with_itself_is_dealt_once(spark):
    draw = random.Random(5)
    rows = [(i, i, [f"w{k}" for k in range(20)] + [f"x{i}y{k}" for k in range(draw.choice([5, 90]))]) for i in range(300)]
    frame = spark.createDataFrame(rows, "id bigint, pos bigint, tokens array<string>").withColumn("size", F.size("tokens"))
    sets = overlap.comparable(frame)
    best = overlap.best_similarity(sets, sets, 0.3)
    assert "CoGroup" not in best._jdf.queryExecution().toString()
    table = sets.select(*[F.col(c.strip("_")).alias(c) for c in overlap.COMPARED]).toArrow()
    found = overlap._best(0.3)(table, [table])
    assert {r.node: r.sim for r in best.collect()} == dict(zip(found["node"].to_pylist(), found["sim"].to_pylist()))
    assert found.num_rows


def test_of_a_crowd_only_the_earliest_pair_is_kept(spark):
    rows = [(i, i, ["a", "b", f"x{i // 40}"]) for i in range(80)] + [(80, 80, ["q", "r"]), (81, 81, ["q", "r", "s"])]
    sets = overlap.comparable(spark.createDataFrame(rows, "id bigint, pos bigint, tokens array<string>").withColumn("size", F.size("tokens")))
    names = {r.node: r.id for r in sets.collect()}
    pairs = sorted((names[r.node], names[r.other], r.more) for r in overlap.first_pairs(sets, sets, 0.6, 5).collect())
    want = [(i, j, False) for x in (0, 40) for i in range(x, x + 5) for j in range(x, i)] + [(i, i // 40 * 40, True) for i in [*range(5, 40), *range(45, 80)]]
    assert pairs == sorted(want + [(81, 80, False)])
