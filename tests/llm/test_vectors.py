"""Whitening and hard negatives against plain numpy, on tables and on odd rows."""

import numpy as np
import pytest

from emberline.llm import negatives, vectors, whitening

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, rank double, n int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 0.5, 3) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def odd_rows():
    rng = np.random.default_rng(11)
    rows = [(i, [float(c) for c in rng.normal(size=5)], int(i % 3)) for i in range(60)]
    same = [0.25, -0.5, 0.125, 0.0, -0.0]
    rows += [(100 + i, same, i % 2) for i in range(40)]  # one vector many times
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0, 0.0], 1), (202, [float("nan")] * 5, 0), (203, [float("inf")] + [0.0] * 4, 0)]
    rows += [(204, [1.0, 2.0], 0), (205, [], 1), (300, [0.0] * 5, 1), (301, [3.5] * 5, None), (None, [1.5] * 5, 2)]
    return rows + [(100, same, 0), (7, rows[7][1], 1), (400, [1e3] * 5, 0), (-100, [0.5] * 5, 0), (-7, [0.25] * 5, 9)]


def good(rows, ids=False):
    kept = [r for r in rows if r[1] and len(r[1]) == 5 and all(c is not None and np.isfinite(c) for c in r[1])]
    return [r for r in kept if not ids or r[0] is not None and r[2] is not None]


def whole(rows):
    return np.floor(256 * np.array([np.array(r[1], np.float32) for r in rows], np.float64)).astype(np.int64)


def check_whitening(found, rows):
    x = whole(rows)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    e, v = np.linalg.eigh((fit - s / n).T @ (fit - s / n) / n)
    e, v = e[::-1], v[:, ::-1]
    plain = (x - s / n) @ v[:, :4] / np.sqrt(e[:4])
    got = {}
    for r in found.collect():
        assert r.n == n and r.identity_error < 1e-10 and abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9
        got.setdefault((r.vec_id, r.component), []).append((r.deviation, r.whitened))
    assert sum(map(len, got.values())) == 4 * len(rows)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    for k in range(4):
        sign = None
        for i, r in enumerate(rows):
            values = got[r[0], k + 1]
            assert int(deviation[i]) in [d for d, _ in values]
            if len(values) == 1:
                if sign is None and abs(plain[i, k]) > 0.1:
                    sign = np.sign(plain[i, k] * values[0][1])
                if sign is not None:
                    assert abs(values[0][1] - sign * plain[i, k]) < 1e-8


def test_whitening(spark, odd_rows):
    check_whitening(whitening.whitened(frame(spark, odd_rows)), good(odd_rows))
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    x = whole(rows)
    fit = np.unique(x, axis=0)
    e = np.linalg.eigvalsh(np.cov(fit.T, bias=True))[::-1]
    found = whitening.whitened(table).filter("vec_id = 3").orderBy("component").collect()
    assert np.allclose([r.explained for r in found], e[:4] / e.sum(), rtol=1e-9)


def test_whitening_without_variance(spark):
    flat = [(i, [0.5, 0.25], 1) for i in range(3)]
    rows = whitening.whitened(frame(spark, flat)).collect()
    assert len(rows) == 6 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in rows)
    line = whitening.whitened(frame(spark, [(i, [float(i), float(i)], 1) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line)
    assert whitening.whitened(frame(spark, []).limit(0)).count() == 0
    large = whitening.whitened(frame(spark, [(1, [3e37, 1.0], 1), (2, [1.0, -2.0], 1), (3, [0.0, 1.0], 1)])).collect()
    assert {r.deviation for r in large} == {None}


@pytest.mark.parametrize("dims", [1, 2, 5, 40])
def test_slices_of_the_spectrum(dims):
    rng = np.random.default_rng(dims)
    a = rng.normal(size=(dims, dims))
    q = np.linalg.qr(a)[0]
    equal = np.r_[np.full(min(3, dims), 4.0), np.ones(dims - min(3, dims))]
    for v in (a @ a.T, a + a.T, np.ones((dims, dims)), np.diag(np.round(2 * a[0])), np.zeros((dims, dims)), (q * equal) @ q.T):
        v = (v + v.T) / 2
        e = np.linalg.eigvalsh(v)
        for shift in rng.normal(size=6):
            assert whitening.inertia(v - shift * np.eye(dims)) == (e < shift).sum()
        found = whitening.leading(v)
        assert np.allclose([x for x, _ in found], e[::-1][: len(found)], atol=1e-11 * max(1, abs(e).max()))
        w = np.array([x for _, x in found])
        assert np.allclose(w @ w.T, np.eye(len(w)), atol=1e-9)
        assert all(np.linalg.norm(v @ x - value * x) < 1e-10 * max(1, abs(e).max()) for value, x in found)


def plain_negatives(rows):
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, x) for (i, _, label), x in zip(rows, whole(rows).tolist())]
    out = []
    for a, own, vector in rows:
        if a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(vector, x)), i, label) for i, label, x in rows]
        for score, p, _ in sorted(s for s in scored if s[2] == own and s[1] != a)[:5]:
            inside = sorted(s for s in scored if s[2] != own and 80 * -score <= 100 * -s[0] <= 100 * -score)[:5]
            out += [(a, p, k + 1, i, -score, -s) for k, (s, i, _) in enumerate(inside)]
    return sorted(out)


COLUMNS = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"


@pytest.mark.parametrize("block", [64 * 5, 1 << 20])
def test_hard_negatives(spark, odd_rows, block, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", block)
    found = negatives.negatives_digest(frame(spark, odd_rows))
    assert sorted(tuple(r) for r in found.select(*COLUMNS).collect()) == plain_negatives(good(odd_rows, ids=True))
    assert negatives.negatives_digest(frame(spark, odd_rows).limit(0)).count() == 0


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 2
    x = np.floor(64 * (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * 0.15)).astype(np.int64)
    return np.arange(n), rng.integers(0, 4, n), x


def test_bounds_hold_and_filter():
    ids, labels, x = clustered(4000, 24, 5)
    directions = negatives.directions_of(x[:512].astype(float))
    norms = negatives._norms(x)
    angles = negatives._angles(x, norms, directions)
    block = negatives.Block(ids, labels, x, norms, angles)
    for a in range(0, 4000, 400):
        scores = x @ x[a]
        low, high = block.bounds(np.arange(4000), norms[a], angles[a])
        assert (low <= scores).all() and (scores <= high).all()
        for floor, top in ((-1e18, 0.0), (0.8 * scores[a], scores[a]), (-5.0, 5.0), (-1e9, -100.0)):
            near, start, end = block.windows(norms[a : a + 1], angles[a : a + 1], np.array([floor]), np.array([float(top)]))
            inside = set(block.order[start[0] : end[0], near[0]].tolist())
            assert set(np.flatnonzero((scores >= floor) & (scores <= top)).tolist()) <= inside
    anchors = {"vec_id": ids[::50], "label": labels[::50], "norm": norms[::50], "x": x[::50], "angles": angles[::50], "number": ids[::50]}
    anchors["floor"] = np.full(80, -(1 << 62))
    found = negatives.best_positives(block, anchors, 5)
    assert len(found) == 400 and block.scored < 0.1 * 80 * 4000  # most rows are never scored
    for i, a in enumerate(range(0, 4000, 50)):
        scores = x @ x[a]
        plain = sorted((-int(scores[j]), j) for j in range(4000) if labels[j] == labels[a] and j != a)[:5]
        assert [(-f[4], f[3]) for f in found[5 * i : 5 * i + 5]] == plain


def test_large_coordinates_are_scored_exactly():
    x = np.array([[vectors.LARGEST, -vectors.LARGEST, 3], [vectors.LARGEST, 1, 7]])
    assert negatives.Scorer(x)(np.array([0, 1]), x[1]).tolist() == [int(sum(int(p) * int(q) for p, q in zip(r, x[1]))) for r in x]
