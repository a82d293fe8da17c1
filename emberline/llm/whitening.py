"""Whitening of embeddings along the leading components, found by slicing the spectrum.

Coordinates are whole numbers, so the sum over the distinct vectors is exact. Their covariance is summed by tasks in
blocks of its rows, after centring; only that matrix (dimensions squared, whatever the number of rows) comes to the driver.

An eigenvalue is found by counting: the signs of the pivots of an LDL' factorisation of V - s*I tell how many
eigenvalues lie below s. Bisection with such counts isolates the k-th largest; Rayleigh quotient iteration
then converges cubically from the middle of its interval; counts on both sides of the result certify that it has the
number k. Eigenvalues that lie within rounding of each other can't be told apart by counts: their interval
is taken as one cluster, and the vectors are made orthogonal to those found before.

Defined cases (for `whitened`): rows without a usable vector (`vectors.usable`) have no result rows; null or
repeated ids keep one result per row and component; with fewer than four dimensions there are as many
components; where the component's variance is not above rounding (all vectors equal, rank too small)
``whitened`` is null and ``explained`` 0, and such components take no part in ``identity_error`` (0.0 if
there is no other); a ``deviation`` beyond a long is null; an empty table gives an empty table. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberline.llm.vectors import coordinates, matrix, usable
from emberline.sources.scratch import stage

COMPONENTS = 4
BLOCK = 256  # rows of the covariance that are summed together
SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, variance double"


def inertia(a: np.ndarray) -> int:
    """The number of negative eigenvalues of a symmetric matrix, from the pivots of its LDL' factorisation.

    Pivots are 1 x 1 or 2 x 2 blocks, chosen so that the factors stay bounded (Bunch and Kaufman). A block
    of two whose determinant is negative has one negative eigenvalue.
    """
    a = np.array(a, np.float64)
    n, k, negative, alpha = len(a), 0, 0, (1 + np.sqrt(17)) / 8

    def swap(p: int, q: int) -> None:
        if p != q:
            a[[p, q]] = a[[q, p]]
            a[:, [p, q]] = a[:, [q, p]]

    while k < n:
        column = np.abs(a[k + 1 :, k])
        r = k + 1 + int(column.argmax()) if len(column) else k
        largest = abs(a[r, k]) if r > k else 0.0
        two = False
        if largest > 0 and abs(a[k, k]) < alpha * largest:
            others = np.abs(a[r, k:]).copy()
            others[r - k] = 0
            sigma = others.max()
            if abs(a[k, k]) * sigma >= alpha * largest * largest:
                pass
            elif abs(a[r, r]) >= alpha * sigma:
                swap(k, r)
            else:
                swap(k + 1, r)
                two = True
        if two:
            block, below = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            negative += 1  # such a block is indefinite
            a[k + 2 :, k + 2 :] -= below @ np.linalg.solve(block, below.T)
            k += 2
        else:
            pivot = a[k, k]
            negative += pivot < 0
            if pivot != 0:
                below = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(below, below / pivot)
            k += 1
    return int(negative)


def leading(v: np.ndarray, count: int = COMPONENTS) -> list[tuple[float, np.ndarray]]:
    """The ``count`` largest eigenvalues of a symmetric matrix and unit eigenvectors, in falling order."""
    dims = len(v)
    identity = np.eye(dims)
    radius = np.abs(v).sum(axis=1) - np.abs(np.diag(v))
    low, high = float((np.diag(v) - radius).min()), float((np.diag(v) + radius).max())
    size = max(abs(low), abs(high))
    if size == 0:
        return [(0.0, identity[k]) for k in range(min(count, dims))]
    unit = size * np.finfo(float).eps
    low, high = low - 8 * dims * unit, high + 8 * dims * unit
    counts: dict[float, int] = {low: 0, high: dims}

    def below(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia(v - shift * identity)
        return counts[shift]

    found: list[tuple[float, np.ndarray]] = []
    for k in range(1, min(count, dims) + 1):
        a = max(s for s, n in counts.items() if n <= dims - k)  # the k-th largest lies in [a, b]
        b = min(s for s, n in counts.items() if n > dims - k)
        while b - a > 4 * dims * unit and not (counts[a] == dims - k and counts[b] == dims - k + 1 and b - a < 0.05 * max(abs(a), abs(b))):
            middle = (a + b) / 2
            if below(middle) <= dims - k:
                a = middle
            else:
                b = middle
        while True:
            value, vector = _iterate(v, (a + b) / 2, a, b, [x for _, x in found])
            if value is not None or b - a <= 4 * dims * unit:
                break
            middle = (a + b) / 2  # it went to another eigenvalue: a narrower interval
            if below(middle) <= dims - k:
                a = middle
            else:
                b = middle
        if value is None:
            value = (a + b) / 2
        margin = 8 * dims * unit
        if below(value + margin) < dims - k + 1 or below(value - margin) > dims - k:
            raise ArithmeticError(f"eigenvalue {k} could not be certified")
        found.append((value, vector))
    return found


def _iterate(v: np.ndarray, start: float, low: float, high: float, before: list[np.ndarray]):
    """Rayleigh quotient iteration; (None, vector) if the value leaves the interval [low, high]."""
    dims, identity = len(v), np.eye(len(v))
    basis = np.array(before).reshape(len(before), dims)
    slack = 4 * dims * np.finfo(float).eps * np.abs(v).sum(axis=1).max()

    def away(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - basis.T @ (basis @ x)
        return x / np.linalg.norm(x)

    vector = away(np.cos(np.arange(dims) * 1.7 + 0.3 + len(before)))
    shift = start
    for step in range(60):
        try:
            solved = np.linalg.solve(v - shift * identity, vector)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last digit
            solved = np.linalg.solve(v - (shift + slack) * identity, vector)
        vector = away(solved)
        quotient = float(vector @ v @ vector)
        residual = np.linalg.norm(v @ vector - quotient * vector)
        if residual <= slack / dims * 2 or step > 8 and residual <= slack:
            break
        if step >= 2:  # the vector has turned towards the interval's eigenvalue: now let the shift follow
            shift = quotient
    inside = low - slack <= quotient <= high + slack
    return (quotient if inside else None), vector


@dataclass
class Whitening:
    """Number of distinct vectors, their sums, eigenvalues and vectors, and the share of the variance explained."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def scales(self) -> np.ndarray:
        """Square roots of the eigenvalues, nan where one isn't above rounding."""
        least = len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)
        return np.sqrt(np.where(self.values > least, self.values, np.nan))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Per row the sum of (n*x - S)^2, exactly; None beyond a long."""
        largest = int(np.abs(x).max(initial=0)) * self.n + max((abs(s) for s in self.sums.tolist()), default=0)
        sums = self.sums.tolist()
        exact = lambda row: sum((self.n * c - s) ** 2 for c, s in zip(row, sums))
        if largest >= 1 << 62:
            values = [exact(row) for row in x.tolist()]
        else:
            off = x * self.n - self.sums
            about = (off.astype(np.float64) ** 2).sum(axis=1) / 2.0**63
            values = (off * off).sum(axis=1).tolist()  # modulo 2^64, so right wherever the sum fits in a long
            for i in np.flatnonzero(about > 1 - 1e-9).tolist():
                values[i] = exact(x[i].tolist())
        return [value if value < 1 << 63 else None for value in values]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates, rows x components."""
        mean = self.sums.astype(np.float64) / self.n
        return (x.astype(np.float64) - mean) @ self.vectors.T / self.scales()


def _sums(fit_list: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of vectors and their exact sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            safe = int(np.abs(x).max(initial=0)) * max(len(x), 1) < 1 << 62
            own = x.sum(axis=0).tolist() if safe else [sum(c) for c in zip(*x.tolist())]
            n, total = n + len(x), [a + b for a, b in zip(total, own)]
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(-1, dims), pa.int32()), "total": [str(v) for v in [n, *total]]})

    parts = fit_list.select("x").mapInArrow(run, "dim int, total string")
    totals = parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    by_dim = {r.dim: int(r.total) for r in totals.collect()}  # one row per dimension
    sums = [by_dim.get(d, 0) for d in range(dims)]
    kind = np.int64 if all(abs(s) < 1 << 62 for s in sums) else object
    return by_dim.get(-1, 0), np.array(sums, kind)


def _covariance(fit_list: DataFrame, dims: int, n: int, sums: np.ndarray) -> np.ndarray:
    """Covariance over the fit list, divisor n: centred, then multiplied."""
    mean = np.array([float(s) / n for s in sums.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch.column("x"), dims).astype(np.float64)
            for low in range(0, len(x), 4096):
                off = x[low : low + 4096] - mean
                total = off.T @ off if total is None else total + off.T @ off
        if total is not None:
            at = range(0, dims, BLOCK)
            yield pa.RecordBatch.from_pydict({"block": pa.array(at, pa.int32()), "sums": [total[i : i + BLOCK].ravel().tolist() for i in at]})

    def add(part: pa.Table) -> pa.Table:
        total = sum(matrix(chunk, len(part["sums"][0]), np.float64).sum(axis=0) for chunk in part["sums"].chunks if len(chunk))
        return pa.table({"block": part["block"].slice(0, 1), "sums": [total.tolist()]}, pa.schema([("block", pa.int32()), ("sums", pa.list_(pa.float64()))]))

    schema = "block int, sums array<double>"
    parts = fit_list.select("x").mapInArrow(run, schema)
    # Two rounds, so that the parts of many tasks don't meet in one.
    spread = parts.withColumn("lane", (F.rand(3) * 16).cast("int"))
    by_lane = spread.groupBy("block", "lane").applyInArrow(add, schema)
    rows = by_lane.groupBy("block").applyInArrow(add, schema).orderBy("block").collect()  # dims squared numbers
    return np.concatenate([np.array(r.sums).reshape(-1, dims) for r in rows]) / n


def fit(fit_list: DataFrame, dims: int, count: int = COMPONENTS) -> Whitening | None:
    """The leading components over a table of distinct coordinate vectors (column x)."""
    n, sums = _sums(fit_list, dims)
    if not n:
        return None
    v = _covariance(fit_list, dims, n, sums)
    pairs = leading((v + v.T) / 2, count)
    return Whitening(n, sums, np.array([e for e, _ in pairs]), np.array([x for _, x in pairs]), float(np.trace(v)))


def whiten(rows: DataFrame, dims: int, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, variance) of rows with coordinates x."""
    count = len(model.values)
    scales = model.scales()
    explained = [0.0 if np.isnan(s) else float(e / model.trace) for e, s in zip(model.values, scales)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            each = np.repeat(np.arange(len(x)), count)
            column = np.tile(np.arange(count, dtype=np.int32), len(x))
            white = model.project(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)),
                    pa.array(column + np.int32(1)),
                    pa.array(np.full(len(each), model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(white, mask=np.isnan(white)),
                    pa.array(np.array(explained)[column]),
                    pa.array(model.values[column]),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "variance"],
            )

    return rows.select("vec_id", "x").mapInArrow(run, SCHEMA)


def identity_error(fit_list: DataFrame, dims: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    used = np.flatnonzero(~np.isnan(model.scales()))
    names = [f"w{i}" for i in used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            white = model.project(matrix(batch.column("x"), dims))
            yield pa.RecordBatch.from_arrays([pa.array(white[:, i]) for i in used], names=names)

    if not names:
        return 0.0
    white = fit_list.select("x").mapInArrow(run, ", ".join(f"{name} double" for name in names))
    pairs = [(a, b) for a in names for b in names if a <= b]
    row = white.agg(*[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()
    return max(abs(row[f"{a}_{b}"] - (a == b)) for a, b in pairs)


def whitened(rows: DataFrame, column: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of all rows with a usable vector, with the columns of the digest and ``variance``."""
    good, dims = usable(rows, column)
    slim = stage(good.select(F.col("vec_id").cast("bigint").alias("vec_id"), coordinates(F.col(column)).alias("x")), "coordinates")
    fit_list = stage(slim.select("x").distinct(), "fit-list")
    model = fit(fit_list, dims, count)
    if model is None:
        return rows.sparkSession.createDataFrame([], f"{SCHEMA}, identity_error double")
    return whiten(slim, dims, model).withColumn("identity_error", F.lit(float(identity_error(fit_list, dims, model))))
