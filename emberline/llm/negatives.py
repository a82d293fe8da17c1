"""Hard negatives of anchors by angular triangle filtering.

Every vector is stored with its angles to a few reference directions. The angle between an anchor and a row is
at least the difference of their angles to any direction, and at most their sum (or what is left of the full
circle), so the cosine lies in an interval; multiplied by both norms and widened by what rounding may have
moved, it bounds the score. Rows are kept in blocks, sorted by their angle to every direction: for an anchor and a
range of scores a block gives a window of its order at the anchor's nearest direction, the other directions
narrow it down, and only rows whose bounds overlap the range are scored, exactly, in whole numbers.

1. Rows are dealt by their nearest direction and the angle to it, so blocks are narrow; anchors are
   written as files of at most ``FILE`` anchors. A bounded sample (``SAMPLE`` rows) gives the directions and, for every
   anchor, a score that its last positive reaches for sure; neither decides what is found.
2. Every block meets every anchor file and yields per anchor its best rows of the same label; the best of
   all blocks are the positives.
3. The positives' scores set the ranges in which every block looks for the best rows of other labels.

Anchors are a stated set of queries, read file by file from the shared folder; a task holds one block and one file.
Blocks are runs of rows, so a vector or a label that a third of all rows share is spread over many tasks, and what
meets in one group afterwards is at most ``depth`` rows per block.

Defined cases (for `mine`): rows without an id, a label or a usable vector (`vectors.usable`) take no part;
rows with the anchor's id are not its positives; rows that occur several times count each time, anchors too;
anchors without another row of their label, and positives without a row in their range, have no result
rows; coordinates beyond `vectors.LARGEST` stay at it; a vector of zeros has the score 0 with every row; an
empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.llm.files import read_file, write_file
from emberline.llm.vectors import LARGEST, coordinates, matrix, usable
from emberline.sources.scratch import scratch_path, stage

DIRECTIONS = 16
SAMPLE = 2048
FILE = 256
BLOCK = 1 << 20  # numbers of a block's matrix
BLUR = 4e-6  # angles are stored with 24 bits; radians that one may be off
DEPTH = 5
ROWS = "vec_id bigint, label bigint, anchor boolean, x array<int>, norm double, near int, theta float, angles array<float>"
FOUND = "anchor bigint, anchor_id bigint, place int, positive_id bigint, positive_score bigint, other_id bigint, score bigint"
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def _angles(x: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles to the directions; a vector of zeros counts as at right angles to all."""
    cosines = x.astype(np.float64) @ directions.T / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)


def directions_of(x: np.ndarray, count: int = DIRECTIONS) -> np.ndarray:
    """Up to ``count`` unit vectors from a sample, each the farthest from those before."""
    norms = _norms(x)
    units = x[norms > 0] / norms[norms > 0][:, None]
    if not len(units):
        return np.eye(x.shape[1])[:1]
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < count and nearest.min() < 0.999:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


class Scorer:
    """Exact whole-number scores: by floating-point products while they stay exact, else by integer sums."""

    def __init__(self, x: np.ndarray):
        self.largest = int(np.abs(x).max(initial=0))
        self.whole = x.astype(np.int64)
        self.real = x.astype(np.float64)

    def __call__(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.largest * int(np.abs(anchor).max(initial=0)) * len(anchor) < 1 << 53:
            return (self.real[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return (self.whole[rows] * anchor.astype(np.int64)).sum(axis=1)


class Block:
    """Some rows, sorted by their angle to every direction."""

    def __init__(self, ids, labels, x, norms, angles):
        self.ids, self.labels, self.norms, self.angles = ids, labels, norms, angles.astype(np.float64)
        self.score = Scorer(x)
        self.order = np.argsort(angles, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.angles, self.order, axis=0)
        self.least, self.most = float(norms.min()), float(norms.max())
        self.scored = 0

    def windows(self, norms: np.ndarray, angles: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Per anchor its nearest direction and the part of that order whose scores may lie in [low, high]."""
        angles = angles.astype(np.float64)
        near = angles.argmin(axis=1)
        own = angles[np.arange(len(near)), near]

        def cosine(score: np.ndarray, norm: np.ndarray) -> np.ndarray:
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.clip(np.nan_to_num(score / (norms * norm), nan=0.0), -1, 1)

        widest = np.arccos(cosine(low - 1, np.where(low > 1, self.most, self.least))) + 2 * BLUR
        narrowest = np.arccos(cosine(high + 1, np.where(high > -1, self.least, self.most))) - 2 * BLUR
        blind = norms == 0  # every score is 0
        widest[blind], narrowest[blind] = np.pi, 0
        first = np.maximum(own - widest, narrowest - own) - BLUR
        last = np.minimum(own + widest, 2 * np.pi - narrowest - own) + BLUR
        starts, ends = np.zeros(len(near), np.int64), np.zeros(len(near), np.int64)
        for direction in np.unique(near):
            mine = near == direction
            starts[mine] = np.searchsorted(self.sorted[:, direction], first[mine], side="left")
            ends[mine] = np.searchsorted(self.sorted[:, direction], last[mine], side="right")
        return near, starts, ends

    def bounds(self, rows: np.ndarray, norm: float, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that the rows can have with an anchor."""
        own = self.angles[rows]
        closest = np.abs(own - angles).max(axis=1) - 2 * BLUR
        both = own + angles
        farthest = np.minimum(both, 2 * np.pi - both).min(axis=1) + 2 * BLUR
        size = self.norms[rows] * norm
        slack = 1 + size * 1e-9
        return size * np.cos(np.minimum(farthest, np.pi)) - slack, size * np.cos(np.maximum(closest, 0)) + slack


def _best(ids: np.ndarray, scores: np.ndarray, depth: int) -> np.ndarray:
    """Places of the ``depth`` highest scores, ties by smaller id."""
    if len(scores) > 4 * depth:
        least = np.partition(scores, len(scores) - depth)[len(scores) - depth]
        few = np.flatnonzero(scores >= least)
    else:
        few = np.arange(len(scores))
    return few[np.lexsort((ids[few], -scores[few]))[:depth]]


def best_positives(block: Block, anchors: dict, depth: int) -> list[tuple]:
    """Rows (anchor, anchor_id, place, id, score, id, score) of the block's best rows of the anchors' labels."""
    out = []
    low = anchors["floor"].astype(np.float64)
    near, starts, ends = block.windows(anchors["norm"], anchors["angles"], low, np.full(len(low), np.inf))
    for i in np.flatnonzero(ends > starts).tolist():
        rows = block.order[starts[i] : ends[i], near[i]]
        rows = rows[(block.labels[rows] == anchors["label"][i]) & (block.ids[rows] != anchors["vec_id"][i])]
        if not len(rows):
            continue
        _, high = block.bounds(rows, anchors["norm"][i], anchors["angles"][i])
        floor = anchors["floor"][i]
        rows, high = rows[high >= floor], high[high >= floor]
        scores = np.zeros(0, np.int64)
        if len(rows) > 16 * depth:  # the most promising ones first; they may settle the rest
            first = np.argpartition(-high, 4 * depth)[: 4 * depth]
            scores = block.score(rows[first], anchors["x"][i])
            block.scored += len(first)
            floor = max(floor, int(np.partition(scores, len(scores) - depth)[len(scores) - depth]))
            rows = rows[high >= floor]
        scores = block.score(rows, anchors["x"][i])
        block.scored += len(rows)
        good = scores >= floor
        rows, scores = rows[good], scores[good]
        for k in _best(block.ids[rows], scores, depth).tolist():
            other, score = int(block.ids[rows[k]]), int(scores[k])
            out.append((int(anchors["number"][i]), int(anchors["vec_id"][i]), 0, other, score, other, score))
    return out


def best_negatives(block: Block, anchors: dict, depth: int) -> list[tuple]:
    """Rows of the block's best rows of other labels in the range of each positive's score."""
    out = []
    wanted = anchors["positives"]  # anchors x depth: ids, scores, floors; absent ones have an empty range
    floors, tops = anchors["floors"], anchors["scores"]
    low = floors.min(axis=1).astype(np.float64)
    high = np.where(anchors["there"], tops, -1).max(axis=1).astype(np.float64)
    near, starts, ends = block.windows(anchors["norm"], anchors["angles"], low, high)
    for i in np.flatnonzero((ends > starts) & (high >= 0)).tolist():
        rows = block.order[starts[i] : ends[i], near[i]]
        rows = rows[block.labels[rows] != anchors["label"][i]]
        if not len(rows):
            continue
        least, most = block.bounds(rows, anchors["norm"][i], anchors["angles"][i])
        rows = rows[(most >= low[i]) & (least <= high[i])]
        scores = block.score(rows, anchors["x"][i])
        block.scored += len(rows)
        for place in np.flatnonzero(anchors["there"][i]).tolist():
            top, floor = int(tops[i, place]), int(floors[i, place])
            inside = np.flatnonzero((scores >= floor) & (100 * scores >= 80 * top) & (scores <= top))
            for k in inside[_best(block.ids[rows[inside]], scores[inside], depth)].tolist():
                row = int(anchors["number"][i]), int(anchors["vec_id"][i]), place, int(wanted[i, place]), top
                out.append((*row, int(block.ids[rows[k]]), int(scores[k])))
    return out


def _saved(arrays: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _loaded(uri: str) -> dict:
    with np.load(io.BytesIO(read_file(uri))) as arrays:
        return dict(arrays)


def _stored(rows: DataFrame, directions: np.ndarray, dims: int) -> DataFrame:
    """The rows with norms and angles, dealt by nearest direction and angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dims, np.int32)
            norms = _norms(x)
            angles = _angles(x, norms, directions)
            near = angles.argmin(axis=1)
            extra = [
                pa.array(norms), pa.array(near.astype(np.int32)), pa.array(angles[np.arange(len(x)), near]),
                pa.FixedSizeListArray.from_arrays(pa.array(angles.ravel()), len(directions)).cast(pa.list_(pa.float32())),
            ]
            kept = [batch.column(c) for c in ("vec_id", "label", "anchor", "x")]
            yield pa.RecordBatch.from_arrays(kept + extra, names=["vec_id", "label", "anchor", "x", "norm", "near", "theta", "angles"])

    found = rows.mapInArrow(run, ROWS)
    return stage(found.repartitionByRange("near", "theta", "vec_id").sortWithinPartitions("near", "theta", "vec_id"), "angles")


def _sample_floor(sample: dict, anchor: dict, i: int, depth: int) -> int:
    """A score that the anchor's last positive reaches, from the sample; the least possible if that has too few rows."""
    same = np.flatnonzero((sample["label"] == anchor["label"][i]) & (sample["vec_id"] != anchor["vec_id"][i]))
    if len(same) < depth:
        return -(1 << 62)
    scores = sample["score"](same, anchor["x"][i])
    return int(np.partition(scores, len(scores) - depth)[len(scores) - depth])


def _write_anchors(stored: DataFrame, folder: str, sample_rows: tuple, dims: int, depth: int) -> list[str]:
    """Files of at most FILE anchors each; returns their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sample = {"vec_id": sample_rows[0], "label": sample_rows[1], "score": Scorer(sample_rows[2])}
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, FILE):
                part = batch.slice(start, FILE)
                arrays = {c: part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "norm")}
                arrays["x"] = matrix(part.column("x"), dims, np.int32)
                arrays["angles"] = matrix(part.column("angles"), len(part.column("angles")[0]), np.float32)
                arrays["number"] = ((task << 20) + number) * FILE + np.arange(part.num_rows)
                arrays["floor"] = np.array([_sample_floor(sample, arrays, i, depth) for i in range(part.num_rows)], np.int64)
                name = f"{folder}/{(task << 20) + number}.npz"
                write_file(name, [_saved(arrays)])
                yield pa.RecordBatch.from_pydict({"name": [name]})
                number += 1

    return sorted(r.name for r in stored.filter("anchor").mapInArrow(run, "name string").collect())


def _search(stored: DataFrame, names: list[str], find, dims: int, depth: int) -> DataFrame:
    """What ``find`` yields for every block of rows and every anchor file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int32() if c == "place" else pa.int64()) for c in (f.split()[0] for f in FOUND.split(", "))])
        step = max(64, BLOCK // max(dims, 1))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                columns = [part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "norm")]
                angles = matrix(part.column("angles"), len(part.column("angles")[0]), np.float32)
                block = Block(columns[0], columns[1], matrix(part.column("x"), dims, np.int32), columns[2], angles)
                for name in names:
                    found = find(block, _loaded(name), depth)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return stored.select("vec_id", "label", "x", "norm", "angles").mapInArrow(run, FOUND)


def _top(found: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """The best rows per key over all blocks, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)


def _write_ranges(positives: DataFrame, folder: str, sample_rows: tuple, depth: int) -> list[str]:
    """Adds the positives and their ranges to the anchors' files, one task per file; returns the new names."""

    def run(part: pa.Table) -> pa.Table:
        file = part["file"][0].as_py()
        arrays = _loaded(f"{folder}/{file}.npz")
        sample = Scorer(sample_rows[2])
        size = len(arrays["number"])
        there = np.zeros((size, depth), bool)
        ids, scores, floors = np.zeros((size, depth), np.int64), np.full((size, depth), -1), np.full((size, depth), 1 << 62)
        for number, rank, other, score in zip(*[part[c].to_pylist() for c in ("anchor", "rank", "other_id", "score")]):
            i, place = number % FILE, rank - 1
            there[i, place] = score >= 0
            ids[i, place], scores[i, place] = other, score
            if score < 0:
                continue
            floors[i, place] = -(-80 * score // 100)
            others = np.flatnonzero(sample_rows[1] != arrays["label"][i])
            seen = sample(others, arrays["x"][i])
            seen = seen[(seen >= floors[i, place]) & (seen <= score)]
            if len(seen) >= depth:
                floors[i, place] = np.partition(seen, len(seen) - depth)[len(seen) - depth]
        name = f"{folder}/ranges/{file}.npz"
        write_file(name, [_saved(arrays | {"there": there, "positives": ids, "scores": scores, "floors": floors})])
        return pa.table({"name": [name]})

    by_file = positives.withColumn("file", F.expr(f"anchor div {FILE}"))
    return sorted(r.name for r in by_file.groupBy("file").applyInArrow(run, "name string").collect())


def mine(rows: DataFrame, anchor: Column, column: str = "embedding", depth: int = DEPTH) -> DataFrame:
    """Hard negatives of the rows for which ``anchor`` holds: columns of the digest.

    ``rows`` has vec_id, label and a vector. Per anchor the ``depth`` best rows of its label are its positives, and per positive
    the ``depth`` best rows of other labels whose score lies between four fifths of the positive's and the positive's.
    """
    spark = rows.sparkSession
    good, dims = usable(rows.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull()), column)
    if not dims:
        return spark.createDataFrame([], RESULT)
    x = F.transform(coordinates(F.col(column), LARGEST), lambda c: c.cast("int"))
    slim = good.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.coalesce(anchor, F.lit(False)).alias("anchor"), x.alias("x"))
    some = slim.select("vec_id", "label", "x").orderBy(F.xxhash64("vec_id"), "vec_id", "label", "x").limit(SAMPLE).collect()
    sample = tuple(np.array(c, np.int64) for c in zip(*[(r.vec_id, r.label, r.x) for r in some]))
    stored = _stored(slim, directions_of(sample[2].astype(np.float64)), dims)
    folder = scratch_path(spark, "anchors")
    names = _write_anchors(stored, folder, sample, dims, depth)
    positives = _top(_search(stored, names, best_positives, dims, depth), ["anchor"], depth)
    positives = stage(positives.select("anchor", "rank", "other_id", "score"), "positives")
    ranges = _write_ranges(positives, folder, sample, depth)
    found = _top(_search(stored, ranges, best_negatives, dims, depth), ["anchor", "place"], depth)
    return found.select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def negatives_digest(rows: DataFrame) -> DataFrame:
    """Hard negatives of every hundredth id, after the labels of every seventh have moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
