"""Exact similarities of token sets, block against block.

At low similarities nearly every two posts of a scope share a key, so a join on keys makes as many rows as there are
pairs. Here no pair is shuffled: the sets are dealt into blocks by their positions, a task holds one block of the asked sets and reads
some of the earlier ones one after another and counts what they have in common. Tokens that many of its sets contain are bits, the
others are looked up in lists. The lists alone, with the bits two sets have at most in common, rule out most pairs; only for the rest the bits
are compared. Sets are ordered by size, so pieces whose sizes don't fit are left out as a whole. A task holds two blocks and a piece of their pairs at
a time; it returns one row per asked set, or the pairs that reach the floor.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from emberline.sources.scratch import scratch_path, stage

COMPARED = ["__node", "__rank", "__size", "__marks"]
BLOCK = 32_768  # sets of a block at most
ENTRIES = 4_000_000  # and tokens of a block, on average
LEAST = 1_024  # sets from which a block is cut for the sake of more tasks
READ = 8  # blocks a task reads
CELLS = 1 << 17  # pairs that are held at a time
WIDTH = 1_024  # and sets of the read block among them
KINDS = 6  # kinds of sets that are told apart
SAMPLE = 256  # sets that pivots are taken from
COLUMNS = 1_024  # tokens that are bits at most
SPARSE = 1_024  # a token in fewer than one of so many pairs is looked up in lists
CUTS = 1_024  # positions that blocks are cut at
CLOSE = 1e-6  # a margin for rounding
MARKS = {"parquet.dictionary.page.size": str(16 << 20)}  # marks recur, and a place among the distinct ones is shorter


def _array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each of ``first`` on, ``n`` of them."""
    ends = np.cumsum(n, dtype=first.dtype)
    return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype=first.dtype)


class Side:
    """Sets of one block, in the order of their sizes; their tokens are places in ``names``."""

    def __init__(self, table: pa.Table):
        node, rank, size, marks = (_array(table.column(name)) for name in COMPARED)
        order = np.argsort(size.to_numpy(), kind="stable")
        self.rank, self.node, self.size = (column.to_numpy()[order] for column in (rank, node, size))
        counts = pc.list_value_length(marks).to_numpy(zero_copy_only=False).astype(np.int64)
        begins, counts = (np.cumsum(counts) - counts)[order], counts[order]
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.row = np.repeat(np.arange(len(order)), counts)
        words = marks.flatten().dictionary_encode()
        names = words.dictionary.to_numpy()
        by_name = np.argsort(names)
        number = np.empty(len(names), np.int64)
        number[by_name] = np.arange(len(names))
        self.names = names[by_name]
        self.codes = number[words.indices.to_numpy()][_runs(begins, counts)]

    def bits(self, place: np.ndarray, width: int) -> np.ndarray:
        """The tokens with a place, as words of 64 bits."""
        out = np.zeros((len(self.rank), -(-max(width, 1) // 64) * 64), bool)
        at = place[self.codes]
        out[self.row[at >= 0], at[at >= 0]] = True
        return np.packbits(out, axis=1).view(np.uint64)


def _kinds(bits: np.ndarray, *sides: np.ndarray) -> list[np.ndarray]:
    """For the rows of each of ``sides`` the pivot they share most bits with; pivots are rows of ``bits`` that share few with each other."""
    near = lambda some, pivot: np.bitwise_count(some & pivot).sum(axis=1) / np.sqrt(np.maximum(np.bitwise_count(some).sum(axis=1), 1) * max(1, int(np.bitwise_count(pivot).sum())))
    some = bits[:: max(1, len(bits) // SAMPLE)]
    pivots, met = [some[0]], near(some, some[0])
    while len(pivots) < KINDS:
        pivots.append(some[int(np.argmin(met))])
        met = np.maximum(met, near(some, pivots[-1]))
    return [np.argmax([near(side, pivot) for pivot in pivots], axis=0) for side in sides]


def _found(left: Side, right: Side, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(a, b, sim)`` of all pairs of a row of ``left`` and an earlier one of ``right`` with a similarity of at least ``need`` of the row, above 0.

    ``need`` is read again for every piece and may rise meanwhile; rows with a need above 1 are done.  Rows are taken by kind and
    size, so that most of a piece's pairs are ruled out, or not, at once.
    """
    if not len(right.names) or not len(left.names):
        return
    # Tokens both sides have, numbered as in ``right``; the others only count for the sizes.
    at = np.minimum(np.searchsorted(right.names, left.names), len(right.names) - 1)
    both = right.names[at] == left.names
    uses = np.zeros(len(right.names), np.int64)
    uses[at[both]] = np.bincount(left.codes, minlength=len(left.names))[both]
    pairs = uses * np.bincount(right.codes, minlength=len(right.names))
    dense = np.argsort(-pairs, kind="stable")[:COLUMNS]
    dense = dense[pairs[dense] * SPARSE > len(left.rank) * len(right.rank)]
    place = np.full(len(right.names), -1)
    place[dense] = np.arange(len(dense))
    own_bits = left.bits(np.where(both, place[at], -1), len(dense))
    bits = right.bits(place, len(dense))
    kind, other_kind = _kinds(bits, own_bits, bits)
    order, other_order = np.lexsort((left.size, kind)), np.lexsort((right.size, other_kind))
    listed = (pairs > 0) & (place < 0)
    # The lists' tokens of either side.
    code = np.where(both & listed[at], at, -1)[left.codes]
    own_row, code = left.row[code >= 0], code[code >= 0]
    first = np.concatenate([[0], np.cumsum(np.bincount(own_row, minlength=len(left.rank)))])
    in_list = listed[right.codes]
    other_row, other_code = right.row[in_list], right.codes[in_list]
    other_first = np.concatenate([[0], np.cumsum(np.bincount(other_row, minlength=len(right.rank)))])
    width = min(WIDTH, CELLS)
    step = max(1, CELLS // min(width, len(right.rank)))
    for begin in range(0, len(right.rank), width):
        tile = other_order[begin : begin + width]
        n = other_first[tile + 1] - other_first[tile]
        codes = other_code[_runs(other_first[tile], n)]
        rows = np.repeat(np.arange(len(tile)), n)[np.argsort(codes, kind="stable")]
        uses = np.bincount(codes, minlength=len(right.names))
        uses, starts = uses.astype(np.int32), (np.cumsum(uses) - uses).astype(np.int32)
        size, rank, tile_bits = right.size[tile], right.rank[tile], bits[tile]
        any_bits, wide, lowest, smallest, largest = np.bitwise_or.reduce(tile_bits), size.astype(np.float32), rank.min(), size.min(), size.max()
        for low in range(0, len(left.rank), step):
            asked = order[low : low + step]
            bound = need[asked] * (1 - CLOSE)
            fits = (bound <= 1) & (left.rank[asked] > lowest) & (left.size[asked] >= bound * smallest) & (largest >= bound * left.size[asked])
            asked, bound = asked[fits], bound[fits]
            if not len(asked):
                continue
            # What a row and the piece's other rows can have in common at most.
            n = first[asked + 1] - first[asked]
            own = code[_runs(first[asked], n)]
            times = uses[own]
            share, most = bound / (1 + bound), np.bitwise_count(own_bits[asked] & any_bits).sum(axis=1).astype(np.float32)
            hit = np.flatnonzero(times)
            own, times, row = own[hit], times[hit], np.repeat(np.arange(len(asked)), n)[hit]
            fits = np.bincount(row, minlength=len(asked)) + most >= share * (left.size[asked] + smallest) * (1 - CLOSE)
            if not fits.all():
                kept = fits[row]
                own, times, row = own[kept], times[kept], (np.cumsum(fits) - 1)[row[kept]]
                asked, share, most = asked[fits], share[fits], most[fits]
                if not len(asked):
                    continue
            met = rows[_runs(starts[own], times)] + np.repeat(row * len(tile), times)
            common = np.bincount(met, minlength=len(asked) * len(tile)).reshape(len(asked), len(tile))
            share = share.astype(np.float32) * np.float32(1 - CLOSE)
            least = np.multiply.outer(share, wide)
            least += (share * left.size[asked].astype(np.float32) - np.float32(CLOSE))[:, None]
            least -= np.minimum.outer(most, np.bitwise_count(tile_bits & np.bitwise_or.reduce(own_bits[asked])).sum(axis=1).astype(np.float32))
            a, b = np.divmod(np.flatnonzero(common >= least), len(tile))
            fits = rank[b] < left.rank[asked[a]]
            a, b = a[fits], b[fits]
            shared = common[a, b] + np.bitwise_count(own_bits[asked[a]] & tile_bits[b]).sum(axis=1)
            sim = shared / np.maximum(left.size[asked[a]].astype(np.float64) + size[b] - shared, 1)
            fits = (sim > 0) & (sim >= need[asked[a]])
            if fits.any():
                yield asked[a[fits]], tile[b[fits]], sim[fits]


def _best(floor: float):
    """The largest similarities of a block with blocks of its scope."""

    def run(left_rows: pa.Table, others: Iterable[pa.Table]) -> pa.Table:
        left = Side(left_rows)
        best, need = np.zeros(len(left.rank)), np.full(len(left.rank), float(floor))
        for right_rows in others:
            for a, _, sim in _found(left, Side(right_rows), need):
                np.maximum.at(best, a, sim)
                need[a] = np.maximum(need[a], best[a])
        found = best > 0
        return pa.table({"node": pa.array(left.node[found], pa.int64()), "sim": pa.array(best[found], pa.float64())})

    return run


def _pairs(floor: float):
    """The pairs of a block with blocks of its scope."""

    def run(left_rows: pa.Table, others: Iterable[pa.Table]) -> pa.Table:
        left = Side(left_rows)
        out, need = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], np.full(len(left.rank), float(floor))
        for right_rows in others:
            right = Side(right_rows)
            out += [(left.node[a], right.node[b], sim) for a, b, sim in _found(left, right, need)]
        node, other, sim = (np.concatenate(c) for c in zip(*out))
        return pa.table({"node": pa.array(node, pa.int64()), "other": pa.array(other, pa.int64()), "sim": pa.array(sim, pa.float64())})

    return run


def _first_pairs(floor: float, crowd: int):
    """The pairs of a block with blocks of its scope; of a set with ``crowd`` of them or more only the earliest one, marked ``more``."""

    def run(left_rows: pa.Table, others: Iterable[pa.Table]) -> pa.Table:
        left = Side(left_rows)
        n, need = np.zeros(len(left.rank), np.int64), np.full(len(left.rank), float(floor))
        earliest = np.full(len(left.rank), np.iinfo(np.int64).max)
        first, out = np.full(len(left.rank), -1), [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for right_rows in others:  # the earliest block first
            right = Side(right_rows)
            for a, b, _ in _found(left, right, need):
                order = np.lexsort((right.rank[b], a))
                a, b = a[order], b[order]
                rows, begin, times = np.unique(a, return_index=True, return_counts=True)
                n[rows] += times
                early = right.rank[b[begin]] < earliest[rows]
                rows, begin = rows[early], begin[early]
                earliest[rows], first[rows] = right.rank[b[begin]], right.node[b[begin]]
                few = n[a] < crowd
                out.append((a[few], right.node[b[few]]))
            need[n >= crowd] = 2
        a, other = (np.concatenate(c) for c in zip(*out))
        a, other = a[n[a] < crowd], other[n[a] < crowd]
        many = np.flatnonzero(n >= crowd)
        more = np.concatenate([np.zeros(len(a), bool), np.ones(len(many), bool)])
        return pa.table(
            {"node": pa.array(left.node[np.concatenate([a, many])], pa.int64()), "other": pa.array(np.concatenate([other, first[many]]), pa.int64()), "more": pa.array(more)}
        )

    return run


def _read_blocks(path: str, group: int, columns: Iterable[int]) -> Iterator[pa.Table]:
    """Blocks of a scope, one after another."""
    system, root = (fs.LocalFileSystem(), path.removeprefix("file:")) if "://" not in path else fs.FileSystem.from_uri(path)
    for column in columns:
        yield pq.read_table(f"{root}/__group={group}/__column={column}", filesystem=system, partitioning=None, columns=COMPARED)


def marked(sets: DataFrame) -> DataFrame:
    """Adds ``marks``, a number for every token; different tokens of ``sets`` have different ones."""
    words = stage(sets.select(F.explode("tokens").alias("token")).distinct(), "words")
    mark = lambda token, seed: F.xxhash64(token, F.lit(seed))
    seed = 0
    while not words.groupBy(mark("token", seed)).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        seed += 1
    return sets.withColumn("marks", F.transform("tokens", lambda token: mark(token, seed)))


def comparable(sets: DataFrame) -> DataFrame:
    """A staged table of sets (``id``, ``pos``, ``tokens``, ``size``) with ``marks``, a number ``node`` of its own and the order ``rank`` of its position.

    Sets without tokens resemble nothing and are left out.
    """
    sets = marked(sets.filter("size > 0")).drop("tokens").withColumn("node", F.monotonically_increasing_id())
    if dict(sets.dtypes)["pos"] == "bigint":
        return stage(sets.withColumn("rank", F.col("pos")), "comparable", **MARKS)
    order = sets.select("pos").distinct().orderBy("pos").withColumn("rank", F.monotonically_increasing_id())
    order = stage(order, "order").withColumnRenamed("pos", "__pos")
    return stage(sets.join(order, F.col("pos").eqNullSafe(F.col("__pos"))).drop("__pos"), "comparable", **MARKS)


def _write_blocks(side: DataFrame, sizes: DataFrame, scope: list[str], block: int, name: str) -> tuple[str, dict[int, list[tuple[int, int, int]]]]:
    """Writes the sets of the scopes ``sizes`` (with ``__group``) by blocks of positions; per group its blocks with their first and last ``rank``."""
    spark = side.sparkSession
    cuts = F.percentile_approx("__rank", [i / CUTS for i in range(1, CUTS)], 10 * CUTS).alias("__cuts")
    facts = (side.join(F.broadcast(sizes), scope) if scope else side.crossJoin(F.broadcast(sizes))).groupBy("__group")
    columns = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("__size") / ENTRIES)).cast("int").alias("__columns")
    facts = stage(facts.agg(columns, cuts).join(sizes, "__group"), "cuts")
    dealt = side.join(F.broadcast(facts), scope).drop(*scope) if scope else side.crossJoin(F.broadcast(facts))
    passed = F.size(F.filter("__cuts", lambda cut: cut < F.col("__rank")))
    column = F.floor(passed * F.col("__columns") / CUTS).cast("int").alias("__column")
    path = scratch_path(spark, name)
    dealt = dealt.select("__group", F.when(F.col("__columns") > 1, column).otherwise(0).alias("__column"), *COMPARED)
    dealt.repartition("__group", "__column").write.options(**MARKS).partitionBy("__group", "__column").parquet(path)
    written = spark.read.schema("__rank bigint, __group bigint, __column int").parquet(path)
    blocks: dict[int, list[tuple[int, int, int]]] = {}
    for r in written.groupBy("__group", "__column").agg(F.min("__rank").alias("low"), F.max("__rank").alias("high")).orderBy("__group", "__column").collect():
        blocks.setdefault(r["__group"], []).append((r["__column"], r["low"], r["high"]))
    return path, blocks


def _compared(left: DataFrame, right: DataFrame, scope: tuple[str, ...], run, schema: str) -> DataFrame:
    """Scopes of one block on either side meet in a task; blocks of larger ones are written once, and a task reads one of the asked sets and some of the others.

    A side that is compared with itself is dealt once.
    """
    spark, whole = left.sparkSession, left is right
    renamed = [F.col(name.strip("_")).alias(name) for name in COMPARED]  # both sides may come from one table
    left, right = (side.dropna(subset=[*scope, "rank"]).select(*[F.col(c).alias(f"__in_{c}") for c in scope], *renamed) for side in (left, right))
    scope = [f"__in_{c}" for c in scope]
    facts = lambda side, n, tokens: side.groupBy(*scope).agg(F.count("*").alias(n), F.sum("__size").alias(tokens))
    own, others = facts(left, "__n", "__tokens"), facts(right, "__m", "__others")
    sizes = own.join(others, scope) if scope else own.crossJoin(others)
    sizes = stage(sizes.filter("__n > 0 and __m > 0"), "sizes")
    # Sets are cut further to keep all cores busy; a block's bounds only matter for memory and balance.
    asked = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    block = min(BLOCK, max(LEAST, math.ceil(asked / (2 * spark.sparkContext.defaultParallelism))))
    alone = (F.greatest("__n", "__m") <= block) & (F.greatest("__tokens", "__others") <= ENTRIES)
    sizes = stage(sizes.select(*scope, alone.alias("__alone"), F.monotonically_increasing_id().alias("__group")), "blocks")
    small, large = (sizes.filter(kind).drop("__alone") for kind in ("__alone", "not __alone"))
    found = [spark.createDataFrame([], schema)]
    if not small.isEmpty():
        deal = lambda side, blocks: side.join(blocks, scope).drop(*scope) if scope else side.crossJoin(F.broadcast(blocks))
        group = lambda side, name: deal(side, small).select(F.col("__group").alias(name), *COMPARED).groupBy(name)
        if whole:
            found.append(group(left, "__l").applyInArrow(lambda rows: run(rows, [rows]), schema))
        else:
            both = group(left, "__l").cogroup(group(right.select(*scope, *[F.col(c).alias(c) for c in COMPARED]), "__r"))
            found.append(both.applyInArrow(lambda rows, others: run(rows, [others] if rows.num_rows and others.num_rows else []), schema))
    if not large.isEmpty():
        path, columns = _write_blocks(right, large, scope, block, "set-blocks")
        own_path, rows = (path, columns) if whole else _write_blocks(left, large, scope, block, "asked-blocks")
        tasks = []
        for g, own in rows.items():
            for r, _, high in own:
                earlier = [c for c, low, _ in columns.get(g, []) if low < high]
                tasks += [(g, r, earlier[i : i + READ]) for i in range(0, len(earlier), READ)]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for task in batch.to_pylist():
                    block = next(_read_blocks(own_path, task["g"], [task["r"]]))
                    yield from run(block, _read_blocks(path, task["g"], task["columns"])).to_batches()

        if tasks:
            listed = spark.createDataFrame(tasks, "g bigint, r int, columns array<int>")
            found.append(listed.repartitionByRange(len(tasks), "g", "r", F.element_at("columns", 1)).mapInArrow(work, schema))
    return reduce(lambda a, b: a.unionByName(b), found)


def best_similarity(left: DataFrame, sets: DataFrame, floor: float, scope: tuple[str, ...] = ()) -> DataFrame:
    """``(node, sim)``: largest similarity with an earlier set, where it reaches ``floor`` and isn't 0; both are ``comparable``."""
    found = _compared(left, sets, scope, _best(floor), "node bigint, sim double")
    return found.groupBy("node").agg(F.max("sim").alias("sim"))


def near_pairs(left: DataFrame, sets: DataFrame, floor: float, scope: tuple[str, ...] = ()) -> DataFrame:
    """``(node, other, sim)``: pairs of a set of ``left`` and an earlier one with similarity of at least ``floor``, above 0."""
    return _compared(left, sets, scope, _pairs(floor), "node bigint, other bigint, sim double")


def first_pairs(left: DataFrame, sets: DataFrame, floor: float, crowd: int) -> DataFrame:
    """``(node, other, more)``: ``near_pairs`` by which sets with many are not flooded.

    Where a task finds ``crowd`` pairs of a set or more, it returns the earliest one only, with ``more``.
    """
    return _compared(left, sets, (), _first_pairs(floor, crowd), "node bigint, other bigint, more boolean")
