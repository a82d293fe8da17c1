"""Removal of long repeats with a logarithmic family of sparse suffix arrays.

A string of ``LENGTH`` bytes occurs again exactly if the windows of that length at two places are equal.
Every window chooses an anchor: the place of its smallest 200-byte fingerprint. Equal windows choose the same
one, so it is enough to sort the suffixes that start at anchors, about one byte in a hundred. A suffix's
entry is the fingerprint of its first 200 bytes and that of the whole stretch covered by the windows that
chose it; entries are ordered by these fingerprints, which puts equal beginnings side by side (their
lexicographic order isn't needed and would cost the bytes).

`SuffixIndex` keeps entries in levels: a batch of documents becomes a sorted level, and while the last two
levels are of about the same size, they are merged, so that there are logarithmically many. A merge-scan
over the levels finds, per beginning,

* stretches that occur twice: all windows in them are repeats;
* beginnings with several stretches, some of them single: only there the windows themselves are compared,
  by one more pass over the texts that counts the fingerprints of these windows.

Both results are sorted arrays in files that the last pass maps and searches, so no text is shuffled and
copies only meet as pre-aggregated counts. Fingerprints have 64 bits.

Defined cases: texts are UTF-8 bytes, null is empty; texts shorter than LENGTH are kept; matches don't cross
documents but may overlap inside one; repeated rows are copies and lose every window; very long texts are
worked on in pieces; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.llm.files import mapped, read_file, write_file
from emberline.llm.wordhash import Powers, bounded, mixed, prefix_sums, stretch_hashes, worker_memory
from emberline.sources.scratch import scratch_path, stage

LENGTH = 400
BEGINNING = 200
PIECE = 1 << 19
BATCHES = 4
PLACE_BITS = np.uint64(24)


@dataclass
class Stretches:
    """The anchors of some texts: the windows from ``low`` to ``high`` of text ``owner`` chose one."""

    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray
    beginning: np.ndarray
    whole: np.ndarray
    sums: np.ndarray
    shift: np.ndarray  # places in the joined bytes minus places in the text

    def windows(self, chosen: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, place in its text, fingerprint) of every window of the chosen stretches."""
        n = self.high[chosen] - self.low[chosen] + 1
        stretch = np.repeat(chosen, n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + self.low[stretch]
        at = place + self.shift[stretch]
        return stretch, place, stretch_hashes(self.sums, at, at + LENGTH, powers)


def stretches(texts: list[bytes], first: list[int], powers: Powers) -> Stretches:
    """Anchors of the windows of pieces of text; ``first`` is each piece's place in its text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return Stretches(none, none, none, none.view(np.uint64), none.view(np.uint64), np.zeros(1, np.uint64), none)
    sums = prefix_sums(data, powers)
    at = np.arange(len(data) - BEGINNING + 1)
    prints = stretch_hashes(sums, at, at + BEGINNING, powers)
    keys = (prints >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64)
    reach, n = LENGTH - BEGINNING + 1, len(data) - LENGTH + 1
    blocks = np.concatenate([keys, np.full(-len(keys) % reach, ~np.uint64(0))]).reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    smallest = np.minimum(behind[:n], ahead[reach - 1 : reach - 1 + n])
    counts = np.maximum(sizes - LENGTH + 1, 0)
    place = np.arange(int(counts.sum())) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    anchor = (smallest[place] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)]))
    if not len(place):
        new = none
    low, high = place[new], place[np.append(new[1:] - 1, len(place) - 1)] if len(new) else none
    anchor = anchor[new]
    piece = np.repeat(np.arange(len(texts)), counts)[new]
    whole = mixed(stretch_hashes(sums, low, high + LENGTH, powers) + (anchor - low).astype(np.uint64))
    shift = begins[piece] - np.array(first, np.int64)[piece]
    return Stretches(piece, low - shift, high - shift, prints[anchor], whole, sums, shift)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[int], list[bytes], list[int]]]:
    """(rows, row number per piece, pieces, first places): documents of about PIECE bytes together.

    A longer text comes alone, cut into pieces that overlap by LENGTH - 1 bytes.
    """
    rows, owners, parts, first, size = [], [], [], [], 0
    for part in (part for batch in batches for part in bounded(batch)):
        for row in zip(*[c.to_pylist() for c in part.columns]):
            text = (row[-1] or "").encode()
            if rows and size + len(text) > PIECE:
                yield rows, owners, parts, first
                rows, owners, parts, first, size = [], [], [], [], 0
            for low in range(0, max(len(text) - LENGTH + 1, 1), PIECE):
                owners.append(len(rows))
                parts.append(text[low : low + PIECE + LENGTH - 1])
                first.append(low)
            rows.append((*row[:-1], text))
            size += len(text)
    if rows:
        yield rows, owners, parts, first


def _chunks(owners: list[int], parts: list[bytes], first: list[int], powers: Powers) -> Iterator[tuple[np.ndarray, Stretches]]:
    """(row number per piece, stretches), with about PIECE bytes worked on at a time."""
    if sum(map(len, parts)) <= 2 * PIECE:
        yield np.array(owners, np.int64), stretches(parts, first, powers)
        return
    for owner, part, low in zip(owners, parts, first):
        yield np.array([owner], np.int64), stretches([part], [low], powers)


def entries(docs: DataFrame, batches: int = 1) -> DataFrame:
    """(batch, beginning, whole, n): the suffix entries of all texts, counted per group of documents."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows, owners, parts, first in pieces(arrow):
            of_row = np.array([zlib.crc32(r[-1]) % batches for r in rows], np.int32)
            for owner, found in _chunks(owners, parts, first, powers):
                batch = of_row[owner[found.owner]] if len(found.owner) else np.zeros(0, np.int32)
                order = np.lexsort((found.whole, found.beginning, batch))
                columns = [batch[order], found.beginning[order], found.whole[order]]
                new = np.ones(len(order), bool)
                new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0][at], pa.int32()),
                        pa.array(columns[1][at].view(np.int64)),
                        pa.array(columns[2][at].view(np.int64)),
                        pa.array(np.diff(at, append=len(order)), pa.int64()),
                    ],
                    ["batch", "beginning", "whole", "n"],
                )

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "batch int, beginning bigint, whole bigint, n bigint")


class SuffixIndex:
    """Levels of sorted suffix entries in a folder; the list of levels is a file beside them."""

    def __init__(self, spark: SparkSession, folder: str, levels: list[dict] | None = None):
        self.spark, self.folder, self.levels = spark, folder, levels or []

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SuffixIndex:
        return cls(spark, folder, json.loads(read_file(f"{folder}/levels.json")))

    def _write(self, rows: DataFrame) -> dict:
        """One level: equal entries added up, dealt by the beginning and sorted."""
        path = scratch_path(self.spark, "suffix-level")
        added = rows.groupBy("beginning", "whole").agg(F.sum("n").alias("n"))
        added.repartition("beginning").sortWithinPartitions("beginning", "whole").write.parquet(path)
        return {"path": path, "rows": self._read(path).count()}

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("beginning bigint, whole bigint, n bigint").parquet(path)

    def add(self, batch: DataFrame) -> None:
        """Add a batch's entries as a level, and merge levels of about the same size."""
        self.levels.append(self._write(batch))
        while len(self.levels) > 1 and self.levels[-2]["rows"] < 2 * self.levels[-1]["rows"]:
            last = self.levels.pop(), self.levels.pop()
            self.levels.append(self._write(self._read(last[0]["path"]).unionByName(self._read(last[1]["path"]))))
        write_file(f"{self.folder}/levels.json", [json.dumps(self.levels).encode()])

    def scan(self) -> DataFrame:
        """Merge-scan of all levels: (beginning, whole, n), every entry once."""
        if not self.levels:
            return self.spark.createDataFrame([], "beginning bigint, whole bigint, n bigint")
        rows = self._read(self.levels[0]["path"])
        for level in self.levels[1:]:
            rows = rows.unionByName(self._read(level["path"]))
        return rows.groupBy("beginning", "whole").agg(F.sum("n").alias("n")) if len(self.levels) > 1 else rows


@dataclass
class NumberSet:
    """Sorted 64-bit numbers in mapped files, one per bucket."""

    folder: str
    buckets: int

    def has(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), bool)
        bucket = (numbers >> np.uint64(40)).astype(np.int64) % self.buckets
        for number in np.unique(bucket).tolist():
            known = worker_memory((self.folder, number), lambda: self._map(number))
            if len(known):
                own = np.flatnonzero(bucket == number)
                at = np.minimum(np.searchsorted(known, numbers[own]), len(known) - 1)
                out[own] = known[at] == numbers[own]
        return out

    def _map(self, number: int) -> np.ndarray:
        try:
            return mapped(f"{self.folder}/{number}").view(np.uint64)
        except FileNotFoundError:  # no number fell into this bucket
            return np.zeros(0, np.uint64)


def write_numbers(numbers: DataFrame, name: str) -> NumberSet:
    """A set from a table of one bigint column without repeats."""
    spark = numbers.sparkSession
    numbers = stage(numbers.toDF("number"), name)
    folder, buckets = scratch_path(spark, name), max(8, -(-numbers.count() // 4_000_000))

    def save(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values = np.sort(table.column("number").to_numpy().view(np.uint64))
        write_file(f"{folder}/{key[0].as_py()}", [values.tobytes()])
        return pa.table({"n": pa.array([len(values)], pa.int64())})

    bucket = F.pmod(F.shiftrightunsigned("number", 40), F.lit(buckets)).cast("int")
    stage(numbers.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(save, "n bigint"), f"{name}-written")
    return NumberSet(folder, buckets)


def _entry(beginning: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return beginning ^ (whole << np.uint64(1) | whole >> np.uint64(63))


@dataclass
class Repeats:
    """What occurs twice: whole stretches (by entry), and windows of the beginnings that needed comparing."""

    stretches: NumberSet
    beginnings: NumberSet
    windows: NumberSet

    def spans(self, texts: list[bytes], owners: list[int], parts: list[bytes], first: list[int], powers: Powers) -> list[np.ndarray]:
        """Per text the maximal runs (begin, end) of repeated bytes."""
        lows, highs, rows = [], [], []
        for owner, found in _chunks(owners, parts, first, powers):
            repeated = self.stretches.has(_entry(found.beginning, found.whole))
            lows.append(found.low[repeated])
            highs.append(found.high[repeated] + LENGTH)
            rows.append(owner[found.owner[repeated]])
            rest = np.flatnonzero(~repeated)
            stretch, place, prints = found.windows(rest[self.beginnings.has(found.beginning[rest])], powers)
            hit = self.windows.has(prints)
            lows.append(place[hit])
            highs.append(place[hit] + LENGTH)
            rows.append(owner[found.owner[stretch[hit]]])
        low, high, row = np.concatenate(lows), np.concatenate(highs), np.concatenate(rows)
        order = np.lexsort((low, row))
        low, high, row = low[order], high[order], row[order]
        edges = np.searchsorted(row, np.arange(len(texts) + 1))
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            begin, reach = low[a:b], np.maximum.accumulate(high[a:b])
            new = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]])) if b > a else np.zeros(0, np.int64)
            ends = reach[np.append(new[1:] - 1, b - a - 1)] if b > a else new
            out.append(np.stack([begin[new], ends], 1))
        return out


def find_repeats(docs: DataFrame, index: SuffixIndex) -> Repeats:
    """Merge-scan the index of ``docs`` and compare the windows where stretches of one beginning differ."""
    scanned = stage(index.scan(), "suffix-scan")
    twice = scanned.filter("n > 1").select(
        F.col("beginning").bitwiseXOR(F.shiftleft("whole", 1).bitwiseOR(F.shiftrightunsigned("whole", 63))).alias("number")
    )
    whole = write_numbers(twice.distinct(), "repeated-stretches")
    differing = scanned.groupBy("beginning").agg(F.count("*").alias("n_wholes"), F.min("n").alias("least"))
    beginnings = write_numbers(differing.filter("n_wholes > 1 AND least = 1").select("beginning"), "differing-beginnings")

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for _, owners, parts, first in pieces(arrow):
            for _, found in _chunks(owners, parts, first, powers):
                chosen = np.flatnonzero(beginnings.has(found.beginning))
                prints, n = np.unique(found.windows(chosen, powers)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(n, pa.int64())], ["number", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "number bigint, n bigint")
    windows = counted.groupBy("number").agg(F.sum("n").alias("n")).filter("n > 1").select("number")
    return Repeats(whole, beginnings, write_numbers(windows, "repeated-windows"))


def build_index(docs: DataFrame, batches: int = BATCHES, folder: str | None = None) -> SuffixIndex:
    """The index of all texts, taken in as several batches."""
    spark = docs.sparkSession
    index = SuffixIndex(spark, folder or scratch_path(spark, "suffix-index"))
    found = stage(entries(docs, batches), "suffix-entries")
    for number in range(batches):
        index.add(found.filter(F.col("batch") == number))
    return index


def _removed(docs: DataFrame, repeats: Repeats, schema: str, row_of) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows, owners, parts, first in pieces(arrow):
            spans = repeats.spans([r[-1] for r in rows], owners, parts, first, powers)
            columns = list(zip(*[row_of(row, span) for row, span in zip(rows, spans)]))
            kinds = [{"bigint": pa.int64(), "string": pa.string()}[part.split()[1]] for part in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.mapInArrow(run, schema)


def _kept(text: bytes, spans: np.ndarray) -> list[bytes]:
    edges = [0, *spans.reshape(-1).tolist(), len(text)]
    return [text[a:b] for a, b in zip(edges[0::2], edges[1::2])]


def removal_digest(docs: DataFrame) -> DataFrame:
    """One row per document: bytes, removed bytes, runs, and the checksum of what is kept."""
    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    repeats = find_repeats(slim, build_index(slim))

    def row_of(row: tuple, spans: np.ndarray) -> tuple:
        doc_id, text = row
        digest = hashlib.sha256()
        for part in _kept(text, spans):
            digest.update(part)
        return doc_id, len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), digest.hexdigest()

    return _removed(slim, repeats, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", row_of)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts without their repeated bytes; characters cut in two are left out."""
    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))

    def row_of(row: tuple, spans: np.ndarray) -> tuple:
        return row[0], b"".join(_kept(row[1], spans)).decode(errors="ignore")

    return _removed(slim, find_repeats(slim, build_index(slim)), "doc_id bigint, text string", row_of)
