"""SimHash near-duplicates with deletion-variant signatures.

Fingerprints of at most two differing bits, cut into two segments, have a segment with at most one
differing bit. Every distinct fingerprint is therefore indexed under its two segments and under all
variants of a segment with one bit left out; fingerprints meet on equal keys and are verified. A key
without a wildcard joins fingerprints whose segment is equal; a key with one joins the two sides of its
bit. Equal fingerprints are one row from the start, so a group of copies counts once.

Where a key is shared by more than ``DENSE`` fingerprints, its members are not compared. They go to
variants of the remaining bits instead (two of them left out, or one where the key already has a
wildcard); all members of such a key are within two bits of each other, so each is linked to the
smallest one only. That is exact, linear in the members, and needs no group in one task.

Defined cases: null and blank texts have fingerprint zero and are linked like any other; a null id
never becomes a component's id unless no member has one; repeated rows are repeated; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.components import components
from emberline.llm.wordhash import bounded
from emberline.sources.scratch import stage

DENSE = 8192
HALF = 32
PIECE = 1 << 16


def _fingerprints(texts: list[str | None], width: int) -> np.ndarray:
    """64-bit SimHash of the word shingles of each text (ASCII lower case, XXH64 with seed 42)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes = []
    for text in texts:
        words = (text or "").encode().lower().split()
        joined = b" ".join(words)
        if len(words) > width:
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            stops = np.cumsum(lengths + 1) - 1
            begins = (stops - lengths).tolist()
            spans = zip(begins, stops[width - 1 :].tolist())
            hashes.append(np.fromiter((digest(joined[b:e], 42) for b, e in spans), np.uint64, len(words) - width + 1))
        else:
            hashes.append(np.array([digest(joined, 42)] if words else [], np.uint64))
    count = np.array([len(h) for h in hashes], np.int64)
    sums = np.zeros((len(texts), 64), np.int64)
    low = 0
    while low < len(texts):  # the bits of PIECE shingles at a time, or of one text, piece by piece
        high = low + 1
        while high < len(texts) and count[low : high + 1].sum() <= PIECE:
            high += 1
        filled = low + np.flatnonzero(count[low:high])
        if high - low > 1 and len(filled):
            begins = np.cumsum(count[filled]) - count[filled]
            sums[filled] = np.add.reduceat(_bits(np.concatenate(hashes[low:high])), begins, axis=0, dtype=np.int64)
        elif len(filled):
            for at in range(0, count[low], PIECE):
                sums[low] += _bits(hashes[low][at : at + PIECE]).sum(axis=0, dtype=np.int64)
        low = high
    return np.packbits(2 * sums > count[:, None], axis=1).view(">u8").reshape(-1).astype("<i8")


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def text_key() -> Column:
    return F.xxhash64(F.col("text"))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_key, fp) of every document; fp is the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch):
                fp = pa.array(_fingerprints(part.column("text").to_pylist(), width), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), fp], ["doc_id", "text_key", "fp"])

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), text_key().alias("text_key"))
    return slim.mapInArrow(run, "doc_id bigint, text_key bigint, fp bigint")


def _keys() -> Column:
    """Array of (key, side) of a fingerprint: segment, bit left out (32: none), the segment's other bits."""
    entries = []
    for segment in (0, 1):
        part = F.shiftrightunsigned("fp", HALF * segment).bitwiseAND(F.lit((1 << HALF) - 1))
        for bit in range(HALF + 1):
            mask = ((1 << HALF) - 1) & ~(1 << bit)
            key = F.lit((segment * 64 + bit) << HALF).bitwiseOR(part.bitwiseAND(F.lit(mask)))
            side = F.shiftright(part, bit).bitwiseAND(F.lit(1)) if bit < HALF else F.lit(0).cast("bigint")
            entries.append(F.struct(key.alias("key"), side.cast("tinyint").alias("side")))
    return F.array(*entries)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing bits; a negative number's are only counted right without its sign."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(members: np.ndarray, sides: np.ndarray | None, within: int) -> tuple[np.ndarray, np.ndarray]:
    """At most len(members) - 1 links that connect all members with up to ``within`` differing bits.

    With ``sides``, members of equal sides aren't compared. Some rows of the comparison at a time.
    """
    label = np.arange(len(members))
    step = max(1, (1 << 20) // len(members))
    for low in range(0, len(members), step):
        near = _differing(members[low : low + step, None], members[None, :]) <= within
        if sides is not None:
            near &= sides[low : low + step, None] != sides[None, :]
        a, b = np.nonzero(near)
        a = a + low
        while (label[a] != label[b]).any():
            small, large = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            np.minimum.at(label, large, small)
            while (label[label] != label).any():
                label = label[label]
    linked = np.flatnonzero(label != np.arange(len(members)))
    return members[linked], members[label[linked]]


def _meet(batches: Iterator[pa.RecordBatch], within: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, fp): verified links of every key's members, one key's rows in memory at a time."""

    def links(keys: np.ndarray, fps: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out_a, out_b = [], []
        edges = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
        sizes = np.diff(edges, append=len(keys))
        twos = edges[sizes == 2]
        close = _differing(fps[twos], fps[twos + 1]) <= within
        out_a.append(fps[twos[close]])
        out_b.append(fps[twos[close] + 1])
        for at, n in zip(edges[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            wild = (keys[at] >> np.int64(HALF)) % 64 < HALF  # only across the two sides of the bit left out
            a, b = _forest(fps[at : at + n], sides[at : at + n] if wild else None, within)
            out_a.append(a)
            out_b.append(b)
        return np.concatenate(out_a), np.concatenate(out_b)

    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "side")]
        if rest is not None:
            columns = [np.concatenate(p) for p in zip(rest, columns)]
        if not len(columns[0]):
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        rest = [c[last:] for c in columns]
        if last:
            yield _batch(*links(*[c[:last] for c in columns]))
    if rest is not None and len(rest[0]):
        yield _batch(*links(*rest))


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _dense_links(dense: DataFrame) -> DataFrame:
    """Links of the members of crowded keys: by variants of the bits that the key doesn't fix."""

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(1 << i) | (1 << j) for i in range(HALF) for j in range(i)] + [1 << i for i in range(HALF)]
        two = np.array(sorted(pairs[: HALF * (HALF - 1) // 2]), np.uint64)
        one = np.array(pairs[HALF * (HALF - 1) // 2 :], np.uint64)
        for batch in batches:
            keys = batch.column("key").to_numpy()
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for low in range(0, len(keys), 2000):
                key, fp = keys[low : low + 2000], fps[low : low + 2000]
                wild = ((key >> np.int64(HALF)) % 64 < HALF)
                other = np.where(key >> np.int64(HALF) >= 64, np.uint64(0), np.uint64(HALF))  # the other segment's place
                for masks, rows in ((two, ~wild), (one, wild)):
                    if rows.any():
                        masked = (fp[rows] >> other[rows] & np.uint64(0xFFFFFFFF))[:, None] & ~masks[None, :]
                        which = np.broadcast_to(masks[None, :], masked.shape)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.repeat(key[rows], len(masks))),
                                pa.array(which.reshape(-1).astype(np.int64)),
                                pa.array(masked.reshape(-1).astype(np.int64)),
                                pa.array(np.repeat(fp[rows].view(np.int64), len(masks))),
                            ],
                            ["key", "mask", "bits", "fp"],
                        )

    spread = dense.select("key", "fp").mapInArrow(variants, "key bigint, mask bigint, bits bigint, fp bigint")
    smallest = spread.groupBy("key", "mask", "bits").agg(F.min("fp").alias("a"), F.max("fp").alias("z"))
    smallest = smallest.filter("a < z").drop("z")
    return spread.join(smallest, ["key", "mask", "bits"]).filter("fp != a").select("a", F.col("fp").alias("b")).distinct()


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) links that connect all fingerprints (column fp) with two or fewer differing bits."""
    spark = distinct.sparkSession
    entries = distinct.select("fp", F.explode(_keys()).alias("e")).select("e.key", "fp", "e.side")
    crowded = stage(entries.groupBy("key").count().filter(F.col("count") > DENSE).select("key"), "crowded-keys")
    rows = distinct.count() * 2 * (HALF + 1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 2_000_000))
    if crowded.isEmpty():
        open_, dense = entries, None
    else:
        open_ = entries.join(crowded, "key", "left_anti")
        dense = entries.join(crowded, "key", "left_semi")
    dealt = open_.repartition(parts, "key").sortWithinPartitions("key", "fp")
    found = dealt.mapInArrow(lambda batches: _meet(batches, 2), "a bigint, b bigint").distinct()
    return found if dense is None else found.unionByName(_dense_links(dense))


def groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_key, fp, component): component is the smallest (id is null, id, text key) reachable."""
    prints = stage(fingerprints(docs, width), "fingerprints")
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    first = stage(prints.groupBy("fp").agg(F.min(member).alias("first")), "distinct-fingerprints")
    labels = components(links(first.select("fp")))
    labelled = first.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    tops = labelled.groupBy("label").agg(F.min("first").alias("component"))
    by_print = stage(labelled.join(tops, "label").select(F.col("fp").alias("_fp"), "component"), "components")
    return prints.join(by_print, F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicates_digest(docs: DataFrame) -> DataFrame:
    return groups(docs.select("doc_id", "text")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component.doc_id").alias("component_id")
    )


def deduplicate(docs: DataFrame, width: int = 3) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id."""
    kept = groups(docs, width).filter(
        F.col("doc_id").eqNullSafe(F.col("component.doc_id")) & (F.col("text_key") == F.col("component.text_key"))
    )
    kept = kept.groupBy(F.col("doc_id").alias("__kept_id"), F.col("text_key").alias("__kept_key")).agg(F.count("*").alias("__rows"))
    kept = stage(kept, "kept-documents")
    same = F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (text_key() == F.col("__kept_key"))
    once = docs.join(kept.filter("__rows = 1"), same, "left_semi")
    repeated = kept.filter("__rows > 1")
    if repeated.isEmpty():
        return once
    rows = docs.join(repeated, same, "left_semi").withColumn("__kept_key", text_key())
    return once.unionByName(rows.dropDuplicates(["doc_id", "__kept_key"]).drop("__kept_key"))
