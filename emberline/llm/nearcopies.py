"""Near copies at a similarity of shingle sets, found by wide SimHash fingerprints with deletion variants.

Two 64-bit SimHashes of the same shingles (the second from scrambled hashes) make a fingerprint of 128 bits, cut into
eight segments of 16. Fingerprints meet where a segment differs by at most one bit. Such segments have a half in
common, so every fingerprint goes to two buckets per segment; there it is indexed under the variants of the
other half with one bit left out. Those within ``REACH`` bits of each other are candidates, and
their whole sets of word shingles are compared (by 32-bit hashes of them).

Texts whose shingles have the similarity 0.8 differ in about a tenth to a sixth of the bits, so all eight
segments differ by two bits or more for a few per cent of such pairs: these are not found. Everything that is linked
has the asked similarity. Variants with more than ``DENSE`` members are first cut into runs of neighbouring
fingerprints, each compared in itself and with the first members. Where a variant's members have over ``MANY`` candidate pairs
each, every member is first paired with the smallest one of those connected to it, so a large group of near copies makes about one
pair per member and variant. Members of such variants meet once more after that, with their shingle sets, and every pair within ``REACH``
bits whose members are not yet in one group is compared as well (``remaining``): no link of a variant is lost. The comparison is made
where they meet: pairs are not rows, only links that join two groups come out. That second meeting holds a bucket's sets and a slice of
a variant's pairs at a time; its work grows with the square of a variant's members.

Defined cases (for `deduplicate`): texts without words are copies of each other; equal fingerprints count as copies; of a
group the document with the smallest id stays, one without an id only if no member has one; of repeated rows one
stays; other columns are kept, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.components import components
from emberline.llm.wordhash import NOT_BLANK, Powers, Words, bounded, mixed
from emberline.operators.sizing import broadcast_if_bytes
from emberline.sources.scratch import stage

SEGMENTS, BITS = 8, 16
REACH = 26
DENSE = 8192
FIRST = 64
MANY = 4
PAIRS = "a bigint, b bigint"
CHARS = 1 << 19  # bytes of text that are worked on at a time
ROW = 128  # bytes of a document's id and key in a broadcast table
PIECE = 1 << 16  # shingles whose bits, or pairs whose bins, are held at a time
BINS = 64  # a power of two


def text_key() -> Column:
    return F.xxhash64(F.col("text"))


def shingle_hashes(texts: list[str | None], width: int, powers: Powers) -> list[np.ndarray]:
    """Hashes of the word shingles of each text, ASCII letters in lower case; a shorter text is one shingle."""
    words = Words(texts, NOT_BLANK, powers)
    salts = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    n = len(words.hashes)
    sums = np.zeros(max(0, n - width + 1), np.uint64)
    for place in range(width):
        sums += mixed(words.hashes[place : place + len(sums)] + salts[place])
    sums, out = mixed(sums), []
    for begin, end in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if end - begin >= width:
            out.append(sums[begin : end - width + 1])
        else:
            own = words.hashes[begin:end]
            out.append(mixed(mixed(own + salts[: len(own)]).sum(keepdims=True)) if len(own) else own)
    return out


def simhashes(hashes: list[np.ndarray]) -> np.ndarray:
    """Per list of hashes 64 bits, each set if it is set in over half of them."""
    count = np.array([len(h) for h in hashes], np.int64)
    sums, low = np.zeros((len(hashes), 64), np.int64), 0
    while low < len(hashes):
        if count[low] > PIECE:  # one long text, piece by piece
            for at in range(0, count[low], PIECE):
                sums[low] += _bits(hashes[low][at : at + PIECE]).sum(axis=0, dtype=np.int64)
            low += 1
            continue
        high = low + max(1, int(np.searchsorted(np.cumsum(count[low : low + PIECE]), PIECE, side="right")))
        filled = low + np.flatnonzero(count[low:high])
        if len(filled):
            begins = np.cumsum(count[filled]) - count[filled]
            sums[filled] = np.add.reduceat(_bits(np.concatenate(hashes[low:high])), begins, axis=0, dtype=np.int64)
        low = high
    return np.packbits(2 * sums > count[:, None], axis=1).view(">u8").reshape(-1).astype("<i8")


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, low, high): both halves of every document's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in bounded(batch, chars=CHARS):
                hashes = shingle_hashes(part.column("text").to_pylist(), width, powers)
                low, high = simhashes(hashes), simhashes([mixed(h) for h in hashes])
                columns = [part.column("doc_id"), part.column("text_key"), pa.array(low, pa.int64()), pa.array(high, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "low", "high"])

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), text_key().alias("text_key"))
    return slim.mapInArrow(run, "doc_id bigint, text_key bigint, low bigint, high bigint")


def _buckets() -> Column:
    """Where a fingerprint meets others: segment, which of the segment's halves is fixed, and that half.

    Two segments that differ by one bit at most have one half in common, so two entries a segment are enough;
    the variants of the other half are made by the task that holds a bucket.
    """
    buckets = []
    for segment in range(SEGMENTS):
        part = F.shiftrightunsigned(F.col("low" if segment < SEGMENTS // 2 else "high"), BITS * (segment % (SEGMENTS // 2)))
        for half in (0, 1):
            fixed = F.shiftrightunsigned(part, BITS // 2 * half).bitwiseAND(F.lit((1 << BITS // 2) - 1)).cast("int")
            buckets.append(F.lit((segment * 2 + half) << BITS // 2).bitwiseOR(fixed))
    return F.array(*buckets)


def _near(low: np.ndarray, high: np.ndarray, rows: slice, others: slice) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs (row, other) within REACH bits, row before other."""
    differ = np.bitwise_count(low[rows, None] ^ low[None, others]) + np.bitwise_count(high[rows, None] ^ high[None, others])
    a, b = np.nonzero(differ <= REACH)
    a, b = a + rows.start, b + others.start
    ahead = a < b
    return a[ahead], b[ahead]


def _linked(node: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one key's members: all of them, or a forest and every member with itself where they are very many."""
    n = len(node)
    blocks = [(slice(at, min(n, at + DENSE)), at) for at in range(0, n, DENSE)]
    label = np.arange(n)
    all_a, all_b, crowded = [], [], False
    for block, at in blocks:
        step = max(1, (1 << 20) // (block.stop - block.start))
        spans = [(slice(r, min(block.stop, r + step)), slice(r, block.stop)) for r in range(block.start, block.stop, step)]
        if at:
            spans.append((slice(0, min(FIRST, at)), block))
        for rows, others in spans:
            a, b = _near(low, high, rows, others)
            if not crowded:
                all_a.append(a)
                all_b.append(b)
                crowded = sum(map(len, all_a)) > MANY * n
                if crowded:
                    a, b = np.concatenate(all_a), np.concatenate(all_b)
            if crowded:
                while (label[a] != label[b]).any():
                    small, large = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
                    np.minimum.at(label, large, small)
                    while (label[label] != label).any():
                        label = label[label]
    if crowded:  # every member with the smallest node of its component
        first = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(first, label, node)
        first = first[label]
        rest = first != node
        return np.concatenate([first[rest], node]), np.concatenate([node[rest], node])
    a, b = np.concatenate(all_a), np.concatenate(all_b)
    cut = node if n > DENSE else node[:0]
    return np.concatenate([np.minimum(node[a], node[b]), cut]), np.concatenate([np.maximum(node[a], node[b]), cut])


def _variants(bucket: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[np.ndarray]:
    """Keys under which fingerprints of a bucket meet whose segments' other halves differ by one bit at most."""
    segment, half = bucket >> (BITS // 2 + 1), bucket >> (BITS // 2) & 1
    word = np.where(segment < SEGMENTS // 2, low, high)
    shift = BITS * (segment % (SEGMENTS // 2)) + BITS // 2 * (1 - half)
    other = (word >> shift.astype(np.uint64)).astype(np.int64) & ((1 << BITS // 2) - 1)
    for bit in range(BITS // 2):
        yield bucket.astype(np.int64) << (BITS // 2) | other & ~(1 << bit)


def _whole_buckets(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by bucket, cut between buckets; the first ones are bucket, node, low and high."""
    rest = None
    for batch in chain(batches, [None]):
        if batch is None:
            columns, last = rest, len(rest[0]) if rest is not None else 0
        else:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            columns[2:4] = [c.view(np.uint64) for c in columns[2:4]]  # bits are only counted right without a sign
            if rest is not None:
                columns = [np.concatenate(p) for p in zip(rest, columns)]
            if not len(columns[0]):
                continue
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            rest = [c[last:] for c in columns]
        if last:
            yield [c[:last] for c in columns]


def _pairs_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and fingerprint: candidate pairs, one bucket's rows in memory at a time."""
    for bucket, node, low, high in _whole_buckets(batches, ["bucket", "node", "low", "high"]):
        out_a, out_b = [], []
        for key in _variants(bucket, low, high):
            order = np.argsort(key, kind="stable")
            for a, b in _equal_keys(key[order], node[order], low[order], high[order]):
                out_a.append(a)
                out_b.append(b)
        yield _pairs_batch(out_a, out_b)


def _first_meeting(low: np.ndarray, high: np.ndarray, place: int, bit: int) -> np.ndarray:
    """Whether pairs that differ in these bits meet in the variant ``bit`` of the bucket ``place`` (segment and half) and nowhere before it."""
    first = np.ones(len(low), bool)
    for at in range(place + 1):
        segment, half = divmod(at, 2)
        word = low if segment < SEGMENTS // 2 else high
        shift = BITS * (segment % (SEGMENTS // 2))
        fixed, other = (word >> np.uint64(shift + BITS // 2 * h) & np.uint64((1 << BITS // 2) - 1) for h in (half, 1 - half))
        if at < place:
            first &= (fixed != 0) | (np.bitwise_count(other) > 1)
        else:
            first &= (other == 1 << bit) | ((other == 0) if bit == 0 else False)
    return first


def _bins(sets: list[np.ndarray]) -> np.ndarray:
    """Per set the number of its shingles in each of ``BINS`` bins: two sets have at most the bins' smaller numbers in common."""
    sizes = [len(s) for s in sets]
    codes = np.concatenate(sets).view(np.uint32) & np.uint32(BINS - 1)
    rows = np.repeat(np.arange(len(sets)), sizes) * BINS
    return np.bincount(rows + codes, minlength=len(sets) * BINS).reshape(-1, BINS).astype(np.int32)


def _links_again(similarity: float):
    """Rows sorted by bucket: links that join all labels of a bucket's candidate pairs with at least the similarity.

    A pair is compared in the first variant it meets in only, and not if verified links of the task already join its members. What
    is returned is a forest over a bucket's labels, so it has fewer rows than the bucket has members.
    """

    def similar(both, total):
        return both >= similarity * (total - both) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, node, low, high, label, sets in _whole_buckets(batches, ["bucket", "node", "low", "high", "label", "shingles"]):
            names, group = np.unique(label, return_inverse=True)
            top = np.arange(len(names))
            size, bins = np.fromiter(map(len, sets), np.int64, len(sets)), _bins(list(sets))
            out_a, out_b = [node[:0]], [node[:0]]
            for bit, key in enumerate(_variants(bucket, low, high)):
                order = np.argsort(key, kind="stable")
                edges = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] - 1))
                for own in np.split(order, edges[1:]):
                    if len(own) < 2 or (top[group[own]] == top[group[own[0]]]).all():
                        continue
                    step = max(1, (1 << 20) // len(own))
                    for begin in range(0, len(own), step):
                        left, right = _near(low[own], high[own], slice(begin, min(len(own), begin + step)), slice(begin, len(own)))
                        for at in range(0, len(left), PIECE):
                            a, b = own[left[at : at + PIECE]], own[right[at : at + PIECE]]
                            apart = top[group[a]] != top[group[b]]
                            a, b = a[apart], b[apart]
                            met = _first_meeting(low[a] ^ low[b], high[a] ^ high[b], int(bucket[own[0]]) >> BITS // 2, bit)
                            a, b = a[met], b[met]
                            maybe = similar(np.minimum(bins[a], bins[b]).sum(axis=1), size[a] + size[b])
                            for i, j in zip(a[maybe].tolist(), b[maybe].tolist()):
                                x, y = top[group[i]], top[group[j]]
                                if x != y and similar(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), size[i] + size[j]):
                                    top[top == max(x, y)] = min(x, y)
                                    out_a.append(np.minimum(node[[i]], node[[j]]))
                                    out_b.append(np.maximum(node[[i]], node[[j]]))
            yield _pairs_batch(out_a, out_b)

    return run


def _equal_keys(key: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of rows sorted by key, among those with equal keys."""
    edges = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    sizes = np.diff(edges, append=len(key))
    size, ends = np.repeat(sizes, sizes), np.repeat(edges + sizes, sizes)
    for shift in range(1, 8):  # small keys all at once: members that are ``shift`` places apart
        at = np.flatnonzero((size <= 8) & (np.arange(len(key)) + shift < ends))
        close = np.bitwise_count(low[at] ^ low[at + shift]) + np.bitwise_count(high[at] ^ high[at + shift]) <= REACH
        a, b = node[at[close]], node[at[close] + shift]
        yield np.minimum(a, b), np.maximum(a, b)
    for at, n in zip(edges[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
        yield _linked(node[at : at + n], low[at : at + n], high[at : at + n])


def candidates(distinct: DataFrame) -> DataFrame:
    """(a, b) pairs of nodes whose fingerprints (node, low, high) meet on a key and are within REACH bits.

    Where a key has more of them than are returned, its members are also returned as pairs with themselves.
    """
    return _dealt(distinct, "low", "high").mapInArrow(_meet, PAIRS).distinct()


def remaining(labelled: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links of at least the similarity that join what all such pairs of the nodes (node, low, high, label, shingles) join."""
    return _dealt(labelled, "low", "high", "label", "shingles").mapInArrow(_links_again(similarity), PAIRS).distinct()


def _dealt(distinct: DataFrame, *columns: str) -> DataFrame:
    spark = distinct.sparkSession
    entries = distinct.select(F.explode(_buckets()).alias("bucket"), "node", *columns)
    rows = distinct.count() * 2 * SEGMENTS
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 1_000_000))
    return entries.repartition(parts, "bucket").sortWithinPartitions("bucket", "low", "high")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the distinct word shingles of each text, as 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in bounded(batch, chars=CHARS):
                sets = [np.unique(h.astype(np.uint32)).view(np.int32) for h in shingle_hashes(part.column("text").to_pylist(), width, powers)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int32()))], names=["node", "shingles"])

    return texts.select("node", F.col("text").cast("string")).mapInArrow(run, "node bigint, shingles array<int>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have at least the asked similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_right"))
    both = F.size(F.array_intersect("_left", "_right"))
    total = F.size("_left") + F.size("_right")
    return pairs.join(left, "a").join(right, "b").filter(both >= F.lit(similarity) * (total - both) - 1e-9).select("a", "b")


def groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, finger_width: int = 3) -> DataFrame:
    """(doc_id, text_key, component) of every row; component is the smallest (id is null, id, text key) reachable."""
    prints = stage(fingerprints(docs, finger_width), "wide-fingerprints")
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    first = prints.groupBy("low", "high").agg(F.min(member).alias("first")).withColumn("node", F.monotonically_increasing_id())
    first = stage(first, "distinct-fingerprints")
    pairs = stage(candidates(first), "candidates")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    owners = stage(first.join(asked, "node").select("node", F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key")), "owners")
    few = broadcast_if_bytes(owners, owners.count(), ROW)  # texts are not shuffled for them while they are few
    texts = docs.select("doc_id", "text", text_key().alias("_own")).join(few, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_own").eqNullSafe(F.col("_key")))
    sets = stage(shingle_sets(texts, width), "shingles").dropDuplicates(["node"])
    links = stage(verified(pairs.filter("a <> b"), sets, similarity), "near-copies")
    labels = components(links)
    cut = first.join(pairs.filter("a = b").select(F.col("a").alias("node")), "node", "left_semi")
    if not cut.isEmpty():
        cut = cut.join(labels, "node", "left").select("node", "low", "high", F.coalesce("label", "node").alias("label"))
        cut = stage(cut.join(sets, "node"), "cut-variants")
        links = links.unionByName(stage(remaining(cut, similarity), "more-near-copies"))
        labels = components(links)
    labelled = first.join(labels, "node", "left").select("low", "high", "first", F.coalesce("label", "node").alias("label"))
    tops = labelled.groupBy("label").agg(F.min("first").alias("component"))
    by_print = labelled.join(tops, "label").select(F.col("low").alias("_low"), F.col("high").alias("_high"), "component")
    by_print = stage(by_print, "components")
    return prints.join(by_print, (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high"))).select("doc_id", "text_key", "component")


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near copies, with all its columns: the one with the smallest id."""
    kept = groups(docs, width, similarity).filter(
        F.col("doc_id").eqNullSafe(F.col("component.doc_id")) & F.col("text_key").eqNullSafe(F.col("component.text_key"))
    )
    kept = kept.groupBy(F.col("doc_id").alias("__kept_id"), F.col("text_key").alias("__kept_key")).agg(F.count("*").alias("__rows"))
    kept = stage(kept, "kept-documents")
    same = F.col("doc_id").eqNullSafe(F.col("__kept_id")) & text_key().eqNullSafe(F.col("__kept_key"))
    few = broadcast_if_bytes(kept.filter("__rows = 1"), kept.count(), ROW)
    once = docs.join(few, same, "left_semi")
    repeated = kept.filter("__rows > 1")
    if repeated.isEmpty():
        return once
    rows = docs.join(repeated, same, "left_semi").withColumn("__kept_key", text_key())
    return once.unionByName(rows.dropDuplicates(["doc_id", "__kept_key"]).drop("__kept_key"))
