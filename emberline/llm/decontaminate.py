"""Benchmark decontamination with a distributed positional inverted index.

The index consists of segments, each over some whole documents: the sorted hashes of its terms and, per
term, the ascending word positions (gaps between documents keep a phrase from running across). It is
written once to the shared folder. A phrase of a benchmark item is looked up by intersecting the lists
of its terms, each moved back by the term's place in the phrase, from the rarest term of the segment on.
Segments are independent, so frequent words and passages that many documents share are spread with the
documents. Test phrases are sent to the tasks in blocks of a fixed number of words; hits of several
blocks are put together per document.

A phrase is ``size`` consecutive words of an item, or the whole item where it has fewer words.

Defined cases: null and empty texts have no words and are never hit; an item without words has no phrase;
an item without id hits but is not named; ids may repeat; empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberline.llm.wordhash import ALNUM, Powers, Words
from emberline.sources.scratch import scratch_path, stage

SEGMENT_CHARS = 3 << 20
BLOCK_WORDS = 1 << 18
INDEX = "segment string, ids binary, has_id binary, keys binary, first binary, terms binary, starts binary, places binary"
HITS = "segment string, row int, doc_id bigint, text_key bigint, n_words bigint, hits array<int>, items array<bigint>"


def text_key():
    return F.xxhash64(F.col("text"))


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Write the index of ``docs`` (doc_id, text) to ``path`` and return it."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        powers, number, held, size = Powers(), 0, [], 0

        def segment() -> pa.RecordBatch:
            words = Words([h[1] for h in held], ALNUM, powers)
            counts = np.diff(words.first)
            first = words.first + np.arange(len(words.first))  # one free place behind each document
            places = np.arange(len(words.hashes)) + np.repeat(np.arange(len(held)), counts)
            order = np.argsort(words.hashes, kind="stable")
            terms, starts = np.unique(words.hashes[order], return_index=True)
            sorted_places = places[order].astype("<u4")
            row = {
                "segment": f"{TaskContext.get().partitionId()}-{number}",
                "ids": np.array([h[0] or 0 for h in held], "<i8").tobytes(),
                "has_id": np.array([h[0] is not None for h in held], bool).tobytes(),
                "keys": np.array([h[2] for h in held], "<i8").tobytes(),
                "first": first.astype("<i8").tobytes(),
                "terms": terms.tobytes(),
                "starts": starts.astype("<u4").tobytes(),
                "places": np.diff(sorted_places, prepend=np.uint32(0)).astype("<u4").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], pa.schema([(k, pa.string() if k == "segment" else pa.binary()) for k in row]))

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "text_key")]):
                held.append(row)
                size += len(row[1] or "")
                if size >= SEGMENT_CHARS:
                    yield segment()
                    number, held, size = number + 1, [], 0
        if held:
            yield segment()

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), text_key().alias("text_key"))
    slim.mapInArrow(segments, INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


class Segment:
    """One row of the index, ready for look-ups."""

    def __init__(self, row: dict):
        self.name = row["segment"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.has_id = np.frombuffer(row["has_id"], bool)
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.first = np.frombuffer(row["first"], "<i8")
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.starts = np.frombuffer(row["starts"], "<u4").astype(np.int64)
        self.places = np.cumsum(np.frombuffer(row["places"], "<u4"), dtype=np.uint32)
        self.counts = np.diff(self.starts, append=len(self.places))
        number = np.repeat(np.arange(len(self.terms), dtype=np.uint64), self.counts)
        self._postings = (number << np.uint64(32)) | self.places

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The terms' numbers in this segment, -1 where absent."""
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == hashes, at, -1) if len(self.terms) else np.full(len(hashes), -1)

    def occurs(self, numbers: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each term has a posting at each place."""
        wanted = (numbers.astype(np.uint64) << np.uint64(32)) | places.astype(np.uint64)
        at = np.searchsorted(self._postings, wanted)
        at[at == len(self._postings)] = 0
        return self._postings[at] == wanted

    def phrases(self, words: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place) of every occurrence of the phrases words[begin : begin + size]."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(begins) or not len(self.terms):
            return none
        distinct, back = np.unique(words, return_inverse=True)
        number = self.numbers(distinct)[back]
        count = np.where(number >= 0, self.counts[number], 0)
        widest = int(sizes.max())
        at = begins[:, None] + np.minimum(np.arange(widest), sizes[:, None] - 1)  # short ones repeat their last word
        held = count[at]
        whole = np.flatnonzero(held.min(axis=1) > 0)
        if not len(whole):
            return none
        order = np.argsort(held[whole], axis=1, kind="stable")
        rarest = np.minimum(order[:, 0], sizes[whole] - 1)
        term = number[begins[whole] + rarest]
        n = self.counts[term]
        phrase = np.repeat(np.arange(len(whole)), n)
        posting = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[term], n)
        place = self.places[posting].astype(np.int64) - rarest[phrase]
        keep = place >= 0
        phrase, place = phrase[keep], place[keep]
        for k in range(1, widest):
            if not len(phrase):
                break
            offset = np.minimum(order[phrase, k], sizes[whole][phrase] - 1)
            good = self.occurs(number[begins[whole][phrase] + offset], place + offset)
            phrase, place = phrase[good], place[good]
        return whole[phrase], place

    def near(self, words: np.ndarray, span: int) -> np.ndarray:
        """Places where a stretch of ``span`` words begins with one of the terms and holds them all."""
        number = self.numbers(np.unique(words))
        if (number < 0).any() or not len(number):
            return np.zeros(0, np.int64)
        lists = sorted((self.places[self.starts[t] : self.starts[t] + self.counts[t]].astype(np.int64) for t in number), key=len)
        begin = np.unique(np.concatenate(lists))
        for places in lists:  # the rarest first
            following = np.searchsorted(places, begin)
            inside = following < len(places)
            begin, following = begin[inside], following[inside]
            begin = begin[places[following] < begin + span]
        ends = self.first[np.searchsorted(self.first, begin, side="right")] - 1
        ok = np.ones(len(begin), bool)
        for places in lists:
            ok &= places[np.searchsorted(places, begin)] < ends
        return begin[ok]

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1


class Block:
    """A bounded number of benchmark items as arrays of term hashes."""

    def __init__(self, rows: list[tuple[int | None, str | None]], size: int):
        rows = [r for r in rows if r[1]]
        words = Words([r[1] for r in rows], ALNUM, Powers())
        self.words, self.item_ids = words.hashes, [r[0] for r in rows]
        self.first, counts = words.first, np.diff(words.first)
        n = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
        self.item = np.repeat(np.arange(len(rows)), n)
        self.begins = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(words.first[:-1], n)
        self.sizes = np.minimum(counts[self.item], size) if len(rows) else np.zeros(0, np.int64)


def blocks(benchmark: DataFrame, size: int) -> Iterator[Block]:
    """The benchmark in blocks of at most BLOCK_WORDS words (one item at least), one at a time on the driver."""
    held, words = [], 0
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).filter(F.length("text") > 0)
    for row in items.toLocalIterator():
        n = len(row.text) // 2 + 1
        if held and words + n > BLOCK_WORDS:
            yield Block(held, size)
            held, words = [], 0
        held.append((row.item_id, row.text))
        words += n
    yield Block(held, size)


def _rows(index: DataFrame, block: Block, with_clean: bool) -> DataFrame:
    """HITS rows of one block: the hit word places and hit items per document."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                segment = Segment(batch.slice(at, 1).to_pylist()[0])
                phrase, place = segment.phrases(block.words, block.begins, block.sizes)
                marks = np.zeros(int(segment.first[-1]) + 2, np.int64)
                np.add.at(marks, place, 1)
                np.add.at(marks, place + block.sizes[phrase], -1)
                hit = np.flatnonzero(np.cumsum(marks) > 0)
                owner = segment.document(hit)
                bounds = np.searchsorted(owner, np.arange(len(segment.ids) + 1))
                pairs = np.unique(np.stack([segment.document(place), block.item[phrase]], 1), axis=0)
                out = []
                named = np.searchsorted(pairs[:, 0], np.arange(len(segment.ids) + 1))
                for row in range(len(segment.ids)):
                    low, high = bounds[row], bounds[row + 1]
                    if low == high and not with_clean:
                        continue
                    items = {block.item_ids[i] for i in pairs[named[row] : named[row + 1], 1]} - {None}
                    out.append({
                        "segment": segment.name, "row": row, "doc_id": int(segment.ids[row]) if segment.has_id[row] else None,
                        "text_key": int(segment.keys[row]), "n_words": int(segment.first[row + 1] - segment.first[row] - 1),
                        "hits": (hit[low:high] - segment.first[row]).tolist(), "items": sorted(items),
                    })
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema(
        [("segment", pa.string()), ("row", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))]
    )
    return index.mapInArrow(search, HITS)


def phrase_hits(index: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """One HITS row per document: places of words inside any occurring phrase, and the phrases' items."""
    parts = [_rows(index, block, with_clean=number == 0) for number, block in enumerate(blocks(benchmark, size))]
    if len(parts) == 1:
        return parts[0]
    together = stage(parts[0], "phrase-hits")
    for part in parts[1:]:
        together = together.unionByName(part)
    joined = together.groupBy("segment", "row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("text_key").alias("text_key"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return joined


def proximity_hits(index: DataFrame, benchmark: DataFrame, span: int) -> DataFrame:
    """(item_id, doc_id, place): stretches of ``span`` words that hold all words of an item, in any order."""
    found = None
    for block in blocks(benchmark, 1):
        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    segment, out = Segment(row), []
                    for number, item_id in enumerate(block.item_ids):
                        places = segment.near(block.words[block.first[number] : block.first[number + 1]], span)
                        for doc, place in zip(segment.document(places).tolist(), places.tolist()):
                            doc_id = int(segment.ids[doc]) if segment.has_id[doc] else None
                            out.append({"item_id": item_id, "doc_id": doc_id, "place": int(place - segment.first[doc])})
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())]))

        part = index.mapInArrow(search, "item_id bigint, doc_id bigint, place bigint")
        found = part if found is None else found.unionByName(part)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = 20) -> DataFrame:
    """Verdict per document: contaminated if at least one in ``one_in`` of its words is hit."""
    index = build_index(docs, scratch_path(docs.sparkSession, "postings"))
    rows = phrase_hits(index, benchmark, size)
    n_hit = F.size("hits").cast("bigint")
    named = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(named.cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
        "text_key",
    )


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs.select("doc_id", "text"), benchmark).drop("text_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = 20) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    bad = stage(contamination(docs, benchmark, size, one_in).filter("contaminated"), "contaminated")
    bad = bad.select(F.col("doc_id").alias("__bad_id"), F.col("text_key").alias("__bad_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__bad_id")) & text_key().eqNullSafe(F.col("__bad_key"))
    return docs.join(bad, same, "left_anti")
