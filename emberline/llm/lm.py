"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped files.

Counting: every task reduces its documents to distinct (word, next word) pairs with counts and sends them
to buckets, packed. A pair's bucket depends on both words, so the followers of a frequent word are spread.
A bucket adds up its pairs and writes them as one file, a sorted array of 64-bit pair hashes and the counts
beside it. What it knows about contexts (how often a word is followed, by how many words once, twice, more
often) and about words (how many words they follow) is added up per word in a second round and written
likewise. Only sums over the whole corpus and the file names pass the driver.

Scoring: workers map the files and look the distinct pairs of some texts up by binary search.

    p(w | v) = (c(vw) - D(c)) / c(v) + g(v) * q(w),    q(w) = (n(w) - D'(n)) / n + g' / (V + 1)

with c counts, n(w) the number of distinct words before w, D the three discounts estimated from the
counts of counts, and g the mass they free. A word never followed falls back to q alone, an unknown word to
the last term. Words are hashed to 64 bits, followers to 48 of them.

The order is two: three is expected to write and shuffle over four times the input, which was not measured.

Defined cases: null and empty texts are the end token alone; a null id is text "null" for the fold; repeated
rows count repeatedly; with nothing to learn from, every token has probability 1 / (V + 1) = 1; an empty
table gives an empty table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberline.llm.files import mapped, write_file
from emberline.llm.text import held_out
from emberline.llm.wordhash import NOT_BLANK, Powers, Words, bounded, mixed, worker_memory
from emberline.sources.scratch import scratch_path, stage

BEGIN, END = np.uint64(1), np.uint64(2)
BUCKET_CHARS = 24 << 20
TASK_PAIRS = 6 << 20
LOW48 = np.uint64((1 << 48) - 1)
ROW = "kind string, bucket int, body binary"


def token_stream(texts: list[str | None], powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, tokens per text): the words of each text and the end, each after what precedes it."""
    words = Words(texts, NOT_BLANK, powers)
    tokens = np.insert(words.hashes, words.first[1:], END)
    counts = np.diff(words.first) + 1
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(counts) - counts] = BEGIN
    return before, tokens, counts


def pair_bucket(before: np.ndarray, after: np.ndarray, buckets: int) -> np.ndarray:
    """By a hash of both words, so the followers of one word are dealt over all buckets."""
    return ((pair_key(before, after) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def word_bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    return ((word & LOW48) >> np.uint64(16)).astype(np.int64) % buckets


def pair_key(before: np.ndarray, after48: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(3) + after48)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where a sorted array's runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _added(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys, and the sums of the values of equal ones."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = _runs(keys)
    return keys[at], *[np.add.reduceat(v[order].astype(np.int64), at) if len(at) else v.astype(np.int64) for v in values]


def _press(*arrays: np.ndarray) -> bytes:
    import zstandard

    packer = zstandard.ZstdCompressor(level=1)
    parts = [packer.compress(a.tobytes()) for a in arrays]
    return struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


def _unpress(body: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    sizes = struct.unpack_from(f"<{len(kinds)}Q", body)
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(body[at : at + size]), kind))
        at += size
    return out


def _six(words: np.ndarray) -> np.ndarray:
    """48-bit numbers as six bytes each."""
    return np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _eight(six: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(six) // 6, 8), np.uint8)
    wide[:, :6] = six.reshape(-1, 6)
    return wide.view("<u8").reshape(-1)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds, buckets, bodies = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(buckets, pa.int32()), pa.array(bodies, pa.binary())], ["kind", "bucket", "body"]
    )


def _pairs(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed pairs of the training documents, (kind, bucket, body)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size = Powers(), [], 0

        def packed() -> pa.RecordBatch:
            before = np.concatenate([h[0] for h in held])
            after = np.concatenate([h[1] for h in held])
            keys = pair_key(before, after & LOW48)
            order = np.argsort(keys, kind="stable")
            at = _runs(keys[order])
            counts = np.diff(at, append=len(order)).astype("<u4")
            before, after = before[order[at]], after[order[at]]
            bucket = pair_bucket(before, after & LOW48, buckets)
            order = np.lexsort((after & LOW48, before, bucket))
            before, after, counts, bucket = before[order], after[order], counts[order], bucket[order]
            edges = np.append(_runs(bucket), len(bucket))
            out = []
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = _runs(before[low:high])
                followers = np.diff(own, append=high - low).astype("<u4")
                body = _press(before[low:high][own], followers, _six(after[low:high] & LOW48), counts[low:high])
                out.append(("pairs", int(bucket[low]), body))
            return _rows(out)

        for batch in batches:
            for part in bounded(batch):
                before, after, _ = token_stream(part.column("text").to_pylist(), powers)
                held.append((before, after))
                size += len(after)
                if size >= TASK_PAIRS:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    return docs.select(F.col("text").cast("string")).mapInArrow(count, ROW)


def _array_file(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Arrays one after another behind a header of their lengths in bytes."""
    head = struct.pack(f"<Q{len(arrays)}Q", len(arrays), *[a.nbytes for a in arrays])
    write_file(f"{folder}/{name}", [head, *[a.tobytes() for a in arrays]])


def _map_arrays(uri: str, *kinds: str) -> list[np.ndarray]:
    raw = mapped(uri)
    sizes = np.frombuffer(raw[8 : 8 + 8 * len(kinds)].tobytes(), "<u8").astype(np.int64)
    ends = 8 + 8 * len(kinds) + np.cumsum(sizes)
    return [raw[end - size : end].view(kind) if size else np.zeros(0, kind) for size, end, kind in zip(sizes.tolist(), ends.tolist(), kinds)]


def _count_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.array([(counts == k).sum() for k in (1, 2, 3, 4)], np.int64)


def _merge_pairs(folder: str, buckets: int):
    """A bucket's pairs: its file, and packed sums per context and per follower."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        before, after, counts = [], [], []
        for body in table.column("body").to_pylist():
            words, followers, six, n = _unpress(body, "<u8", "<u4", "u1", "<u4")
            before.append(np.repeat(words, followers))
            after.append(_eight(six))
            counts.append(n)
        before, after, counts = np.concatenate(before), np.concatenate(after), np.concatenate(counts)
        keys = pair_key(before, after)
        order = np.argsort(keys, kind="stable")
        at = _runs(keys[order])
        totals = np.add.reduceat(counts[order].astype(np.int64), at)
        keys, before, after = keys[order[at]], before[order[at]], after[order[at]]
        large = np.flatnonzero(totals > 254)
        _array_file(folder, f"pairs-{bucket}", keys, np.minimum(totals, 255).astype(np.uint8), keys[large], totals[large])
        context, c, n1, n2, n3 = _added(before, totals, totals == 1, totals == 2, totals > 2)
        follower, n = _added(after, np.ones(len(after), np.int64))
        out = [("sums", bucket, _press(_count_of_counts(totals)))]
        for kind, words, arrays in (("context", context, (c, n1, n2, n3)), ("follower", follower, (n,))):
            home = word_bucket(words, buckets)
            order = np.argsort(home, kind="stable")
            edges = np.append(_runs(home[order]), len(order))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = order[low:high]
                out.append((kind, int(home[own[0]]), _press(words[own], *[a[own].astype("<i8") for a in arrays])))
        return pa.Table.from_batches([_rows(out)])

    return run


def _merge_words(folder: str):
    """A bucket's contexts or followers: their file and sums."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, bucket = key[0].as_py(), key[1].as_py()
        width = {"context": 4, "follower": 1, "sums": 0}[kind]
        if not width:
            bodies = [_unpress(b, "<i8")[0] for b in table.column("body").to_pylist()]
            return pa.Table.from_batches([_rows([("pair sums", bucket, _press(np.sum(bodies, axis=0)))])])
        parts = [_unpress(b, "<u8", *["<i8"] * width) for b in table.column("body").to_pylist()]
        words, *values = _added(*[np.concatenate(p) for p in zip(*parts)])
        _array_file(folder, f"{kind}-{bucket}", words, *[v.astype("<i8") for v in values])
        if kind == "context":
            real = words != BEGIN
            sums = np.array([values[0].sum(), real.sum(), values[0][~real].sum()], np.int64)  # N, words, ends
        else:
            sums = np.append(_count_of_counts(values[0]), [values[0].sum(), len(words), (values[0] > 2).sum()])
        return pa.Table.from_batches([_rows([(f"{kind} sums", bucket, _press(sums.astype("<i8")))])])

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """The three discounts (counts of 1, 2 and more) from the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return np.array([0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.clip(raw, 0.05, [1.0, 2.0, 3.0])


@dataclass
class Bigrams:
    """Where the files are, and the sums over the whole corpus."""

    folder: str
    buckets: int
    tokens: int  # N, end tokens included
    words: int  # V, the end token included
    ends: int
    discount: np.ndarray
    lower: np.ndarray  # discounts of the numbers of preceding words
    pairs: int
    lower_mass: float

    def open(self) -> Lookup:
        return worker_memory(("bigrams", self.folder), lambda: Lookup(self))


def count_bigrams(docs: DataFrame, folder: str | None = None) -> Bigrams:
    """Count the model of all whole texts of ``docs`` into files below ``folder``."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "bigrams")
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(16, -(-chars // BUCKET_CHARS))
    pairs = _pairs(docs, buckets)
    merged = stage(pairs.groupBy("bucket").applyInArrow(_merge_pairs(folder, buckets), ROW), "bigram-words")
    merged = merged.withColumn("bucket", F.when(F.col("kind") == "sums", F.lit(0)).otherwise(F.col("bucket")))
    done = stage(merged.groupBy("kind", "bucket").applyInArrow(_merge_words(folder), ROW), "bigram-sums")
    sums: dict[str, np.ndarray] = {}
    for row in done.collect():  # some numbers per bucket
        own = _unpress(row.body, "<i8")[0]
        sums[row.kind] = own + sums.get(row.kind, 0)
    tokens, words, ends = (int(x) for x in sums.get("context sums", np.zeros(3, np.int64)))
    n = sums.get("follower sums", np.zeros(7, np.int64))
    lower = discounts(n[:4])
    mass = float(lower @ [n[0], n[1], n[6]]) / float(n[4]) if n[4] else 1.0
    top = sums.get("pair sums", np.zeros(4, np.int64))
    return Bigrams(folder, buckets, tokens, words + (ends > 0), ends, discounts(top), lower, int(n[4]), mass)


class Lookup:
    """The mapped files of a model."""

    def __init__(self, model: Bigrams):
        self.model = model
        self.files: dict[tuple[str, int], list[np.ndarray]] = {}

    def _file(self, kind: str, bucket: int, *kinds: str) -> list[np.ndarray]:
        if (kind, bucket) not in self.files:
            try:
                arrays = _map_arrays(f"{self.model.folder}/{kind}-{bucket}", *kinds)
            except FileNotFoundError:  # nothing fell into this bucket
                arrays = [np.zeros(0, k) for k in kinds]
            self.files[kind, bucket] = arrays
        return self.files[kind, bucket]

    def _find(self, kind: str, keys: np.ndarray, bucket: np.ndarray, kinds: tuple[str, ...], width: int) -> np.ndarray:
        """Values of sorted keys, 0 where absent; one binary search per bucket."""
        out = np.zeros((width, len(keys)), np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.append(_runs(bucket[order]), len(order))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own = order[low:high]
            known, *values = self._file(kind, int(bucket[own[0]]), *kinds)
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
            hit = known[at] == keys[own]
            for column in range(width):
                out[column, own[hit]] = values[column][at[hit]]
            if kind == "pairs" and (many := own[hit][out[0, own[hit]] == 255]).size:
                out[0, many] = values[2][np.searchsorted(values[1], keys[many])]
        return out

    def contexts(self, words: np.ndarray) -> np.ndarray:
        """Rows c, n1, n2, n3 of sorted words as contexts; c is the word's own count."""
        return self._find("context", words, word_bucket(words, self.model.buckets), ("<u8", "<i8", "<i8", "<i8", "<i8"), 4)

    def score(self, texts: list[str | None], powers: Powers) -> dict[str, np.ndarray]:
        """Per text: n_tokens, n_known, base_score and score (log10)."""
        m = self.model
        before, after, counts = token_stream(texts, powers)
        owner = np.repeat(np.arange(len(texts)), counts)
        vocabulary, place = np.unique(np.concatenate([before, after]), return_inverse=True)
        of_before, of_after = place[: len(before)], place[len(before) :]
        c, n1, n2, n3 = self.contexts(vocabulary)
        own = np.where(vocabulary == END, m.ends, np.where(vocabulary == BEGIN, 0, c))
        base = np.log10((own + 0.1) / (m.tokens + 0.1 * (m.words + 1)))
        short = vocabulary & LOW48
        order = np.argsort(short)
        n = np.zeros(len(vocabulary), np.int64)
        n[order] = self._find("follower", short[order], word_bucket(short[order], m.buckets), ("<u8", "<i8"), 1)[0]
        lower = np.full(len(vocabulary), m.lower_mass / (m.words + 1))
        if m.pairs:
            lower = lower + np.where(n > 0, n - m.lower[np.clip(n, 1, 3) - 1], 0) / m.pairs
        keys, first, back = np.unique(pair_key(before, after & LOW48), return_index=True, return_inverse=True)
        bucket = pair_bucket(before[first], after[first] & LOW48, m.buckets)
        seen = self._find("pairs", keys, bucket, ("<u8", "u1", "<u8", "<i8"), 1)[0]
        total = c[of_before[first]]
        free = np.stack([n1, n2, n3])[:, of_before[first]]
        safe = np.maximum(total, 1)
        p = np.where(seen > 0, seen - m.discount[np.clip(seen, 1, 3) - 1], 0) / safe
        p = p + np.where(total > 0, m.discount @ free / safe, 1.0) * lower[of_after[first]]
        log = np.log10(p)[back]
        add = lambda x: np.bincount(owner, weights=x, minlength=len(texts))
        return {
            "n_tokens": counts,
            "n_known": add(own[of_after] > 0).astype(np.int64),
            "base_score": add(base[of_after]),
            "score": add(log),
        }


def score(docs: DataFrame, model: Bigrams) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, powers = model.open(), Powers()
        for batch in batches:
            for part in bounded(batch):
                found = lookup.score(part.column("text").to_pylist(), powers)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found])

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def perplexity(docs: DataFrame, model: Bigrams) -> DataFrame:
    """(doc_id, perplexity): 10 to the mean negative score of a text's tokens."""
    return score(docs, model).select("doc_id", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def score_digest(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Learn from the documents outside the held-out fold, score all."""
    slim = docs.select("doc_id", "text")
    model = count_bigrams(slim.filter(~held_out(F.col("doc_id"), folds)))
    return score(slim, model).select(
        "doc_id",
        held_out(F.col("doc_id"), folds).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
