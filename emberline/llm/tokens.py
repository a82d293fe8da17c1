"""Token ids in a compact binary format.

Ids are ranked by their frequency in the whole corpus, and ranks are written with 1 to 4 bytes each; the
lengths of four ranks share a control byte, and control and data bytes are two separate streams, so
that both coding and decoding are numpy table look-ups. Documents are range-partitioned and sorted by
id; every partition writes files of bounded size, with a document table in front. A manifest gives the
files' order and offsets, which is all that is needed to read them in parallel.

Defined cases: a null or empty text is the end id alone; a null document id comes first and is read back
as null; rows with equal ids follow each other by length and content; an empty table gives no file
and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from emberline.llm.files import read_file, write_file
from emberline.llm.wordhash import Powers, bounded, prefix_sums, stretch_hashes, worker_memory
from emberline.sources.scratch import scratch_path, stage

MAGIC = b"EMBTOK1\0"
FILE_BYTES = 16 << 20
CACHED_WORDS = 1 << 21
NO_ID = -(1 << 63)

# The bytes that each of the four ranks of a control byte takes.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
_OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+\\Z")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def pieces(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places where the bytes of several texts may be cut without changing their ids.

    The tokenizer's pattern always begins a new piece before white space that follows something else,
    behind a single line end, and at a point or comma behind a letter. Texts start at ``begins``.
    """
    space = _SPACE[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & ~space[:-1]
    cut[2:] |= ~space[2:] & (data[1:-1] == 10) & ~space[:-2]
    letter = _ASCII_LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut[1:] |= ((data[1:] == 0x2E) | (data[1:] == 0x2C)) & letter[:-1]
    cut[begins] = True
    return np.flatnonzero(cut)


class WordEncoder:
    """Encodes texts piece by piece; the ids of pieces seen before are found by a 64-bit hash.

    The memory is a sorted array of hashes with the pieces' ids in one pool. Where new pieces would take it over
    ``CACHED_WORDS`` it is emptied first, and then holds all pieces of the texts at hand, however many they are.
    Texts with white space outside ASCII are encoded whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits are not supported")
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(1 << 16, bool)  # ids of tokens that begin with a blank
        self.opens[[number for token, number in vocabulary.items() if token.startswith("\u0120")]] = True
        self.end, self.powers = end_id, Powers()
        self.forget()

    def forget(self) -> None:
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u2")

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u2") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Adds pieces that aren't known; keys are ascending."""
        word = np.array([_WORD.match(t) is not None for t in texts], bool)
        codes: list[np.ndarray] = [np.zeros(0, "<u2")] * len(texts)
        words = np.flatnonzero(word)
        if len(words):  # each is one piece and begins with the only blank in it, also when they are joined
            ids = np.array(self.tokenizer.encode("".join([texts[i] for i in words]), add_special_tokens=False).ids, dtype="<u2")
            for i, code in zip(words.tolist(), np.split(ids, np.flatnonzero(self.opens[ids])[1:])):
                codes[i] = code
        rest = np.flatnonzero(~word).tolist()
        for i, code in zip(rest, self._whole([texts[i] for i in rest]) if rest else []):
            codes[i] = code
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        starts = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate([self.pool, *codes])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.starts, self.sizes = (
            np.insert(old, at, new) for old, new in ((self.keys, keys), (self.starts, starts), (self.sizes, sizes))
        )

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their end ids, number of ids per text)."""
        odd = [i for i, t in enumerate(texts) if not t.isascii() and _OTHER_SPACE.search(t)]
        by_text = dict(zip(odd, self._whole([texts[i] for i in odd]))) if odd else {}
        raw = [b"" if i in by_text else t.encode() for i, t in enumerate(texts)]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1  # a line end behind each keeps texts apart
        begins = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"\n".join(raw) + b"\n\n", np.uint8)
        cuts = pieces(data, begins)
        owner = np.searchsorted(begins, cuts, side="right") - 1
        ends = np.minimum(np.append(cuts[1:], len(data)), (begins + sizes - 1)[owner])
        filled = ends > cuts
        cuts, ends, owner = cuts[filled], ends[filled], owner[filled]
        hashes = stretch_hashes(prefix_sums(data, self.powers), cuts, ends, self.powers)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > CACHED_WORDS:
                self.forget()
                new = np.arange(len(keys))
            buffer = data.tobytes()
            self._learn(keys[new], [buffer[a:b].decode() for a, b in zip(cuts[first[new]].tolist(), ends[first[new]].tolist())])
            at = np.searchsorted(self.keys, keys)
            if not (self.keys[at] == keys).all():
                raise RuntimeError("a piece of the texts is missing in the memory")
        size, start = self.sizes[at][back], self.starts[at][back]
        offset = np.cumsum(size) - size
        ids = self.pool[np.arange(int(size.sum())) + np.repeat(start - offset, size)]
        counts = np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)
        edges = np.cumsum(counts)
        where, what = list(edges), [np.uint16(self.end)] * len(texts)
        if by_text:
            parts = np.split(ids, edges[:-1])
            parts = [np.append(by_text.get(i, p), np.uint16(self.end)) for i, p in enumerate(parts)]
            return np.concatenate(parts).astype("<u2"), np.fromiter(map(len, parts), np.int64, len(parts))
        return np.insert(ids, where, what).astype("<u2"), counts + 1


def _slots(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ids when every document begins at a whole control byte, and control bytes per document."""
    controls = -(-counts // 4)
    shift = 4 * (np.cumsum(controls) - controls) - (np.cumsum(counts) - counts)
    return np.arange(int(counts.sum())) + np.repeat(shift, counts), controls


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of documents with ``counts`` ranks each, and their number per document."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    slots, controls = _slots(counts)
    codes = np.zeros(4 * int(controls.sum()), np.uint8)
    codes[slots] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts)])]
    return control, controls, data, np.diff(ends)


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of documents with ``counts`` ranks each, one after another."""
    slots, _ = _slots(counts)
    size = _LENGTHS[control].reshape(-1)[slots]
    wide = np.zeros((len(size), 4), np.uint8)
    wide[np.arange(4) < size[:, None]] = data
    return wide.view("<u4").reshape(-1)


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive parts of the bytes as an Arrow array, without copying them."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    large = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
    return large.cast(pa.binary())


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """(doc_id, n, ids): every whole text's ids, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_memory(("tokens", tokenizer, end_id), lambda: WordEncoder(tokenizer, end_id))
        for batch in batches:
            for part in bounded(batch):
                ids, counts = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), _binaries(ids, 2 * counts)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "ids"])

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id bigint, n bigint, ids binary")


def frequency_ranks(codes: DataFrame) -> np.ndarray:
    """ids in order of their frequency (ties by id); at most the vocabulary's size, so it may be collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in bounded(batch, "ids"):
                total += np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), "<u2"), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    counts = codes.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.collect()
    return np.array([r.id for r in sorted(rows, key=lambda r: (-r.n, r.id))], dtype="<u4")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the files below ``folder`` and return their manifest, one row per file in order.

    Manifest: part, file (place inside the part), path, n_docs, n_ids, start (ids before the file).
    """
    spark = docs.sparkSession
    codes = stage(encoded(docs, tokenizer, end_id), "token-ids")
    by_rank = frequency_ranks(codes)
    write_file(f"{folder}/ranks.bin", [by_rank.tobytes()])
    rank_of = np.zeros(1 << 16, "<u4")
    rank_of[by_rank] = np.arange(len(by_rank))

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, "ids"):
                ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), "<u2")
                control, controls, data, sizes = pack(rank_of[ids], part.column("n").to_numpy())
                columns = [part.column("doc_id"), part.column("n"), _binaries(control, controls), _binaries(data, sizes)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "control", "data"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, file, held, size, rows = TaskContext.get().partitionId(), 0, [], 0, []
        attempt = TaskContext.get().taskAttemptId()  # the manifest names the files of the attempt that counted

        def flush():
            ids = np.array([NO_ID if h[0] is None else h[0] for h in held], "<i8")
            counts = np.array([h[1] for h in held], "<i8")
            head = struct.pack("<QQQ", len(held), int(counts.sum()), sum(len(h[2]) for h in held))
            path = f"{folder}/part-{part:05d}-{file:05d}-{attempt}.tok"
            write_file(path, [MAGIC, head, ids.tobytes(), counts.tobytes(), *[h[2] for h in held], *[h[3] for h in held]])
            rows.append((part, file, path, len(held), int(counts.sum())))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "n", "control", "data")]
            for row in zip(*columns):
                held.append(row)
                size += len(row[2]) + len(row[3]) + 16
                if size >= FILE_BYTES:
                    flush()
                    file, held, size = file + 1, [], 0
        if held:
            flush()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("part", "file", "path", "n_docs", "n_ids"), r)) for r in rows],
            pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    packed = codes.mapInArrow(compact, "doc_id bigint, n bigint, control binary, data binary")
    total = codes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, -(-2 * total // FILE_BYTES))
    ordered = packed.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n", "control", "data")
    files = stage(ordered.mapInArrow(write, "part int, file int, path string, n_docs bigint, n_ids bigint"), "token-files")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(path: str, by_rank: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ids) of one file, in its order."""
    raw = read_file(path)
    if raw[:8] != MAGIC:
        raise ValueError(f"not a token file: {path}")
    n_docs, _, n_control = struct.unpack("<QQQ", raw[8:32])
    ids = np.frombuffer(raw, "<i8", n_docs, 32)
    counts = np.frombuffer(raw, "<i8", n_docs, 32 + 8 * n_docs)
    control = np.frombuffer(raw, np.uint8, n_control, 32 + 16 * n_docs)
    data = np.frombuffer(raw, np.uint8, -1, 32 + 16 * n_docs + n_control)
    ranks = unpack(control, data, counts)
    for doc_id, part in zip(ids.tolist(), np.split(by_rank[ranks], np.cumsum(counts)[:-1])):
        yield (None if doc_id == NO_ID else doc_id), part


def token_digest(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens and the CRC-32 of the ids as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = None
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                if by_rank is None:
                    by_rank = np.frombuffer(read_file(f"{folder}/ranks.bin"), "<u4")
                rows = []
                for doc_id, ids in read_documents(path, by_rank):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                columns = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("path", "start").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenize_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encode, write, read back: one row per document."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = scratch_path(docs.sparkSession, "tokens")
    return token_digest(stage(write_tokens(docs, folder, tokenizer), "token-manifest"), folder)
