"""Secrets in texts and in what is encoded inside them, by a recursive decoding worklist.

A text is the first layer. Every layer is scanned with the patterns of `KINDS`; its URL escapes, Unicode
escapes, base64 stretches and compressed streams are unwrapped into further layers, which wait on a stack
until none is left. A layer knows for each of its bytes which code points of the text it came from, so a find
in any layer is a span of the text. A layer that was seen before with the same bytes from the same place
is dropped, which ends cycles (a stream that unpacks to itself) as well as repeats (two orders of decoding).

The finds of the text itself are the sure ones; those of deeper layers are added where they name another
span. All bytes that an archive unpacks to come from the archive's whole span.

Layers hold UTF-8 bytes; the patterns are ASCII, so offsets only have to be turned into code points at the
end. Escapes are decoded line by line, since no find runs over a line break. Base64 is read at all four
alignments, because a word of its alphabet may stand right before it, and only stretches of printable
characters (``LEAST`` at least, shorter ones hold no secret) and compressed streams go on. Archives are unpacked in pieces of ``WINDOW``
bytes that overlap, so memory is bounded by the text and a window.

Every text is worked through in its row by one task: no shuffle, nothing collected.

Offsets are code points, ends exclusive. Defined cases: null and empty texts have no spans; repeated rows
give repeated results; other columns are ignored by the digest and kept by `redact`; an empty table gives
an empty table. A text whose layers unpack to more than ``max_unpacked`` bytes (an archive bomb) keeps what was
found until then and is marked by ``complete`` = false.
"""

from __future__ import annotations

import binascii
import bz2
import lzma
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.wordhash import bounded

#: Kinds in order, their patterns, the group whose length counts and its least length.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": (rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (rb"AKIA[A-Z0-9]+", 0, 20),
    "hex": (rb"[0-9a-f]{24,}", 0, 24),  # a shorter run never passes, and runs don't overlap
}
_COMPILED = [(re.compile(p, re.IGNORECASE if kind == "assign" else 0), group, least) for kind, (p, group, least) in PATTERNS.items()]

LEAST = 12  # the shortest secret: "token=" or "secret" and a mark, and six characters
WINDOW = 4 << 20
OVERLAP = 256 << 10
MAX_UNPACKED = 1 << 30

_URL = re.compile(rb"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(
    rb"(?:\\u[0-9A-Fa-f]{4}|%u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|U\+[0-9A-F]{4,6}(?![0-9A-F])|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};)"
)
_HINT = re.compile(rb"%[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4}|\\[uUx]|U\+[0-9A-F]{4}|&#")
_RUN = re.compile(rb"(?<![A-Za-z0-9+/_-])(?:(?:[A-Za-z0-9+/_-]{60,}+\r?\n)++[A-Za-z0-9+/_-]*+|[A-Za-z0-9+/_-]{16,}+)")
_PRINTABLE = re.compile(rb"[\x20-\x7E\t\r\n]{12,}+")
_MAGIC = re.compile(rb"\x1F\x8B\x08|BZh[1-9]1AY&SY|\xFD7zXZ\x00|\x28\xB5\x2F\xFD|\x78[\x01\x5E\x9C\xDA]", re.DOTALL)
_NOT_BASE64 = re.compile(rb"[^A-Za-z0-9+/_-]")
_TO_STANDARD = bytes.maketrans(b"-_", b"+/")


class Layer:
    """Bytes, and per byte the code points of the text (from ``low`` up to ``high``) it came from."""

    __slots__ = ("data", "low", "high")

    def __init__(self, data: bytes, low: np.ndarray, high: np.ndarray):
        self.data, self.low, self.high = data, low, high

    def part(self, start: int, end: int) -> "Layer":
        return Layer(self.data[start:end], self.low[start:end], self.high[start:end])

    def key(self) -> bytes:
        digest = blake2b(self.data, digest_size=16)
        digest.update(self.low.tobytes())
        digest.update(self.high.tobytes())
        return digest.digest()


def matches(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of all finds in one layer's bytes: leftmost, not overlapping within a kind."""
    for kind, (pattern, group, least) in enumerate(_COMPILED):
        for found in pattern.finditer(data):
            if found.end(group) - found.start(group) >= least:
                yield kind, found.start(), found.end()


def _first_layer(data: bytes) -> Layer:
    """The text itself: the bytes of a character come from its code point."""
    raw = np.frombuffer(data, np.uint8)
    place = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32) - 1
    return Layer(data, place, place + 1)


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match replaced by its decoded bytes; None if there is no match."""
    data, low, high, at = [], [], [], 0
    for found in pattern.finditer(layer.data):
        start, end = found.span()
        pieces = decode(found[0])
        if pieces is None:
            continue
        data.append(layer.data[at:start])
        low.append(layer.low[at:start])
        high.append(layer.high[at:start])
        for value, width in pieces:  # decoded bytes and the number of bytes they were written in
            data.append(value)
            low.append(np.full(len(value), layer.low[start], np.int32))
            high.append(np.full(len(value), layer.high[start + width - 1], np.int32))
            start += width
        at = end
    if not at:
        return None
    data.append(layer.data[at:])
    low.append(layer.low[at:])
    high.append(layer.high[at:])
    return Layer(b"".join(data), np.concatenate(low), np.concatenate(high))


def _url(escaped: bytes):
    raw = binascii.unhexlify(escaped.replace(b"%", b""))
    return [(raw[i : i + 1], 3) for i in range(len(raw))]


def _unicode(escaped: bytes):
    digits = re.search(rb"[0-9A-Fa-f]+(?=[};]?$)", escaped[2:])[0]
    value = int(digits, 10 if escaped[:2] == b"&#" and escaped[2:3] not in b"xX" else 16)
    if value > 0x10FFFF:
        return None
    if escaped[:2] == b"\\x":
        return [(bytes([value]), len(escaped))]
    return [(chr(value).encode("utf-8", "surrogatepass"), len(escaped))]


def _escapes(layer: Layer) -> Iterator[Layer]:
    """Lines of the layer with their URL or their Unicode escapes decoded."""
    done = -1
    for hint in _HINT.finditer(layer.data):
        if hint.start() < done:
            continue
        start = layer.data.rfind(b"\n", 0, hint.start()) + 1
        done = layer.data.find(b"\n", hint.start())
        done = len(layer.data) if done < 0 else done
        line = layer.part(start, done)
        for pattern, decode in ((_URL, _url), (_UNICODE, _unicode)):
            decoded = _replaced(line, pattern, decode)
            if decoded is not None:
                yield decoded
                if pattern is _URL and b"+" in line.data:  # in a form, a plus is a blank
                    spaced = Layer(line.data.replace(b"+", b" "), line.low, line.high)
                    yield _replaced(spaced, pattern, decode)


def _base64(layer: Layer) -> Iterator[Layer]:
    """What the layer's base64 runs stand for, at each alignment."""
    for run in _RUN.finditer(layer.data):
        start, end = run.span()
        if b"\n" in run[0]:
            place = start + np.flatnonzero(_ALPHABET[np.frombuffer(run[0], np.uint8)])
            text = _NOT_BASE64.sub(b"", run[0])
        else:
            place, text = np.arange(start, end), run[0]
        text = text.translate(_TO_STANDARD)
        for shift in range(4):
            body = text[shift:]
            n = len(body) * 3 // 4
            if n < LEAST:
                continue
            body += b"A" * (-len(body) % 4)
            decoded = binascii.a2b_base64(body)[:n]
            if not (_PRINTABLE.search(decoded) or _MAGIC.search(decoded)):
                continue
            first = shift + np.arange(n) // 3 * 4 + np.arange(n) % 3
            yield Layer(decoded, layer.low[place[first]], layer.high[place[np.minimum(first + 1, len(place) - 1)]])


_ALPHABET = np.zeros(256, bool)
_ALPHABET[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")] = True


def _opener(magic: bytes):
    if magic[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if magic[:1] == b"\x78":
        return zlib.decompressobj(15)
    if magic[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if magic[:1] == b"\xfd":
        return lzma.LZMADecompressor(lzma.FORMAT_XZ)
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj()


def _pieces(data: bytes, start: int, magic: bytes) -> Iterator[tuple[bytes, int]]:
    """Unpacked pieces of a stream that begins at ``start``, and where the part read so far ends."""
    opener, at = _opener(magic), start
    limited = isinstance(opener, (bz2.BZ2Decompressor, lzma.LZMADecompressor))
    zlibs = magic[:1] in (b"\x1f", b"\x78")
    waiting = b""
    try:
        while not opener.eof and (waiting or at < len(data) or limited and not opener.needs_input):
            if limited:
                chunk = b"" if not opener.needs_input else data[at : at + 65536]
                at += len(chunk)
                out = opener.decompress(chunk, WINDOW)
                if not chunk and not out and not opener.eof:
                    return
            elif zlibs:
                chunk = waiting or data[at : at + 65536]
                at += 0 if waiting else len(chunk)
                out = opener.decompress(chunk, WINDOW)
                waiting = opener.unconsumed_tail
            else:
                chunk = data[at : at + 256]
                at += len(chunk)
                out = opener.decompress(chunk)
            if out:
                yield out, at - len(opener.unused_data)
    except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError) as broken:  # not a stream, or one that is cut off
        del broken
    except Exception as error:
        if type(error).__name__ != "ZstdError":
            raise


def _unpacked(layer: Layer) -> Iterator[Layer]:
    """Windows over what the layer's compressed streams unpack to."""
    for magic in _MAGIC.finditer(layer.data):
        held, end = b"", 0
        low = int(layer.low[magic.start()])

        def window(data: bytes, upto: int) -> Layer:
            high = int(layer.high[magic.start() : upto].max())
            return Layer(data, np.full(len(data), low, np.int32), np.full(len(data), high, np.int32))

        for piece, end in _pieces(layer.data, magic.start(), magic[0]):
            held += piece
            while len(held) > WINDOW + OVERLAP:
                yield window(held[: WINDOW + OVERLAP], len(layer.data))
                held = held[WINDOW:]
        if held:
            yield window(held, end)


def scan(text: str | None, max_unpacked: int = MAX_UNPACKED, decoders=None) -> tuple[list, list, bool]:
    """(sure spans, added spans, whether every layer was opened) of one text; spans are (start, kind, end)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    sure = list(matches(data))
    openers = decoders or (_escapes, _base64, _unpacked)
    first, left = None, max_unpacked
    added: set[tuple[int, int, int]] = set()
    if decoders or _HINT.search(data) or _RUN.search(data):
        first = _first_layer(data)
        seen = {first.key()}
        waiting = [chain.from_iterable(map(lambda opener, layer: opener(layer), openers, repeat(first)))]
        while waiting and left > 0:  # the deepest open layer goes on first, so few are in memory at a time
            inner = next(waiting[-1], None)
            if inner is None:
                waiting.pop()
                continue
            key = inner.key()
            if key in seen:
                continue
            seen.add(key)
            left -= len(inner.data)
            for kind, start, end in matches(inner.data):
                added.add((int(inner.low[start:end].min()), kind, int(inner.high[start:end].max())))
            waiting.append(chain.from_iterable(map(lambda opener, layer: opener(layer), openers, repeat(inner))))
    if sure and not data.isascii():
        first = first or _first_layer(data)
        sure = [(int(first.low[s]), kind, int(first.high[e - 1])) for kind, s, e in sure]
    else:
        sure = [(s, kind, e) for kind, s, e in sure]
    return sorted(sure), sorted(added - set(sure)), left > 0


SPANS = "array<struct<start:int,kind:string,end:int>>"


def find_secrets(docs: DataFrame, max_unpacked: int = MAX_UNPACKED) -> DataFrame:
    """(doc_id, sure, added, complete): both kinds of spans of every document, in the order of their starts."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("sure", pa.list_(span)), ("added", pa.list_(span)), ("complete", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch):
                found = [scan(t, max_unpacked) for t in part.column("text").to_pylist()]
                spans = [[[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in row[side]] for row in found] for side in (0, 1)]
                columns = [part.column("doc_id"), *[pa.array(x, pa.list_(span)) for x in spans], pa.array([row[2] for row in found])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return slim.mapInArrow(run, f"doc_id bigint, sure {SPANS}, added {SPANS}, complete boolean")


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secrets_digest(docs: DataFrame) -> DataFrame:
    """One row per document: finds in the text itself per kind, their checksum, and all spans."""
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "complete"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch):
                rows = [scan(t) for t in part.column("text").to_pylist()]
                counts = [pa.array([sum(k == kind for _, k, _ in r[0]) for r in rows], pa.int64()) for kind in range(len(KINDS))]
                digests = pa.array([sha256(_joined(r[0]).encode()).hexdigest() for r in rows], pa.string())
                spans = pa.array([_joined(sorted(r[0] + r[1])) for r in rows], pa.string())
                rest = [pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, digests, spans, *rest], names=names)

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    longs = ", ".join(f"n_{k} bigint" for k in KINDS)
    return slim.mapInArrow(run, f"doc_id bigint, {longs}, base_sha256 string, spans string, n_added bigint, complete boolean")


def _masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with spans (ascending) replaced; of overlapping ones the first is named, all are covered."""

    def cut(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        name = F.when(s["start"] >= done["at"], F.format_string(mark, s["kind"])).otherwise("")
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], gap, name).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, cut, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def redact(docs: DataFrame, mark: str = "[%s]") -> DataFrame:
    """The documents with every span replaced by its kind; texts without spans stay as they are.

    ``docs`` may have any columns besides text; rows are changed where they are, without a join.
    """
    span = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])
    own = "_secret_spans"
    while own in docs.columns:
        own += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch):
                found = []
                for text in part.column("text").to_pylist():
                    sure, added, _ = scan(text)
                    found.append([{"start": s, "kind": KINDS[k], "end": e} for s, k, e in sorted(sure + added)])
                fields = [*part.schema, pa.field(own, pa.list_(span))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(span))], schema=pa.schema(fields))

    marked = docs.mapInArrow(run, docs.withColumn(own, F.lit(None).cast(SPANS)).schema)
    text = F.when(F.size(own) > 0, _masked(F.col("text"), F.col(own), mark)).otherwise(F.col("text"))
    return marked.withColumn("text", text).drop(own)
