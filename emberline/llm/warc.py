"""WARC archives with a merged capture index.

Writing tasks make gzip archives (one member per record) of bounded size and, for each, a capture run:
one line per record, sorted by URL key and time. Runs are merged by a loser tree, k at a time: rounds of
groups of ``FAN_IN`` runs until that many are left, then one last merge that is cut into key ranges, every
task merging the same range of all runs. The result is the globally ordered capture history, and reading
the archives back starts from it: every capture names file, offset and length of its record.

A payload of at least ``least_bytes`` that several rows share is stored once, as the response of the row
with the largest id; the others are revisits that refer to it.

Defined cases: a null payload is empty; a null URL is the key ``-``; rows without id can't be referred to,
so payloads shared only by such rows stay responses; rows that share the largest id and the payload are
all responses; an empty table makes no archive; other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.files import open_range, read_file, write_file
from emberline.operators.sizing import broadcast_if_small
from emberline.sources.scratch import scratch_path, stage

FILE_BYTES = 48 << 20
FAN_IN = 128
MARK_LINES = 256
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
RECORD = "urn:x-page:"
CAPTURE = "urlkey string, time string, page_id bigint, kind string, digest string, file string, offset bigint, length bigint"


class LoserTree:
    """Merges sorted iterators of bytes: one comparison per level and line, from the leaf to the root."""

    def __init__(self, sources: list[Iterator[bytes]]):
        self.sources = sources
        self.k = len(sources)
        self.heads = [next(s, None) for s in sources]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Whether source a's head comes first; an ended source loses, -1 (nobody yet) wins."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self._before(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[bytes]:
        while self.k and (best := self.losers[0]) >= 0 and self.heads[best] is not None:
            yield self.heads[best]
            self.heads[best] = next(self.sources[best], None)
            self._play(best)


def url_key(url: str | None) -> str:
    """Host labels reversed, then port, path and query; blanks and control characters quoted."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return quote(url, safe="/:?&=%#")
    labels = host.removeprefix("www.").split(".")
    key = ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")"
    return quote(key + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else ""), safe="/:?&=%),")


def _time(page_id: int | None) -> datetime:
    """Where the table has no capture time: the page's number in seconds since 2020, within a century."""
    return EPOCH + timedelta(seconds=(page_id or 0) % (100 * 365 * 86400))


def _record(page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One gzip member: the WARC headers and an HTTP response, without its body for a revisit."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = "none" if page_id is None else str(page_id)
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{RECORD}{name}>",
        f"WARC-Date: {_time(page_id):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {quote(url or 'urn:x-none', safe=chr(33) + '#$%&()*+,/:;=?@[]~' + chr(39))}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    else:
        body += payload
    head.append(f"Content-Length: {len(body)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> dict:
    """Headers, HTTP headers and payload of one gzip member."""
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return {"headers": headers, "http": fields, "payload": payload}


def payload_of(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def with_references(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to): refers_to is null for responses.

    Only digests of several rows are joined back, and a revisit's payload is dropped.
    """
    payload = payload_of(F.col("html"))
    slim = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), payload.alias("payload"))
    sized = slim.withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha1("payload"))
    shared = sized.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("top"))
    shared = stage(shared.filter((F.col("n") > 1) & F.col("top").isNotNull()).select("digest", "top"), "shared-payloads")
    long = sized.withColumn("_at", F.when(F.col("size") >= least_bytes, F.col("digest")))
    joined = long.join(broadcast_if_small(shared.withColumnRenamed("digest", "_at")), "_at", "left").drop("_at")
    refers_to = F.when(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    joined = joined.withColumn("refers_to", refers_to).drop("top")
    return joined.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000) -> DataFrame:
    """Write archives and capture runs below ``folder``; returns (run, lines), one row per run."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, members, size, lines, done = 0, [], 0, [], []
        # Named after the attempt: a run and its archive always come from the same one.
        prefix = f"{folder}/part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}"

        def flush():
            name = f"{prefix}-{number:05d}"
            write_file(f"{name}.warc.gz", members)
            write_run(f"{name}.run", sorted(lines))
            done.append((f"{name}.run", len(lines)))

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "digest", "refers_to")]):
                page_id, url, payload, n, digest, refers_to = row
                record = _record(page_id, url, payload or b"", n, digest, refers_to)
                kind = "response" if refers_to is None else "revisit"
                file = f"{prefix}-{number:05d}.warc.gz"
                lines.append(_line(url, page_id, kind, digest, file, size, len(record)))
                members.append(record)
                size += len(record)
                if size >= FILE_BYTES:
                    flush()
                    number, members, size, lines = number + 1, [], 0, []
        if members:
            flush()
        runs, counts = zip(*done) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(counts, pa.int64())], ["run", "lines"])

    slim = with_references(pages, least_bytes)
    return stage(slim.mapInArrow(write, "run string, lines bigint"), "capture-runs")


def _line(url, page_id, kind, digest, file, offset, length) -> bytes:
    """Sorts by URL key, time and id; the fields hold no blanks."""
    name = "-" if page_id is None else str(page_id)
    order = f"{(page_id if page_id is not None else -(1 << 63)) + (1 << 63):020d}"
    return f"{url_key(url)} {_time(page_id):%Y%m%d%H%M%S} {order} {name} {kind} {digest} {quote(file, safe='/:')} {offset} {length}\n".encode()


def write_run(path: str, lines: list[bytes] | Iterator[bytes]) -> None:
    """A run file, and beside it its marks: offset and text of every MARK_LINES-th line and of the end."""
    marks, at = [], 0

    def marked() -> Iterator[bytes]:
        nonlocal at
        for number, line in enumerate(lines):
            if number % MARK_LINES == 0:
                marks.append(b"%d " % at + line)
            at += len(line)
            yield line

    write_file(path, marked())
    write_file(f"{path}.marks", [*marks, b"%d \n" % at])


def read_run(path: str, start: int = 0, end: int | None = None) -> Iterator[bytes]:
    """Lines of a run between two offsets, streamed."""
    rest = b""
    for chunk in open_range(path, start, end):
        lines = (rest + chunk).splitlines(keepends=True)
        rest = b"" if lines and lines[-1].endswith(b"\n") else lines.pop() if lines else b""
        yield from lines


def _marks(path: str) -> tuple[list[bytes], list[int]]:
    pairs = [m.split(b" ", 1) for m in read_file(f"{path}.marks").splitlines(keepends=True)]
    return [text for _, text in pairs[:-1]], [int(at) for at, _ in pairs]


def merge_slice(runs: list[str], low: bytes | None, high: bytes | None) -> Iterator[bytes]:
    """The merged lines of the runs that are at least ``low`` and below ``high``."""
    from bisect import bisect_left, bisect_right

    def part(run: str) -> Iterator[bytes]:
        texts, offsets = _marks(run)
        first = max(bisect_right(texts, low) - 1, 0) if low is not None else 0
        last = bisect_left(texts, high) if high is not None else len(texts)
        for line in read_run(run, offsets[first], offsets[last]):
            if (low is None or line >= low) and (high is None or line < high):
                yield line

    return iter(LoserTree([part(run) for run in runs]))


def merge_runs(runs: DataFrame, folder: str) -> DataFrame:
    """The capture history (CAPTURE), globally ordered: its partitions are ascending key ranges."""
    spark = runs.sparkSession
    names = runs.select("run")
    level = 0
    while (count := names.count()) > FAN_IN:  # rounds of whole merges, so the last one opens FAN_IN files at most
        groups = -(-count // FAN_IN)
        level += 1

        prefix = f"{folder}/level-{level}"

        def merge_group(key, frame):
            import pandas as pd

            path = f"{prefix}-{int(key[0])}.run"
            write_run(path, merge_slice(sorted(frame["run"]), None, None))
            return pd.DataFrame({"run": [path]})

        grouped = names.withColumn("g", F.pmod(F.xxhash64("run"), F.lit(groups)))
        names = stage(grouped.groupBy("g").applyInPandas(merge_group, "run string"), "merged-runs")
    listed = sorted(r.run for r in names.collect())  # at most FAN_IN names

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column("run").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_marks(run)[0], pa.binary())], ["mark"])

    ranges = max(1, 2 * spark.sparkContext.defaultParallelism)
    marks = names.mapInArrow(sample, "mark binary")
    placed = marks.repartitionByRange(ranges, "mark").groupBy(F.spark_partition_id().alias("p")).agg(F.min("mark").alias("low"))
    lows = sorted(bytes(r.low) for r in placed.collect())  # one per range
    bounds = [None, *lows[1:], None]
    spans = [(n, bounds[n], bounds[n + 1]) for n in range(len(bounds) - 1)] if listed else []

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, low, high in zip(*[batch.column(c).to_pylist() for c in ("n", "low", "high")]):
                held = []
                for line in merge_slice(listed, low, high):
                    held.append(line)
                    if len(held) == 5000:
                        yield _captures(held)
                        held = []
                yield _captures(held)

    table = spark.createDataFrame(spans, "n int, low binary, high binary").repartitionByRange(max(1, len(spans)), "n")
    return table.mapInArrow(merge, CAPTURE)


def _captures(lines: list[bytes]) -> pa.RecordBatch:
    from urllib.parse import unquote

    fields = [line.decode().rstrip("\n").split(" ") for line in lines]
    rows = [(f[0], f[1], None if f[3] == "-" else int(f[3]), f[4], f[5], unquote(f[6]), int(f[7]), int(f[8])) for f in fields]
    columns = list(zip(*rows)) or [()] * 8
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = ["urlkey", "time", "page_id", "kind", "digest", "file", "offset", "length"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def read_archives(captures: DataFrame) -> DataFrame:
    """Read the records that the captures name; digests of stored payloads are worked out again.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload)
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, offset, length in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")]):
                record = parse_record(b"".join(open_range(file, offset, offset + length)))
                headers, payload = record["headers"], record["payload"]
                own = re.fullmatch(rf"<{RECORD}(.*)>", headers["WARC-Record-ID"])[1]
                refers = re.fullmatch(rf"<{RECORD}(.*)>", headers.get("WARC-Refers-To", ""))
                stated = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                size = int(record["http"]["Content-Length"])
                if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != stated):
                    raise ValueError(f"damaged record in {file} at {offset}")
                out.append({
                    "page_id": None if own == "none" else int(own), "payload_bytes": size, "payload_digest": stated,
                    "record_type": headers["WARC-Type"], "refers_to": int(refers[1]) if refers else None,
                    "url": headers["WARC-Target-URI"], "payload": payload if headers["WARC-Type"] == "response" else None,
                })
                if len(out) == 200:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema)

    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
    schema = pa.schema(kinds)
    parts = captures.sparkSession.sparkContext.defaultParallelism * 4
    near = captures.select("file", "offset", "length").repartition(parts, "file", F.floor(F.col("offset") / (4 << 20)))
    near = near.sortWithinPartitions("file", "offset")
    return near.mapInArrow(
        read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"
    )


def archive_digest(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write, merge the capture runs, read back: one row per page."""
    folder = scratch_path(pages.sparkSession, "archives")
    history = stage(merge_runs(write_archives(pages, folder, least_bytes), folder), "capture-history")
    return read_archives(history).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
