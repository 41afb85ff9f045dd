"""WARC archives with payload deduplication, and the merge of their capture indexes.

Writing: payload digests are grouped over all pages (sums are partial before the shuffle), so of equal
payloads the record with the smallest page id is the response and the others revisit it. Every task
sorts its pages by URL key and time, writes gzip members of one record each into archives of about
``ARCHIVE_BYTES`` and leaves one locally sorted run of captures per archive.

External index merge: the runs are dealt into ranges of (URL key, time, page id), so that a URL with
any share of the captures is split, and each range merges its pieces of the runs by a loser tree.
The ranges are in order among themselves, so the captures are globally ordered histories.

Null and empty payloads are payloads of 0 bytes; null URLs have the key "". A null page id comes after
all others and is named "null". Rows with the same page id and payload are all responses or all
revisits. An empty table gives no archives and no rows; other columns are not read. Files are written
under a temporary name and renamed, so a task that runs again leaves the same files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.common import stage

ARCHIVE_BYTES = 8_000_000
#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 0
#: The tables carry no capture times. A page's date is this one plus page_id nanoseconds (WARC/1.1 allows
#: nine decimals), so every id has a date of its own between the years 1731 and 2316, in the order of ids.
FIRST_DATE = "2024-01-01T00:00:00Z"
READ_BYTES = 65_536
#: Captures of a range of the merge, about.
RANGE_CAPTURES = 200_000


def url_key(url: str | None) -> str:
    """The host's labels from the right, then path and query, in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    labels = host.split(".")
    labels = labels[1:] if labels[0] == "www" and len(labels) > 2 else labels
    key = ",".join(reversed(labels)) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/")
    return key + (f"?{'&'.join(sorted(parts.query.split('&')))}" if parts.query else "")


class LoserTree:
    """Merges sorted sequences; every item costs one comparison per level of the tree."""

    def __init__(self, runs: Iterable[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(self.k, 1)
        self.champion = self._play(1) if self.k else -1

    def _before(self, a: int, b: int) -> bool:
        """Run a's head comes first; a finished run comes last, ties go to the earlier run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        winner, loser = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = loser
        return winner

    def __iter__(self) -> Iterator:
        while self.k and (item := self.heads[self.champion]) is not None:
            yield item
            self.heads[self.champion] = next(self.runs[self.champion], None)
            at, node = self.champion, (self.champion + self.k) // 2
            while node:
                if self._before(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.champion = at


def record(kind: str, page: str, refers_to: str | None, url: str, date: str, digest: str, payload: bytes) -> bytes:
    """One WARC record; a revisit keeps the HTTP head and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    target = "".join(c for c in url if c not in "\r\n")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(content: bytes) -> bytes:
    """A gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(content) + packer.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, plain bytes) of every gzip member."""
    at, whole = 0, memoryview(content)
    while at < len(content):
        opener, parts, length = zlib.decompressobj(31), [], 0
        while not opener.eof:  # in chunks, so that no member copies the rest of its archive
            chunk = whole[at + length : at + length + READ_BYTES]
            if not len(chunk):
                raise ValueError("the archive ends inside a member")
            parts.append(opener.decompress(chunk))
            length += len(chunk)
        length -= len(opener.unused_data)
        yield at, length, b"".join(parts)
        at += length


def parse(plain: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


RUNS = "url_key string, date string, page string, archive string, place long, length long"
_RUN_KINDS = [pa.string()] * 4 + [pa.int64()] * 2
_RUN_NAMES = ["url_key", "date", "page", "archive", "place", "length"]


def _put(store: fs.FileSystem, path: str, content: bytes) -> None:
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(draft) as out:
        out.write(content)
    store.move(draft, path)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        part, turn, held, size, captures = TaskContext.get().partitionId(), 0, [], 0, []

        def flush() -> pa.RecordBatch:
            _put(store, f"{base}/{part:06d}-{turn:06d}.warc.gz", b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*captures, strict=True), _RUN_KINDS, strict=True)], names=_RUN_NAMES)

        for batch in batches:
            for row in batch.to_pylist():
                kind = "revisit" if row["refers_to"] is not None else "response"
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                packed = member(record(kind, row["page"], row["refers_to"], row["url"] or "", row["date"], digest, row["payload"]))
                if held and size + len(packed) > ARCHIVE_BYTES:
                    yield flush()
                    turn, held, size, captures = turn + 1, [], 0, []
                captures.append((row["url_key"], row["date"], row["page"], f"{part:06d}-{turn:06d}.warc.gz", size, len(packed)))
                held.append(packed)
                size += len(packed)
        if held:
            yield flush()

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([url_key(u) for u in batch.column(batch.schema.names.index("url")).to_pylist()], pa.string())], names=[*batch.schema.names, "url_key"])


def capture_date(page_id: Column) -> Column:
    """FIRST_DATE plus page_id nanoseconds; a null id has the latest date."""
    number = F.coalesce(page_id, F.lit((1 << 63) - 1))
    rest = number % 1_000_000_000
    seconds = F.call_function("div", number, F.lit(1_000_000_000)) - (rest < 0).cast("long")
    start = F.unix_timestamp(F.lit(FIRST_DATE), "yyyy-MM-dd'T'HH:mm:ssX")
    return F.concat(F.date_format(F.timestamp_seconds(start + seconds), "yyyy-MM-dd'T'HH:mm:ss."), F.lpad(F.pmod(rest, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("Z"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the archives; the locally sorted runs of captures, staged."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    first = rows.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    dated = rows.withColumn("date", capture_date(F.col("page_id")))
    joined = dated.join(first, ["sha1", "bytes"], "left").select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("page"), "url", "payload", "sha1", "date",
        F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first").cast("string")).alias("refers_to"),
    )
    fields = "page string, url string, payload binary, sha1 string, date string, refers_to string, url_key string"
    local = joined.mapInArrow(_keys, fields).sortWithinPartitions("url_key", "date", "page")
    return stage(local.mapInArrow(_write(folder), RUNS), "warc-runs")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(row[3], []).append(row)
    merged, turn = [], 0
    kinds, names = [*_RUN_KINDS, pa.int32(), pa.int64()], [*_RUN_NAMES, "range", "turn"]
    for row in LoserTree(iter(runs[name]) for name in sorted(runs)):
        merged.append((*row, part, turn))
        turn += 1
        if len(merged) == 5000:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*merged, strict=True), kinds, strict=True)], names=names)
            merged = []
    if merged:
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*merged, strict=True), kinds, strict=True)], names=names)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Captures in global order: by range, then by turn inside the range.

    A range's pieces of the runs are held by one task; the number of ranges follows the number of captures,
    and no key is kept together, so a range stays near RANGE_CAPTURES.
    """
    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_CAPTURES))
    key = ("url_key", "date", "page", "archive", "place")
    return runs.repartitionByRange(parts, *key).sortWithinPartitions("archive", *key[:3], "place").mapInArrow(_merge, RUNS + ", range int, turn long")


RECORDS = "archive string, place long, page string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for place, _, plain in members(content.as_buffer().to_pybytes()):
                fields, block = parse(plain)
                head, _, payload = block.partition(b"\r\n\r\n")
                digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                size = int(next(line.split(b":")[1] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")))
                if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
                names = [fields.get(f, "")[len("<urn:page:") : -1] or None for f in ("warc-record-id", "warc-refers-to")]
                rows.append((path.rsplit("/", 1)[-1], place, names[0], size, digest, kind, names[1]))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "place", "page", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record; payloads of responses are checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("path", "content").mapInArrow(_read, RECORDS)


def captures(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes, merges and reads back: the records with their place in the global order of captures."""
    merged = merge_runs(write_archives(pages, folder, least_bytes))
    records = read_archives(pages.sparkSession, folder)
    return records.join(merged.drop("page", "length"), ["archive", "place"]).select(
        F.expr("try_cast(page AS long)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.expr("try_cast(refers_to AS long)").alias("refers_to"), "url_key", "date", "range", "turn",
    )
