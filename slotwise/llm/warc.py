"""WARC archives of captures, and their index by an external merge of sorted runs.

``write`` makes WARC 1.1 files, each a gzip file of about SEGMENT bytes of records. Captures
with equal payloads of at least ``least`` bytes keep one response, that of the largest page_id;
the others become revisit records (identical-payload-digest) without payload. ``read``
walks through the files by their length fields, checks every response's digest and yields
one index row per record. ``merged`` orders the index: each reading task's rows are one locally
sorted run, ranges of the key space collect their share of every run, and a loser tree merges
these by URL key, timestamp and page_id. Ranges in order are the whole history; a
range is a bounded share of the index, whatever URL is most frequent.

Archives go through Spark's own text writer, so that any shared store will do and a lost
executor's files are never half there.

Null html is an empty payload. Null urls have no target and an empty key. A null page_id counts
as smaller than any other. Of repeated rows (same page_id and payload) one is the response
and the others revisit it; repeated rows of one page meet in one task. An empty table
gives no archive and an empty index.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cells, folder, in_pieces, partitions, query, raw_texts, stored, table

SEGMENT, LEAST = 16 << 20, 0
EPOCH = datetime.datetime(2024, 1, 1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n\r\n"


def url_key(url: str | None) -> str:
    """Sort key: host parts from the right, then path and query; no scheme, "www", port or fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    path = (parts.path.rstrip("/") or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + path.lower()


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str) -> bytes:
    """One record without the final blank lines."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    when = EPOCH + datetime.timedelta(seconds=(page_id or 0) % 1_000_000_000)
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + BREAK + block


def write(pages: DataFrame, target: str, least: int = LEAST, segment: int = SEGMENT) -> None:
    """Archives of (page_id, url, html) in the folder ``target``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    # Small rows decide which captures revisit; payloads move once, by page.
    small = rows.where(F.octet_length("html") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("rows"))
    small = stored(small, "warc-digests")
    groups = small.groupBy("digest").agg(F.max("page_id").alias("keep"), F.sum("rows").alias("n")).where("n > 1")
    found = small.join(groups, "digest").where("not (page_id <=> keep) or rows > 1")
    found = found.select(
        F.col("page_id").alias("f_page"), F.col("digest").alias("f_digest"), "keep",
        F.when(F.col("page_id").eqNullSafe(F.col("keep")), "repeat").otherwise("revisit").alias("kind"),
    )
    found = stored(found, "warc-revisits")
    same = F.col("page_id").eqNullSafe(F.col("f_page")) & (F.col("digest") == F.col("f_digest"))
    told = rows.join(found, same, "left").where("kind is null or kind = 'revisit'")
    captures = told.select("page_id", "url", "html", "digest", "keep", F.col("kind").isNotNull().alias("revisit"))
    repeats = found.where("kind = 'repeat'")
    if not repeats.isEmpty():
        # Repeated rows, apart from the others so that payloads move once.
        again = Window.partitionBy("page_id", "digest").orderBy("url")
        repeated = rows.join(repeats, same).withColumn("revisit", F.row_number().over(again) > 1)
        captures = captures.unionByName(repeated.select(captures.columns))
    schema = pa.schema([("records", pa.string())])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            names = ("page_id", "url", "digest", "keep", "revisit")
            for page, url, digest, keep, revisit, html in zip(*(cells(batch, n) for n in names), raw_texts(batch, "html")):
                record = warc_record(page, url, html, keep, revisit, base64.b32encode(digest).decode())
                if held and size + len(record) > segment:
                    yield pa.RecordBatch.from_arrays([pa.array([BREAK.join(held)], pa.string())], schema=schema)
                    held, size = [], 0
                held.append(record)
                size += len(record) + len(BREAK)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([BREAK.join(held)], pa.string())], schema=schema)

    segments = captures.mapInArrow(run, "records string")
    # One row is one file; the writer's line end closes the last record.
    writer = segments.write.option("maxRecordsPerFile", 1).option("compression", "gzip")
    writer.option("lineSep", BREAK.decode()).text(target)


class Stream:
    """Bytes of a gzip file as far as they are asked for."""

    def __init__(self, content: bytes):
        self.content, self.at, self.buffer = memoryview(content), 0, bytearray()
        self.gzip, self.passed = zlib.decompressobj(31), 0

    def more(self) -> bool:
        if self.at >= len(self.content):
            return False
        self.buffer += self.gzip.decompress(self.content[self.at:self.at + (1 << 16)])
        self.at += 1 << 16
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (end := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self.more():
                return None
        return self.take(end + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError("an archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.passed += n
        return out


def records(content: bytes) -> Iterator[tuple[int, int, dict, bytes]]:
    """Offset and length in the unpacked file, header fields and block of each record."""
    stream = Stream(content)
    while True:
        offset = stream.passed
        head = stream.until(BREAK)
        if head is None:
            return
        fields = dict(line.split(": ", 1) for line in head[:-4].decode().split("\r\n")[1:])
        block = stream.take(int(fields["Content-Length"]))
        if stream.take(4) != BREAK:
            raise ValueError("a record does not end where its length says")
        yield offset, stream.passed - offset, fields, block


INDEX = pa.schema([
    ("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()),
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("run", pa.int32()),
])
INDEX_DDL = (
    "url_key string, timestamp string, page_id long, record_type string, payload_digest string, payload_bytes long, "
    "refers_to long, file string, offset long, length long, run int"
)


def page_of(name: str | None) -> int | None:
    number = name[len("<urn:page:"):-1] if name else ""
    return int(number) if number else None


def read(spark: SparkSession, source: str) -> DataFrame:
    """One index row per record; the rows of a task are one sorted run."""

    def run(batches):
        number = TaskContext.get().partitionId()

        def rows():
            for batch in batches:
                for file, content in zip(cells(batch, "path"), batch.column(batch.schema.get_field_index("content"))):
                    for offset, length, fields, block in records(content.as_buffer().to_pybytes()):
                        http, payload = block.split(BREAK, 1)
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                        if kind == "response" and (len(payload) != size or base32_digest(payload) != digest):
                            raise ValueError(f"{file} at {offset}: the payload is not what its digest says")
                        yield (
                            url_key(fields.get("WARC-Target-URI")), fields["WARC-Date"], page_of(fields["WARC-Record-ID"]), kind,
                            digest, size, page_of(fields.get("WARC-Refers-To")), file.rsplit("/", 1)[1], offset, length, number,
                        )

        yield from in_pieces(rows(), INDEX)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")
    return files.mapInArrow(run, INDEX_DDL).sortWithinPartitions("url_key", "timestamp", "page_id")


class LoserTree:
    """Merges sorted sequences of (key, row): an inner node keeps the loser of its match."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        n = len(self.runs)
        self.losers = [-1] * n
        winners = [-1] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.before(a, b) else (b, a)
        self.winner = winners[1] if n > 1 else 0

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def __iter__(self):
        while self.heads and (head := self.heads[self.winner]) is not None:
            yield head[1]
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + len(self.runs)) // 2
            while node:
                if self.before(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def merged(runs: DataFrame) -> DataFrame:
    """The index in global order: ranges of (url_key, timestamp, page_id), each merged by a loser tree."""
    spark = runs.sparkSession
    runs = stored(runs, "warc-runs")
    keys = ["url_key", "timestamp", "page_id"]

    def run(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                parts.setdefault(row[-1], []).append(((row[0], row[1], row[2] is not None, row[2] or 0), row))
        if parts:
            yield from in_pieces(iter(LoserTree([parts[k] for k in sorted(parts)])), INDEX)

    dealt = runs.repartitionByRange(partitions(spark), *keys).sortWithinPartitions("run", *keys)
    return dealt.mapInArrow(run, INDEX_DDL)


@query("op6_warc_index_merge")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = folder(spark, "warc")
    write(table(spark, sf_dir, "pages"), target)
    index = merged(read(spark, target))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp")
