"""WARC archives with a two-level capture index (operator 1).

Pages are written as gzip-per-record WARC/1.1 archives, repeated payloads as
revisit records.  The captures' keys (host reversed, then path) are
range-sorted; each sorted part is written as a file of gzip blocks of ``BLOCK_LINES``
lines, followed by its sparse block directory (first and last key, offset and length of
each block).  A lookup bisects the list of files, one entry a sorted part; bisects
the file's block directory, read by its byte range; reads the blocks that can hold
the key by theirs; bisects the block's lines; and reads the records by their ranges.
Reading many URLs routes their keys to the files by the same bisection and goes on there
in order of keys, so a block is read once for all its keys.

Which record of equal payloads holds the payload is decided by one aggregation
over digests; pages then meet their decision in one join, whose key is the page's
own for payloads that cannot repeat, so that short and empty payloads do not meet
in one task (repeated long ones are split by adaptive execution).

Files are written below ``spark.checkpoint.dir`` through pyarrow's file systems,
under a name that is new for each attempt of a task; the manifest names only
files of tasks that ended, so a lost executor leaves at most files that nothing reads.

Defined cases: a null html is an empty payload; a null url is recorded as
``urn:page:<id>``; white space and control characters in urls are
percent-encoded; payloads of under ``LEAST_BYTES`` bytes are always responses;
rows that repeat a page and its payload are all responses if theirs is the
largest page_id; payloads of any length are written and read one record at a time,
and come back only where asked for; a null page_id never names a response for others and revisits
one if there is one; an empty table gives no archives and no rows; other columns
are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import BATCH_BYTES, new_path, ready, saved, table

LEAST_BYTES = 1000
BLOCK_LINES = 1000
ARCHIVE_BYTES = 256 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("8b9f6a52-0f4e-5d0a-9a57-6d0d1c0f7e11")

_BAD = re.compile(r"[\x00-\x20\x7f-\xa0  ]")
_CAPTURES = "key string, page_id long, file string, offset long, length long, record_type string"
_FILES = "first string, last string, file string, offset long, length long, lines long"


def clean_url(url: str | None, page_id: int | None) -> str:
    if url is None:
        return f"urn:page:{page_id}"
    return _BAD.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def url_key(url: str) -> str:
    """The sort key of a cleaned URL: labels of the host reversed, then path and query; scheme, user, port 80/443 and fragment go."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    at = "" if port in (None, 80, 443) else f":{port}"
    return ",".join(reversed(host.rstrip(".").split("."))) + at + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, which tells the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if revisit else head + payload
    names = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if page_id is not None:
        names.append(("X-Page-ID", str(page_id)))
    if revisit:
        names += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in names).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record, digests verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode():
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    http, _, payload = body.partition(b"\r\n\r\n")
    headers["payload-bytes"] = re.search(rb"Content-Length: (\d+)", http)[1].decode()
    return headers, payload


def gzip_member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, digest, refers_to, revisit) -> captures; archives roll at ``ARCHIVE_BYTES``."""
    store, base = _opened(folder)
    out, name, offset = None, "", 0
    try:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for page_id, url, html, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or offset >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                target = clean_url(url, page_id)
                data = gzip_member(record(page_id, target, html or b"", digest, refers_to, revisit))
                out.write(data)
                for own, value in zip(rows, (url_key(target), page_id, name, offset, len(data), "revisit" if revisit else "response"), strict=True):
                    own.append(value)
                offset += len(data)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["key", "page_id", "file", "offset", "length", "record_type"])
    finally:
        if out is not None:
            out.close()


def _index(batches: Iterator[pa.RecordBatch], folder: str, block_lines: int) -> Iterator[pa.RecordBatch]:
    """Sorted captures -> a file of compressed blocks and their directory; gives where the directory stands."""
    store, base = _opened(folder)
    name, offset, lines = f"captures-{uuid.uuid4().hex}.cdx.gz", 0, 0
    out, held, blocks = None, [], []

    def flush(own: list[tuple]) -> None:
        nonlocal out, offset, lines
        if out is None:
            out = store.open_output_stream(f"{base}/{name}", compression=None)
        data = gzip_member("\n".join("\t".join("" if v is None else str(v) for v in line) for line in own).encode())
        out.write(data)
        blocks.append((own[0][0], own[-1][0], offset, len(data)))
        offset += len(data)
        lines += len(own)

    rows = []
    try:
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= block_lines:
                flush(held[:block_lines])
                held = held[block_lines:]
        if held:
            flush(held)
        if out is not None:
            data = gzip_member(json.dumps(blocks).encode())
            out.write(data)
            rows.append((blocks[0][0], blocks[-1][1], name, offset, len(data), lines))
    finally:
        if out is not None:
            out.close()
    kinds = [("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [k for k, _ in kinds])


def read_range(store: fs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with store.open_input_file(path) as f:
        return zlib.decompress(f.read_at(length, offset), 31)


def holding(firsts: list[str], lasts: list[str], key: str) -> range:
    """Places of the sorted ranges that can hold a key, by bisection; a key may stand in several neighbours."""
    return range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))


class CaptureFile:
    """One file of captures: its directory is read once, and the last block stays at hand."""

    def __init__(self, store: fs.FileSystem, base: str, name: str, offset: int, length: int):
        self.store, self.path = store, f"{base}/{name}"
        self.blocks = json.loads(read_range(store, self.path, offset, length))
        self.firsts, self.lasts = [b[0] for b in self.blocks], [b[1] for b in self.blocks]
        self.at, self.lines, self.keys, self.reads = -1, [], [], 0

    def find(self, key: str) -> Iterator[list[str]]:
        """The capture lines of a key."""
        for i in holding(self.firsts, self.lasts, key):
            if i != self.at:
                text = read_range(self.store, self.path, *self.blocks[i][2:]).decode()
                self.at, self.lines = i, [line.split("\t") for line in text.split("\n")]
                self.keys = [x[0] for x in self.lines]
                self.reads += 1
            yield from self.lines[bisect.bisect_left(self.keys, key) : bisect.bisect_right(self.keys, key)]


_RECORD = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("key", pa.string()), ("file", pa.string()), ("offset", pa.int64())]
_RECORD_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, key string, file string, offset long"


def _records(store: fs.FileSystem, base: str, lines: list[list[str]], payloads: bool) -> Iterator[pa.RecordBatch]:
    """Capture lines -> their records, digests verified; batches end after ``BATCH_BYTES`` of payload."""
    kinds = _RECORD + [("payload", pa.binary())] * payloads

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, (_, kind) in enumerate(kinds)], [k for k, _ in kinds])

    found, held = [], 0
    for name, own in itertools.groupby(sorted(lines, key=lambda x: (x[2], int(x[3]))), key=lambda x: x[2]):
        with store.open_input_file(f"{base}/{name}") as f:
            for key, _, _, offset, length, kind in own:
                headers, payload = parse_record(zlib.decompress(f.read_at(int(length), int(offset)), 31))
                digest = base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex()
                if headers["WARC-Type"] != kind or kind != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                row = (None if page is None else int(page), int(headers["payload-bytes"]), digest, kind, None if refers is None else int(refers), headers["WARC-Target-URI"], key, name, int(offset))
                if payloads:
                    row += (None if kind == "revisit" else payload,)
                    held += len(payload)
                found.append(row)
                if held >= BATCH_BYTES:
                    yield batch()
                    found, held = [], 0
    if found:
        yield batch()


def _lookups(batches: Iterator[pa.RecordBatch], folder: str, files: list[tuple], payloads: bool) -> Iterator[pa.RecordBatch]:
    """(file, key) in this order -> records, some ``BLOCK_LINES`` captures at a time."""
    store, base = _opened(folder)
    now, place, lines = None, -1, []
    for batch in batches:
        for i, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i != place:
                place, now = i, CaptureFile(store, base, *files[i][2:5])
            for line in now.find(key):
                lines.append(line)
                if len(lines) >= BLOCK_LINES:
                    yield from _records(store, base, lines, payloads)
                    lines = []
    if lines:
        yield from _records(store, base, lines, payloads)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [url_key(clean_url(u, p)) for p, u in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["key"])


def decide(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``pages(page_id, url, html)`` with ``digest``, ``refers_to`` and ``revisit``."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = pages.select("page_id", "url", payload.alias("html")).withColumn("digest", F.sha1("html"))
    repeats = F.octet_length("html") >= least_bytes
    keyed = own.withColumn("key", F.when(repeats, F.col("digest")).otherwise(F.concat(F.lit("own:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("url", F.lit("")))))
    largest = own.where(repeats).groupBy(F.col("digest").alias("key")).agg(F.max("page_id").alias("largest"))
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    out = keyed.join(largest, "key", "left").withColumn("revisit", revisit)
    return out.select("page_id", "url", "html", "digest", F.when(F.col("revisit"), F.col("largest")).alias("refers_to"), "revisit")


class Archive:
    """Archives and index below a shared folder, with lookups by URL.

    ``files`` has an entry for each sorted part of the index, so as many as that sort had tasks.
    """

    def __init__(self, spark: SparkSession, folder: str, captures: DataFrame, files: list[tuple]):
        self.spark, self.folder, self.captures, self.files = spark, folder, captures, files

    @classmethod
    def write(cls, pages: DataFrame, block_lines: int = BLOCK_LINES, least_bytes: int = LEAST_BYTES) -> Archive:
        spark = pages.sparkSession
        ready(spark)
        folder = new_path(spark, "warc")
        store, base = _opened(folder)
        store.create_dir(base)
        captures = saved(decide(pages, least_bytes).mapInArrow(lambda it: _write(it, folder), _CAPTURES), "captures")
        ordered = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
        files = ordered.mapInArrow(lambda it: _index(it, folder, block_lines), _FILES).collect()
        return cls(spark, folder, captures, sorted((tuple(f) for f in files), key=lambda f: (f[0], f[1], f[2])))

    def find(self, pages: DataFrame, payloads: bool = False) -> DataFrame:
        """The records of the URLs of ``pages(page_id, url)``, found through the index (a null URL is the page's own)."""
        keys = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(_keys, "key string")
        return self._through(keys.distinct(), payloads)

    def _through(self, keys: DataFrame, payloads: bool) -> DataFrame:
        """Different keys -> records: each key goes to the files that can hold it, then down to its lines."""
        folder, files = self.folder, self.files
        firsts, lasts = [f[0] for f in files], [f[1] for f in files]

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = [(i, k) for k in batch.column(0).to_pylist() for i in holding(firsts, lasts, k)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int32()), pa.array([k for _, k in pairs], pa.string())], ["place", "key"])

        ordered = keys.mapInArrow(routed, "place int, key string").repartitionByRange("place", "key").sortWithinPartitions("place", "key")
        return ordered.mapInArrow(lambda it: _lookups(it, folder, files, payloads), _RECORD_SQL + (", payload binary" if payloads else ""))

    def records(self, payloads: bool = False) -> DataFrame:
        """All records, by all keys of the index."""
        return self._through(self.captures.select("key").distinct(), payloads)

    def lookup(self, url: str) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers and payloads of one URL's records, one at a time."""
        key = url_key(clean_url(url, None))
        store, base = _opened(self.folder)
        for i in holding([f[0] for f in self.files], [f[1] for f in self.files], key):
            for line in CaptureFile(store, base, *self.files[i][2:5]).find(key):
                yield parse_record(read_range(store, f"{base}/{line[2]}", int(line[3]), int(line[4])))


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = Archive.write(pages).find(pages)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS largest FROM p WHERE payload_bytes >= {LEAST_BYTES} GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN p.payload_bytes >= {LEAST_BYTES} AND m.largest IS NOT NULL AND p.page_id IS DISTINCT FROM m.largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.payload_bytes >= {LEAST_BYTES} AND p.page_id IS DISTINCT FROM m.largest THEN m.largest END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)"""
