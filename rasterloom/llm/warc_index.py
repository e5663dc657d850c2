"""WARC archives with a two-level capture index.

Records are gzip members of WARC files in the shared folder; each task rolls its own files and
Spark commits, as a Parquet table, where every record lies, so a lost attempt's files are never
read. The index sorts captures by reversed-host key into compressed blocks; the range partitions
of the sort are its shards, and each shard file ends in a sparse directory, the first key of every
block. A look-up bisects the shards' first keys (one a partition), then the shard's directory,
range-reads the blocks that can hold the key, bisects inside them, and range-reads the records.
A key with many captures becomes many block rows, which are dealt out anew before they are read.

Equal payloads: the record with the largest page id is the response, the others are revisits of
it. The group is found by a digest that is grouped map-side and joined back; hot digests are split
by adaptive execution.

Defined results: a null payload is empty; a null or unusable URL has the key of its escaped text;
a null page id is a revisit if its payload has a page id elsewhere; rows that repeat the largest
page id of a payload are all responses.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, shared_path

#: Bytes after which a WARC file is closed, captures of an index block, and bytes of one read.
FILE_BYTES, BLOCK_LINES, READ_BYTES, READ_GAP = 256 << 20, 512, 8 << 20, 64 << 10
#: One date for all records: the input has none, and reruns agree.
RECORD_DATE = "2000-01-01T00:00:00Z"
CAPTURES = "key string, page_id bigint, file string, offset bigint, length bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def capture_key(url: str | None) -> str:
    """The URL with its host reversed, without scheme, fragment, user or default port; sorts by site."""
    escape = lambda s: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s)
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        return escape(url)
    if not host:
        return escape(url)
    port_text = "" if port in (None, 80, 443) else f":{port}"
    return escape(f"{','.join(reversed(host.rstrip('.').split('.')))}{port_text}){parts.path or '/'}{'?' + parts.query if parts.query else ''}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has no payload but its digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda i: "<urn:page:%s>" % ("" if i is None else i)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {RECORD_DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of a record's bytes."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines)
    http, _, payload = rest[: int(field["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    ident = lambda s: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", s)) else None
    told = field["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = field["WARC-Type"] == "revisit"
    if not revisit and (payload_digest(payload) != told or len(payload) != size):
        raise ValueError(f"the payload of {field['WARC-Record-ID']} is damaged")
    return ident(field["WARC-Record-ID"]), field.get("WARC-Target-URI"), size, told, field["WARC-Type"], ident(field["WARC-Refers-To"]) if revisit else None, None if revisit else payload


def write_archives(pages: DataFrame, root: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write a record per row of pages (page_id, url, html); returns where each capture lies, as a written table."""
    folder = root or shared_path(pages.sparkSession, "warc")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path)
        number, out, at, name, rows = TaskContext.get().partitionId(), None, 0, "", []

        def close() -> pa.RecordBatch:
            """A file is closed before its captures are told."""
            out.close()
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "page_id", "file", "offset", "length"])

        for part in parts:
            for page_id, url, payload, keeper, known in zip(*(c.to_pylist() for c in part.columns)):
                if out is None:
                    name, at, rows = f"part-{number:06d}-{uuid.uuid4().hex}.warc.gz", 0, []
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                revisit = known and page_id != keeper and len(payload) >= least_bytes
                member = gzip.compress(warc_record(page_id, url, payload, keeper if revisit else None, revisit), 6, mtime=0)
                out.write(member)
                rows.append((capture_key(url), page_id, f"{folder}/{name}", at, len(member)))
                at += len(member)
                if at >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    keepers = rows.groupBy("digest").agg(F.max("page_id").alias("keeper"))
    met = rows.join(keepers, "digest").select("page_id", "url", "payload", "keeper", F.col("keeper").isNotNull().alias("known"))
    return materialise(met.mapInArrow(write, CAPTURES), "warc-captures")


def build_index(captures: DataFrame, root: str | None = None) -> DataFrame:
    """Write the shard files; returns the top level, a table (shard, file, first_key, last_key), one row a shard."""
    folder = root or shared_path(captures.sparkSession, "warc-index")

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path)
        number = TaskContext.get().partitionId()
        name = f"shard-{number:06d}-{uuid.uuid4().hex}.idx"
        directory, lines, at, last, out = [], [], 0, "", None

        def close_block() -> int:
            block = zlib.compress("\n".join(lines).encode(), 6)
            out.write(block)
            directory.append(f"{lines[0].split(chr(9), 1)[0]}\t{at}\t{len(block)}")
            return at + len(block)

        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if out is None:
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                lines.append("\t".join("" if v is None else str(v) for v in row))
                last = row[0]
                if len(lines) >= BLOCK_LINES:
                    at, lines = close_block(), []
        if out is None:
            return
        if lines:
            at = close_block()
        sparse = zlib.compress("\n".join(directory).encode(), 6)
        out.write(sparse + len(sparse).to_bytes(8, "little"))
        out.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int32()), "file": [f"{folder}/{name}"], "first_key": [directory[0].split("\t", 1)[0]], "last_key": [last]})

    placed = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(partitions(captures.sparkSession), "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return materialise(placed.mapInArrow(build, "shard int, file string, first_key string, last_key string"), "warc-shards")


def find_captures(keys: DataFrame, index: DataFrame) -> DataFrame:
    """The captures of every key of keys (key, distinct), by bisection of both levels."""
    spark = keys.sparkSession
    n = partitions(spark)
    shards = sorted((r["shard"], r["first_key"], r["last_key"], r["file"]) for r in index.collect())  # one row a partition of the sort
    firsts, lasts, files = ([s[i] for s in shards] for i in (1, 2, 3))

    def to_shards(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [(files[s], k) for k in part.column(0).to_pylist() for s in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            yield pa.RecordBatch.from_pydict({"file": pa.array([r[0] for r in rows], pa.string()), "key": pa.array([r[1] for r in rows], pa.string())})

    def to_blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        opened, heads, places = None, [], []
        for part in parts:
            rows = []
            for file, key in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if file != opened:
                    system, path = fs.FileSystem.from_uri(file)
                    with system.open_input_file(path) as f:
                        size = f.size()
                        length = int.from_bytes(f.read_at(8, size - 8), "little")
                        lines = [x.rsplit("\t", 2) for x in zlib.decompress(f.read_at(length, size - 8 - length)).decode().split("\n")]
                    opened, heads, places = file, [x[0] for x in lines], [(int(x[1]), int(x[2])) for x in lines]
                for b in range(max(0, bisect.bisect_left(heads, key) - 1), bisect.bisect_right(heads, key)):
                    rows.append((file, *places[b], key))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "offset", "length", "key"])

    def to_captures(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        opened, keys_of, lines = None, [], []
        for part in parts:
            rows = []
            for file, offset, length, key in zip(*(c.to_pylist() for c in part.columns)):
                if (file, offset) != opened:
                    system, path = fs.FileSystem.from_uri(file)
                    with system.open_input_file(path) as f:
                        lines = [x.split("\t") for x in zlib.decompress(f.read_at(length, offset)).decode().split("\n")]
                    opened, keys_of = (file, offset), [x[0] for x in lines]
                for x in lines[bisect.bisect_left(keys_of, key) : bisect.bisect_right(keys_of, key)]:
                    rows.append((x[0], int(x[1]) if x[1] else None, x[2], int(x[3]), int(x[4])))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "page_id", "file", "offset", "length"])

    dealt = keys.select("key").mapInArrow(to_shards, "file string, key string").repartition(n, "file", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("file", "key")
    blocks = dealt.mapInArrow(to_blocks, "file string, offset bigint, length bigint, key string").repartition(n, "file", "offset").sortWithinPartitions("file", "offset", "key")
    return blocks.mapInArrow(to_captures, CAPTURES)


def read_captures(captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of captures, by range reads that take neighbours in one go."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def runs(rows):
            run: list = []
            for file, offset, length in rows:
                if run and (file != run[0][0] or offset - (run[-1][1] + run[-1][2]) > READ_GAP or offset + length - run[0][1] > READ_BYTES):
                    yield run
                    run = []
                run.append((file, offset, length))
            if run:
                yield run

        opened = handle = None
        for part in parts:
            rows = []
            for run in runs(zip(*(c.to_pylist() for c in part.columns))):
                if run[0][0] != opened:
                    system, path = fs.FileSystem.from_uri(run[0][0])
                    opened, handle = run[0][0], system.open_input_file(path)
                start = run[0][1]
                data = handle.read_at(run[-1][1] + run[-1][2] - start, start)
                for _, offset, length in run:
                    parsed = parse_record(gzip.decompress(data[offset - start : offset - start + length]))
                    rows.append(parsed if with_payload else (*parsed[:-1], None))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    dealt = captures.select("file", "offset", "length").repartition(partitions(captures.sparkSession), "file", F.expr(f"offset div {READ_BYTES}")).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, RECORDS)


def keys_of(urls: DataFrame, column: str = "url") -> DataFrame:
    """The distinct capture keys of a column of URLs."""

    def to_keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u) for u in part.column(0).to_pylist()], pa.string())], names=["key"])

    return urls.select(column).distinct().mapInArrow(to_keys, "key string").distinct()


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write pages, index them, look every page's key up and read the records back; one row a page."""
    index = build_index(write_archives(pages))
    return read_captures(find_captures(keys_of(pages), index)).drop("payload")
