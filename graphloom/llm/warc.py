"""WARC archives with a two-level capture index.

Archives are gzip files with one member for each record, written by Spark's own text writer, so they go to any file system that
Spark knows; its file names end in ``.txt``, but any WARC reader opens them. An archive ends with the record that fills
ARCHIVE_BYTES, whatever the records' sizes. The index has a line for each record under its reversed-host URL key. Lines are
sorted by range and packed into compressed blocks of BLOCK_LINES; the sparse directory, a table of its own, has each block's
first and last key. A look-up searches the bounds of the directory's parts in binary, runs the keys of a part and its directory
past each other in order, decompresses only the blocks that can hold a key, and searches those in binary.

Spark has no reader of byte ranges: an archive with a wanted record is read whole and cut to the ranges there. That is why
archives are small.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, shuffle_width

#: Smallest payload that a revisit record stands for.
REVISIT_BYTES = 100
#: Compressed bytes after which an archive ends, and index lines of a block.
ARCHIVE_BYTES, BLOCK_LINES = 8 << 20, 2048
#: So many revisits, of about 100 bytes each, are joined by broadcast, so that payloads stay where they are; more by shuffle.
BROADCAST_REVISITS = 200_000
#: Tasks that archives are dealt out to, at most; beyond that a task reads several.
MOST_TASKS = 20_000
CAPTURE_DATE = "1970-01-01T00:00:00Z"
#: gzip level; archives are written once and read seldom.
LEVEL = 6


def url_key(url: str | None) -> str:
    """Sort key with the host's labels in reverse: ``http://a.example.com/x?y`` gives ``com,example,a)/x?y``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id} {digest}'.encode()).hexdigest())}>"


def _member(data: bytes) -> bytes:
    """A gzip member that ends with a zero byte: its length field does, or that of an empty member after it."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    whole = packer.compress(data) + packer.flush()
    if whole[-1]:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        whole += packer.compress(b"") + packer.flush()
    return whole


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that has the response's HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}"]
    lines += [f"WARC-Date: {CAPTURE_DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=%-._~''')}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes) -> dict:
    """Headers, payload and HTTP length of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"fields": fields, "payload": payload, "length": length}


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, uncompressed bytes) of the gzip members of an archive; empty ones belong to the one before."""
    at, found = 0, None
    view = memoryview(data)
    while at < len(data):
        reader = zlib.decompressobj(31)
        out, step, fed = [], 1 << 16, at
        while not reader.eof and fed < len(data):
            out.append(reader.decompress(view[fed : fed + step]))
            fed += step
        if not reader.eof:
            raise ValueError(f"the archive ends within the record at byte {at}")
        end = min(fed, len(data)) - len(reader.unused_data)
        body = b"".join(out)
        if body:
            if found:
                yield found
            found = (at, end - at, body)
        elif found:
            found = (found[0], end - found[0], found[2])
        at = end
    if found:
        yield found


def write_archives(pages: DataFrame, path: str, work: Workspace, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record for each row to ``.gz`` archives in ``path``.

    Of rows with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with the smallest id is the response and the
    others revisit it. Payloads move once, from the scan to the archive; only ids and digests are shuffled.
    """
    page = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    large = page.where(F.length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = work.save(
        large.join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits"
    )
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)

    def run(batches):
        records, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(c)[i].as_py() for c, n in enumerate(batch.schema.names)}
                records.append(_member(make_record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(records)[:-1]], pa.binary())], names=["archive"])
                    records, size = [], 0
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(records)[:-1]], pa.binary())], names=["archive"])

    archives = page.join(revisits, ["page_id", "digest"], "left").mapInArrow(run, "archive binary")
    # One row is one file. The writer ends it with a zero byte, which is the last byte of the last member.
    writer = archives.select(F.col("archive").cast("string").alias("value")).write
    writer.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


class Index(NamedTuple):
    """``blocks``: block, data (compressed lines). ``directory``: part, block, first_key, last_key, lines."""

    blocks: DataFrame
    directory: DataFrame


def build_index(spark: SparkSession, path: str, work: Workspace) -> Index:
    """Reads the archives of ``path`` and writes their index."""

    def scan(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for offset, length, data in members(batch.column(1)[i].as_buffer().to_pybytes()):
                    f = read_record(data)["fields"]
                    line = {k: f.get(k) for k in ("WARC-Target-URI", "X-Page-ID", "WARC-Type", "WARC-Payload-Digest")}
                    rows.append((url_key(line["WARC-Target-URI"]), batch.column(0)[i].as_py(), offset, length, json.dumps(line)))
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["key", "path", "offset", "length", "line"]), preserve_index=False)

    lines = work.save(_archives(spark, path).mapInArrow(scan, "key string, path string, offset long, length long, line string"), "lines")

    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("first_key", pa.string()), ("last_key", pa.string()), ("lines", pa.int32()), ("data", pa.binary())])

    def pack(batches):
        held: list[tuple] = []
        made = 0

        def block(rows):
            data = zlib.compress(json.dumps([r[1:] for r in rows]).encode())
            values = {"part": rows[0][0], "block": rows[0][0] << 32 | made, "first_key": rows[0][1], "last_key": rows[-1][1], "lines": len(rows), "data": data}
            return pa.RecordBatch.from_pylist([values], schema=schema)

        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
            while len(held) >= BLOCK_LINES:
                yield block(held[:BLOCK_LINES])
                held, made = held[BLOCK_LINES:], made + 1
        if held:
            yield block(held)

    ranges = lines.repartitionByRange(shuffle_width(spark), "key", "path", "offset").sortWithinPartitions("key", "path", "offset")
    ranges = ranges.select(F.spark_partition_id().alias("part"), "key", "path", "offset", "length", "line")
    packed = work.save(ranges.mapInArrow(pack, "part int, block long, first_key string, last_key string, lines int, data binary"), "blocks")
    return Index(packed.select("block", "data"), work.save(packed.drop("data"), "directory"))


def look_up(index: Index, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Captures (key, path, offset, length, line) of each distinct URL key of ``urls``; null is the key of records without URL."""
    # a row for each part of the directory, as few as there are shuffle partitions
    bounds = [tuple(x) for x in index.directory.groupBy("part").agg(F.min("first_key"), F.max("last_key")).collect()]
    bounds.sort(key=lambda x: (x[1], x[2]))
    firsts, lasts = [b[1] for b in bounds], [b[2] for b in bounds]

    def locate(batches):
        for batch in batches:
            keys = sorted({url_key(u) for u in batch.column(0).to_pylist()})
            found = [(bounds[p][0], k) for k in keys for p in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.string())], names=["part", "key"])

    wanted = urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(locate, "part int, key string").distinct()
    entries = index.directory.select("part", F.col("first_key").alias("key"), "block", "last_key").unionByName(wanted, allowMissingColumns=True)
    # entries of a block (block not null) come before the keys that are equal to its first key
    entries = entries.repartition(shuffle_width(urls.sparkSession), "part").sortWithinPartitions("part", "key", F.col("block").asc_nulls_last())

    def passing(batches):
        """(block, key) for every key, from one walk; only blocks that can still hold a key are kept."""
        current, opened = None, []
        for batch in batches:
            found = []
            for part, key, block, last_key in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if part != current:
                    current, opened = part, []
                if block is not None:
                    if opened and opened[-1][1] < key:
                        opened = []
                    opened.append((block, last_key))
                else:
                    if opened and opened[0][1] < key:
                        opened = [x for x in opened if x[1] >= key]
                    found += [(b, key) for b, _ in opened]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], names=["block", "key"])

    keys = entries.mapInArrow(passing, "block long, key string").groupBy("block").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # of one block: bounded

    def search(batches):
        names = ["key", "path", "offset", "length", "line"]
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            for data, wanted_keys in zip(batch.column(0), batch.column(1).to_pylist()):
                lines = json.loads(zlib.decompress(data.as_buffer()))
                sorted_keys, rows = [x[0] for x in lines], []
                for key in wanted_keys:
                    rows += lines[bisect_left(sorted_keys, key) : bisect_right(sorted_keys, key)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)], names=names)

    held = index.blocks.join(keys, "block").select("data", "keys")
    return held.mapInArrow(search, "key string, path string, offset long, length long, line string")


def read_captures(spark: SparkSession, path: str, captures: DataFrame) -> DataFrame:
    """Reads the captures' byte ranges: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    The payload of a revisit is null; its length and digest are those of the response.
    """
    ranges = captures.groupBy("path").agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))  # of one archive: bounded
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def run(batches):
        types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

        def as_int(x):
            return None if x is None else int(x)

        for batch in batches:
            for i in range(batch.num_rows):
                content = memoryview(batch.column(0)[i].as_buffer())
                rows, size = [], 0
                for at in batch.column(1)[i].as_py():
                    data = b"".join(x[2] for x in members(bytes(content[at["offset"] : at["offset"] + at["length"]])))
                    r = read_record(data)
                    f, revisit = r["fields"], r["fields"]["WARC-Type"] == "revisit"
                    digest = f["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(r["payload"]).hexdigest()
                    rows.append((as_int(f.get("X-Page-ID")), f.get("WARC-Target-URI"), r["length"] if revisit else len(r["payload"]), digest, f["WARC-Type"], as_int(f.get("X-Refers-To-Page-ID")), None if revisit else r["payload"]))
                    size += len(r["payload"])
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)

    # archives are few and large rows: so many partitions that hardly two of them meet in one task
    archives = _archives(spark, path)
    spread = max(shuffle_width(spark), min(4 * archives.select("path").count(), MOST_TASKS))
    return archives.repartition(spread, "path").join(ranges.repartition(spread, "path"), "path").select("content", "ranges").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives all pages, indexes the archives, looks every page's URL up and reads the records back.

    Returns page_id, payload_bytes long, payload_digest string (both of the full payload), record_type string (response or
    revisit), refers_to long (the response's page_id for revisits), payload binary (null for revisits).

    Nulls and odd rows: a null html is an empty payload; a null url is a record without target, found under the empty key; a
    null id is always a response. Repeated rows are records of their own; rows with one id and one payload are responses
    each. An empty table gives an empty result. Other columns are ignored.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "warc")
    path = work.path("archives")
    write_archives(pages, path, work, id_col, url_col, html_col)
    index = build_index(spark, path, work)
    work.drop("lines", "revisits")
    # URLs reach the archive percent-encoded; the key is made from that form
    quoted = F.pandas_udf(lambda s: s.map(lambda u: None if u is None else quote(u, safe=":/?#[]@!$&'()*+,;=%-._~")), "string")
    captures = look_up(index, pages.select(quoted(F.col(url_col).cast("string")).alias("url")))
    return read_captures(spark, path, captures).drop("url")


#: What ``archive_pages`` gives over ``pages``, without the payloads, in DuckDB's SQL.
ARCHIVE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
