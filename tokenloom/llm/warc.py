"""WARC archives: one gzip member per record, written and read sequentially.

Payload digests come from the scan (JVM); the smallest id per digest is a
partial aggregation and is joined back on the digest, where large groups of copies
are split by the skew-join rule.  Every task writes one archive; a record is a
``response`` with the payload or, for further copies of a payload of at least
``MIN_REVISIT`` bytes, a ``revisit`` with HTTP header and digest only that refers to
the response.  The reader streams an archive: incremental decompression to the end
of each member, header lines, content-length framing, digest verification.

Rows: null payload is the empty payload; a null page id makes a record without page
id that is never a response for others (equal payloads without any id are all
responses); rows that repeat the smallest id of their payload are all responses; null url
is written as an empty target; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written
from .sharedfiles import Writer, open_input

MIN_REVISIT = 100
LEVEL = 4
READ_BYTES = 1 << 20
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}",
            "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head[4:4] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def members(stream) -> Iterator[bytes]:
    """The decompressed members of a gzip stream, one after the other."""
    rest, z, parts = b"", zlib.decompressobj(31), []
    while True:
        chunk = rest or stream.read(READ_BYTES)
        if not chunk:
            if parts:
                raise ValueError("the archive ends inside a member")
            return
        parts.append(z.decompress(chunk))
        rest = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of a record; framing errors raise."""
    head, sep, body = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] != VERSION:
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.decode().partition(":") for line in lines[1:])}
    n = int(headers["content-length"])
    if body[n:] != b"\r\n\r\n":
        raise ValueError("content length does not match the record")
    return headers, body[:n]


def read_record(member: bytes):
    """(page_id, payload bytes, digest, type, refers_to, url, payload) of a record, verified."""
    headers, block = parse(member)
    http, sep, payload = block.partition(b"\r\n\r\n")
    lengths = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    if not sep or len(lengths) != 1:
        raise ValueError("not an HTTP response")
    algorithm, _, digest = headers["warc-payload-digest"].partition(":")
    size, kind = int(lengths[0]), headers["warc-type"]
    if kind == "response" and (algorithm != "sha256" or len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload does not match its digest")
    name = lambda x: None if x in (None, "<urn:page:>") else int(x[len("<urn:page:"):-1])
    return name(headers["warc-record-id"]), size, digest, kind, name(headers.get("warc-refers-to")), headers["warc-target-uri"], payload if kind == "response" else None


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives; a written table (file, records) of them."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    least = rows.select("id", "digest", "size").where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("id").alias("first")).withColumnRenamed("digest", "key")
    # short payloads have no partner: keys of their own spread them over the tasks
    key = F.when(F.col("size") >= MIN_REVISIT, F.col("digest")).otherwise(F.concat(F.lit("short "), F.xxhash64("id", "url").cast("string")))
    typed = rows.withColumn("key", key).join(least.hint("shuffle_hash"), "key", "left").select("id", "url", "html", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        out, n = None, 0
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for page, url, html, digest, first in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns), strict=True):
                    out = out or Writer(folder, name)
                    out.write(record(page, url, html.encode(), digest, first, first is not None and first != page))
                    n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([name]), "records": pa.array([n], pa.int64())})

    return written(typed.mapInArrow(run, "file string, records long"), "warc-files")


def read(files: DataFrame, folder: str) -> DataFrame:
    """The records of the archives: page id, sizes, digest, type, reference, url and payload (null for revisits)."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, records in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                held, size, seen = [], 0, 0
                with open_input(folder, file) as stream:
                    for member in members(stream):
                        r = read_record(member)
                        held.append((*r[:6], None if r[6] is None else r[6].decode()))
                        size += r[1]
                        seen += 1
                        if size > 4 << 20 or len(held) > 2000:
                            yield _batch(held, names)
                            held, size = [], 0
                if seen != records:
                    raise ValueError(f"{file} holds {seen} records, not {records}")
                if held:
                    yield _batch(held, names)

    return files.repartition(max(1, files.count()), "file").mapInArrow(run, schema)  # a task per archive


def _batch(rows, names):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def archive(pages: DataFrame, **columns) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    folder = scratch(pages.sparkSession, "warc")
    return read(write(pages, folder, **columns), folder)
