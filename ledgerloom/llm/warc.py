"""WARC archives: one gzip member per record, written by Spark's tasks and read back in order.

Writing: each task streams its rows into archive files of a shared folder and returns a manifest row per finished
file; only files in the manifest of tasks that succeeded are read, so a task that is run again leaves nothing behind
that counts. Reading: the members of an archive are inflated bit by bit, the headers parsed, the block cut by its
content length, and block and payload digests compared. Memory is bounded by one record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


@dataclass(frozen=True)
class WarcParams:
    least_payload: int = 100  # equal payloads of at least so many bytes are stored once
    roll_bytes: int = 256 << 20  # a new archive file from this size on
    level: int = 6
    date: str = "2024-01-01T00:00:00Z"
    salts: int = 32  # a payload that a third of all pages share is dealt to so many partitions


def roles(pages: DataFrame, params: WarcParams = WarcParams(), page: str = "page_id", html: str = "html") -> DataFrame:
    """pages with payload_digest, payload_bytes and refers_to (null: the record keeps its payload).

    The smallest page_id of each payload is found by a grouped minimum, which Spark computes on the map side first;
    payloads that occur once never travel. Pages without an id, and repeated rows of the smallest id, are responses.
    """
    raw = F.coalesce(F.col(html), F.lit("")).cast("binary")
    base = pages.withColumns({"payload_bytes": F.octet_length(raw).cast("long"), "payload_digest": F.sha2(raw, 256)})
    first = base.where(F.col("payload_bytes") >= params.least_payload).groupBy("payload_digest").agg(F.min(page).alias("first_page"), F.count("*").alias("n"))
    first = first.where("n > 1").select("payload_digest", "first_page", F.explode(F.sequence(F.lit(0), F.lit(params.salts - 1))).alias("salt"))
    salted = base.withColumn("salt", F.pmod(F.xxhash64(F.col(page)), F.lit(params.salts)).cast("int"))
    joined = salted.join(first, ["payload_digest", "salt"], "left").drop("salt")
    return joined.withColumn("refers_to", F.when((F.col("first_page") != F.col(page)) & (F.col("payload_bytes") >= params.least_payload), F.col("first_page"))).drop("first_page")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, params: WarcParams) -> bytes:
    """One gzip member. A revisit's block keeps the HTTP header, with the full length, and drops the payload."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {params.date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(params.level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode()) + z.compress(block + b"\r\n\r\n") + z.flush()


def write_archives(pages: DataFrame, folder: str, params: WarcParams = WarcParams(), page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the rows of roles() as archives below folder (any file system that pyarrow knows); the manifest: path, records, bytes."""
    lean = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"), "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [size]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if out is None:
                    name, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(name)
                data = record(*row[:2], row[2], row[3], params)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= params.roll_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return lean.mapInArrow(run, "path string, records long, bytes long")


def members(stream, chunk: int = 1 << 16) -> Iterator[Iterator[bytes]]:
    """For each gzip member of a stream, an iterator over its inflated bytes; it must be read to its end."""
    left = stream.read(chunk)
    while left:
        z = zlib.decompressobj(31)

        def one() -> Iterator[bytes]:
            nonlocal left
            while not z.eof:
                if not left and not (left := stream.read(chunk)):
                    raise ValueError("archive ends inside a record")
                yield z.decompress(left, 1 << 20)
                left = z.unconsumed_tail
            left = z.unused_data or stream.read(chunk)

        yield one()


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in order. ValueError if framing or a digest is wrong."""
    for parts in members(stream):
        head, rest = b"", bytearray()
        for piece in parts:
            rest += piece
            if not head and (at := rest.find(b"\r\n\r\n")) >= 0:
                head, rest = bytes(rest[:at]), rest[at + 4 :]
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should start")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        block, end = bytes(rest[:size]), bytes(rest[size:])
        if len(block) != size or end != b"\r\n\r\n":
            raise ValueError("content length and record end disagree")
        if fields.get("WARC-Block-Digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError("block digest is wrong")
        yield fields, block


def parse(fields: dict[str, str], block: bytes) -> tuple:
    """A row of RECORD. A revisit's payload is null; its length and digest are those of the full payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload digest is wrong")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Page-ID"), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], number("X-Refers-To-Page-ID"), None if revisit else payload


def read_archives(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives in the manifest (RECORD; without the payload column if not wanted).

    Each archive is read by one task from start to end; a manifest row's record count is checked.
    """
    files = manifest.count()
    spread = manifest.repartition(max(1, min(files, 4096)), "path")
    schema = RECORD if payload else RECORD.rpartition(",")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(folder)
        types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())][: 7 if payload else 6])
        for batch in batches:
            for path, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen = [], 0
                with fs.open_input_stream(path) as stream:
                    for fields, block in records(stream):
                        rows.append(parse(fields, block))
                        seen += 1
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types)], schema=types)
                            rows = []
                if seen != want:
                    raise ValueError(f"{path} holds {seen} records, not {want}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types)], schema=types)

    return spread.mapInArrow(run, schema)


def round_trip(pages: DataFrame, params: WarcParams = WarcParams(), payload: bool = False) -> DataFrame:
    """Archive all pages in the shared work folder and read them back.

    Null html is an empty payload. Empty tables give empty results. Extra columns of pages aren't archived. Of equal
    payloads the smallest page_id responds; repeated rows of one page are records each. A very long page is one record,
    compressed and read piece by piece.
    """
    folder = new_path(pages.sparkSession, "warc")
    manifest = written(write_archives(roles(pages, params), folder, params), "warc-manifest")
    return read_archives(manifest, folder, payload)
