"""Media columns: ISO base media containers, written and read without touching the payload's meaning.

`store` puts a payload into a container: file type box, movie box with one track of raw 8-bit frames and its sample
tables, media data box. `probe` walks the nested boxes of stored bytes, decodes the sample tables and returns codec,
duration and the byte ranges of the keyframes; nothing of the payload is decoded. `read_back` follows the tables to
the payload's bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended

FRAME = 192  # bytes: 16 x 12 pixels of 8 bits
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9i", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)


@dataclass(frozen=True)
class MediaParams:
    frames_per_second: int = 25
    keyframe_every: int = 12
    frames_per_chunk: int = 10


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes before padding, and the payload: filled up with spaces to whole frames, one at least."""
    data = (text or "").encode()
    return len(data), data.ljust(max(1, -(-len(data) // FRAME)) * FRAME, b" ")


def mux(payload: bytes, params: MediaParams = MediaParams()) -> bytes:
    """A container whose only track holds the payload as raw frames of 8-bit samples."""
    n, per = len(payload) // FRAME, params.frames_per_chunk
    chunks, last = -(-n // per), n % per
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")

    def movie(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 16, 12, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
        runs = [(1, per)] if not last else [(1, last)] if chunks == 1 else [(1, per), (chunks, last)]
        tables = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(f">I{(keys := len(range(0, n, params.keyframe_every)))}I", keys, *range(1, n + 1, params.keyframe_every))),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, k, 1) for at, k in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *range(first, first + chunks * per * FRAME, per * FRAME))),
        )
        rate = params.frames_per_second
        track = box(
            b"trak",
            full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhh", 0, 0, 0, 0), MATRIX, struct.pack(">II", 16 << 16, 12 << 16), flags=7),
            box(
                b"mdia",
                full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, n, 0x55C4, 0)),
                full(b"hdlr", struct.pack(">I4s", 0, b"vide"), bytes(12), b"frames\0"),
                box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), tables),
            ),
        )
        return box(b"moov", full(b"mvhd", struct.pack(">IIIIIH", 0, 0, rate, n, 65536, 256), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2)), track)

    data = box(b"mdat", payload)
    start = len(head) + len(movie(0)) + len(data) - len(payload)
    return head + movie(start) + data


def walk(data: bytes, lo: int = 0, hi: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of kinds, first and last byte of the body) of every box, containers before what they hold."""
    hi = len(data) if hi is None else hi
    while lo + 8 <= hi:
        size, kind = struct.unpack_from(">I4s", data, lo)
        body = lo + 8
        if size == 1:
            if lo + 16 > hi:
                raise ValueError("box header cut off")
            size, body = struct.unpack_from(">Q", data, lo + 8)[0], lo + 16
        end = hi if size == 0 else lo + size
        if end > hi or end < body:
            raise ValueError(f"box {kind!r} at {lo} leaves its container")
        yield (*path, kind), body, end
        if kind in CONTAINERS:
            yield from walk(data, body, end, (*path, kind))
        lo = end
    if lo != hi:
        raise ValueError("bytes left over in a container")


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    frames: list[tuple[int, int]]  # byte range (offset, size) of each sample
    keyframes: list[tuple[int, int]]


def probe_bytes(data: bytes) -> list[Track]:
    """The tracks of a container, from its boxes alone. ValueError if they contradict each other."""
    tracks, here = [], None
    for path, lo, hi in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append(here := {})
        elif here is not None and kind in (b"mdhd", b"stsd", b"stts", b"stss", b"stsc", b"stsz", b"stco", b"co64"):
            here[kind] = (lo, hi)
    return [_decode(data, t) for t in tracks]


def _decode(data: bytes, t: dict) -> Track:
    def table(kind: bytes, fields: str, at: int = 4) -> list[tuple]:
        if kind not in t:
            return []
        lo, hi = t[kind]
        n, step = struct.unpack_from(">I", data, lo + at)[0], struct.calcsize(">" + fields)
        if lo + at + 4 + n * step > hi:
            raise ValueError(f"table {kind!r} is cut off")
        return list(struct.iter_unpack(">" + fields, data[lo + at + 4 : lo + at + 4 + n * step]))

    lo = t[b"mdhd"][0]
    scale, duration = struct.unpack_from(">IQ", data, lo + 20) if data[lo] == 1 else struct.unpack_from(">II", data, lo + 12)
    codec = data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16].decode("latin-1")
    at = t[b"stsz"][0]
    same, n = struct.unpack_from(">II", data, at + 4)
    sizes = [same] * n if same else [x[0] for x in table(b"stsz", "I", 8)]
    offsets = [x[0] for x in (table(b"co64", "Q") if b"co64" in t else table(b"stco", "I"))]
    runs = table(b"stsc", "III")
    frames: list[tuple[int, int]] = []
    for k, (first, per, _) in enumerate(runs):
        until = runs[k + 1][0] if k + 1 < len(runs) else len(offsets) + 1
        for chunk in range(first, until):
            place = offsets[chunk - 1]
            for size in sizes[len(frames) : len(frames) + per]:
                frames.append((place, size))
                place += size
    if len(frames) != n or sum(c for c, _ in table(b"stts", "II")) != n or any(p + s > len(data) for p, s in frames[-1:]):
        raise ValueError("sample tables disagree")
    keys = [frames[x[0] - 1] for x in table(b"stss", "I")] if b"stss" in t else frames
    return Track(codec, scale, duration, frames, keys)


def read_back(data: bytes, track: Track) -> bytes:
    """The track's bytes in order, neighbouring ranges read together."""
    out, lo, hi = [], None, None
    for place, size in track.frames:
        if place != hi:
            if lo is not None:
                out.append(data[lo:hi])
            lo = place
        hi = place + size
    if lo is not None:
        out.append(data[lo:hi])
    return b"".join(out)


def _mapped(df: DataFrame, source: str, schema, per_row) -> DataFrame:
    names, at = [f.name for f in schema.fields], df.columns.index(source)
    width = len(names) - len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = [f.type for f in to_arrow_schema(schema)][-width:]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                new = [per_row(v) for v in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([r[i] for r in new], t) for i, t in enumerate(types))], names=names)

    return df.mapInArrow(run, schema)


def store(docs: DataFrame, text: str = "text", media: str = "media", params: MediaParams = MediaParams()) -> DataFrame:
    """docs with two columns: the text's bytes before padding (n_bytes) and the container (binary).

    Null and empty texts give one frame of spaces. Columns of docs with the new names are replaced. Equal texts give
    equal containers, byte for byte. A very long text is one container of many frames, made in one task, as it is one
    value. No rows give no rows.
    """
    kept = docs.drop("n_bytes", media)

    def per_row(t: str | None) -> tuple:
        n, payload = payload_of(t)
        return n, mux(payload, params)

    return _mapped(kept, text, extended(kept, f"n_bytes long, {media} binary"), per_row)


PROBED = "codec string, duration_s double, n_frames long, keyframes array<struct<offset:long,size:long>>, media_error string"
READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def probe(media: DataFrame, column: str = "media") -> DataFrame:
    """Codec, duration, frames and keyframe byte ranges of each container, and size and digest of what it stores.

    The first track counts. Bytes that aren't a sound container, and null, give nulls and a reason in media_error.
    The column itself is dropped from the result; columns with the new names are replaced.
    """
    new = [part.split()[0] for part in f"{PROBED}, {READ}".replace("struct<offset:long,size:long>", "x").split(", ")]
    kept = media.drop(*(name for name in new if name != column))
    schema = extended(kept, f"{PROBED}, {READ}")

    def per_row(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 4 + ("null",) + (None,) * 5
        whole = (len(data), hashlib.sha256(data).hexdigest())
        try:
            track = probe_bytes(data)[0]
            payload = read_back(data, track)
        except (ValueError, KeyError, IndexError, struct.error) as e:
            return (None,) * 4 + (f"{type(e).__name__}: {e}"[:200],) + (None,) * 3 + whole
        keys = [{"offset": p, "size": s} for p, s in track.keyframes]
        return (track.codec, track.duration / track.timescale, len(track.frames), keys, None, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *whole)

    return _mapped(kept, column, schema, per_row).drop(column)
