"""Packing of tokenised documents into windows of a fixed length by best-fit decreasing.

Documents are tokenised and cut: one longer than a window gives full windows and one remainder. The pieces, a few
numbers each, are then dealt to blocks by a hash of the document, and each block is packed on its own: pieces from
long to short, each into the open window whose room is the tightest that still holds it. A segment tree over the
possible rooms finds that window. Blocks hold tens of thousands of pieces, so what their last windows waste is small.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, once_per_worker, written


@dataclass(frozen=True)
class PackingParams:
    window: int = 2048
    end_id: int = 1
    tokenizer: str | None = None  # file of the vocabulary; None: byte_bpe_50k of public_tokenizers
    block_pieces: int = 40_000  # pieces packed together, on average


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: A space between two other characters: what follows, with the space, is tokenised as if it stood alone.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class Coder:
    """text -> its ids as the tokenizers library gives them for the file, special strings included.

    Byte-level vocabularies of this kind never join a word with what precedes the single space before it. So a text is
    cut there, and the ids of a space with its word are remembered: the library is asked once for each such word. When
    many are remembered, those not met again since as many were new are forgotten.
    """

    def __init__(self, path: str, most: int = 600_000, longest: int = 64):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism; threads for a few words cost more than the words
        self.tokenizer, self.most, self.longest = Tokenizer.from_file(path), most, longest
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before = kind.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not kind.get("normalizer")
        self.by_word = plain and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in kind.get("added_tokens", []))

    def __call__(self, text: str) -> np.ndarray:
        first, *words = BETWEEN.split(text) if self.by_word else [text]
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known = self.known
        if new := set(words).difference(known):
            known |= {w: self.older[w] for w in new if w in self.older}
            new = [w for w in new if w not in known]
        if new:
            made = self.tokenizer.encode_batch_fast([f" {w}" for w in new], add_special_tokens=False)
            found = {w: array("I", e.ids).tobytes() for w, e in zip(new, made, strict=True)}
            known |= found
        head = array("I", self.tokenizer.encode(first, add_special_tokens=False).ids).tobytes()
        ids = np.frombuffer(head + b"".join(map(known.__getitem__, words)), np.uint32)
        for w in new:
            if len(w) > self.longest:
                del known[w]
        return ids


def load_tokenizer(path: str | None) -> Coder:
    """The coder of a tokenizers file; None stands for byte_bpe_50k of public_tokenizers. A Python worker keeps it from task to task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return once_per_worker(("coder", path), lambda: Coder(path))


def pieces(docs: DataFrame, params: PackingParams = PackingParams(), text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """One row per piece: where it starts in its document, its length, checksum of its ids (and the ids, if wanted).

    Null text counts as empty, which still has its end id. Every id lies in exactly one piece.
    """
    lean = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = PIECES + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = load_tokenizer(params.tokenizer), params.window
        fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
        types = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if ids else []))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = []
                for doc, t in zip(*(batch.column(c).slice(lo, 512).to_pylist() for c in range(2)), strict=True):
                    all_ids = np.append(encode(t or ""), params.end_id).astype("<u4")
                    for at in range(0, len(all_ids), size):
                        part = all_ids[at : at + size]
                        rows.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(all_ids), *([part.astype(np.int32)] if ids else [])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows, strict=True), types.types)], schema=types)

    return lean.mapInArrow(run, schema)


class Rooms:
    """Open windows by the room they have left; finds the smallest room that is large enough in log steps."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) with the least room of at least need; None if no open window has it."""
        count, at = self.count, need + self.leaves
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        window = self.open[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, window


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """For lengths from long to short: the window each goes to, and its place there."""
    rooms, where, place, opened = Rooms(window), [], [], 0
    for n in lengths:
        found = rooms.take(n) if n < window else None
        room, w = found or (window, opened)
        opened += found is None
        where.append(w)
        place.append(window - room)
        if room > n:
            rooms.add(room - n, w)
    return where, place


def pack(parts: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """parts (a written table of pieces) with sequence_id and offset.

    Ties in length go by document, start and checksum, so reruns over the same rows agree; repeated rows are packed
    once each. sequence_id is unique over all blocks; offsets of a sequence leave no gap.
    """
    blocks = max(1, -(-parts.count() // params.block_pieces))
    kept = parts.drop("sequence_id", "offset", "pack_block")
    dealt = kept.withColumn("pack_block", F.pmod(F.xxhash64("doc_id", F.shiftright("start", 20), "ids_crc32"), F.lit(blocks)).cast("long"))
    schema = extended(kept, "sequence_id long, offset long")

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        where, place = best_fit_decreasing(group["length"].to_pylist(), params.window)
        block = group["pack_block"][0].as_py()
        group = group.drop_columns(["pack_block"]).append_column("sequence_id", pa.array(np.array(where, np.int64) * blocks + block))
        return group.append_column("offset", pa.array(place, pa.int64()))

    return dealt.groupBy("pack_block").applyInArrow(one, schema)


def pack_documents(docs: DataFrame, params: PackingParams = PackingParams(), text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack all documents."""
    return pack(written(pieces(docs, params, text, key, ids), "pieces"), params)
