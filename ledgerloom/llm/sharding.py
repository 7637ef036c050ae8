"""Sharding by balanced label propagation, with DataFrame operations only.

Documents that belong together share a hub (here: their text). Every document starts in the shard that a hash of its
id names. In each round a hub's members are counted by shard, and each member asks to move to the shard that holds
most of its neighbours and still has room. Moves into a shard are let in, in hash order, as far as its quota of
bytes goes. When no more documents move, those without neighbours, which cut no edge anywhere, fill up what the
shards have left, so that all shards end within about one document of the same number of bytes.

Only sums by shard and by hash bin (a bounded number of rows) reach the driver. A hub's members are never gathered:
what travels per hub is one count for each of the shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import utf8_size, written


@dataclass(frozen=True)
class ShardParams:
    shards: int = 16
    rounds: int = 12  # at most
    bins: int = 1024  # hash bins in which moves are let in
    rows_per_bin: int = 50_000  # documents numbered together, on average
    seed: int = 23


def _bin(bins: int | Column, *cols: str | int) -> Column:
    return F.pmod(F.xxhash64(*[F.lit(c) if isinstance(c, int) else F.col(c) for c in cols]), F.lit(bins) if isinstance(bins, int) else bins).cast("int")


def _loads(nodes: DataFrame, shards: int) -> list[int]:
    got = {r["shard"]: r["b"] for r in nodes.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    return [int(got.get(s, 0)) for s in range(shards)]


def _lookup(values: list, index: Column, kind: str = "long") -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), index + 1)


def propagate(nodes: DataFrame, quota: float, params: ShardParams) -> DataFrame:
    """nodes (rid, hub, size, shard) after the rounds; no shard's bytes exceed the quota by moves into it."""
    p = params
    for turn in range(p.rounds):
        room = [quota - b for b in _loads(nodes, p.shards)]
        counts = nodes.groupBy("hub", "shard").agg(F.count("*").alias("c"))
        ranked = counts.groupBy("hub").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), _bin(1 << 30, "hub", "shard", p.seed).alias("tie"), "shard"))).alias("prefer"))
        best = F.expr("element_at(filter(prefer, x -> x.shard = shard or element_at(open_now, x.shard + 1)), 1).shard")
        asked = nodes.join(ranked, "hub").withColumn("open_now", F.array(*[F.lit(bool(v > 0)) for v in room]))
        asked = asked.withColumn("target", best).withColumn("bin", _bin(p.bins, "hub", "rid", p.seed + turn)).select("rid", "hub", "size", "shard", "target", "bin")
        asked = written(asked, "shard-asked")
        sums = asked.where("target <> shard").groupBy("target", "bin").agg(F.sum("size").alias("b"), F.count("*").alias("moves"))
        run = Window.partitionBy("target").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        let_in = sums.withColumn("upto", F.sum("b").over(run)).where(F.col("upto") <= _lookup(room, F.col("target"), "double")).groupBy("target").agg(F.max("bin").alias("last"), F.sum("moves").alias("moves")).collect()
        last = {r["target"]: r["last"] for r in let_in}
        moved = sum(r["moves"] for r in let_in)
        if not moved:
            return nodes
        gate = _lookup([last.get(s, -1) for s in range(p.shards)], F.col("target"), "int")
        nodes = asked.select("rid", "hub", "size", F.when(F.col("bin") <= gate, F.col("target")).otherwise(F.col("shard")).alias("shard"))
        if turn % 3 == 2:
            nodes = written(nodes, "shard-nodes")
    return nodes


def _filled(loose: DataFrame, room: list[float], bins: int) -> DataFrame:
    """loose with the shard in whose stretch of a line of bytes each document's middle lies; stretches as long as the rooms."""
    binned = loose.withColumn("_bin", _bin(bins, "doc_id", "hub", "rid"))
    at = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    starts = binned.groupBy("_bin").agg(F.sum("size").alias("_b")).withColumns({"_start": F.coalesce(F.sum("_b").over(at), F.lit(0)), "_all": F.sum("_b").over(every)}).drop("_b")
    inner = Window.partitionBy("_bin").orderBy("doc_id", "hub", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = binned.withColumn("_in", F.sum("size").over(inner)).join(F.broadcast(starts), "_bin")
    if not sum(room):
        room = [1.0] * len(room)
    edges = [sum(room[: i + 1]) / sum(room) for i in range(len(room) - 1)]
    middle = (F.col("_start") + F.col("_in") - F.col("size") / 2) / F.col("_all")
    return placed.withColumn("shard", F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= middle)) if edges else F.lit(0)).drop("_bin", "_start", "_in", "_all")


def numbered(rows: DataFrame, group: list[str], bins: int, order: list[str]) -> DataFrame:
    """rows with slot: gapless from 0 in each group. Rows are numbered within hash bins, the bins stacked by their counts."""
    binned = rows.withColumn("_bin", _bin(bins, *order))
    at = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.groupBy(*group, "_bin").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(at), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*group, "_bin").orderBy(*order)
    placed = binned.withColumn("_rank", F.row_number().over(inner) - 1)
    return placed.join(F.broadcast(starts) if bins <= 4096 else starts, [*group, "_bin"]).withColumn("slot", (F.col("_start") + F.col("_rank")).cast("long")).drop("_bin", "_start", "_rank")


def shard(docs: DataFrame, params: ShardParams = ShardParams(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs, under the law `bytes`.

    size is the text's UTF-8 bytes plus one. Equal texts are neighbours, null texts among themselves too. Repeated
    rows and null ids are rows like others. A group larger than a shard's quota fills shards one after another. Ties are
    settled by a hash and the row. A very long text counts with its bytes, and may fill a shard alone. No rows give no
    rows; further columns of docs, whatever their names, aren't read.
    """
    p = params
    raw = F.col(text).cast("binary")
    lean = docs.select(F.col(key).cast("long").alias("doc_id"), (utf8_size(F.col(text)) + 1).alias("size"), F.crc32(F.coalesce(raw, F.lit("").cast("binary"))).alias("text_crc32"), F.coalesce(F.sha2(raw, 256), F.lit("null")).alias("hub"))
    rows = written(lean.withColumn("rid", F.monotonically_increasing_id()), "shard-rows")
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    n, quota = total["n"], (total["b"] or 0) / p.shards
    bins = max(16, min(65_536, -(-n // p.rows_per_bin)))
    many = rows.groupBy("hub").agg(F.count("*").alias("k")).where("k > 1").select("hub")
    start = rows.join(many, "hub", "left_semi").select("rid", "hub", "size", _bin(p.shards, "doc_id", p.seed).alias("shard"))
    linked = written(propagate(written(start, "shard-start"), quota, p), "shard-linked")
    spill = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = linked.withColumn("bin", _bin(p.bins, "hub", p.seed)).groupBy("shard", "bin").agg(F.sum("size").alias("b")).withColumn("upto", F.sum("b").over(spill))
    last = {r["shard"]: r["bin"] for r in over.where(F.col("upto") > quota + 1).groupBy("shard").agg(F.min("bin").alias("bin")).collect()}
    gate = _lookup([last.get(s, p.bins) for s in range(p.shards)], F.col("shard"), "int")
    kept = linked.where(_bin(p.bins, "hub", p.seed) < gate).select("rid", "shard")
    placed = written(rows.join(kept, "rid", "left"), "shard-placed")
    names = ["rid", "doc_id", "hub", "size", "text_crc32", "shard"]
    done = [placed.where("shard is not null").select(*names)]
    mean = (total["b"] or 0) / max(1, n)
    for most, least in ((None, mean), (mean, mean / 4), (mean / 4, None)):
        now = placed.where("shard is null").drop("shard")
        now = now if most is None else now.where(F.col("size") <= most)
        later = 0 if least is None else now.where(F.col("size") <= least).agg(F.sum("size")).first()[0] or 0
        now = now if least is None else now.where(F.col("size") > least)
        loads = [0] * p.shards
        for part in done:
            loads = [a + b for a, b in zip(loads, _loads(part, p.shards), strict=True)]
        room = [max(0.0, quota - later / p.shards - b) for b in loads]
        done.append(written(_filled(now, room, bins).select(*names), "shard-filled"))
    all_rows = done[0].unionByName(done[1]).unionByName(done[2]).unionByName(done[3])
    out = numbered(all_rows, ["shard"], max(1, bins // p.shards), ["doc_id", "rid"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
