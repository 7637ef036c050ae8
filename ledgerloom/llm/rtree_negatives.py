"""Hard negatives by an STR-packed R-tree over inner products.

Vectors of one label and length are cut into tiles of about equal size, first along the coordinate in which they
spread most, then, within such a slab, along the next. Cut points come from a bounded sample; every vector is placed.
Coordinates are whole numbers and a fraction hashed from the id is added, so copies of one vector are cut apart like
any others. A tile is a subtree: its task packs the tile's vectors the same way into leaves, leaves into nodes, and
keeps the smallest and largest value of each coordinate in a node. For a query these bound the inner product coordinate
by coordinate. A best-first queue takes nodes by their upper bound, leaves out those outside the window of scores, and
ends once the best bound left is strictly below the k-th score.

Queries are sent to the tiles that can answer them and stream past the subtree in batches, so a task holds one tile and
one batch. Each tile answers with k rows at most for a window; a window function keeps the k best of all tiles. Positives
ask the tiles of their own label without a window; each gives a window for the tiles of all other labels.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WINDOWS = "array<struct<positive_id: bigint, low: bigint, high: bigint>>"
LEAST, MOST = -(2**63), 2**63 - 1
TILE = ("dim", "label", "tile")


@dataclass(frozen=True)
class NegativeParams:
    positives: int = 5
    negatives: int = 5
    least: int = 80  # a negative's score in percent of the positive's, at least
    most: int = 100  # and at most
    leaf: int = 32  # vectors in a leaf
    fanout: int = 8  # children of a node
    tile: int = 8192  # vectors in a subtree, about
    sample: int = 20_000  # vectors, about, that cut points are taken from


def packed_order(points: np.ndarray, size: int) -> np.ndarray:
    """Sort-tile-recursive order of points, by the two coordinates of greatest spread, for groups of size."""
    groups = -(-len(points) // size)
    slab = size * max(1, round(len(points) / size / np.sqrt(groups)))
    first, second = spread(points)
    order = np.argsort(points[:, first], kind="stable")
    return np.concatenate([part[np.argsort(points[part, second], kind="stable")] for part in np.split(order, range(slab, len(order), slab))])


def spread(points: np.ndarray) -> tuple[int, int]:
    """The two coordinates with the greatest variance; one twice if there is but one."""
    order = np.argsort(-points.var(0), kind="stable")
    return int(order[0]), int(order[min(1, len(order) - 1)])


class RTree:
    """The vectors of one tile. Values are whole numbers, held as floats where products stay exact, else as Python's integers."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, params: NegativeParams):
        self.params, dim = params, points.shape[1]
        order = packed_order(points, params.leaf)
        self.ids, points = ids[order], points[order]
        self.largest = float(np.abs(points).max())
        self.points = points
        self.big: np.ndarray | None = None
        starts = np.arange(0, len(points), params.leaf)
        self.levels = [(np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts))]
        while len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            starts = np.arange(0, len(low), params.fanout)
            self.levels.append((np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))
        self.slack = 4 * dim * np.finfo(float).eps

    def bounds(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level the least and the greatest inner product that a node's box allows, a row per query, widened by the rounding of floats."""
        up, down, out = np.maximum(queries, 0), np.minimum(queries, 0), []
        for low, high in self.levels:
            reach = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T * self.slack
            out.append((up @ low.T + down @ high.T - reach, up @ high.T + down @ low.T + reach))
        return out

    def scores(self, query: np.ndarray, leaf: int) -> np.ndarray:
        part = slice(leaf * self.params.leaf, (leaf + 1) * self.params.leaf)
        if self.largest * float(np.abs(query).sum()) < 2**53:
            return (self.points[part] @ query).astype(np.int64)
        whole = lambda x: np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
        return np.array([min(max(s, LEAST), MOST) for s in whole(self.points[part]) @ whole(query)], np.int64)

    def best(self, query: np.ndarray, bounds: list, row: int, low: int, high: int, k: int, without: int | None, known: dict[int, np.ndarray]) -> list[tuple[int, int]]:
        """The k best (score, id) with low <= score <= high: by falling score, then id. known keeps the query's scores by leaf."""
        top = len(self.levels) - 1
        queue, found = [(-bounds[top][1][row, 0], top, 0)], []
        while queue:
            negative, level, node = heapq.heappop(queue)
            if -negative < low or len(found) == k and -negative < -found[-1][0]:
                break
            if bounds[level][0][row, node] > high:
                continue
            if level:
                children = slice(node * self.params.fanout, (node + 1) * self.params.fanout)
                for child, most in enumerate(bounds[level - 1][1][row, children].tolist(), children.start):
                    heapq.heappush(queue, (-most, level - 1, child))
                continue
            if node not in known:
                known[node] = self.scores(query, node)
            score = known[node]
            floor = max(low, -found[-1][0]) if len(found) == k else low
            hits = np.flatnonzero((score >= floor) & (score <= high))
            if len(hits):
                found += [(-int(score[i]), int(self.ids[node * self.params.leaf + i])) for i in hits if self.ids[node * self.params.leaf + i] != without]
                found = sorted(found)[:k]
        return [(-s, i) for s, i in found]


def takes_part(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, number), F.lit(False))


def placed(vectors: DataFrame, params: NegativeParams) -> DataFrame:
    """vectors (id, label, v) with their length dim and tile."""
    jitter = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = vectors.select("id", "label", F.size("v").alias("dim"), "v", jitter.alias("u"))
    n = rows.count()
    share = min(1.0, params.sample / max(1, n))
    mark = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    sampled: dict[tuple, list] = {}
    for r in rows.where(mark < share).select("dim", "label", "id", "v", "u").collect():
        sampled.setdefault((r["dim"], r["label"]), []).append((r["id"], r["v"], r["u"]))
    cuts = {k: found for k, s in sampled.items() if (found := cut_points(sorted(s), share, params))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile = np.zeros(batch.num_rows, np.int64)
            keys = list(zip(batch["dim"].to_pylist(), batch["label"].to_pylist()))
            jitters = batch["u"].to_numpy()
            for key in set(keys) & cuts.keys():
                (first, second), slabs, within = cuts[key]
                at = np.array([i for i, k in enumerate(keys) if k == key])
                v = np.array(batch["v"].take(pa.array(at)).to_pylist(), float)
                slab = np.searchsorted(slabs, v[:, first] + jitters[at])
                for s in np.unique(slab):
                    own = slab == s
                    tile[at[own]] = (int(s) << 32) + np.searchsorted(within[s], v[own, second] + jitters[at[own]])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], batch["dim"], batch["v"], pa.array(tile)], names=["id", "label", "dim", "v", "tile"])

    return rows.mapInArrow(run, f"id long, label {dict(vectors.dtypes)['label']}, dim int, v array<double>, tile long") if cuts else rows.select("id", "label", "dim", "v", F.lit(0).cast("long").alias("tile"))


def cut_points(sample: list, share: float, params: NegativeParams) -> tuple | None:
    """((first, second) coordinate, cuts into slabs, cuts within each slab); None if one tile holds all."""
    tiles = round(len(sample) / share / params.tile)
    if tiles < 2:
        return None
    points, jitters = np.array([v for _, v, _ in sample], float), np.array([u for _, _, u in sample])
    first, second = spread(points)
    n = round(np.sqrt(tiles))
    at = lambda x, parts: np.quantile(x, np.arange(1, parts) / parts) if parts > 1 and len(x) else np.zeros(0)
    x, y = points[:, first] + jitters, points[:, second] + jitters
    slabs = at(x, n)
    where = np.searchsorted(slabs, x)
    return (first, second), slabs, [at(y[where == s], -(-tiles // n)) for s in range(n)]


def answers(tiles: DataFrame, queries: DataFrame, k: int, params: NegativeParams) -> DataFrame:
    """(anchor_id, positive_id, other_id, score): the k best of each tile for each window of the queries sent to it.

    tiles has the placed vectors; queries has dim, label and tile of the tile asked, id and v of the anchor, and windows.
    """
    rows = tiles.select(*TILE, F.lit(0).alias("kind"), "id", "v", F.lit(None).cast(WINDOWS).alias("windows"))
    asked = queries.select(*TILE, F.lit(1).alias("kind"), "id", "v", "windows")
    dealt = rows.unionByName(asked).repartition(*TILE).sortWithinPartitions(*TILE, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, tree = None, [], None
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in (*TILE, "kind"))))
            ids = batch["id"].to_numpy()
            begin = 0
            while begin < len(keys):
                end = begin + 1
                while end < len(keys) and keys[end] == keys[begin]:
                    end += 1
                *own, kind = keys[begin]
                v = np.array(batch["v"].slice(begin, end - begin).to_pylist(), float)
                if own != tile:
                    tile, held, tree = own, [], None
                if not kind:
                    held.append((ids[begin:end], v))
                elif held:
                    if tree is None:
                        tree = RTree(*(np.concatenate(c) for c in zip(*held)), params)
                    out = []
                    bounds = tree.bounds(v)
                    for i, windows in enumerate(batch["windows"].slice(begin, end - begin).to_pylist()):
                        anchor, known = int(ids[begin + i]), {}
                        for w in windows:
                            low, high = (LEAST, MOST) if w["low"] is None else (w["low"], w["high"])
                            out += [(anchor, w["positive_id"], other, score) for score, other in tree.best(v[i], bounds, i, low, high, k, anchor, known)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], [], []))], names=["anchor_id", "positive_id", "other_id", "score"])
                begin = end

    return dealt.mapInArrow(run, "anchor_id long, positive_id long, other_id long, score long")


def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best answers of all tiles, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, params: NegativeParams = NegativeParams(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of vectors that anchor picks.

    vectors hold whole numbers; a score is the inner product with the anchor, exact, ended at those of a long. Higher
    scores come first, ties by id. An anchor's positives are its first others of the same label; a positive's negatives
    the first of other labels whose score is between least and most percent of the positive's.

    Rows without id or label, or whose vector is null, empty, or holds a null or non-finite component, take no part.
    Vectors of different lengths don't meet. Rows that share an id count once, by their smallest (label, vector).
    Anchors without positives, positives without negatives and empty tables give no rows.
    """
    usable = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & takes_part(F.col(vector)))
    rows = usable.select(F.col(key).cast("long").alias("id"), F.struct(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).alias("r"), anchor.alias("anchor"))
    rows = rows.groupBy("id").agg(F.min("r").alias("r"), F.max("anchor").alias("anchor"))
    kept = written(rows.select("id", "r.label", "r.v", "anchor"), "rtree-rows")
    tiles = written(placed(kept.select("id", "label", "v"), params), "rtree-tiles")
    anchors = kept.where("anchor").select("id", F.col("label").alias("own"), F.size("v").alias("dim"), "v")
    asked = tiles.select(*TILE).distinct()
    alone = F.array(F.struct(F.lit(None).cast("long").alias("positive_id"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")))
    at_home = anchors.withColumnRenamed("own", "label").join(asked, ["dim", "label"]).withColumn("windows", alone)
    positives = first(answers(tiles, at_home, params.positives, params), ["anchor_id"], params.positives)
    positives = written(positives.select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "rtree-positives")
    wide = F.col("positive_score").cast("decimal(38,0)")
    low, high = F.ceil(wide * params.least / 100), F.floor(wide * params.most / 100)
    windows = positives.where(low <= high).groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", low.cast("long").alias("low"), high.cast("long").alias("high"))).alias("windows"))
    abroad = anchors.join(windows, "id").join(asked, "dim").where("label <> own")
    negatives = first(answers(tiles, abroad, params.negatives, params), ["anchor_id", "positive_id"], params.negatives)
    return negatives.join(positives, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
