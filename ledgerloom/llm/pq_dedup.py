"""Near-duplicate embeddings by product quantisation.

Unit vectors are split in two halves, each with centroids of its own; a pair of centroids names an inverted list, so a
few hundred centroids make tens of thousands of lists, and lists keep their length when the table grows. What the
centroids leave of a vector is cut into subspaces, each coded by its nearest codeword.

1. Every vector is a member of its nearest list and visits the nearest few. A visitor goes as bytes (a scalar
   quantised vector with its error), a member as codes with its coding error. Within a list the distance between a
   visitor and a member's code is added up from look-up tables (asymmetric distances). A member can only be a partner
   if that distance is at most the radius plus both errors, so this step loses nothing.
2. Only vectors with such a partner are joined to their full vectors, list by list, and compared by exact cosine in
   double precision.

A pair is lost only if neither vector visits the other's list: with 8 visits about one in a hundred pairs at the
threshold, in lists of a table of a million vectors a label. Equal vectors are one class with a count, and pairs are never
written: a list gives the number of links of each vector and, for the components, the edges of a forest. A list longer
than a block, as a group of near copies makes, is dealt into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written


@dataclass(frozen=True)
class PqParams:
    cosine: float = 0.98
    list_length: int = 64  # vectors of the largest label in a list, on average
    probes: int = 8  # lists that a vector visits
    sample: int = 8192  # vectors on which centroids and codewords are fitted; 8 for each centroid if that is more
    subspaces: int = 16
    codes: int = 256
    block: int = 1024  # vectors of a list compared at once
    seed: int = 3

    @property
    def radius(self) -> float:
        return math.sqrt(2 - 2 * self.cosine) * (1 + 1e-9) + 1e-9


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(-2 * x[i : i + 4096] @ c.T + (c * c).sum(1)).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        sums = np.column_stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])])
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class Quantiser:
    """Centroids of the two halves and, for the residuals, codewords of each subspace."""

    def __init__(self, sample: np.ndarray, lists: int, params: PqParams):
        rng = np.random.default_rng(params.seed)
        self.params, self.dim = params, sample.shape[1]
        halves = np.linspace(0, self.dim, min(2, self.dim) + 1).astype(int)
        self.halves = list(zip(halves, halves[1:]))
        k = math.ceil(lists ** (1 / len(self.halves)))
        self.centroids = [kmeans(sample[:, a:b], k, rng) for a, b in self.halves]
        cuts = np.linspace(0, self.dim, min(params.subspaces, self.dim) + 1).astype(int)
        self.cuts = list(zip(cuts, cuts[1:]))
        rest = sample - self.centre(self.places(sample)[:, 0])
        self.words = [kmeans(rest[:, a:b], params.codes, rng) for a, b in self.cuts]

    def places(self, unit: np.ndarray) -> np.ndarray:
        """The lists that each vector visits, the nearest first, which is its own."""
        lists, far = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for (a, b), c in zip(self.halves, self.centroids):
            d = -2 * unit[:, a:b] @ c.T + (c * c).sum(1)
            near = np.argsort(d, 1, kind="stable")[:, : self.params.probes]  # the nearest sums lie among the nearest of each half
            lists = (lists[:, :, None] * len(c) + near[:, None, :]).reshape(len(unit), -1)
            far = (far[:, :, None] + np.take_along_axis(d, near, 1)[:, None, :]).reshape(len(unit), -1)
            best = np.argsort(far, 1, kind="stable")[:, : self.params.probes]
            lists, far = np.take_along_axis(lists, best, 1), np.take_along_axis(far, best, 1)
        return lists

    def centre(self, lists: np.ndarray) -> np.ndarray:
        parts = []
        for c in reversed(self.centroids):
            parts.append(c[lists % len(c)])
            lists = lists // len(c)
        return np.concatenate(parts[::-1], 1)

    def encode(self, unit: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (one byte per subspace) and the length of what they miss."""
        rest = unit - self.centre(home)
        codes = np.empty((len(unit), len(self.words)), np.uint8)
        for m, (a, b) in enumerate(self.cuts):
            w = self.words[m]
            codes[:, m] = (-2 * rest[:, a:b] @ w.T + (w * w).sum(1)).argmin(1)
        coded = np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], 1)
        return codes, np.linalg.norm(rest - coded, axis=1)

    def distances(self, visitors: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Distances (visitors, members of list `which`) from look-up tables."""
        rest, total = visitors - self.centre(np.array([which])), np.zeros((len(visitors), len(codes)))
        for m, (a, b) in enumerate(self.cuts):
            w, r = self.words[m], rest[:, a:b]
            table = (r * r).sum(1)[:, None] - 2 * r @ w.T + (w * w).sum(1)
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def classes_of(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(cid, label, vec, rep, n): the distinct usable vectors of each label, numbered; rep is the smallest id."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    usable = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & good)
    classes = usable.groupBy(F.col(label).cast("string").alias("label"), F.col(vector).alias("vec")).agg(F.min(key).cast("long").alias("rep"), F.count("*").alias("n"))
    return classes.where("rep is not null").withColumn("cid", F.monotonically_increasing_id())


def _unit(vecs: pa.Array | list, dim: int) -> np.ndarray:
    x = np.array(vecs, np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(classes: DataFrame, params: PqParams, dim: int) -> Quantiser:
    """Lists in proportion to the largest label; fitted on a bounded sample, the classes with the smallest hashes."""
    of_dim = classes.where(F.size("vec") == dim)
    largest = of_dim.groupBy("label").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0]
    lists = max(1, math.ceil(largest / params.list_length))
    rows = of_dim.select("cid", "vec").orderBy(F.xxhash64("vec", F.lit(params.seed)), "cid").limit(max(params.sample, 8 * math.ceil(math.sqrt(lists)))).collect()
    return Quantiser(_unit([r["vec"] for r in rows], dim), lists, params)


def entries(classes: DataFrame, quantiser: Quantiser) -> DataFrame:
    """A row in each list that a class visits, without its vector: quant and err for its own look-ups, codes and miss for others'."""
    dim = quantiser.dim
    lean = classes.where(F.size("vec") == dim).select("label", "cid", F.col("vec").cast("array<double>").alias("vec"))
    types = pa.schema([("label", pa.string()), ("list", pa.int64()), ("cid", pa.int64()), ("home", pa.int64()), ("visits", pa.list_(pa.int64())), ("quant", pa.binary()), ("step", pa.float64()), ("err", pa.float64()), ("codes", pa.binary()), ("miss", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                labels, cids, vecs = (batch.column(c).slice(lo, 1024).to_pylist() for c in range(3))
                if not cids:
                    continue
                unit = _unit(vecs, dim)
                visits = quantiser.places(unit)
                codes, miss = quantiser.encode(unit, visits[:, 0])
                step = np.abs(unit).max(1) / 127
                quant = np.rint(unit / step[:, None]).astype(np.int8)
                err = np.linalg.norm(unit - quant * step[:, None], axis=1)
                at = np.repeat(np.arange(len(unit)), visits.shape[1])
                own = visits.ravel() == visits[at, 0]
                pick = lambda v: [v[i] for i in at]
                sent = [c.tobytes() for c in codes]
                columns = [pick(labels), visits.ravel(), pick(cids), visits[at, 0], list(visits[at]), pick([q.tobytes() for q in quant]), step[at], err[at], [sent[i] if o else None for i, o in zip(at, own, strict=True)], miss[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.types, strict=True)], schema=types)

    return lean.mapInArrow(run, "label string, list long, cid long, home long, visits array<long>, quant binary, step double, err double, codes binary, miss double")


BLOCKS = ["label", "list", "lo", "hi"]


def blocks(rows: DataFrame, params: PqParams) -> DataFrame:
    """rows with x, a block within the list, and lo <= hi, the pair of blocks to compare: once for each block of the list."""
    sized = rows.groupBy("label", "list").agg(F.ceil(F.count("*") / F.lit(params.block)).cast("long").alias("blocks"))
    dealt = rows.join(sized, ["label", "list"]).withColumn("x", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    every = dealt.withColumn("_y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return every.withColumns({"lo": F.least("x", "_y"), "hi": F.greatest("x", "_y")}).drop("_y", "blocks")


def _meetings(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For a pair of blocks: (list, visitors, members, wanted), with row numbers and the pairs that count here.

    An unordered pair of one list's members counts once. A pair of a visitor and a member might meet in the visitor's
    list too; it counts there only if that list has the smaller number and the member visits it.
    """
    which, lo, hi = (table[c][0].as_py() for c in ("list", "lo", "hi"))
    x, home, cid = (table[c].to_numpy() for c in ("x", "home", "cid"))
    visits = np.array(table["visits"].to_pylist(), np.int64)
    sides = [np.nonzero(x == lo)[0], np.nonzero(x == hi)[0]]
    out = []
    for first, second, turned in [(*sides, False)] if lo == hi else [(*sides, False), (*sides[::-1], True)]:
        members = second[home[second] == which]
        both = np.broadcast_to((home[first] == which)[:, None], (len(first), len(members)))
        once = (cid[first][:, None] < cid[members]) if lo == hi else np.full(both.shape, not turned)
        elsewhere = np.zeros(both.shape, bool)
        for column in visits[members].T:
            elsewhere |= column == home[first][:, None]
        elsewhere &= (home[first] < which)[:, None]
        out.append((which, first, members, np.where(both, once, ~elsewhere)))
    return out


def survivors(placed: DataFrame, quantiser: Quantiser) -> DataFrame:
    """(label, list, lo, hi, x, cid, home, visits) of the vectors that have a possible partner by their codes."""
    reach, dim = quantiser.params.radius, quantiser.dim
    names = [*BLOCKS, "x", "cid", "home", "visits"]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        quant = np.frombuffer(b"".join(table["quant"].to_pylist()), np.int8).reshape(-1, dim)
        rough, err, miss = quant * table["step"].to_numpy()[:, None], table["err"].to_numpy(), table["miss"].to_numpy()
        seen = np.zeros(len(rough), bool)
        for which, visitors, members, wanted in _meetings(table):
            if len(visitors) and len(members) and wanted.any():
                codes = np.frombuffer(b"".join(table["codes"].take(pa.array(members)).to_pylist()), np.uint8).reshape(len(members), -1)
                near = wanted & (quantiser.distances(rough[visitors], which, codes) <= reach + err[visitors][:, None] + miss[members] + 1e-9)
                seen[visitors[near.any(1)]] = seen[members[near.any(0)]] = True
        return table.select(names).filter(pa.array(seen))

    schema = "label string, list long, lo long, hi long, x long, cid long, home long, visits array<long>"
    return placed.groupBy(*BLOCKS).applyInArrow(run, schema)


def linked(left: DataFrame, classes: DataFrame, params: PqParams, dim: int) -> DataFrame:
    """(cid, rep, links, root) of the survivors: links found in a pair of blocks, and the smallest id that they reach there."""
    full = left.join(classes.select("cid", "rep", "n", F.col("vec").cast("array<double>").alias("vec")), "cid")
    types = pa.schema([("cid", pa.int64()), ("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        raw = table["vec"].chunk(0).values.to_numpy().reshape(-1, dim)
        norm, n, rep = np.linalg.norm(raw, axis=1), table["n"].to_numpy(), table["rep"].to_numpy()
        links, pairs = np.zeros(len(raw)), []
        for _, visitors, members, wanted in _meetings(table):
            i, j = np.nonzero(wanted)
            i, j = visitors[i], members[j]
            for at in range(0, len(i), 65536):
                a, b = i[at : at + 65536], j[at : at + 65536]
                hit = np.einsum("ij,ij->i", raw[a], raw[b]) / (norm[a] * norm[b]) >= params.cosine
                pairs.append((a[hit], b[hit]))
        i, j = (np.concatenate(v) if pairs else np.zeros(0, int) for v in (zip(*pairs, strict=True) if pairs else ([], [])))
        links += np.bincount(i, n[j], len(raw)) + np.bincount(j, n[i], len(raw))
        root = rep.copy()
        while len(i):  # smallest id that links reach within the two blocks
            before = root.sum()
            np.minimum.at(root, j, root[i])
            np.minimum.at(root, i, root[j])
            if before == root.sum():
                break
        some = links > 0
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (table["cid"].to_numpy()[some], rep[some], links[some].astype(np.int64), root[some])], schema=types)

    return full.groupBy(*BLOCKS).applyInArrow(run, "cid long, rep long, links long, root long")


def near_duplicates(vectors: DataFrame, params: PqParams = PqParams(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Rows whose label is null, or whose vector is null, empty, all zero or holds a null or non-finite component, link
    with nothing. Vectors of different lengths don't link. Repeated rows of one id are links of each other, as any
    equal vectors are. Rows without an id, if their vector occurs with one, get its component; kept is false.
    """
    classes = written(classes_of(vectors, key, vector, label), "pq-classes")
    found = None
    for row in classes.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("k")).orderBy("dim").collect():
        quantiser = fit(classes, params, row["dim"])
        left = written(survivors(blocks(written(entries(classes, quantiser), "pq-entries"), params), quantiser), "pq-survivors")
        part = linked(left, classes, params, row["dim"])
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.select(F.col(key).alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id"), F.col(key).isNotNull().alias("kept"))
    found = written(found, "pq-found")
    labels = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "pq-components").withColumnRenamed("id", "rep")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    done = classes.join(links, "cid", "left").join(labels, "rep", "left")
    done = done.select(F.col("label").alias("_l"), F.col("vec").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("_n"), F.coalesce("component", "rep").alias("_c"))
    out = vectors.join(done, (F.col(label).cast("string") == F.col("_l")) & (F.col(vector) == F.col("_v")), "left")
    component = F.coalesce("_c", F.col(key).cast("long"))
    return out.select(F.col(key).alias("vec_id"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(False)).alias("kept"))
