"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size is how often each of its documents is wanted on average: a whole number of times,
and once more with the fractional rest as inclusion probability. The cube method turns these fractions into zeros
and ones so that the source's document and token totals hardly move: three documents at a time, the probabilities
are moved along the null space of the two totals (the cross product of the constraint rows) until one of them
arrives at zero or one. A block ends with at most two undecided documents and with a few that it holds back, one of
each of the graded sizes 1, 2, 4 and so on. Those of all blocks of a source meet again in the next round, until one
block is left. Its last two and the graded ones are the landing problem, settled by trying all ends: whatever the two
leave over, some choice of graded sizes makes up for it almost to the word.
"""

from __future__ import annotations

import bisect
import math
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import word_count, written


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)  # of the sources by code point, null last, over and over
    share: float = 1.5  # of all sizes, shared out
    most: float = 2.0  # times a source's size at most
    block: int = 5_000  # documents whose fractions are rounded together
    landing: int = 15  # documents of graded sizes are settled last, together with the two that a flight leaves
    seed: int = 17


def targets(units: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """(source, source_size, target) from units (source, size, n): weighted shares, capped, the excess reshared.

    Sources in order of cap over weight: those capped come first, and the level of the rest follows from running
    sums. The windows run over one row per source.
    """
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    k = len(params.weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in params.weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(k)) + 1).cast("int"))
    rows = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(params.most)).withColumn("ratio", F.col("cap") / F.col("w"))
    every = Window.partitionBy()
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("room", F.sum("source_size").over(every) * F.lit(params.share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("room") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    rows = rows.withColumn("fill", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("fill"), F.col("cap"))).alias("target"))


def graded(probability: list[float], count: list[float], size: list[float], most: int) -> set[int]:
    """Up to `most` undecided documents whose tokens are nearest to the powers of two from 1 to the largest document's."""
    free = sorted((size[i] * count[i], i) for i, p in enumerate(probability) if 0.0 < p < 1.0 and size[i] > 0)
    if not free or not most:
        return set()
    held: set[int] = set()
    steps = min(most, max(1, math.ceil(math.log2(free[-1][0])) + 1))
    for k in range(steps):
        goal = 2.0 ** (k * max(1.0, math.log2(free[-1][0]) / max(1, steps - 1)))
        at = bisect.bisect_left(free, (goal, -1))
        near = [x for x in free[max(0, at - 1 - len(held)) : at + 1 + len(held)] if x[1] not in held]
        if near:
            held.add(min(near, key=lambda x: (abs(x[0] - goal), x))[1])
    return held


def flight(probability: list[float], count: list[float], size: list[float], rng: random.Random, held: set[int] | frozenset[int] = frozenset()) -> list[float]:
    """Moves probabilities to 0 or 1 with sum(count * p) and sum(count * size * p) unmoved; two stay between at most.

    Those held are left as they are.
    """
    p, active = list(probability), []
    for i in range(len(p)):
        if 0.0 < p[i] < 1.0 and i not in held:
            active.append(i)
        if len(active) == 3:
            a, b, c = active
            x, y, z = size[a], size[b], size[c]
            u = (count[b] * count[c] * (z - y), count[a] * count[c] * (x - z), count[a] * count[b] * (y - x))
            if x == y == z:
                u = (1.0 / count[a], -1.0 / count[b], 0.0)
            _step(p, active, u, rng)
            active = [j for j in active if 0.0 < p[j] < 1.0]
    return p


def _step(p: list[float], active: list[int], u: tuple[float, ...], rng: random.Random) -> None:
    up = min(((1 - p[j]) / d if d > 0 else p[j] / -d) for j, d in zip(active, u, strict=True) if d)
    down = min((p[j] / d if d > 0 else (1 - p[j]) / -d) for j, d in zip(active, u, strict=True) if d)
    move = up if rng.random() * (up + down) < down else -down
    for j, d in zip(active, u, strict=True):
        q = p[j] + move * d
        p[j] = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q


def landing(p: list[float], count: list[float], size: list[float]) -> list[float]:
    """Settles the few documents that a flight leaves, as zeros and ones whose tokens, then documents, miss least."""
    left = [i for i, v in enumerate(p) if 0.0 < v < 1.0]
    tokens, docs = np.zeros(1), np.zeros(1)
    for i in left:  # of all choices so far, in the order of binary numbers with the last document's digit in front
        tokens = np.concatenate([tokens - p[i] * count[i] * size[i], tokens + (1 - p[i]) * count[i] * size[i]])
        docs = np.concatenate([docs - p[i] * count[i], docs + (1 - p[i]) * count[i]])
    best = int(np.lexsort((np.abs(docs), np.round(np.abs(tokens), 6)))[0])
    for k, i in enumerate(left):
        p[i] = float(best >> k & 1)
    return p


def _round(frame: DataFrame, last: bool, params: MixParams, level: int) -> DataFrame:
    """One flight per (source_no, block)."""
    fields = "doc_id long, source_no long, size long, n long, whole int, p double, blocks long, block long"

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("doc_id", "ascending")])
        rng = random.Random(f"{params.seed}/{level}/{group['source_no'][0]}/{group['block'][0]}")
        count = [float(v) for v in group["n"].to_pylist()]
        size = [float(v) for v in group["size"].to_pylist()]
        p = group["p"].to_pylist()
        p = flight(p, count, size, rng, graded(p, count, size, params.landing))
        if last or group["blocks"][0].as_py() == 1:
            p = landing(p, count, size)
        return group.set_column(group.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    names = [f.split()[0] for f in fields.split(", ")]
    return frame.select(*names).groupBy("source_no", "block").applyInArrow(one, fields)


def units_of(docs: DataFrame, text: str, source: str, key: str) -> DataFrame:
    lean = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    return lean.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))


def decide(docs: DataFrame, params: MixParams = MixParams(), text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, n, source_size, target, copies): how often the mix takes each document.

    Rows with the same id, source and size are one unit of n rows and share one decision. Null is a source of its
    own; null texts have size 0. The result depends on the rows alone, not on their order or partitions: ties are
    settled by hashes of the units. A very long text counts with its words like any other. No rows give no rows; further
    columns of docs, whatever their names, aren't read.
    """
    units = written(units_of(docs, text, source, key), "mix-units")
    goal = written(targets(units, params).withColumn("source_no", F.xxhash64(F.coalesce("source", F.lit("\0null")))), "mix-targets")
    blocks = units.groupBy("source").agg(F.ceil(F.count("*") / F.lit(params.block)).cast("long").alias("blocks"))
    goal = goal.join(blocks.withColumnRenamed("source", "s"), goal["source"].eqNullSafe(F.col("s"))).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = units.withColumnRenamed("source", "s").join(goal, F.col("s").eqNullSafe(goal["source"])).drop("s")
    whole = F.floor(ratio + 1e-12).cast("int")
    rest = ratio - whole
    table = joined.withColumns({"whole": whole, "p": F.when(rest < 1e-9, 0.0).otherwise(rest), "block": F.pmod(F.xxhash64("doc_id", "size", F.lit(params.seed)), F.col("blocks"))})
    most = goal.agg(F.max("blocks")).first()[0] or 1
    fold = max(2, params.block // (params.landing + 2))  # blocks whose undecided documents make a block
    rounds = 1 + math.ceil(math.log(most) / math.log(fold) - 1e-9)
    settled, now = None, table
    for level in range(rounds):
        now = written(_round(now, level == rounds - 1, params, level), f"mix-round{level}")
        done = now.where("p = 0 or p = 1").select("doc_id", "source_no", "size", "n", (F.col("whole") + F.col("p").cast("int")).alias("copies"))
        settled = done if settled is None else settled.unionByName(done)
        fewer = F.ceil(F.col("blocks") / F.lit(fold)).cast("long") if level < rounds - 2 else F.lit(1).cast("long")
        now = now.where("p > 0 and p < 1").withColumn("blocks", fewer).withColumn("block", F.pmod(F.col("block"), F.col("blocks")))
    return settled.join(goal.drop("blocks"), "source_no").select("doc_id", "source", "size", "n", "source_size", "target", "copies")


def mix(docs: DataFrame, params: MixParams = MixParams(), text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs as the mix takes them: each row 0, 1 or 2 times (up to the most), same columns.

    The decisions, a few numbers per document, are joined to the texts by id, source and size.
    """
    chosen = decide(docs, params, text, source, key).where("copies > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"), "copies")
    sized = docs.withColumn("_size", word_count(F.col(text)))
    on = F.col(key).cast("long").eqNullSafe(F.col("_d")) & F.col(source).cast("string").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_n"))
    joined = sized.join(chosen, on).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return joined.select(*[joined[c] for c in docs.columns])
