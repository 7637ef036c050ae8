"""What several corpus operators share: the shared work folder, written intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Java's notation for the words of the contracts: runs of anything but space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"

_own: dict[str, str] = {}
_kept: dict = {}


def once_per_worker(key: object, make: Callable):
    """What a worker process keeps from task to task, made once: one thing at a time, so that one operator's doesn't stay while another works."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Tasks that keep nothing themselves begin with it: workers serve one operator after another, and what those kept may be large."""
    _kept.clear()


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir; a temporary one where that is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def extended(df: DataFrame, ddl: str) -> StructType:
    """df's schema with more columns behind."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def crc_mod(column: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo a small number: the folds of the contracts. A null id is in fold 0."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % F.lit(modulus), F.lit(0)).cast("int")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null or blank text."""
    parts = F.split(text, SPACE, -1)
    blank_ends = (F.element_at(parts, 1) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    return F.coalesce(F.greatest(F.size(parts) - blank_ends, F.lit(0)), F.lit(0)).cast("long")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60, edges_per_task: int = 100_000) -> DataFrame:
    """(id, component) for every id in the undirected edges (a, b); component is the smallest id that links reach.

    Alternating large-star and small-star steps: each round every id hands its neighbours the smallest id it
    knows, so a path halves from round to round. A round is grouped minima and joins on ids, written to the shared
    folder; no id's neighbours are ever gathered in one place. It ends once every id has one edge, to a root.
    """

    def settled(df: DataFrame) -> bool:
        roots = df.select(F.col("b").alias("a"), F.lit(0).alias("n")).distinct()
        per = df.groupBy("a").agg(F.count("*").alias("n")).unionByName(roots).groupBy("a").agg(F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("root"), F.sum("n").alias("n"))
        return not per.where("n > 1 or (n > 0 and root > 0)").limit(1).count()

    flat = edges.where("a is not null and b is not null and a <> b")
    pairs = written(flat.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    tasks = -(-pairs.count() // edges_per_task)
    for _ in range(most_rounds):
        if not tasks or settled(pairs):
            break
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large.coalesce(tasks), name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("x"), F.least("b", "m").alias("y"))
        pairs = small.unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y"))).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        pairs = written(pairs.coalesce(tasks), name)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
