"""Written stage outputs: tables that several readers need are Parquet in the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

#: Written tables repeat much and shrink to a hundredth of their rows' size. Spark takes the bytes of their files for that
#: size and broadcasts tables of millions of rows; with this factor only tiny ones are broadcast unseen, others by what
#: their shuffle turns out to hold.
EXPANSION = 100.0
#: Generated methods of more bytes are never compiled by the JVM but interpreted, at several times the cost of a row: a plan
#: with one runs in smaller methods instead.
METHOD_BYTES = 8000


def stage_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: later plans start from it, and nothing of it is computed twice or lost with an executor."""
    conf = df.sparkSession.conf
    if float(conf.get("spark.sql.sources.fileCompressionFactor")) < EXPANSION:
        conf.set("spark.sql.sources.fileCompressionFactor", str(EXPANSION))
    if int(conf.get("spark.sql.codegen.hugeMethodLimit")) > METHOD_BYTES:
        conf.set("spark.sql.codegen.hugeMethodLimit", str(METHOD_BYTES))
    path = f"{stage_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
