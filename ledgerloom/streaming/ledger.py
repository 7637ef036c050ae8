"""Streaming forms of batch operators: ingestion without repeats, fast pay-outs, daily flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def from_events(events: DataFrame) -> DataFrame:
    """Rows of a ledger from the events table: the user is the account, the type tells the direction."""
    way = F.when(F.col("event_type").isin("purchase", "signup"), "IN").when(F.col("event_type").isin("click", "view"), "OUT").otherwise("UNKNOWN")
    return events.select("event_id", "ts", F.col("user_id").alias("account"), way.alias("direction"), F.round(F.col("value") * 100).cast("long").alias("amount_cents"))


def read_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """Parquet files of events that arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.parquet").parquet(path)


def ingest(stream: DataFrame, ident: str = "event_id", late: str = "1 day") -> DataFrame:
    """Rows once each, however often a file brings them, within the time that a row may be late."""
    return from_events(stream).withWatermark("ts", late).dropDuplicatesWithinWatermark([ident])


def fast_in_out(stream: DataFrame, least_cents: int = 3_000, percent: int = 15, within: str = "2 days", late: str = "1 day") -> DataFrame:
    """Candidate pairs of a receipt and a later pay-out of one account: an interval join with watermarks on both sides."""
    rows = from_events(stream)
    received = rows.where((F.col("direction") == "IN") & (F.col("amount_cents") >= least_cents)).selectExpr("event_id as in_id", "ts as in_ts", "account as in_account", "amount_cents as in_cents").withWatermark("in_ts", late)
    paid = rows.where("direction = 'OUT'").selectExpr("event_id as out_id", "ts as out_ts", "account as out_account", "amount_cents as out_cents").withWatermark("out_ts", late)
    pair = F.expr(f"in_account = out_account and out_ts >= in_ts and out_ts <= in_ts + interval {within} and 100 * abs(out_cents - in_cents) <= {percent} * in_cents")
    return received.join(paid, pair)


def daily_flows(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """In- and outflow per account and day; of a stream, days come out once they are past the watermark."""
    base = rows.withWatermark("ts", late) if rows.isStreaming else rows
    amount = lambda d: F.sum(F.when(F.col("direction") == d, F.col("amount_cents")).otherwise(0))
    return base.groupBy("account", F.window("ts", "1 day").alias("w")).agg(amount("IN").alias("in_cents"), amount("OUT").alias("out_cents"), F.count("*").alias("n_rows")).select("account", F.col("w.start").cast("date").alias("day"), "in_cents", "out_cents", "n_rows")
