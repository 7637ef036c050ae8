"""Flow categories and time phases of statement rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.identity import is_judicial_deduction, joined, text


def flow_code(kind: str = "transaction_type", internal: str = "is_internal") -> Column:
    """Category code of a row; null for internal transfers and unknown directions. The printed type decides first, then words."""
    direction = F.col("direction")
    words = F.lower(joined("summary", "counterparty_name", "counterparty_bank", "raw_text"))
    has_party = (text("counterparty_name") != "") | (text("counterparty_account") != "")
    code = F.when(F.coalesce(F.col(internal), F.lit(False)) | ~direction.isin("IN", "OUT"), F.lit(None).cast("string"))
    code = reduce(lambda c, x: c.when((text(kind) == x[0]) & (direction == x[1]), x[2]), P.FLOW_TYPES, code)
    code = code.when(is_judicial_deduction(kind=kind), "JUDICIAL_DEDUCTION")
    code = reduce(lambda c, x: c.when((direction == x[0]) & words.rlike(x[1]), x[2]), P.FLOW_WORDS, code)
    code = code.when((direction == "IN") & (words.rlike(P.TRANSFER_IN_WORDS) | has_party), "TRANSFER_IN")
    code = code.when((direction == "OUT") & (words.rlike(P.TRANSFER_OUT_WORDS) | has_party), "TRANSFER_OUT")
    return code.when(direction == "IN", "OTHER_IN").otherwise("OTHER_OUT")


def classify_flow(txn: DataFrame) -> DataFrame:
    """txn with flow_code."""
    return txn.withColumn("flow_code", flow_code())


def flow_category_totals(txn: DataFrame) -> DataFrame:
    """Total and rows per case and category, with label, direction and priority."""
    spark = txn.sparkSession
    names = spark.createDataFrame(list(P.FLOW_CODES), "flow_code string, label string, direction string, priority int")
    totals = classify_flow(txn).where("flow_code is not null").groupBy("case_id", "flow_code").agg(F.sum("amount_cents").alias("total_cents"), F.count("*").alias("n_rows"))
    return totals.join(F.broadcast(names), "flow_code").select("case_id", "flow_code", "label", "direction", "priority", "total_cents", "n_rows")


def phase_tag(date: Column) -> Column:
    """The latest milestone reached; before the first, which side of the debt. Milestones t0 to t6 are columns of the row."""
    nodes = [F.when(F.col(c) <= date, F.struct(F.col(c).alias("at"), F.lit(-i).alias("rank"), F.lit(tag).alias("tag"))) for i, (c, tag) in enumerate(P.PHASES)]
    reached = F.greatest(*nodes)["tag"]
    return F.coalesce(reached, F.when(date < F.col("t0"), P.PHASE_BEFORE_DEBT).when(date >= F.col("t0"), P.PHASE_BEFORE_SUIT).otherwise(P.PHASE_DEFAULT))


def tag_phases(txn: DataFrame, cases: DataFrame) -> DataFrame:
    """txn with phase_tag, by the milestones of its case."""
    dates = [f"t{i}" for i in range(7)]
    joined_rows = txn.join(cases.select("case_id", *dates), "case_id", "left")
    return joined_rows.withColumn("phase_tag", phase_tag(F.col("transaction_date"))).drop(*dates)
