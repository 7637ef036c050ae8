"""Transfers between a party's own accounts, and fast pay-outs: matching of rows by joins, greedy picks on edges only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identity import norm_part


def greedy_pairs(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One partner each: left rows in the order of left_seq take the free right row with the best rank.

    edges: keys, left_id, left_seq, right_id, rank (smaller is better, total per left row). An edge whose two rows
    have no other edge is taken as it is; only the others go, by their keys, to a grouped Python step.
    """
    fields = [*keys, "left_id", "left_seq", "right_id", "rank"]
    ends = edges.select(*fields).select("*", F.explode(F.array("left_id", "right_id")).alias("_end"))
    degree = ends.withColumn("_d", F.count("*").over(Window.partitionBy(*keys, "_end"))).groupBy(*fields).agg(F.max("_d").alias("_d"))
    sure = degree.where("_d = 1").select(*keys, "left_id", "right_id")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for row in group.sort_values(["left_seq", "left_id", "rank"]).itertuples(index=False):
            if row.left_id not in used and row.right_id not in used:
                used |= {row.left_id, row.right_id}
                out.append(row)
        return pd.DataFrame(out, columns=group.columns)[[*keys, "left_id", "right_id"]]

    rest = degree.where("_d > 1").select(*fields).groupBy(*keys).applyInPandas(pick, sure.schema)
    return sure.unionByName(rest)


def owned_accounts(accounts: DataFrame) -> DataFrame:
    """(case_id, _account) of the party's own accounts."""
    return accounts.where("owner_type = 'DEBTOR_MAIN'").select("case_id", norm_part("account_number").alias("_account")).where("_account <> ''").distinct()


def _owned_rows(txn: DataFrame, accounts: DataFrame | None) -> DataFrame:
    """Rows of the party's own accounts; all of txn, if accounts are not given."""
    rows = txn.where(F.col("direction").isin("IN", "OUT")).withColumns({"_acct": norm_part("account_number"), "_party": norm_part("counterparty_account")})
    return rows if accounts is None else rows.join(owned_accounts(accounts).withColumnRenamed("_account", "_acct"), ["case_id", "_acct"], "left_semi")


def internal_transfer_edges(txn: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """(case_id, amount_cents, left_id, left_seq, right_id, right_seq, days, reciprocal): rows that could be two sides of one transfer.

    The counterparty account of one row is the other row's account, so that is the join key, with case and amount;
    neither row may name a third account. Left is the earlier row. Without accounts, all rows are of own accounts.
    """
    rows = _owned_rows(txn, accounts).select("case_id", "amount_cents", "id", "seq", "direction", "transaction_date", "_acct", "_party")
    x, y = rows.where("_party <> ''").alias("x"), rows.alias("y")
    match = (F.col("x.case_id") == F.col("y.case_id")) & (F.col("x.amount_cents") == F.col("y.amount_cents")) & (F.col("x._party") == F.col("y._acct"))
    near = F.abs(F.datediff("x.transaction_date", "y.transaction_date")) <= 2
    fits = (F.col("x.direction") != F.col("y.direction")) & near & ((F.col("y._party") == "") | (F.col("y._party") == F.col("x._acct")))
    first = F.col("x.seq") < F.col("y.seq")
    side = lambda c, left: F.when(first == F.lit(left), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
    found = x.join(y, match & (F.col("x._acct") != F.col("y._acct"))).where(fits)
    return found.select(
        "x.case_id", "x.amount_cents", side("id", True).alias("left_id"), side("seq", True).alias("left_seq"), side("id", False).alias("right_id"), side("seq", False).alias("right_seq"),
        F.abs(F.datediff("x.transaction_date", "y.transaction_date")).alias("days"), (F.col("y._party") == F.col("x._acct")).alias("reciprocal"),
    ).distinct()


def internal_pairs(txn: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """(case_id, amount_cents, left_id, right_id): each row in at most one pair; reciprocal first, then fewer days, then order."""
    edges = internal_transfer_edges(txn, accounts)
    rank = F.struct((-(F.when(F.col("reciprocal"), 100).otherwise(80) - F.col("days"))).alias("s"), "right_seq")
    order = Window.partitionBy("case_id", "left_id").orderBy(rank)
    return greedy_pairs(edges.withColumn("rank", F.row_number().over(order)), ["case_id", "amount_cents"])


def net_internal(txn: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """txn with is_internal and internal_pair_id."""
    pairs = internal_pairs(txn, accounts)
    both = pairs.select("case_id", F.col("left_id").alias("id"), F.col("right_id").alias("internal_pair_id")).unionByName(pairs.select("case_id", F.col("right_id").alias("id"), F.col("left_id").alias("internal_pair_id")))
    return txn.join(both, ["case_id", "id"], "left").withColumn("is_internal", F.col("internal_pair_id").isNotNull())


def internal_candidates(txn: DataFrame, accounts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Same-day opposite rows of equal amount whose counterparty only bears an owner's name: for review, never netted."""
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)[\s·•]", ""))
    names = accounts.where("owner_type = 'DEBTOR_MAIN'").select("case_id", plain("account_name").alias("_name")).where("_name <> ''").distinct()
    rows = _owned_rows(txn, accounts).where("_party = ''").withColumn("_name", plain("counterparty_name")).join(names.withColumn("_own", F.lit(True)), ["case_id", "_name"], "left")
    rows = rows.select("case_id", "amount_cents", "transaction_date", "id", "seq", "direction", "_acct", F.coalesce("_own", F.lit(False)).alias("_own"))
    left = txn.select("case_id", F.col("id").alias("left_id"), F.col("seq").alias("turn"))
    turns = pairs.join(left, ["case_id", "left_id"])
    paired = turns.select("case_id", F.explode(F.array("left_id", "right_id")).alias("id"), "turn")
    rows = rows.join(paired, ["case_id", "id"], "left")
    a, b = rows.where("turn is null").alias("a"), rows.alias("b")
    key = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("case_id", "amount_cents", "transaction_date")]
    more = (F.col("a.seq") < F.col("b.seq")) & (F.col("a.direction") != F.col("b.direction")) & (F.col("a._acct") != F.col("b._acct")) & (F.col("a._own") | F.col("b._own")) & (F.col("b.turn").isNull() | (F.col("b.turn") > F.col("a.seq")))
    return a.join(b, key).where(more).select("a.case_id", F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), "a.amount_cents")


def fast_in_out_edges(txn: DataFrame, least_cents: int = 3_000_000, percent: int = 15, days: int = 2) -> DataFrame:
    """Receipts and the later pay-outs of one account that could use them: within days, amounts within percent.

    The date range is turned into equality of spans of days + 1 days: a receipt is repeated for the one or two spans in
    which a pay-out may follow. Pay-outs too small for the least receipt are left out before.
    """
    span = lambda date: F.floor(F.datediff(date, F.lit("1970-01-01").cast("date")) / (days + 1))
    rows = txn.where("not coalesce(is_internal, false)")
    received = rows.where((F.col("direction") == "IN") & (F.col("amount_cents") >= least_cents)).select("case_id", "account_number", F.col("id").alias("left_id"), F.col("seq").alias("left_seq"), F.col("amount_cents").alias("in_cents"), F.col("transaction_date").alias("_from"), F.explode(F.sequence(span(F.col("transaction_date")), span(F.date_add("transaction_date", days)))).alias("_span"))
    paid = rows.where((F.col("direction") == "OUT") & (100 * F.col("amount_cents") >= (100 - percent) * least_cents)).select("case_id", "account_number", F.col("id").alias("right_id"), F.col("seq").alias("right_seq"), F.col("amount_cents").alias("out_cents"), F.col("transaction_date").alias("_at"), span(F.col("transaction_date")).alias("_span"))
    found = received.join(paid, ["case_id", "account_number", "_span"]).where(F.datediff("_at", "_from").between(0, days))
    return found.where((F.col("right_seq") > F.col("left_seq")) & (100 * F.abs(F.col("out_cents") - F.col("in_cents")) <= percent * F.col("in_cents"))).select("case_id", "account_number", "left_id", "left_seq", "right_id", "right_seq", "in_cents", "out_cents")


def fast_in_out(txn: DataFrame) -> DataFrame:
    """(case_id, account_number, left_id, right_id): each receipt with the first pay-out that no earlier receipt took."""
    edges = fast_in_out_edges(txn)
    return greedy_pairs(edges.withColumn("rank", F.col("right_seq")), ["case_id", "account_number"])
