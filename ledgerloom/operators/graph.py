"""The evidence graph as tables: entities of each kind and one table of relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import account_key, is_judicial_deduction, is_reliable_account, norm_part, text
from .aggregates import EXTERNAL, with_counterparty
from .flow import classify_flow


def _account(txn: DataFrame):
    return F.when(is_reliable_account("account_number"), norm_part("account_number")).otherwise(account_key("account_number", "bank_name", "source_document_id", "source_document_id"))


def account_entities(txn: DataFrame) -> DataFrame:
    """One row per account of a case over all its documents; name and bank are the first that aren't empty."""
    first = lambda c: F.min_by(F.when(text(c) != "", F.col(c)), F.when(text(c) != "", F.col("seq")))
    return txn.groupBy("case_id", _account(txn).alias("account_number")).agg(first("account_name").alias("account_name"), F.array_join(F.array_sort(F.collect_set("source_document_id")), ",").alias("documents"), F.count("*").alias("n_rows"))


def counterparty_entities(txn: DataFrame) -> DataFrame:
    """One row per counterparty of external rows, with its names and the numbers of rows each way."""
    return with_counterparty(txn.where(EXTERNAL)).groupBy("case_id", "party_key").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("direction") == "IN").alias("n_in"), F.count_if(F.col("direction") == "OUT").alias("n_out"), F.array_join(F.array_sort(F.collect_set("party_name")), ",").alias("aliases"),
    )


def relationships(txn: DataFrame) -> DataFrame:
    """Edges of six types between accounts, transactions, counterparties, categories and judicial deductions.

    A row gives all its edges at once, so it is read and classified once; only pairs of transfers need a join.
    """
    rows = classify_flow(with_counterparty(txn))
    account, party, judicial = F.concat(F.lit("account|"), _account(txn)), F.concat(F.lit("party|"), "party_key"), F.concat(F.lit("judicial|"), "id")
    rows = rows.withColumns({"_from": account, "_party": party, "_judicial": judicial, "_taken": is_judicial_deduction(), "_external": F.expr(EXTERNAL)})
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("type"), F.col(a).alias("from_id"), F.col(b).alias("to_id"))
    each = F.array(
        edge("ACCOUNT_HAS_TRANSACTION", "_from", "event_id"),
        F.when(F.col("_external"), edge("TRANSACTION_WITH_COUNTERPARTY", "event_id", "_party")),
        F.when(F.col("flow_code").isNotNull(), F.struct(F.lit("TRANSACTION_CLASSIFIED_AS").alias("type"), F.col("event_id").alias("from_id"), F.concat(F.lit("flow|"), "flow_code").alias("to_id"))),
        F.when(F.col("_taken"), edge("JUDICIAL_DEDUCTION_FROM_ACCOUNT", "_from", "_judicial")),
        F.when(F.col("_taken") & F.col("_external"), edge("JUDICIAL_DEDUCTION_TO_AUTHORITY", "_judicial", "_party")),
    )
    edges = rows.select("case_id", F.explode(each).alias("e"), "amount_cents").where("e is not null").select("case_id", "e.*", "amount_cents")
    other = txn.where("internal_pair_id is not null").select("case_id", F.col("id").alias("internal_pair_id"), F.col("event_id").alias("_other"))
    paired = txn.where("id < internal_pair_id").join(other, ["case_id", "internal_pair_id"])
    return edges.unionByName(paired.select("case_id", F.lit("INTERNAL_TRANSFER_PAIR").alias("type"), F.col("event_id").alias("from_id"), F.col("_other").alias("to_id"), "amount_cents"))


def duplicate_groups(events: DataFrame) -> DataFrame:
    """Events with more than one observation, and their rows."""
    return events.where("n_observations > 1").groupBy("case_id", "event_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("observation_ids"))


def drill_down(txn: DataFrame, flow_code: str) -> DataFrame:
    """The rows of a category, newest first."""
    return classify_flow(txn).where(F.col("flow_code") == flow_code).orderBy("case_id", F.desc("transaction_date"), "id")


SEARCHED = ("account_name", "counterparty_name", "counterparty_account", "summary", "account_number", "bank_name")


def search(txn: DataFrame, words: str, fields: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Rows that hold the words in one of the fields, in any case."""
    return txn.where(F.lower(F.concat_ws(" ", *fields)).contains(words.strip().lower()))
