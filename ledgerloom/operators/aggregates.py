"""Aggregations of a case: counterparties, accounts, key figures, audits, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.identity import counterparty_key, effective_counterparty, text

EXTERNAL = "not coalesce(is_internal, false)"


def _cents(direction: str) -> Column:
    return F.sum(F.when(F.col("direction") == direction, F.col("amount_cents")).otherwise(0))


def with_counterparty(txn: DataFrame) -> DataFrame:
    """txn with party_name (or its placeholder) and party_key."""
    return txn.withColumn("party_name", effective_counterparty()).withColumn("party_key", counterparty_key(F.col("party_name")))


def counterparty_summary(txn: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per case and counterparty, internal transfers left out.

    Name, account and the suspicion of kinship are those of the first row; summaries are the first five distinct
    ones in order; the role tag is the first there is.
    """
    if "counterparty_role_tag" not in txn.columns:
        txn = txn.withColumn("counterparty_role_tag", F.lit(None).cast("string"))
    rows = with_counterparty(txn.where(EXTERNAL)).join(cases.select("case_id", F.trim(text("respondent_name")).alias("_debtor")), "case_id", "left")
    surname = F.left("_debtor", F.lit(1))
    kin = ((text("_debtor") != "") & F.startswith("party_name", surname) & (F.length("party_name") <= 4) & (F.col("party_name") != F.col("_debtor"))) | text("summary").rlike(P.RELATIVE_SUMMARY)
    rows = rows.withColumn("_kin", F.coalesce(kin, F.lit(False)))
    # numbers and dates alone are aggregated here, which needs no sort
    parts = rows.groupBy("case_id", "party_key", "party_name", "summary", "counterparty_account", "counterparty_role_tag", "_kin").agg(
        F.min("seq").alias("seq"), _cents("IN").alias("in_cents"), _cents("OUT").alias("out_cents"), F.count("*").alias("n_rows"), F.min("transaction_date").alias("earliest_date"), F.max("transaction_date").alias("latest_date"),
    )
    parts = parts.repartition("case_id", "party_key")  # both what follows and distinct names are found where a party's parts are
    party = Window.partitionBy("case_id", "party_key")
    has = text("summary") != ""
    at = F.min("seq").over(Window.partitionBy("case_id", "party_key", "summary"))
    parts = parts.withColumn("_at", at).withColumn("_rank", F.dense_rank().over(party.orderBy(~has, "_at", "summary")))
    by_name = F.row_number().over(Window.partitionBy("case_id", "party_key", "party_name").orderBy("_at"))
    role = F.when(text("counterparty_role_tag") != "", F.struct("seq", "counterparty_role_tag"))
    totals = parts.withColumn("_new", (by_name == 1).cast("long")).groupBy("case_id", "party_key").agg(
        F.min(F.struct("seq", "party_name", "counterparty_account", "_kin")).alias("_first"),
        F.sum("in_cents").alias("in_cents"), F.sum("out_cents").alias("out_cents"), F.sum("n_rows").alias("n_rows"), F.sum("_new").alias("n_aliases"),
        F.min("earliest_date").alias("earliest_date"), F.max("latest_date").alias("latest_date"), F.min(role)["counterparty_role_tag"].alias("role_tag"),
        F.collect_set(F.when(has & (F.col("_rank") <= 5), F.struct("_rank", "summary"))).alias("_said"),
    )
    summaries = F.when(F.size("_said") > 0, F.transform(F.array_sort("_said"), lambda x: x["summary"]))
    return totals.select(
        "case_id", "party_key", F.col("_first.party_name").alias("name"), F.col("_first.counterparty_account").alias("account"), "in_cents", "out_cents", "n_rows", "n_aliases", "earliest_date", "latest_date",
        "role_tag", F.col("_first._kin").alias("suspected_relative"), (F.col("out_cents") - F.col("in_cents")).alias("net_out_cents"), summaries.alias("frequent_summaries"),
    )


def counterparty_lookup(txn: DataFrame, summary: DataFrame, fields: list[str]) -> DataFrame:
    """txn with fields of its counterparty's summary: by key, else by name."""
    name = F.trim(text("counterparty_name"))
    keyed = txn.withColumn("_key", counterparty_key(name)).withColumn("_name", name)
    by_key = summary.select("case_id", F.col("party_key").alias("_key"), F.lit(True).alias("_hit"), *[F.col(f).alias(f"_k_{f}") for f in fields])
    by_name = summary.select("case_id", F.col("party_key").alias("_name"), *[F.col(f).alias(f"_n_{f}") for f in fields])
    found = keyed.join(by_key, ["case_id", "_key"], "left").join(by_name, ["case_id", "_name"], "left")
    return found.select(*txn.columns, *[F.when(F.col("_hit"), F.col(f"_k_{f}")).otherwise(F.col(f"_n_{f}")).alias(f) for f in fields])


def case_kpis(txn: DataFrame, cases: DataFrame, observations: DataFrame) -> DataFrame:
    """Raw and net totals, outflow after filing and after the report order, income in execution, solvency ratio per case."""
    rows = txn.join(cases.select("case_id", "t3", "t4"), "case_id", "left")
    external, incoming, outgoing = ~F.coalesce(F.col("is_internal"), F.lit(False)), F.col("direction") == "IN", F.col("direction") == "OUT"
    after = lambda t: F.coalesce(F.col("transaction_date") >= F.col(t), F.lit(False))
    total = lambda cond: F.sum(F.when(cond, F.col("amount_cents")).otherwise(0))
    sums = rows.groupBy("case_id").agg(
        total(incoming).alias("raw_in_cents"), total(outgoing).alias("raw_out_cents"), total(~external & incoming).alias("internal_cents"), F.count_if(~external).alias("internal_rows"),
        total(outgoing & external & after("t3")).alias("post_execution_out_cents"), total(outgoing & external & after("t4")).alias("post_report_out_cents"),
        total(incoming & external & after("t3")).alias("execution_income_cents"), F.count("*").alias("canonical_rows"),
    )
    seen = observations.groupBy("case_id").agg(F.count("*").alias("observation_rows"))
    out = cases.select("case_id", "target_cents").join(sums, "case_id", "left").join(seen, "case_id", "left").na.fill(0)
    return out.withColumns({
        "net_in_cents": F.col("raw_in_cents") - F.col("internal_cents"), "net_out_cents": F.col("raw_out_cents") - F.col("internal_cents"),
        "duplicate_rows": F.col("observation_rows") - F.col("canonical_rows"),
        "solvency_ratio": F.col("execution_income_cents") / F.when(F.col("target_cents") == 0, 100).otherwise(F.col("target_cents")),
    })


def top_counterparties(summary: DataFrame, k: int = 10, by: str = "out_cents") -> DataFrame:
    """The k largest counterparties of each case."""
    order = Window.partitionBy("case_id").orderBy(F.desc(by), "party_key")
    return summary.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("case_id", "rank", "party_key", "name", "in_cents", "out_cents", "net_out_cents")


def sankey_links(totals: DataFrame) -> DataFrame:
    """Links between categories and the case's pool: inflows into it, outflows out of it."""
    pool = F.lit("POOL")
    return totals.where("total_cents > 0").select("case_id", F.when(F.col("direction") == "IN", F.col("flow_code")).otherwise(pool).alias("source"), F.when(F.col("direction") == "IN", pool).otherwise(F.col("flow_code")).alias("target"), "total_cents")


def fingerprint(txn: DataFrame, fields: list[str]) -> DataFrame:
    """Order-independent hash of each case's facts: count, sum and xor of 60 bits of the row hashes."""
    h = F.conv(F.left(F.md5(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])), F.lit(15)), 16, 10).cast("long")
    per = txn.withColumn("_h", h).groupBy("case_id").agg(F.count("*").alias("n_rows"), F.sum(F.col("_h").cast("decimal(20,0)")).cast("string").alias("hash_sum"), F.bit_xor("_h").alias("hash_xor"))
    return per.withColumn("fingerprint", F.sha2(F.concat_ws("|", "n_rows", "hash_sum", "hash_xor"), 256))


def changed_cases(now: DataFrame, before: DataFrame) -> DataFrame:
    """Cases whose fingerprint isn't that of the report before: those to compute again."""
    return now.join(before.select("case_id", "fingerprint"), ["case_id", "fingerprint"], "left_anti").select("case_id")


def ownership_groups(accounts: DataFrame) -> DataFrame:
    """Accounts by holder with the distinct owner types."""
    return accounts.groupBy("case_id", "account_name").agg(F.countDistinct("account_number").alias("n_accounts"), F.array_join(F.array_sort(F.collect_set("owner_type")), ",").alias("owner_types"))


def account_totals(txn: DataFrame) -> DataFrame:
    """Per document and account: totals, rows, dates, pages and the most frequent names (ties: the shorter, then by order)."""
    key = ["case_id", "source_document_id", "account_number"]

    def mode(c: str) -> DataFrame:
        counts = txn.where(text(c) != "").groupBy(*key, c).agg(F.count("*").alias("_n"))
        order = Window.partitionBy(*key).orderBy(F.desc("_n"), F.length(c), c)
        return counts.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*key, c)

    totals = txn.groupBy(*key).agg(
        _cents("IN").alias("in_cents"), _cents("OUT").alias("out_cents"), F.count("*").alias("n_rows"), F.min("transaction_date").alias("start_date"), F.max("transaction_date").alias("end_date"),
        F.countDistinct("page").alias("n_pages"), F.bool_or(F.col("balance_cents").isNotNull()).alias("has_balance"),
    )
    return totals.join(mode("account_name"), key, "left").join(mode("bank_name"), key, "left")


def accounts_without_rows(accounts: DataFrame, txn: DataFrame) -> DataFrame:
    return accounts.join(txn.select("case_id", "account_number"), ["case_id", "account_number"], "left_anti").select("case_id", "account_number", "account_name", "owner_type")


def transaction_accounts(txn: DataFrame, accounts: DataFrame) -> DataFrame:
    """(case_id, id, account_number) of the account that a row belongs to: same number, same document where both name one; first by document."""
    a = accounts.select("case_id", F.col("account_number").alias("_number"), F.col("source_document_id").alias("_doc"))
    found = txn.join(a, (txn["case_id"] == a["case_id"]) & (txn["account_number"] == a["_number"]) & (txn["source_document_id"].isNull() | a["_doc"].isNull() | (txn["source_document_id"] == a["_doc"]))).drop(a["case_id"])
    order = Window.partitionBy("case_id", "id").orderBy("_doc")
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("case_id", "id", F.col("_number").alias("matched_account"), F.col("_doc").alias("matched_document"))


def diagnostics(txn: DataFrame) -> DataFrame:
    """Files, accounts, rows, rows without balance, of unknown direction or without amount, per case."""
    return txn.groupBy("case_id").agg(
        F.countDistinct("source_document_id").alias("files"), F.countDistinct("account_number").alias("accounts"), F.count("*").alias("n_rows"),
        F.count_if(F.col("balance_cents").isNull()).alias("no_balance"), F.count_if(F.col("direction") == "UNKNOWN").alias("unknown_direction"), F.count_if(F.col("amount_cents") <= 0).alias("no_amount"),
    )
