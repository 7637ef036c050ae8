"""Review of evidence: states of rows, queues of pages, decisions, corrections, frozen predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transaction_review_state(txn: DataFrame, issues: DataFrame) -> DataFrame:
    """PENDING with an open issue, else CORRECTED or VERIFIED as the row or its closed issues say, else AUTO.

    issues: case_id, transaction_ids (array), status OPEN or CLOSED.
    """
    rows = issues.select("case_id", "status", F.explode("transaction_ids").alias("id")).groupBy("case_id", "id").agg(F.bool_or(F.col("status") == "OPEN").alias("_open"), F.bool_and(F.col("status") == "CLOSED").alias("_closed"))
    both = txn.join(rows, ["case_id", "id"], "left")
    state = F.when(F.coalesce("_open", F.lit(False)) | (F.col("review_status") == "PENDING"), "PENDING").when(F.col("review_status") == "CORRECTED", "CORRECTED").when((F.col("review_status") == "VERIFIED") | F.coalesce("_closed", F.lit(False)), "VERIFIED").otherwise("AUTO")
    return both.select("case_id", "id", state.alias("state"))


def row_issues(txn: DataFrame, breaks: DataFrame, low: float = 0.75) -> DataFrame:
    """(case_id, id, issue): doubts about rows from their fields, their confidence and the balances around them."""
    pick = lambda cond, name: txn.where(cond).select("case_id", "id", F.lit(name).alias("issue"))
    parts = [
        pick("transaction_date is null", "INVALID_DATE"), pick("direction = 'UNKNOWN'", "INVALID_DIRECTION"), pick("amount_cents <= 0", "INVALID_AMOUNT"),
        pick(F.col("extraction_confidence") < low, "LOW_CONFIDENCE"), breaks.where("not long_interval").select("case_id", "id", F.lit("BALANCE_BREAK").alias("issue")),
    ]
    return reduce(DataFrame.unionByName, parts)


def page_review_queue(txn: DataFrame, issues: DataFrame) -> DataFrame:
    """Pages with the distinct reasons to look at them and the number of rows concerned."""
    rows = txn.select("case_id", "id", "source_document_id", "page").join(issues, ["case_id", "id"])
    return rows.groupBy("case_id", "source_document_id", "page").agg(F.array_join(F.array_sort(F.collect_set("issue")), ",").alias("reasons"), F.countDistinct("id").alias("n_rows"))


def reapply_status(issues: DataFrame, saved: DataFrame) -> DataFrame:
    """issues with the status that was saved for the same case, row and issue; OPEN without one."""
    return issues.join(saved.select("case_id", "id", "issue", "status"), ["case_id", "id", "issue"], "left").withColumn("status", F.coalesce("status", F.lit("OPEN")))


def review_decisions(evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """Long table of field values (case_id, id, field, original, current) after decisions USE_ORIGINAL, ACCEPT_CURRENT or UNRESOLVED."""
    both = evidence.join(decisions.select("case_id", "id", "field", "decision"), ["case_id", "id", "field"], "left")
    value = F.when(F.col("decision") == "USE_ORIGINAL", F.col("original")).otherwise(F.col("current"))
    return both.select("case_id", "id", "field", "original", value.alias("current"), "decision", F.coalesce(F.col("decision") == "UNRESOLVED", F.lit(False)).alias("pending"))


def record_corrections(txn: DataFrame, corrections: DataFrame) -> DataFrame:
    """txn with corrections (case_id, id, amount_cents, reason): the first original is kept, reasons pile up once each."""
    new = corrections.select("case_id", "id", F.col("amount_cents").alias("_new"), F.col("reason").alias("_reason"))
    both = txn.join(new, ["case_id", "id"], "left")
    first = F.coalesce("original_amount_cents", F.when(F.col("_new") != F.col("amount_cents"), F.col("amount_cents")))
    reasons = F.array_distinct(F.filter(F.split(F.concat_ws("；", "correction_reason", "_reason"), "；"), lambda x: x != ""))
    return both.withColumns({"original_amount_cents": first, "correction_reason": F.array_join(reasons, "；"), "amount_cents": F.coalesce("_new", "amount_cents")}).drop("_new", "_reason")


def split_by_policy(txn: DataFrame, protected: str = "EVIDENCE_ONLY_V1") -> tuple[DataFrame, DataFrame]:
    """Rows that no repair may touch, and the others."""
    kept = F.coalesce(F.col("recognition_policy") == protected, F.lit(False))
    return txn.where(kept), txn.where(~kept)


def freeze_check(frozen: DataFrame, exported: DataFrame, fields: list[str]) -> DataFrame:
    """Rows, counted as multisets, that only one of the two tables has: none if the predictions weren't edited."""
    a, b = frozen.select(*fields), exported.select(*fields)
    return a.exceptAll(b).withColumn("side", F.lit("frozen")).unionByName(b.exceptAll(a).withColumn("side", F.lit("exported")))


def delivery_status(issues: DataFrame, documents: DataFrame) -> DataFrame:
    """Per document: INCOMPLETE with a blocking page, NEEDS_REVIEW with an open required issue, else READY."""
    open_rows = issues.where("status = 'OPEN'").groupBy("case_id", "source_document_id").agg(F.count("*").alias("pending"))
    both = documents.join(open_rows, ["case_id", "source_document_id"], "left").withColumn("pending", F.coalesce("pending", F.lit(0)))
    return both.select("case_id", "source_document_id", "pending", F.when(F.col("blocking_pages") > 0, "INCOMPLETE").when(F.col("pending") > 0, "NEEDS_REVIEW").otherwise("READY").alias("status"))


def review_groups(txn: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues of a page over all its accounts, as one group with a label: REVIEWED once none is open."""
    rows = issues.join(txn.select("case_id", "id", "source_document_id", "page", "account_number"), ["case_id", "id"])
    return rows.groupBy("case_id", "source_document_id", "page").agg(F.count("*").alias("n_issues"), F.countDistinct("account_number").alias("n_accounts"), F.when(F.bool_and(F.col("status") != "OPEN"), "REVIEWED").otherwise("OPEN").alias("label"))
