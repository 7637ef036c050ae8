"""Queries on readings and their review, derived from the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recognition, review, sequence
from ..plans import demo_ledger
from ..plans.demo_ledger import ORACLE
from ..plans.storage import written
from .registry import query
from .sequences import ORIENT, SIGNED, KEY


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ledger, written: operators that join it with itself start from a table."""
    return written(demo_ledger.ledger(spark, sf_dir), "ledger")


@query("d2_dedup_locator", f"""{ORACLE} SELECT case_id, source_document_id, page, account_number, id FROM ledger QUALIFY row_number() OVER (PARTITION BY case_id, source_document_id, page, account_number ORDER BY row_index % 10 DESC, seq) = 1""")
def _locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).withColumn("confidence", F.col("row_index") % 10)
    return recognition.dedup_locator(rows, ["case_id", "source_document_id", "page", "account_number"]).select("case_id", "source_document_id", "page", "account_number", "id")


@query("d1_dedup_in_document", f"""{ORACLE} SELECT case_id, id || '_R' AS id, id AS duplicate_of_id FROM ledger WHERE row_index % 23 = 0""")
def _in_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    again = rows.where("row_index % 23 = 0").withColumns({"id": F.concat("id", F.lit("_R")), "page": F.col("page") + 50, "account_number": F.when(F.col("row_index") % 2 == 0, F.col("account_number"))})
    return recognition.dedup_in_document(rows.unionByName(again))


def _readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = ledger(spark, sf_dir).select("case_id", F.col("source_document_id").alias("document_id"), "page", F.col("seq").cast("int").alias("row"), F.col("account_number").alias("account"), F.col("transaction_date").cast("string").alias("date"), "direction", F.col("amount_cents").cast("string").alias("amount"), F.col("balance_cents").cast("string").alias("balance"), F.col("counterparty_account").alias("party_account"))
    other = rows.where("row % 37 <> 0").withColumn("balance", F.when(F.col("row") % 29 == 0, F.concat("balance", F.lit("1"))).otherwise(F.col("balance")))
    return rows, other


@query("d7_align_readings", f"{ORACLE} SELECT case_id, source_document_id AS document_id, page, seq::INT AS left_row, seq::INT AS right_row FROM ledger WHERE seq % 37 <> 0")
def _align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.align_readings(*_readings(spark, sf_dir))


@query("d8_compare_readings", f"""{ORACLE} SELECT case_id, source_document_id AS document_id, page, 'VALUE_CONFLICT' AS issue, seq::INT AS left_row, seq::INT AS right_row, 'balance' AS field FROM ledger WHERE seq % 37 <> 0 AND seq % 29 = 0 AND balance_cents IS NOT NULL
UNION ALL SELECT case_id, source_document_id, page, 'UNMATCHED_ROW', seq::INT, NULL, NULL FROM ledger WHERE seq % 37 = 0""")
def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _readings(spark, sf_dir)
    return recognition.compare_readings(left, right, written(recognition.align_readings(left, right), "pairs"))


IMPLIED = f"""{ORACLE}, r AS (SELECT *, balance_cents - {SIGNED} AS implied FROM ledger WHERE balance_cents IS NOT NULL)"""


@query("d22_predecessor_check", f"""{IMPLIED}, f AS (SELECT case_id, account_number, min(transaction_date) AS first FROM r GROUP BY 1, 2)
SELECT r.case_id, r.id, implied AS implied_cents FROM r JOIN f USING (case_id, account_number) WHERE transaction_date > first AND implied IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM r p WHERE p.case_id = r.case_id AND p.account_number = r.account_number AND p.balance_cents = r.implied AND p.transaction_date <= r.transaction_date)""")
def _predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.predecessor_check(ledger(spark, sf_dir))


@query("d21_merge_overlapping_views", f"""{IMPLIED}, m AS (SELECT *, EXISTS (SELECT 1 FROM r p WHERE p.case_id = r.case_id AND p.account_number = r.account_number AND p.balance_cents = r.implied AND p.transaction_date <= r.transaction_date) AS ok FROM r)
SELECT case_id, account_number, transaction_date, direction, balance_cents, first(amount_cents ORDER BY ok DESC, seq) AS amount_cents, first(summary ORDER BY length(summary) DESC, seq) AS summary, count(*) AS n_views FROM m GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5"))
def _overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.merge_overlapping_views(ledger(spark, sf_dir))


@query("d23_row_contract_checks", f"""{ORACLE}, c AS (SELECT case_id, source_document_id AS document_id, page, count(*) AS got, count(*) + CASE WHEN page % 13 = 0 THEN 1 ELSE 0 END AS declared FROM ledger GROUP BY case_id, source_document_id, page)
SELECT case_id, source_document_id AS document_id, page, row_index AS row, 'DUPLICATE_LOCATION' AS code FROM (SELECT case_id, source_document_id, page, row_index FROM ledger GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT case_id, source_document_id, page, row_index, 'DIRECTION' FROM ledger WHERE direction = 'UNKNOWN' UNION ALL SELECT case_id, source_document_id, page, row_index, 'AMOUNT' FROM ledger WHERE amount_cents <= 0
UNION ALL SELECT case_id, source_document_id, page, row_index, 'COUNTERPARTY' FROM ledger WHERE counterparty_name IS NULL AND counterparty_account IS NULL
UNION ALL SELECT case_id, document_id, page, NULL, 'PAGE_COUNT' FROM c WHERE got <> declared""")
def _contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    declared = rows.groupBy("case_id", "source_document_id", "page").agg((F.count("*") + F.when(F.col("page") % 13 == 0, 1).otherwise(0)).alias("declared_rows"))
    return recognition.row_contract_checks(rows, declared)


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).where("row_index % 19 = 0")
    edits = rows.select("case_id", "id", (F.col("amount_cents") + 100).alias("amount_cents"), F.lit(None).cast("long").alias("balance_cents"), F.lit(None).cast("string").alias("direction"), F.lit("改").alias("summary"))
    return edits.unionByName(edits.where("amount_cents % 2 = 0")).unionByName(edits.where("amount_cents % 5 = 0").withColumn("id", F.concat(F.lit("NO_"), "id")))


@query("d25_apply_model_edits", f"""{ORACLE} SELECT case_id, id, CASE WHEN row_index % 19 = 0 AND amount_cents % 2 = 1 THEN amount_cents + 100 ELSE amount_cents END AS amount_cents, CASE WHEN row_index % 19 = 0 AND amount_cents % 2 = 1 THEN amount_cents END AS original_amount_cents,
CASE WHEN row_index % 19 = 0 AND amount_cents % 2 = 1 THEN '改' ELSE summary END AS summary FROM ledger""")
def _apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.apply_edits(ledger(spark, sf_dir), _edits(spark, sf_dir)).select("case_id", "id", "amount_cents", "original_amount_cents", "summary")


@query("d25_edit_counts", f"""{ORACLE}, e AS (SELECT * FROM ledger WHERE row_index % 19 = 0)
SELECT case_id, count(*) FILTER (amount_cents % 2 = 1) AS applied, count(*) FILTER (amount_cents % 2 = 0) AS ambiguous, count(*) FILTER (amount_cents % 5 = 0) AS unknown FROM e GROUP BY 1""")
def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.edit_counts(ledger(spark, sf_dir), _edits(spark, sf_dir))


ISSUES = f"""{ORIENT}, brk AS (SELECT case_id, id FROM (SELECT *, lag(balance_cents) OVER w + {SIGNED} AS e, abs(transaction_date - lag(transaction_date) OVER w) AS d FROM physical WINDOW w AS (PARTITION BY {KEY} ORDER BY physical_rank)) WHERE e <> balance_cents AND coalesce(d, 0) <= 30),
issues AS (SELECT case_id, id, 'INVALID_DIRECTION' AS issue FROM ledger WHERE direction = 'UNKNOWN' UNION ALL SELECT case_id, id, 'INVALID_AMOUNT' FROM ledger WHERE amount_cents <= 0 UNION ALL SELECT case_id, id, 'LOW_CONFIDENCE' FROM ledger WHERE row_index % 17 = 0 UNION ALL SELECT case_id, id, 'BALANCE_BREAK' FROM brk)"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).withColumn("extraction_confidence", F.when(F.col("row_index") % 17 == 0, 0.5).otherwise(0.98))
    return review.row_issues(rows, sequence.balance_breaks(sequence.physical_rank(rows), "physical_rank"))


query("v1_review_issues", f"{ISSUES} SELECT * FROM issues")(_issues)


@query("v1c_page_review_queue", f"{ISSUES} SELECT case_id, source_document_id, page, string_agg(DISTINCT issue, ',' ORDER BY issue) AS reasons, count(DISTINCT id) AS n_rows FROM issues JOIN ledger USING (case_id, id) GROUP BY ALL")
def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.page_review_queue(ledger(spark, sf_dir), _issues(spark, sf_dir))


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _issues(spark, sf_dir)
    saved = found.where("issue = 'LOW_CONFIDENCE'").select("case_id", "id", "issue", F.lit("CLOSED").alias("status"))
    return review.reapply_status(found, saved)


STATUS = f"{ISSUES}, marked AS (SELECT *, CASE WHEN issue = 'LOW_CONFIDENCE' THEN 'CLOSED' ELSE 'OPEN' END AS status FROM issues)"


@query("v1b_txn_review_state", f"""{STATUS}, s AS (SELECT case_id, id, bool_or(status = 'OPEN') AS o, bool_and(status = 'CLOSED') AS c FROM marked GROUP BY 1, 2)
SELECT case_id, id, CASE WHEN coalesce(o, false) THEN 'PENDING' WHEN row_index % 41 = 0 THEN 'CORRECTED' WHEN coalesce(c, false) THEN 'VERIFIED' ELSE 'AUTO' END AS state FROM ledger LEFT JOIN s USING (case_id, id)""")
def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).withColumn("review_status", F.when(F.col("row_index") % 41 == 0, "CORRECTED"))
    return review.transaction_review_state(rows, _status(spark, sf_dir).select("case_id", "status", F.array("id").alias("transaction_ids")))


@query("a16_review_groups", f"{STATUS} SELECT case_id, source_document_id, page, count(*) AS n_issues, count(DISTINCT account_number) AS n_accounts, CASE WHEN bool_and(status <> 'OPEN') THEN 'REVIEWED' ELSE 'OPEN' END AS label FROM marked JOIN ledger USING (case_id, id) GROUP BY 1, 2, 3")
def _review_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_groups(ledger(spark, sf_dir), _status(spark, sf_dir))


@query("a14_delivery_status", f"""{STATUS}, o AS (SELECT case_id, source_document_id, count(*) AS pending FROM marked JOIN ledger USING (case_id, id) WHERE status = 'OPEN' GROUP BY 1, 2), d AS (SELECT case_id, source_document_id, count(*) FILTER (row_index % 997 = 0) AS b FROM ledger GROUP BY 1, 2)
SELECT case_id, source_document_id, coalesce(pending, 0) AS pending, CASE WHEN b > 0 THEN 'INCOMPLETE' WHEN coalesce(pending, 0) > 0 THEN 'NEEDS_REVIEW' ELSE 'READY' END AS status FROM d LEFT JOIN o USING (case_id, source_document_id)""")
def _delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    documents = rows.groupBy("case_id", "source_document_id").agg(F.count_if(F.col("row_index") % 997 == 0).alias("blocking_pages"))
    return review.delivery_status(_status(spark, sf_dir).join(rows.select("case_id", "id", "source_document_id"), ["case_id", "id"]), documents)


@query("v2_row_review_decision", f"""{ORACLE} SELECT case_id, id, 'amount' AS field, amount_cents::VARCHAR AS original, CASE WHEN row_index % 3 = 0 THEN amount_cents ELSE amount_cents + 1 END::VARCHAR AS current, CASE row_index % 3 WHEN 0 THEN 'USE_ORIGINAL' WHEN 1 THEN 'UNRESOLVED' END AS decision, row_index % 3 = 1 AS pending FROM ledger""")
def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    evidence = rows.select("case_id", "id", F.lit("amount").alias("field"), F.col("amount_cents").cast("string").alias("original"), (F.col("amount_cents") + 1).cast("string").alias("current"))
    decided = rows.where("row_index % 3 < 2").select("case_id", "id", F.lit("amount").alias("field"), F.when(F.col("row_index") % 3 == 0, "USE_ORIGINAL").otherwise("UNRESOLVED").alias("decision"))
    return review.review_decisions(evidence, decided)


@query("v3_correction_audit", f"""{ORACLE} SELECT case_id, id, CASE WHEN row_index % 10 = 0 THEN amount_cents + 5 ELSE amount_cents END AS amount_cents, CASE WHEN row_index % 20 = 0 THEN 7 WHEN row_index % 10 = 0 THEN amount_cents END AS original_amount_cents,
CASE WHEN row_index % 20 = 0 THEN '旧；新' WHEN row_index % 10 = 0 THEN '新' ELSE '' END AS correction_reason FROM ledger""")
def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).withColumns({"original_amount_cents": F.when(F.col("row_index") % 20 == 0, F.lit(7).cast("long")), "correction_reason": F.when(F.col("row_index") % 20 == 0, "旧")})
    fixes = rows.where("row_index % 10 = 0").select("case_id", "id", (F.col("amount_cents") + 5).alias("amount_cents"), F.lit("新").alias("reason"))
    return review.record_corrections(rows, fixes).select("case_id", "id", "amount_cents", "original_amount_cents", "correction_reason")


@query("v5_freeze_check", f"""{ORACLE} SELECT id, amount_cents, 'frozen' AS side FROM ledger WHERE row_index % 500 = 0 UNION ALL SELECT id, amount_cents + 1, 'exported' FROM ledger WHERE row_index % 500 = 0""")
def _frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    edited = rows.withColumn("amount_cents", F.when(F.col("row_index") % 500 == 0, F.col("amount_cents") + 1).otherwise(F.col("amount_cents")))
    return review.freeze_check(rows, edited, ["id", "amount_cents"])
