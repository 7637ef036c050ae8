"""Queries on issues and the evidence that closes them: each row of the derived ledger in two views, with differences by the order's key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import pending
from ..plans import demo_ledger
from ..plans.demo_ledger import ORACLE
from ..plans.storage import written
from .registry import query

#: The same text runs in Spark and in DuckDB. View 1 has accounts in its rows, view 2 in its head; an event has both.
BASE = "base AS (SELECT source_document_id AS document_id, cast(row_number() OVER (PARTITION BY source_document_id ORDER BY seq, id) AS bigint) AS event, cast(row_index AS bigint) AS k, account_number, direction, cast(amount_cents AS string) AS amount, coalesce(counterparty_account, '') AS party FROM ledger)"
OBS = """SELECT document_id, event * 2 + v AS obs, event, k, v = 0 AS direct_owner, k % 5 = 0 AS name_bound, k % 9 = 0 AS placeholder, k % 12 = 2 AS cash, party <> '' AS party_present, k % 8 = 2 AS party_blank, v FROM base CROSS JOIN (VALUES (0), (1)) views(v)"""
VALUES = """SELECT document_id, event * 2 + v AS obs, event, 'account_number' AS field, CASE WHEN v = 1 AND k % 6 = 0 THEN '999' WHEN k % 25 = 1 THEN '' ELSE account_number END AS printed, CASE WHEN k % 10 = 3 THEN NULL WHEN v = 1 AND k % 18 = 0 THEN account_number WHEN v = 1 AND k % 6 = 0 THEN '999' ELSE account_number END AS read, account_number AS value, v FROM base CROSS JOIN (VALUES (0), (1)) views(v)
UNION ALL SELECT document_id, event * 2 + v, event, 'amount', CASE WHEN v = 1 AND k % 7 = 0 THEN concat(amount, '1') ELSE amount END, CASE WHEN k % 10 = 3 THEN NULL WHEN k % 14 = 0 OR v = 0 THEN amount ELSE concat(amount, '2') END, amount, v FROM base CROSS JOIN (VALUES (0), (1)) views(v)
UNION ALL SELECT document_id, event * 2 + v, event, 'direction', CASE WHEN direction = 'UNKNOWN' THEN '' ELSE direction END, CASE WHEN k % 11 = 0 THEN 'IN' ELSE direction END, direction, v FROM base CROSS JOIN (VALUES (0), (1)) views(v)
UNION ALL SELECT document_id, event * 2 + v, event, 'bank_name', CASE WHEN k % 3 = 0 THEN '' ELSE concat('BANK', right(document_id, 1)) END, NULL, concat('BANK', right(document_id, 1)), v FROM base CROSS JOIN (VALUES (0), (1)) views(v)"""
#: (number, code, field, which events have it, which views it names)
KINDS = ((0, "OUTSIDE_TRANSACTION_SOURCES", "account_name", "k % 4 = 0", "both"), (1, "INVALID_SOURCE_FRAGMENT", "bank_name", "k % 4 = 1", "both"), (2, "UNREADABLE_SOURCE", "counterparty_account", "k % 4 = 2", "one"), (3, "MISSING_KEY_SOURCE", "account_number", "k % 4 = 3", "one"),
         (4, "DIRECTION_REQUIRES_INDEPENDENT_READ", "direction", "k % 3 = 0", "both"), (5, "COUNTERPARTY_IDENTITY_MISSING", "counterparty_name", "k % 2 = 0", "both"), (6, "INDEPENDENT_VALUE_CONFLICT", "amount", "k % 7 < 3", "other"), (7, "INDEPENDENT_VALUE_CONFLICT", "account_number", "k % 3 < 2", "other"),
         (8, "DUPLICATE_VIEW_CONFLICT", "amount", "k % 7 = 0", "both"), (9, "DUPLICATE_VIEW_CONFLICT", "account_number", "k % 6 = 0", "both"), (10, "SOURCE_ROW_REUSED", None, "k % 13 = 0", "both"), (11, "UNASSIGNED_SOURCE_ROW", None, "k % 17 = 0", "none"))
LISTED = "SELECT DISTINCT document_id, account_number AS account FROM base WHERE cast(right(account_number, 3) AS int) % 4 <> 0"
ISSUERS = "SELECT DISTINCT document_id, concat('BANK', right(document_id, 1)) AS issuer FROM base WHERE right(document_id, 1) IN ('0', '1', '2', 'B')"
ISSUES = " UNION ALL ".join(f"SELECT document_id, event * 20 + {n} AS issue_no, event, k, '{c}' AS code, {'NULL' if f is None else repr(f)} AS field, '{v}' AS names FROM base WHERE {w}" for n, c, f, w, v in KINDS)


def _base(rows: DataFrame) -> DataFrame:
    """BASE of the rows, written. A document's rows are numbered in ranges of their order, so that no task sorts a whole document."""
    order = ["document_id", "seq", "id"]
    lean = rows.select(F.col("source_document_id").alias("document_id"), "seq", "id", F.col("row_index").cast("long").alias("k"), "account_number", "direction", F.col("amount_cents").cast("string").alias("amount"), F.coalesce("counterparty_account", F.lit("")).alias("party"))
    placed = written(written(lean, "lean").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "placed")
    sizes = placed.groupBy("document_id", "_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy("document_id").orderBy("_part")) - F.col("_size")).drop("_size")
    within = F.row_number().over(Window.partitionBy("document_id", "_part").orderBy("seq", "id"))
    numbered = placed.withColumn("_nth", within).join(before, ["document_id", "_part"])
    return written(numbered.select("document_id", (F.col("_before") + F.col("_nth")).cast("long").alias("event"), "k", "account_number", "direction", "amount", "party"), "base")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _base(demo_ledger.ledger(spark, sf_dir))
    of = lambda t: written(spark.sql(t.replace("FROM base", "FROM {base}"), base=base), "pending")
    issues, values = of(ISSUES), of(VALUES)
    named = F.when(F.col("names") == "both", F.array(F.col("event") * 2, F.col("event") * 2 + 1)).when(F.col("names") == "one", F.array(F.col("event") * 2)).when(F.col("names") == "other", F.array(F.col("event") * 2 + 1)).otherwise(F.array().cast("array<bigint>"))
    return pending.judged_issues(issues.withColumn("observations", named), of(OBS), values, values.where("v = 0").select("document_id", "event", "field", "value"), of(LISTED), of(ISSUERS))


@query("d19_judged_issues", f"""{ORACLE}, {BASE}, i AS ({ISSUES}), l AS ({LISTED}), s AS ({ISSUERS}), b AS (SELECT base.*, l.account IS NOT NULL AS listed, s.issuer FROM base LEFT JOIN l ON l.document_id = base.document_id AND l.account = account_number LEFT JOIN s ON s.document_id = base.document_id),
j AS (SELECT i.*, b.listed, b.issuer, b.direction, b.party FROM i JOIN b USING (document_id, event)),
r AS (SELECT *, CASE issue_no % 20 WHEN 0 THEN CASE WHEN k % 5 = 0 THEN 'OWNER_NAME_BOUND_TO_ACCOUNT' END WHEN 1 THEN CASE WHEN k % 3 <> 0 AND issuer IS NOT NULL THEN 'ISSUER_READ_INDEPENDENTLY' END WHEN 2 THEN CASE WHEN k % 9 = 0 THEN 'PLACEHOLDER_IN_BOTH_READINGS' END
WHEN 3 THEN CASE WHEN k % 25 <> 1 AND k % 10 <> 3 THEN 'ACCOUNT_READ_TWICE' END WHEN 4 THEN CASE WHEN direction = 'IN' OR (direction = 'OUT' AND k % 11 <> 0) THEN 'DIRECTION_READ_TWICE' END WHEN 5 THEN CASE WHEN party <> '' THEN 'PARTY_PRESENT' WHEN k % 12 = 2 AND k % 8 = 2 THEN 'CASH_WITHOUT_PARTY' END
WHEN 6 THEN CASE WHEN k % 10 <> 3 AND k % 14 = 0 THEN 'OTHER_VIEW_AGREES' END
WHEN 7 THEN CASE WHEN listed AND (k % 10 = 3 OR (k % 6 = 0 AND k % 18 <> 0)) AND k % 25 <> 1 AND k % 10 <> 3 THEN 'LISTED_ACCOUNT_IN_DETAILED_VIEW' WHEN k % 10 <> 3 AND (k % 6 <> 0 OR k % 18 = 0) AND k % 25 <> 1 THEN 'OTHER_VIEW_AGREES' END
WHEN 8 THEN CASE WHEN k % 10 <> 3 AND k % 14 = 0 THEN 'READ_IN_EVERY_DIFFERING_VIEW' END WHEN 9 THEN CASE WHEN listed AND k % 25 <> 1 THEN 'LISTED_ACCOUNT_IN_ROWS' WHEN k % 18 = 0 AND k % 10 <> 3 THEN 'READ_IN_EVERY_DIFFERING_VIEW' END END AS basis FROM j)
SELECT document_id, issue_no, code, field, CASE WHEN basis IS NULL THEN 'PENDING' ELSE 'RESOLVED' END AS state, basis FROM r""")
def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)
