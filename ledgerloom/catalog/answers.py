"""Queries on a model's answers: the derived ledger as JSON, one answer for each document of a case, with faults by the order's key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import demo_ledger
from ..plans.demo_ledger import ORACLE
from ..plans.storage import written
from ..sources import extraction_json
from .registry import query

#: The same text runs in Spark and in DuckDB; place is a row's place in its document's answer.
TOLD = """told AS (SELECT concat(cast(case_id AS string), '/', source_document_id) AS document_id, cast(row_number() OVER (PARTITION BY case_id, source_document_id ORDER BY seq, id) AS int) - 1 AS place, cast(row_index AS bigint) AS k, page, account_number, account_name, transaction_date, direction, amount_cents, balance_cents,
  concat(cast((amount_cents - amount_cents % 100) / 100 AS bigint), '.', lpad(cast(amount_cents % 100 AS string), 2, '0')) AS amount, summary, coalesce(counterparty_account, '') AS party_account FROM ledger)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"WITH {TOLD.replace('FROM ledger', 'FROM {ledger}')} SELECT * FROM told", ledger=demo_ledger.ledger(spark, sf_dir))
    short = F.col("k") % 2 == 0
    key = lambda a, b: F.when(short, a).otherwise(b)
    day = F.when(F.col("k") % 43 == 0, "").otherwise(F.concat(F.col("transaction_date").cast("string"), F.lit(" 09:15")))
    pair = lambda k, v: F.concat(F.lit('"'), k, F.lit('": '), v)
    quoted = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    parts = [
        F.when(F.col("k") % 31 != 0, pair(key("p", "page"), F.when(F.col("k") % 61 == 0, "99").otherwise(F.col("page").cast("string")))), pair(key("tm", "transactionTime"), quoted(day)), pair(key("amt", "amount"), quoted(F.when(F.col("k") % 41 == 0, "12x").otherwise(F.col("amount")))),
        F.when(F.col("balance_cents") >= 0, pair(key("bal", "balance"), (F.col("balance_cents") / 100).cast("decimal(20,2)").cast("string"))), pair(key("dir", "direction"), quoted(F.lower("direction"))), pair(key("ac", "accountNumber"), quoted(F.when(F.col("k") % 29 == 0, "?").otherwise(F.col("account_number")))),
        pair(key("sm", "summary"), quoted(F.col("summary"))), F.when(F.col("party_account") != "", pair(key("ca", "counterpartyAccount"), quoted(F.col("party_account")))), F.when(F.col("k") % 3 > 0, pair(key("cf", "confidence"), F.when(F.col("k") % 3 == 1, "0.95").otherwise("7"))), F.lit('"deep": {"a": [1, {"b": null}]}'),
    ]
    element = F.when(F.col("k") % 37 == 0, "17").otherwise(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}")))
    listed = F.concat(F.lit('{"ac": "'), F.col("account_number"), F.lit('", "holder": "'), F.col("account_name"), F.lit('", "bk": "银行"}'))
    check = F.concat(F.lit('{"p": '), F.col("page").cast("string"), F.lit(', "extracted": 1, "status": "'), F.when(F.col("k") % 47 == 0, "needs_review").otherwise("ok"), F.lit('"}'))
    per = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("place", element.alias("e")))).alias("e"), F.array_sort(F.collect_list(F.struct("place", listed.alias("e")))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("page") != 5, F.struct("place", check.alias("e"))))).alias("c"))
    part = lambda c: F.concat(F.lit("["), F.array_join(F.col(c)["e"], ", "), F.lit("]"))
    whole = F.concat(F.lit('{"accounts": '), part("a"), F.lit(', "transactions": '), F.when(F.endswith("document_id", F.lit("_3")), '{"rows": 1}').otherwise(part("e")), F.lit(', "pageChecks": '), part("c"), F.lit("}"))
    cut = F.when(F.endswith("document_id", F.lit("_4")), F.expr("left(w, 1000)")).otherwise(F.col("w"))
    return written(per.withColumn("w", whole).select("document_id", F.lit(40).alias("total_pages"), F.lit("张三").alias("respondent"), cut.alias("answer")), "answers")


READ = f"{ORACLE}, {TOLD}, g AS (SELECT * FROM told WHERE NOT suffix(document_id, '_4')), r AS (SELECT * FROM g WHERE NOT suffix(document_id, '_3') AND k % 37 <> 0 AND k % 31 <> 0 AND k % 61 <> 0)"


@query("read_extraction_json", f"""{READ} SELECT document_id, page, place + 1 AS "row", CASE WHEN k % 29 = 0 THEN '待核验账号-第' || page || '页' ELSE account_number END AS account_number, CASE WHEN k % 43 <> 0 THEN transaction_date END AS transaction_date, CASE WHEN k % 43 <> 0 THEN '09:15:00' END AS transaction_clock, direction,
CASE WHEN k % 41 <> 0 THEN amount_cents END AS amount_cents, CASE WHEN balance_cents >= 0 THEN balance_cents END AS balance_cents, summary, nullif(party_account, '') AS counterparty_account, CASE k % 3 WHEN 0 THEN 0.65 WHEN 1 THEN 0.95 ELSE 1.0 END::DOUBLE AS confidence,
concat_ws(',', CASE WHEN k % 43 = 0 THEN 'INVALID_DATE' END, CASE WHEN k % 41 = 0 THEN 'INVALID_AMOUNT' END, CASE WHEN direction = 'UNKNOWN' THEN 'UNKNOWN_DIRECTION' END) AS issues, CASE WHEN k % 43 = 0 OR k % 41 = 0 OR direction = 'UNKNOWN' OR k % 3 = 0 THEN 'PENDING' ELSE 'AUTO_PASSED' END AS review_status FROM r""")
def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction_json.read_extraction_json(_answers(spark, sf_dir)).rows
    return found.select("document_id", "page", "row", "account_number", "transaction_date", "transaction_clock", "direction", "amount_cents", "balance_cents", "summary", "counterparty_account", "confidence", F.array_join("issues", ",").alias("issues"), "review_status")


@query("extraction_json_rejects", f"""{READ} SELECT DISTINCT document_id, 'answer' AS part, NULL::INT AS position, 'NOT_A_JSON_OBJECT' AS reason FROM told WHERE suffix(document_id, '_4') UNION ALL SELECT DISTINCT document_id, 'transactions', NULL::INT, 'NOT_AN_ARRAY' FROM told WHERE suffix(document_id, '_3')
UNION ALL SELECT document_id, 'transactions', place, CASE WHEN k % 37 = 0 THEN 'NOT_AN_OBJECT' ELSE 'NO_PAGE_OF_THE_DOCUMENT' END FROM g WHERE NOT suffix(document_id, '_3') AND (k % 37 = 0 OR k % 31 = 0 OR k % 61 = 0)""")
def _rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction_json.read_extraction_json(_answers(spark, sf_dir)).rejects


@query("extraction_json_warnings", f"""{READ}, c AS (SELECT document_id, page, count(*) AS n, bool_or(k % 47 = 0) AS review FROM g WHERE page <> 5 GROUP BY 1, 2), d AS (SELECT DISTINCT document_id FROM g), s AS (SELECT document_id, coalesce((SELECT sum(n) FROM c WHERE c.document_id = d.document_id), 0) - coalesce((SELECT count(*) FROM r WHERE r.document_id = d.document_id), 0) AS more FROM d)
SELECT document_id, 'PAGE_NOT_CHECKED' AS warning, p::INT AS page, NULL::BIGINT AS count FROM d, range(1, 41) t(p) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.document_id = d.document_id AND c.page = p) UNION ALL SELECT document_id, 'PAGE_NEEDS_REVIEW', page, NULL FROM c WHERE review UNION ALL SELECT document_id, 'COUNT_DIFFERS', NULL, more::BIGINT FROM s WHERE more <> 0""")
def _warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction_json.read_extraction_json(_answers(spark, sf_dir)).warnings


@query("extraction_json_accounts", f"""{READ} SELECT document_id, account_number, first(account_name ORDER BY place) AS account_name, '待核验银行' AS bank_name, 1 AS page FROM g GROUP BY 1, 2""")
def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction_json.read_extraction_json(_answers(spark, sf_dir)).accounts
