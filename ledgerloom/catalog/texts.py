"""Queries on printed text, tables, provenance and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, money
from ..plans import demo_ledger
from ..plans.demo_ledger import ORACLE
from ..plans.storage import written
from ..sources import statements
from ..streaming import ledger as streams
from .registry import query


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ledger, written: operators that join it with itself start from a table."""
    return written(demo_ledger.ledger(spark, sf_dir), "ledger")


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement cells as a bank might print them."""
    rows = ledger(spark, sf_dir)
    amount = F.format_string("￥%,d.%02d", F.floor(F.col("amount_cents") / 100).cast("long"), F.col("amount_cents") % 100)
    return rows.select("case_id", "id", F.concat(F.lit("账号 "), "account_number").alias("account"), F.when(F.col("row_index") % 2 == 0, "工商银行北京分行").otherwise("本行").alias("bank"), F.date_format("transaction_date", "yyyy年M月d日").alias("date"),
                       F.when(F.col("direction") == "IN", "贷方").when(F.col("direction") == "OUT", "借").otherwise("?").alias("direction"), F.when(F.col("row_index") % 50 == 0, "1,23.0").otherwise(amount).alias("amount"), F.when(F.col("balance_cents").isNull(), "--").otherwise(F.format_string("%d.%02d", F.floor(F.abs("balance_cents") / 100).cast("long"), F.abs("balance_cents") % 100)).alias("balance"))


@query("normalize_statement_fields", f"""{ORACLE} SELECT case_id, id, account_number, CASE WHEN row_index % 2 = 0 THEN '中国工商银行' ELSE '本行' END AS canonical_bank, transaction_date, nullif(direction, 'UNKNOWN') AS flow_direction,
CASE WHEN row_index % 50 = 0 THEN NULL ELSE amount_cents END AS amount_cents, abs(balance_cents) AS balance_cents, concat_ws(',', CASE WHEN row_index % 50 = 0 THEN 'amount' END, CASE WHEN direction = 'UNKNOWN' THEN 'direction' END) AS unreadable FROM ledger""")
def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return money.normalize_statement_fields(_printed(spark, sf_dir)).select("case_id", "id", "account_number", "canonical_bank", "transaction_date", "flow_direction", "amount_cents", "balance_cents", F.array_join("unreadable", ",").alias("unreadable"))


@query("account_key", f"{ORACLE} SELECT case_id, id, 'source-account|' || source_document_id || '|' || account_number AS account_key FROM ledger")
def _key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("case_id", "id", identity.account_key("account_number", "bank_name", "source_document_id", "source_document_id").alias("account_key"))


@query("statement_values", f"""{ORACLE} SELECT account_number AS "accountNumber", account_name AS "accountName", bank_name AS "bankName", transaction_date::VARCHAR AS "transactionTime", transaction_date::VARCHAR AS "transactionDate", CASE WHEN direction = 'UNKNOWN' THEN '' ELSE direction END AS direction,
printf('%d.%02d', amount_cents // 100, amount_cents % 100) AS amount, coalesce(CASE WHEN balance_cents < 0 THEN '-' ELSE '' END || printf('%d.%02d', abs(balance_cents) // 100, abs(balance_cents) % 100), '') AS balance, '' AS "transactionType", coalesce(counterparty_name, '') AS "counterpartyName", coalesce(counterparty_account, '') AS "counterpartyAccount", '' AS "counterpartyBank" FROM ledger""")
def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.statement_values(ledger(spark, sf_dir))


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per customer: a table of the orders, under a cell that spans both columns."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    row = F.concat(F.lit("<tr><td>"), F.col("o_orderkey").cast("string"), F.lit("</td><TD class=x>"), "o_orderstatus", F.lit("&amp;co</TD></tr>"))
    rows = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("rs"))
    return rows.select("o_custkey", F.concat(F.lit("<p>x</p><table border=1><tr><th colspan=2>orders</th></tr>"), F.array_join(F.transform("rs", lambda x: x["r"]), "\n"), F.lit("</table>")).alias("html"))


ORDERS = "WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS r FROM orders)"


@query("extract_html_tables", f"""{ORDERS} SELECT o_custkey, 0 AS table_no, r AS row_no, 0 AS col_no, o_orderkey::VARCHAR AS text FROM n UNION ALL SELECT o_custkey, 0, r, 1, o_orderstatus || '&co' FROM n
UNION ALL SELECT o_custkey, 0, 0, c::INT, CASE WHEN c = 0 THEN 'orders' ELSE '' END FROM (SELECT DISTINCT o_custkey FROM orders), range(2) t(c)""")
def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.extract_html_tables(_html(spark, sf_dir), "o_custkey")


@query("build_source_registry", f"""{ORDERS}, c AS (SELECT o_custkey, r AS row_no, unnest([0, 1]) AS col_no FROM n UNION ALL SELECT o_custkey, 0, unnest([0, 1]) FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT concat_ws('_', o_custkey, 'P1', 'T1', 'R' || (row_no + 1), 'C' || (col_no + 1)) AS cell_id, concat_ws('_', o_custkey, 'P1', 'T1', 'R' || (row_no + 1)) AS row_id FROM c""")
def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = statements.extract_html_tables(_html(spark, sf_dir), "o_custkey").withColumn("page", F.lit(1))
    return statements.build_source_registry(cells, "o_custkey", "page").select("cell_id", "row_id")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A printed table per account, header in the second row."""
    rows = ledger(spark, sf_dir).where("direction <> 'UNKNOWN'")
    amount = F.format_string("%d.%02d", F.floor(F.col("amount_cents") / 100).cast("long"), F.col("amount_cents") % 100)
    values = F.array(F.col("transaction_date").cast("string"), F.when(F.col("direction") == "OUT", amount).otherwise(""), F.when(F.col("direction") == "IN", amount).otherwise(""), "counterparty_name", "summary")
    body = rows.select("account_number", (F.col("seq") + 10).alias("row_no"), F.posexplode(values).alias("col_no", "text"))
    heads = rows.select("account_number").distinct().select("account_number", F.lit(1).cast("long").alias("row_no"), F.posexplode(F.array(*[F.lit(x) for x in ("交易日期", "支出", "存入", "对方户名", "摘要")])).alias("col_no", "text"))
    return heads.unionByName(body)


@query("rows_from_tables", f"""{ORACLE} SELECT account_number, seq + 10 AS row_no, transaction_date, direction, amount_cents, counterparty_name, summary FROM ledger WHERE direction <> 'UNKNOWN' AND amount_cents > 0""")
def _table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.rows_from_tables(_cells(spark, sf_dir), ["account_number"]).select("account_number", "row_no", "transaction_date", "direction", "amount_cents", "counterparty_name", "summary")


@query("table_schema_detect", f"""{ORACLE} SELECT DISTINCT account_number, 'TRANSACTIONS' AS kind FROM ledger WHERE direction <> 'UNKNOWN'""")
def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.table_kind(_cells(spark, sf_dir), ["account_number"])


@query("replace_document_version", f"""{ORACLE} SELECT id, amount_cents FROM ledger WHERE source_document_id <> 'DOC_1' UNION ALL SELECT id, amount_cents + 1 FROM ledger WHERE source_document_id = 'DOC_1' AND row_index % 2 = 0 AND case_id IN (SELECT case_id FROM ledger WHERE source_document_id = 'DOC_1' AND row_index % 2 = 0)
UNION ALL SELECT id, amount_cents FROM ledger WHERE source_document_id = 'DOC_1' AND case_id NOT IN (SELECT case_id FROM ledger WHERE source_document_id = 'DOC_1' AND row_index % 2 = 0)""")
def _replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    new = rows.where("source_document_id = 'DOC_1' and row_index % 2 = 0").withColumn("amount_cents", F.col("amount_cents") + 1)
    return statements.replace_document_version(rows, new).select("id", "amount_cents")


@query("source_row_counts", f"""{ORACLE}, d AS (SELECT DISTINCT case_id, source_document_id FROM account) SELECT case_id, source_document_id, count(id) AS n_rows FROM d LEFT JOIN ledger USING (case_id, source_document_id) GROUP BY 1, 2""")
def _row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.source_row_counts(demo_ledger.accounts(spark, sf_dir).select("case_id", "source_document_id").distinct(), ledger(spark, sf_dir))


@query("page_ranges", f"""{ORACLE}, p AS (SELECT DISTINCT case_id, source_document_id, page FROM ledger WHERE page % 7 <> 0), i AS (SELECT *, page - row_number() OVER (PARTITION BY case_id, source_document_id ORDER BY page) AS k FROM p)
SELECT case_id, source_document_id, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages FROM i GROUP BY case_id, source_document_id, k""")
def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return money.page_ranges(ledger(spark, sf_dir).where("page % 7 <> 0").select("case_id", "source_document_id", "page"), ["case_id", "source_document_id"])


EVENTS = """WITH rows AS (SELECT event_id, ts, user_id AS account, CASE WHEN event_type IN ('purchase', 'signup') THEN 'IN' WHEN event_type IN ('click', 'view') THEN 'OUT' ELSE 'UNKNOWN' END AS direction, round(value * 100)::BIGINT AS amount_cents FROM events)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("daily_flows", f"""{EVENTS} SELECT account, ts::DATE AS day, sum(CASE WHEN direction = 'IN' THEN amount_cents ELSE 0 END)::BIGINT AS in_cents, sum(CASE WHEN direction = 'OUT' THEN amount_cents ELSE 0 END)::BIGINT AS out_cents, count(*) AS n_rows FROM rows GROUP BY 1, 2""")
def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.daily_flows(_events(spark, sf_dir))
