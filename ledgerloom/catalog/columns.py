"""Queries on what columns say: one table per account, laid out by the account's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import columns
from ..plans import demo_ledger
from ..plans.demo_ledger import ORACLE
from ..plans.storage import written
from .registry import query

CENTS = "concat(cast((abs({0}) - abs({0}) % 100) / 100 AS bigint), '.', lpad(cast(abs({0}) % 100 AS string), 2, '0'))"
#: The same text runs in Spark and in DuckDB. a is the account's number, which lays out its table; k is the order's key.
LINES = f"""lines AS (SELECT account_number AS document_id, cast(right(account_number, 6) AS int) AS a, 1 + row_number() OVER (PARTITION BY account_number ORDER BY seq) AS row_id, cast(row_index AS bigint) AS k, direction, amount_cents AS amount, coalesce(balance_cents, 0) AS balance, cast(transaction_date AS string) AS d, summary, counterparty_name AS party, coalesce(counterparty_account, '') AS party_account, {CENTS.format('amount_cents')} AS printed FROM ledger),
docs AS (SELECT document_id, a, count(*) AS n FROM lines GROUP BY document_id, a)"""
#: columns: date, out, in, party, description or what it is called; a label beside the table, a second table on some pages
HEADS = """SELECT document_id, 1 AS page, 1 AS table_no, cast(1 AS bigint) AS row_id, c AS col_no, CASE c WHEN 1 THEN '日期' WHEN 2 THEN CASE WHEN a % 7 = 1 THEN '金额' ELSE '借方 金额' END WHEN 3 THEN CASE WHEN a % 11 = 2 THEN '借方金额' ELSE '贷方发生额' END
WHEN 4 THEN CASE cast(a % 4 AS int) WHEN 0 THEN '对方账号/户名' WHEN 1 THEN '对方信息' WHEN 2 THEN '对方 账号与名称' ELSE '户名' END ELSE CASE WHEN a % 3 = 0 THEN '摘 要' WHEN a % 3 = 1 THEN '说明' ELSE '用途' END END AS text, 0 AS x FROM docs CROSS JOIN (VALUES (1), (2), (3), (4), (5)) cols(c) WHERE c < 5 OR a % 5 <> 0"""
CELLS = f"""{HEADS} UNION ALL SELECT document_id, 1, CAST(NULL AS int), CAST(NULL AS bigint), CAST(NULL AS int), '摘要', 1 FROM docs WHERE a % 2 = 0 UNION ALL SELECT document_id, 1, 2, 900000, 1, '附', 0 FROM docs WHERE a % 9 = 4
UNION ALL SELECT document_id, 1, 1, row_id, c, CASE c WHEN 1 THEN d WHEN 2 THEN CASE WHEN direction = 'OUT' THEN printed WHEN k % 13 = 0 THEN '' ELSE '0.00' END WHEN 3 THEN CASE WHEN direction = 'IN' THEN printed WHEN k % 13 = 0 THEN '' ELSE '0.00' END WHEN 4 THEN CASE WHEN a % 8 = 5 AND k % 29 = 0 THEN '甲公司12345' WHEN k % 6 = 0 THEN '' ELSE '甲公司1234' END ELSE summary END, 0
FROM lines CROSS JOIN (VALUES (1), (2), (3), (4), (5)) cols(c)"""
TABLES = "SELECT document_id, 1 AS page, 1 AS table_no, 'transactions' AS kind, CASE WHEN a % 10 = 3 THEN 'credit' ELSE 'deposit' END AS account_kind, CASE WHEN a % 6 = 0 THEN 1 END AS description_col, CASE WHEN a % 7 = 1 THEN '金 额' ELSE '借方金额' END AS amount_header, a % 12 <> 1 AS complete FROM docs"
OUTPUTS = "SELECT document_id, row_id AS out_no, 1 AS page, 1 AS table_no, row_id, CASE WHEN k % 3 = 0 THEN direction ELSE '' END AS direction, CASE WHEN k % 17 = 0 THEN amount + 1 ELSE amount END AS amount_cents FROM lines"
ROWS = "SELECT document_id, 1 AS page, 1 AS table_no, CASE WHEN a % 13 = 6 AND row_id = 3 THEN 2 ELSE row_id END AS group_no, row_id FROM lines"
READINGS = """SELECT document_id, 1 AS page, 1 AS table_no, row_id AS out_no, concat(CASE WHEN direction = 'OUT' THEN '-' WHEN k % 10 = 0 THEN '+' ELSE '' END, printed) AS printed, CASE WHEN direction = 'OUT' AND k % 5 <> 0 THEN 'OUT' ELSE '' END AS direction, cast(amount AS string) AS amount, cast(balance AS string) AS balance, d AS transaction_date, document_id AS account_number, party_account AS counterparty_account,
CASE WHEN direction = 'UNKNOWN' THEN '' ELSE direction END AS i_direction, cast(CASE WHEN k % 19 = 0 THEN amount + 1 ELSE amount END AS string) AS i_amount, cast(balance AS string) AS i_balance, CASE WHEN k % 4 = 0 THEN '' ELSE d END AS i_transaction_date, document_id AS i_account_number, party_account AS i_counterparty_account, k % 23 = 0 AS doubted FROM lines"""


def _tables(spark: SparkSession, sf_dir: str, *texts: str) -> list[DataFrame]:
    rows = written(demo_ledger.ledger(spark, sf_dir), "ledger")
    return [written(spark.sql(f"WITH {LINES.replace('FROM ledger', 'FROM {ledger}')} {t}", ledger=rows), "columns") for t in texts]


HEADERS = "SELECT document_id, 1 AS page, 1 AS table_no, cast(1 AS bigint) AS row_id FROM docs"


@query("d15_paired_directions", f"""{ORACLE}, {LINES}, t AS ({TABLES}), o AS ({OUTPUTS}) SELECT o.document_id, o.out_no, l.direction FROM o JOIN lines l ON l.document_id = o.document_id AND l.row_id = o.row_id JOIN t ON t.document_id = o.document_id JOIN docs q ON q.document_id = o.document_id
WHERE o.direction = '' AND account_kind = 'deposit' AND q.a % 7 <> 1 AND q.a % 11 <> 2 AND q.a % 5 <> 0 AND l.direction IN ('IN', 'OUT') AND l.k % 13 <> 0 AND l.amount = o.amount_cents AND l.amount > 0""")
def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.paired_directions(*_tables(spark, sf_dir, CELLS, TABLES, HEADERS, OUTPUTS))


@query("d15_signed_income", f"""{ORACLE}, {LINES}, t AS ({TABLES}), r AS ({READINGS}), e AS (SELECT r.* FROM r JOIN t USING (document_id) WHERE account_kind = 'deposit' AND complete AND amount_header = '金 额' AND r.amount = i_amount AND r.balance = i_balance AND (transaction_date = i_transaction_date OR counterparty_account <> '') AND NOT doubted),
s AS (SELECT DISTINCT document_id FROM e WHERE left(printed, 1) = '-' AND direction = 'OUT' AND amount <> '0') SELECT document_id, out_no FROM e SEMI JOIN s USING (document_id) WHERE direction = '' AND left(printed, 1) NOT IN ('-', '+') AND i_direction = 'IN' AND amount <> '0'""")
def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.signed_income(*_tables(spark, sf_dir, TABLES, READINGS))


@query("d16_recovered_columns", f"""{ORACLE}, {LINES}, t AS (SELECT * FROM ({TABLES}) JOIN docs USING (document_id) WHERE NOT (a % 13 = 6 AND n >= 2)), v AS (SELECT document_id, count(*) FILTER (k % 6 <> 0 OR (a % 8 = 5 AND k % 29 = 0)) AS filled, count(*) FILTER (a % 8 = 5 AND k % 29 = 0) AS odd FROM lines GROUP BY 1)
SELECT document_id, 'DESCRIPTION' AS what, 5 AS col_no FROM t WHERE a % 5 <> 0 AND a % 3 <> 1 UNION ALL SELECT document_id, 'DETACHED_DESCRIPTION', 5 FROM t WHERE a % 5 = 0 AND description_col IS NULL AND a % 2 = 0 AND a % 9 <> 4
UNION ALL SELECT document_id, 'PARTY', 4 FROM t WHERE a % 4 IN (0, 2) UNION ALL SELECT document_id, 'PARTY_SUFFIX', 4 FROM t JOIN v USING (document_id) WHERE a % 4 = 1 AND n >= 3 AND filled >= 3 AND odd = 0""")
def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.recovered_columns(*_tables(spark, sf_dir, CELLS, TABLES, HEADERS, ROWS)).select("document_id", "what", F.col("col_no").cast("int").alias("col_no"))
