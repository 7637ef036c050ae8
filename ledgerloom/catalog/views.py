"""Queries on several views of the same rows: the derived ledger printed three times, with differences planted by the order's key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consolidation
from ..plans import demo_ledger
from ..plans.demo_ledger import ORACLE
from ..plans.storage import written
from .registry import query

#: The same text runs in Spark and in DuckDB. View 1 has the owner in each row; view 2 in the head, odd accounts from the
#: last row; view 3 names no account and is out of order. Each numbers its rows from a million on.
VIEWS = """base AS (
  SELECT concat(cast(case_id AS string), '/', source_document_id, '/', account_number) AS document_id, account_number, row_index AS k, cast(row_number() OVER (PARTITION BY case_id, source_document_id, account_number ORDER BY seq) AS bigint) AS n, CASE WHEN right(account_number, 1) IN ('1', '3', '5', '7', '9') THEN -1 ELSE 1 END AS turn,
         cast(transaction_date AS string) AS d, direction, cast(amount_cents AS string) AS amount, coalesce(cast(balance_cents AS string), '') AS balance, coalesce(counterparty_account, '') AS party_account, counterparty_name AS party
  FROM ledger WHERE direction <> 'UNKNOWN'),
views AS (
  SELECT document_id, 1000000 + n AS obs, k, n, 1 AS view, account_number, d, direction, amount, balance, party_account, party, balance AS i_balance, CASE WHEN k % 31 = 0 AND k % 2 = 1 THEN '' ELSE amount END AS i_amount FROM base
  UNION ALL SELECT document_id, 2000000 + turn * n, k, n, 2, account_number, d, direction, CASE WHEN k % 61 = 0 THEN '999' ELSE amount END, CASE WHEN k % 31 = 0 OR k % 61 = 0 THEN concat(balance, '1') ELSE balance END, CASE WHEN k % 61 = 0 THEN 'x' ELSE party_account END,
    CASE WHEN k % 17 = 0 THEN '' ELSE party END, balance, CASE WHEN k % 31 = 0 AND k % 2 = 1 THEN '' ELSE amount END FROM base WHERE k % 7 <> 0
  UNION ALL SELECT document_id, 3000000 + (n * 7919) % 100003, k, n, 3, '', d, direction, amount, CASE WHEN k % 43 = 0 THEN concat(balance, '1') ELSE balance END, '', party, '', '' FROM base WHERE k % 5 <> 0)"""
ROWS = """SELECT document_id, cast(obs AS bigint) AS obs, 'deposit' AS account_kind, view = 1 AS direct_owner, account_number, '' AS account_name, '' AS bank_name, '' AS transaction_time, d AS transaction_date, direction, amount, balance, '' AS transaction_type, party AS counterparty_name, party_account AS counterparty_account, '' AS counterparty_bank,
CASE WHEN i_amount = '' THEN '' ELSE account_number END AS i_account_number, CASE WHEN i_amount = '' THEN '' ELSE d END AS i_transaction_date, CASE WHEN i_amount = '' THEN '' ELSE direction END AS i_direction, i_amount, CASE WHEN i_amount = '' THEN '' ELSE i_balance END AS i_balance, CASE WHEN i_amount = '' THEN '' ELSE party_account END AS i_counterparty_account FROM views"""


def _consolidated(spark: SparkSession, sf_dir: str) -> consolidation.Views:
    rows = written(demo_ledger.ledger(spark, sf_dir), "ledger")
    views = spark.sql(f"WITH {VIEWS.replace('FROM ledger', 'FROM {ledger}')} {ROWS}", ledger=rows)
    return consolidation.consolidated(written(views, "views"))


#: Anchors and leftovers by their rules; a row in order between anchors is matched to the row that it was printed from.
#: Which of the three later rules finds a row depends on its neighbours, so these share a name in the query; tests tell them apart.
MATCHED = f"""{ORACLE}, {VIEWS}, v AS (SELECT *, count(*) OVER (PARTITION BY document_id, view, d, direction, amount, balance) AS same, count(*) OVER (PARTITION BY document_id, view) AS size, count(*) OVER (PARTITION BY document_id, view, d, direction, amount, i_balance, i_amount) AS alike FROM views),
e AS (SELECT a.document_id, a.view AS av, b.view AS bv, a.obs AS a, b.obs AS b, a.n AS an, b.n AS bn, a.d, least(a.size, b.size) AS size FROM v a JOIN v b USING (document_id, d, direction, amount, balance) WHERE a.view = 1 AND b.view > 1 AND a.same = 1 AND b.same = 1 AND balance <> ''),
three AS (SELECT document_id, bv FROM e GROUP BY 1, 2 HAVING count(*) >= 3),
c AS (SELECT a.document_id, 2 AS bv, a.obs AS a, b.obs AS b, a.d, least(a.size, b.size) AS size FROM v a JOIN v b ON a.document_id = b.document_id AND a.d = b.d AND a.direction = b.direction AND a.amount = b.amount AND a.i_balance = b.i_balance AND a.i_amount = b.i_amount AND a.account_number = b.account_number JOIN three t ON t.document_id = a.document_id AND t.bv = 2
  WHERE a.view = 1 AND b.view = 2 AND a.i_amount = a.amount AND b.i_amount = b.amount AND a.i_balance <> '' AND a.alike = 1 AND b.alike = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.document_id = a.document_id AND e.bv = 2 AND (e.a = a.obs OR e.b = b.obs))),
anchors AS (SELECT document_id, bv, a, b, d, size, 'EXACT' AS basis FROM e UNION ALL SELECT document_id, bv, a, b, d, size, 'TWO_READINGS' FROM c),
good AS (SELECT document_id, bv FROM anchors GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT d) >= 2 AND count(*) >= 0.8 * any_value(size)),
m0 AS (SELECT document_id, bv, a, b, basis FROM anchors SEMI JOIN good USING (document_id, bv)),
o AS (SELECT a.document_id, 2 AS bv, a.obs AS a, b.obs AS b, CASE WHEN b.k % 61 = 0 THEN 'ASSISTED_ORDERED' ELSE 'ORDERED' END AS basis FROM v a JOIN v b ON a.document_id = b.document_id AND a.n = b.n AND a.view = 1 AND b.view = 2 JOIN good g ON g.document_id = a.document_id AND g.bv = 2
  WHERE NOT EXISTS (SELECT 1 FROM m0 WHERE m0.document_id = a.document_id AND m0.bv = 2 AND (m0.a = a.obs OR m0.b = b.obs)) AND NOT (b.k % 61 = 0 AND b.i_amount = '')),
m1 AS (SELECT * FROM m0 UNION ALL SELECT * FROM o),
fits AS (SELECT a.document_id, b.view AS bv, a.obs AS a, b.obs AS b FROM v a JOIN v b USING (document_id, d, direction) JOIN good g ON g.document_id = a.document_id AND g.bv = b.view WHERE a.view = 1 AND (a.amount = b.amount OR (a.balance = b.balance AND a.balance <> '')) AND NOT EXISTS (SELECT 1 FROM m1 WHERE m1.document_id = a.document_id AND m1.bv = b.view AND (m1.a = a.obs OR m1.b = b.obs))),
m AS (SELECT * FROM m1 UNION ALL SELECT document_id, bv, a, b, 'UNIQUE_CONFLICT' FROM (SELECT *, count(*) OVER (PARTITION BY document_id, bv, a) AS x, count(*) OVER (PARTITION BY document_id, bv, b) AS y FROM fits) WHERE x = 1 AND y = 1)"""


@query("d9_view_matches", f"{MATCHED} SELECT document_id, a AS left_obs, b AS right_obs, CASE WHEN basis IN ('EXACT', 'TWO_READINGS') THEN basis ELSE 'BY_PLACE_OR_ALONE' END AS basis FROM m")
def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = F.when(F.col("basis").isin(consolidation.EXACT, consolidation.CORROBORATED), F.col("basis")).otherwise("BY_PLACE_OR_ALONE")
    return _consolidated(spark, sf_dir).matches.select("document_id", "left_obs", "right_obs", basis.alias("basis"))


#: all matches start in view 1, which matches a row of another view once: a group is a row of view 1 with its partners
GROUPED = f"""{MATCHED}, g AS (SELECT v.*, coalesce(m.a, v.obs) AS event FROM v LEFT JOIN m ON m.document_id = v.document_id AND m.b = v.obs),
q AS (SELECT document_id, event, any_value(amount) FILTER (view = 1) AS a1, list_sort(list(obs)) AS obs, min(obs) AS representative, {', '.join(f"list_sort(list_distinct(list({c}) FILTER ({c} <> ''))) AS {c}_all, first({c} ORDER BY obs) AS {c}_own" for c in ('account_number', 'd', 'direction', 'amount', 'balance', 'party_account', 'party'))} FROM g GROUP BY 1, 2),
w AS (SELECT document_id, event, representative, obs, {', '.join(f"{c}_all, CASE WHEN {c}_own <> '' THEN {c}_own WHEN len({c}_all) = 1 THEN {c}_all[1] ELSE '' END AS {c}" for c in ('account_number', 'd', 'direction', 'amount', 'balance', 'party_account', 'party'))} FROM q)"""


@query("d9_consolidated_views", f"{GROUPED} SELECT document_id, event, representative, array_to_string(obs, ',') AS observations, account_number, d AS transaction_date, direction, amount, balance, party AS counterparty_name, party_account AS counterparty_account FROM w")
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consolidated(spark, sf_dir).events.select("document_id", "event", "representative", F.array_join("observations", ",").alias("observations"), "account_number", "transaction_date", "direction", "amount", "balance", "counterparty_name", "counterparty_account")


@query("d9_view_conflicts", f"""{GROUPED}, clash AS (SELECT document_id, event, unnest(['amount', 'balance', 'counterparty_account', 'counterparty_name']) AS field, unnest([amount_all, balance_all, party_account_all, CASE WHEN party_account = '' THEN party_all ELSE [] END]) AS vals FROM w) SELECT document_id, event, field, array_to_string(vals, ',') AS "values" FROM clash WHERE len(vals) > 1""")
def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _consolidated(spark, sf_dir).events.select("document_id", "event", F.explode("conflicts").alias("c"))
    return found.select("document_id", "event", "c.field", F.array_join("c.values", ",").alias("values"))
