"""Queries on second readings: the derived ledger in pages of eight rows, read twice, with changes planted by page and row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recovery
from ..plans import demo_ledger
from ..plans.demo_ledger import ORACLE
from ..plans.storage import written
from .registry import query

#: The same text runs in Spark and in DuckDB: what is printed on each page; p plants what a second reading changes.
SHEETS = """sheets AS (
  SELECT account_number AS document_id, cast(1 + floor((n - 1) / 8) AS int) AS page, cast(2 + (n - 1) % 8 AS int) AS row_no, cast(row_index AS bigint) AS k, cast(floor((n - 1) / 8) AS int) + cast(right(account_number, 3) AS int) AS p, cast(transaction_date AS string) AS d, amount_cents AS amount, balance_cents AS balance, direction,
         coalesce(counterparty_name, '') AS party, coalesce(counterparty_account, '') AS party_account
  FROM (SELECT *, row_number() OVER (PARTITION BY account_number ORDER BY seq) AS n FROM ledger) AS numbered),
pages AS (SELECT DISTINCT document_id, page, p FROM sheets)"""
PRINTED = "CASE WHEN {0} IS NULL THEN '--' ELSE concat(CASE WHEN {0} < 0 THEN '-' ELSE '' END, cast((abs({0}) - abs({0}) % 100) / 100 AS bigint), '.', lpad(cast(abs({0}) % 100 AS string), 2, '0')) END"
#: x orders what has no row; {amount} and {keep} differ between the readings
READ = """SELECT document_id, page, cast(NULL AS int) AS table_no, cast(NULL AS int) AS row_no, cast(NULL AS int) AS col_no, x, t AS text FROM pages CROSS JOIN (VALUES {near}) near(x, t, gone) WHERE p % 7 <> gone
UNION ALL SELECT document_id, page, 1, 1, c, 0, t FROM pages CROSS JOIN (VALUES (1, '日期'), (2, '金额'), (3, '余额'), (4, '户名')) heads(c, t)
UNION ALL SELECT document_id, page, 1, row_no, 1, 0, d FROM sheets WHERE {keep} UNION ALL SELECT document_id, page, 1, row_no, 2, 0, {amount} FROM sheets WHERE {keep} UNION ALL SELECT document_id, page, 1, row_no, 3, 0, {balance} FROM sheets WHERE {keep} UNION ALL SELECT document_id, page, 1, row_no, 4, 0, party FROM sheets WHERE {keep}"""
AMOUNT, BALANCE = PRINTED.format("amount"), PRINTED.format("balance")
FIRST = READ.format(near="(1, '续', -1), (2, '续', -1)", amount=AMOUNT, balance=BALANCE, keep="true")
#: a changed amount, another text on top, one of two equal texts gone
REREAD = READ.format(near="(1, '新', -1), (2, '续', -1), (3, '续', 2)", amount=f"CASE WHEN p % 7 = 0 AND row_no = 2 THEN '1.00' ELSE {AMOUNT} END", balance=BALANCE, keep="true").replace("WHERE p % 7 <> gone", "WHERE p % 7 <> gone AND (t <> '新' OR p % 7 = 1)")
NUMBERED = "SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, coalesce(row_no, 0), coalesce(col_no, 0), x) AS cell_id, CASE WHEN row_no IS NOT NULL THEN dense_rank() OVER (PARTITION BY document_id ORDER BY page, coalesce(row_no, 0)) END AS row_id FROM ({0}) AS c"


def _tables(spark: SparkSession, sf_dir: str, *texts: str) -> list[DataFrame]:
    of = lambda t, **given: written(spark.sql(t, **given), "sheets")
    sheets = of(f"WITH {SHEETS.replace('FROM ledger', 'FROM {ledger}')} SELECT * FROM sheets", ledger=demo_ledger.ledger(spark, sf_dir))
    pages = of("SELECT DISTINCT document_id, page, p FROM {sheets}", sheets=sheets)
    return [of(t.replace("FROM sheets", "FROM {sheets}").replace("FROM pages", "FROM {pages}"), sheets=sheets, pages=pages) for t in texts]


REFERENCES = "SELECT b.document_id, b.page, 1 AS table_no, concat('row', b.row_no) AS slot, 'row' AS kind, row_id AS ref FROM {0} b WHERE col_no = 1 UNION ALL SELECT o.document_id, o.page, 1, 'owner', 'cell', b.cell_id FROM pages o JOIN {0} b ON b.document_id = o.document_id AND b.page = greatest(o.page - 1, 1) AND b.row_no IS NULL AND b.x = 2"


def _rebased(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    before, after, pages = _tables(spark, sf_dir, NUMBERED.format(FIRST), NUMBERED.format(REREAD), "SELECT document_id, page, 1 AS table_no, p FROM pages")
    references = spark.sql(REFERENCES.format("{b}").replace("FROM pages", "FROM {pages}"), b=before, pages=pages)
    return recovery.rebased_mapping(before, after, pages.where("p % 11 <> 0"), references.join(pages.where("p % 11 <> 0").drop("p"), ["document_id", "page", "table_no"]), pages.where("p % 5 <> 0"))


REBASED = f"""{ORACLE}, {SHEETS}, b AS ({NUMBERED.format(FIRST)}), c AS ({NUMBERED.format(REREAD)}),
t AS (SELECT o.document_id, o.page, o.p, o.p % 11 <> 0 AND o.p % 7 > 2 AS kept, (SELECT p FROM pages q WHERE q.document_id = o.document_id AND q.page = greatest(o.page - 1, 1)) % 7 <> 2 AS whole, o.p % 5 <> 0 AS fresh FROM pages o),
taken AS (SELECT *, CASE WHEN kept AND whole THEN 'KEPT' WHEN fresh THEN 'NEW' ELSE 'LOST' END AS taken FROM t WHERE kept OR fresh)"""


@query("d18_rebased_tables", f"{REBASED} SELECT document_id, page, taken FROM taken")
def _rebased_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rebased(spark, sf_dir)[0].select("document_id", "page", "taken")


@query("d18_rebased_references", f"""{REBASED}, r AS ({REFERENCES.format('b')}) SELECT r.document_id, r.page, slot, ref, c.row_id AS new_ref FROM r JOIN taken USING (document_id, page) JOIN c ON c.document_id = r.document_id AND c.page = r.page AND c.col_no = 1 AND 'row' || c.row_no = slot WHERE taken = 'KEPT' AND kind = 'row'
UNION ALL SELECT r.document_id, r.page, slot, ref, c.cell_id FROM r JOIN taken USING (document_id, page) JOIN c ON c.document_id = r.document_id AND c.page = greatest(r.page - 1, 1) AND c.row_no IS NULL AND c.x = 3 WHERE taken = 'KEPT' AND kind = 'cell'""")
def _rebased_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rebased(spark, sf_dir)[1].select("document_id", "page", "slot", "ref", "new_ref")


#: the second reading by p: an amount lost, a row lost, an amount lost on a page not read whole, amount and balance lost
WORSE = READ.format(near="(1, '续', -1)", amount=f"CASE WHEN p % 9 IN (0, 2, 3) AND row_no = 4 THEN 'x' ELSE {AMOUNT} END", balance=f"CASE WHEN p % 9 = 3 AND row_no = 4 THEN 'x' ELSE {BALANCE} END", keep="(p % 9 <> 1 OR row_no <> 4)")
BACKED = f"""{ORACLE}, {SHEETS}, s AS (SELECT *, p % 9 AS q FROM sheets), o AS (SELECT a.document_id, a.page, a.row_no AS i, b.row_no AS j FROM s a JOIN s b USING (document_id, page) WHERE a.balance IS NOT NULL AND b.balance IS NOT NULL AND a.d = b.d AND ((abs(a.amount) = abs(b.amount) AND a.balance = b.balance) OR (abs(a.amount) = abs(b.balance) AND a.balance = b.amount))),
one AS (SELECT *, count(*) OVER (PARTITION BY document_id, page, i) AS x, count(*) OVER (PARTITION BY document_id, page, j) AS y FROM o), old AS (SELECT document_id, page, i, j FROM one WHERE x = 1 AND y = 1),
n AS (SELECT o.* FROM o JOIN pages USING (document_id, page) WHERE NOT (p % 9 <= 3 AND j = 4)), two AS (SELECT *, count(*) OVER (PARTITION BY document_id, page, i) AS x, count(*) OVER (PARTITION BY document_id, page, j) AS y FROM n), new AS (SELECT document_id, page, i, j FROM two WHERE x = 1 AND y = 1),
lost AS (SELECT * FROM old ANTI JOIN new USING (document_id, page, i)), size AS (SELECT document_id, page, p % 9 AS q, count(*) AS rows FROM sheets GROUP BY 1, 2, 3),
f AS (SELECT document_id, page, q, rows, (SELECT count(*) FROM old x WHERE x.document_id = z.document_id AND x.page = z.page) AS n_before, (SELECT count(*) FROM new x WHERE x.document_id = z.document_id AND x.page = z.page) AS n_after, (SELECT count(*) FROM lost x WHERE x.document_id = z.document_id AND x.page = z.page) AS n_lost,
  (SELECT count(*) FROM old x JOIN new y USING (document_id, page, i) WHERE x.document_id = z.document_id AND x.page = z.page AND x.j = y.j) AS steady, (SELECT count(*) FROM old x JOIN new y USING (document_id, page, i) WHERE x.document_id = z.document_id AND x.page = z.page AND x.j <> y.j) AS moved FROM size z),
g AS (SELECT *, CASE WHEN n_lost = 0 THEN 'REPLACED' WHEN q = 0 AND rows >= 4 AND steady >= 3 AND moved = 0 AND NOT EXISTS (SELECT 1 FROM lost l WHERE l.document_id = f.document_id AND l.page = f.page AND l.j <> 4) THEN 'REPLACED_IN_PART' ELSE 'RETAINED' END AS decision FROM f)"""


def _reread(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    before, after, readings, complete = _tables(spark, sf_dir, NUMBERED.format(FIRST), NUMBERED.format(WORSE), f"SELECT document_id, page, row_no AS reading_row, d AS date, {AMOUNT} AS amount, {BALANCE} AS balance FROM sheets", "SELECT document_id, page FROM pages WHERE p % 9 <> 2")
    return recovery.reread_pages(before, after, readings, complete)


@query("d11_reread_pages", f"{BACKED} SELECT document_id, page, decision, n_before, n_after, n_lost FROM g")
def _reread_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reread(spark, sf_dir)[0]


@query("d11_retained_rows", f"{BACKED} SELECT document_id, page, 1 AS table_no, j AS row_no FROM lost JOIN g USING (document_id, page) WHERE decision = 'REPLACED_IN_PART'")
def _retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reread(spark, sf_dir)[1]


CODES = "INDEPENDENT_VALUE_CONFLICT INDEPENDENT_ROW_UNMATCHED SOURCE_BALANCE_DISCONTINUITY INDEPENDENT_PAGE_INCOMPLETE INDEPENDENT_SOURCE_UNCERTAIN UNASSIGNED_SOURCE_ROW OUTSIDE_TRANSACTION_SOURCES".split()
ISSUE_FIELDS = "amount balance bank_name account_number counterparty_name".split()
ISSUES = f"""SELECT document_id, page, CASE cast(k % 7 AS int) {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES))} END AS code, CASE WHEN k % 7 IN (0, 4, 6) THEN CASE cast(k % 5 AS int) {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(ISSUE_FIELDS))} END END AS field,
CASE WHEN k % 17 = 0 THEN 'ADVISORY' ELSE 'REQUIRED' END AS severity, k AS out_no FROM sheets WHERE k % 3 = 0"""
PLANNED = "SELECT document_id, page, r::INT AS rank, CASE WHEN r <= {0} THEN 'SELECTED' ELSE 'DEFERRED' END AS state, reasons FROM ranked"


def _plan(plan, spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return plan(*_tables(spark, sf_dir, ISSUES, *more)).withColumn("reasons", F.array_join("reasons", ","))


@query("d14_primary_plan", f"""{ORACLE}, {SHEETS}, i AS ({ISSUES}), w AS (SELECT *, code IN ('INDEPENDENT_ROW_UNMATCHED', 'UNASSIGNED_SOURCE_ROW') AS s FROM i WHERE severity <> 'ADVISORY' AND (code IN ('INDEPENDENT_ROW_UNMATCHED', 'UNASSIGNED_SOURCE_ROW', 'INDEPENDENT_PAGE_INCOMPLETE', 'SOURCE_BALANCE_DISCONTINUITY') OR (code = 'INDEPENDENT_VALUE_CONFLICT' AND field IN ('amount', 'balance', 'account_number')))),
g AS (SELECT document_id, page, bool_or(s) AS s, count(DISTINCT out_no) AS n, string_agg(DISTINCT code, ',' ORDER BY code) AS reasons FROM w GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY s DESC, n DESC, page) AS r FROM g) {PLANNED.format(6)}""")
def _primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(recovery.primary_plan, spark, sf_dir)


@query("d14_account_plan", f"""{ORACLE}, {SHEETS}, i AS ({ISSUES}), d AS (SELECT document_id, page, code, 1 AS d FROM i JOIN pages USING (document_id, page) WHERE severity <> 'ADVISORY' AND field IN ('account_number', 'bank_name') AND p % 6 <> 0),
a AS (SELECT * FROM d UNION ALL SELECT document_id, page, 'ACCOUNT_INVENTORY_SUPPORTS_DISPUTED_OWNER', 0 FROM pages WHERE p % 4 = 0 AND p % 6 <> 0 AND document_id IN (SELECT document_id FROM d)),
g AS (SELECT document_id, page, max(d) AS d, string_agg(DISTINCT code, ',' ORDER BY code) AS reasons FROM a GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY d DESC, page) AS r FROM g) {PLANNED.format(12)}""")
def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(recovery.account_plan, spark, sf_dir, "SELECT document_id, page FROM pages WHERE p % 4 = 0", "SELECT document_id, page FROM pages WHERE p % 6 = 0")


@query("d14_critical_plan", f"""{ORACLE}, {SHEETS}, i AS ({ISSUES}), g AS (SELECT document_id, page, string_agg(DISTINCT code || ':' || field, ',' ORDER BY code || ':' || field) AS reasons FROM i WHERE severity <> 'ADVISORY' AND code IN ('INDEPENDENT_VALUE_CONFLICT', 'INDEPENDENT_SOURCE_UNCERTAIN') AND field <> 'bank_name' GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page) AS r FROM g) {PLANNED.format(12)}""")
def _critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(recovery.critical_plan, spark, sf_dir)


VALUES = {"account_number": "document_id", "transaction_date": "d", "direction": "direction", "amount": "cast(amount AS string)", "balance": "coalesce(cast(balance AS string), '')", "counterparty_name": "party", "counterparty_account": "CASE WHEN k % 2 = 0 THEN '' ELSE party_account END"}
#: (k %, field, what the reading gives, whether it doubts)
ONE = {"amount": "CASE WHEN k % 5 = 0 THEN concat(v, '9') ELSE v END", "balance": "CASE WHEN k % 7 = 0 THEN '' ELSE v END", "counterparty_name": "CASE WHEN k % 4 = 0 THEN '某' ELSE v END"}
TWO = {"amount": "CASE WHEN k % 25 = 0 THEN '1' ELSE v END", "direction": "CASE WHEN k % 6 = 0 THEN 'IN' ELSE v END", "transaction_date": "CASE WHEN k % 12 = 0 THEN '' ELSE v END", "account_number": "CASE WHEN k % 24 = 0 THEN '6' ELSE v END"}
LONG = " UNION ALL ".join(f"SELECT document_id, page, page * 100 + row_no AS out_no, k, '{f}' AS field, {v} AS v FROM sheets" for f, v in VALUES.items())
CASES = lambda given: "CASE field " + " ".join(f"WHEN '{f}' THEN {v}" for f, v in given.items()) + " ELSE v END"
DOUBTS_1, DOUBTS_2 = "(field = 'direction' AND k % 9 = 0)", "(field = 'amount' AND k % 35 = 0)"
USABLE = "SELECT document_id, page, count(*) AS n_rows, count(*) AS first_rows, count(*) - CASE WHEN page % 10 = 3 THEN 1 ELSE 0 END AS second_rows, page % 8 <> 5 AS usable FROM sheets GROUP BY document_id, page"


@query("d13_critical_fields", f"""{ORACLE}, {SHEETS}, l AS ({LONG}), u AS ({USABLE}), m AS (SELECT *, {CASES(ONE)} AS one, {CASES(TWO)} AS two, {DOUBTS_1} AS d1, {DOUBTS_2} AS d2 FROM l),
a AS (SELECT *, v <> '' AND v = two AND NOT d2 AS same, sum(CASE WHEN v <> '' AND v = two AND NOT d2 AND field <> 'counterparty_name' THEN 1 ELSE 0 END) OVER w AS n, bool_or(field = 'counterparty_account' AND (v <> '' OR one <> '' OR two <> '')) OVER w AS party FROM m WINDOW w AS (PARTITION BY document_id, page, out_no))
SELECT document_id, page, out_no, field, one AS before, v AS after FROM a JOIN u USING (document_id, page) WHERE usable AND n_rows = second_rows AND same AND (d1 OR one <> v) AND k % 11 <> 0 AND n - CASE WHEN field <> 'counterparty_name' THEN 1 ELSE 0 END >= 3 AND (field <> 'counterparty_name' OR NOT party)""")
def _critical_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pages = _tables(spark, sf_dir, LONG, USABLE)
    reading = lambda given, doubted: rows.select("document_id", "page", "out_no", "field", F.expr(CASES(given)).alias("value"), F.expr(doubted).alias("doubted"))
    return recovery.critical_fields(rows.select("document_id", "page", "out_no", "field", F.col("v").alias("value"), (F.col("k") % 11 != 0).alias("proven")), reading(ONE, DOUBTS_1), reading(TWO, DOUBTS_2), pages)


#: wanted rows: as printed, with the amount as balance too, or another balance
WANTED = "SELECT document_id, k AS item, amount AS amount_cents, CASE WHEN k % 4 = 0 THEN amount WHEN k % 4 = 1 THEN coalesce(balance, 0) + 1 ELSE balance END AS balance_cents FROM (SELECT *, row_number() OVER (PARTITION BY document_id, k ORDER BY page, row_no) AS nth FROM sheets) AS s WHERE nth = 1 AND (k % 4 < 2 OR balance IS NOT NULL)"
TWICE = READ.format(near="(1, '续', -1)", amount=AMOUNT, balance=f"CASE WHEN k % 8 = 0 THEN {AMOUNT} ELSE {BALANCE} END", keep="true")


@query("a12c_cell_evidence", f"""{ORACLE}, {SHEETS}, w AS ({WANTED}), c AS (SELECT *, CASE WHEN k % 8 = 0 THEN amount ELSE balance END AS shown FROM sheets),
h AS (SELECT w.document_id, item, min((page, row_no)) AS place FROM w JOIN c ON c.document_id = w.document_id AND ((abs(c.amount) = amount_cents AND shown = balance_cents) OR (abs(shown) = amount_cents AND c.amount = balance_cents)) GROUP BY 1, 2)
SELECT document_id, item, place[1] AS page, place[2] AS row_no, place IS NOT NULL AS found FROM w LEFT JOIN h USING (document_id, item)""")
def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, cells = _tables(spark, sf_dir, WANTED, NUMBERED.format(TWICE))
    return recovery.cell_evidence(wanted, cells).drop("table_no")
