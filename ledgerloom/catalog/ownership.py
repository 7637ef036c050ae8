"""Queries on whose account a row belongs to, over the printed ledger in pages of five rows of one account."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import ownership, pages
from ..plans import demo_ledger
from ..plans.storage import written
from .registry import query
from .sequences import PAGES

DOC = "case_id, source_document_id"
#: the same texts for Spark and DuckDB: a is the account's number, nth its page's place, holder a name without digits
SHEETS = """SELECT case_id, source_document_id, account_number, account_name, bank_name, id, seq, row_index, k, direction, amount_cents, balance_cents, transaction_date, a, nth, a * 1000 + nth AS page,
CASE cast(a % 5 AS int) WHEN 0 THEN '张三' WHEN 1 THEN '李四' WHEN 2 THEN '王五' WHEN 3 THEN '赵六' ELSE '钱七' END AS holder FROM (SELECT *, cast(substr(account_number, 5) AS bigint) AS a, (page - 1) * 4 + cast((row_index - 1 - (row_index - 1) % 5) / 5 AS int) + 1 AS nth FROM printed) AS numbered"""
SQL = f"{PAGES}, sheets AS ({SHEETS})"

LOCAL = "SELECT case_id, source_document_id, CASE WHEN a % 2 = 0 THEN substr(account_number, 4) ELSE account_number END AS account_number, account_name, id, page, row_index, seq, transaction_date, balance_cents, k FROM sheets"
LASTS = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {DOC}, account_number ORDER BY transaction_date DESC, page DESC, row_index DESC, seq DESC) AS r FROM sheets WHERE balance_cents IS NOT NULL) AS ranked WHERE r = 1"
INVENTORY = f"""SELECT {DOC}, account_number, account_name, CASE WHEN a % 5 = 0 THEN balance_cents + 1 ELSE balance_cents END AS balance_cents, cast(transaction_date + CASE WHEN a % 7 = 0 THEN -1 ELSE 1 END AS date) AS as_of, a % 8 <> 0 AS verified FROM ({LASTS}) AS l
UNION ALL SELECT {DOC}, '99' || substr(account_number, 4), account_name, balance_cents, transaction_date, true FROM ({LASTS}) AS l WHERE a % 6 = 0"""
MISREAD = f"""SELECT {DOC}, account_number, account_name, bank_name, id, page, transaction_date, direction, amount_cents, balance_cents, false AS reviewed FROM sheets
UNION ALL SELECT {DOC}, '7' || substr(account_number, 2), account_name, CASE WHEN a % 3 = 0 THEN '未知' WHEN a % 20 = 5 THEN 'OTHER' ELSE bank_name END, id || '_R', page + 1000000000, transaction_date, direction, CASE WHEN k % 4 = 0 AND a % 2 = 0 THEN amount_cents + 1 ELSE amount_cents END, balance_cents, a % 35 = 0 FROM sheets WHERE a % 5 = 0 AND source_document_id <> 'DOC_B'"""
READINGS = f"""SELECT DISTINCT {DOC}, page, page % 9 <> 0 AS complete, cast(page % 13 AS int) AS n_issues, CASE WHEN nth = 2 AND a % 10 = 0 THEN '光大银行' WHEN a % 4 = 0 THEN '工商银行' WHEN a % 4 = 1 THEN '建设银行成都分行' WHEN a % 4 = 2 THEN '商业银行' ELSE '中国农业银行' END AS bank,
CASE WHEN nth = 2 AND a % 10 = 1 THEN '孙八' WHEN a % 7 = 0 THEN holder || ',周九' WHEN a % 3 = 0 THEN holder || ',客户1,' || holder ELSE holder END AS names FROM sheets"""
NUMBERS = f"SELECT DISTINCT {DOC}, page, account_number AS number FROM sheets"
BANKS = f"""SELECT DISTINCT {DOC}, page, CASE WHEN a % 4 = 0 THEN '中国工商银行股份有限公司' WHEN a % 4 = 1 THEN '建设银行' WHEN a % 4 = 2 THEN '商业银行' ELSE '对账单' END AS text FROM sheets
UNION ALL SELECT DISTINCT {DOC}, page, '中国光大银行' FROM sheets WHERE nth = 2"""
OWNERS = f"""SELECT DISTINCT {DOC}, page, CASE cast(a % 6 AS int) WHEN 0 THEN '户名：' || named WHEN 1 THEN ' ' || named || ' ' WHEN 2 THEN named || '510101199001011234 卡号 ' || account_number WHEN 3 THEN '姓名 ' || named || ' 2024' WHEN 4 THEN named || ' ' || named ELSE '客户 ' || named END AS text
FROM (SELECT *, CASE WHEN nth = 2 AND a % 10 = 1 THEN '孙八' ELSE holder END AS named FROM sheets) AS n"""
UNNAMED = f"SELECT {DOC}, id, page, account_number, CASE cast(k % 3 AS int) WHEN 0 THEN '' WHEN 1 THEN holder || '510101199001011234' ELSE holder END AS account_name FROM sheets"
CLIPPED = f"SELECT {DOC}, id, page, CASE WHEN nth = 1 AND a % 3 = 0 THEN left(account_number, 10) ELSE account_number END AS account_number, a % 11 <> 0 AS direct_owner FROM sheets"
FULL = f"""SELECT DISTINCT {DOC}, page, CASE cast(a % 4 AS int) WHEN 0 THEN '卡号' || account_number || ' 日期20240101' WHEN 1 THEN account_number || ' 6222000000999999' WHEN 2 THEN substr(account_number, 1, 8) || ' ' || substr(account_number, 9) ELSE account_number END AS text FROM sheets"""
LISTED = f"SELECT DISTINCT {DOC}, page + 500 AS page, account_number AS number FROM sheets WHERE a % 5 <> 0"
BOXES = f"""SELECT {DOC}, id, page, row_index, seq, cast(k % 5 * 90 - 90 AS int) AS rotation, CASE cast(k % 4 AS int) WHEN 1 THEN 100.0 + row_index * 30 WHEN 2 THEN (100 + row_index * 30) / 1000.0 WHEN 3 THEN 0.5 END AS box_top, CASE cast(k % 4 AS int) WHEN 1 THEN 50.0 WHEN 2 THEN 0.05 WHEN 3 THEN 0.5 END AS box_left,
CASE cast(k % 4 AS int) WHEN 1 THEN 125.0 + row_index * 30 WHEN 2 THEN (125 + row_index * 30) / 1000.0 WHEN 3 THEN 0.503 END AS box_bottom, CASE cast(k % 4 AS int) WHEN 1 THEN 950.0 WHEN 2 THEN 0.95 WHEN 3 THEN 0.9 END AS box_right FROM sheets"""


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SHEETS.replace("FROM printed", "FROM {printed}"), printed=demo_ledger.printed(spark, sf_dir))


def _tables(spark: SparkSession, sf_dir: str, *texts: str) -> list[DataFrame]:
    sheets = written(_sheets(spark, sf_dir), "sheets")
    return [spark.sql(t.replace("FROM sheets", "FROM {sheets}"), sheets=sheets) for t in texts]


@query("j8_inventory_bindings", f"""{SQL}, own AS ({LOCAL}), inventory AS ({INVENTORY}),
l AS (SELECT {DOC}, account_number, account_name, count(*) FILTER (balance_cents IS NOT NULL) AS n, arg_max(balance_cents, (transaction_date, page, row_index, seq)) FILTER (balance_cents IS NOT NULL) AS b, max(transaction_date) FILTER (balance_cents IS NOT NULL) AS d FROM own ANTI JOIN inventory USING ({DOC}, account_number) GROUP BY ALL HAVING n >= 2),
c AS (SELECT l.*, i.account_number AS chosen, verified FROM l JOIN inventory i ON l.case_id = i.case_id AND l.source_document_id = i.source_document_id AND l.account_name = i.account_name AND l.b = i.balance_cents AND i.as_of >= l.d AND suffix(i.account_number, l.account_number) AND length(i.account_number) - length(l.account_number) BETWEEN 1 AND 4),
g AS (SELECT {DOC}, account_number, account_name, count(DISTINCT chosen) AS n_choices, min(chosen) AS chosen, bool_or(verified) AS verified FROM c GROUP BY ALL),
s AS (SELECT {DOC}, account_number, account_name, count(*) AS n FROM own WHERE k % 4 = 0 GROUP BY ALL),
r AS (SELECT g.*, CASE WHEN n_choices > 1 THEN 'MULTIPLE_FULL_ACCOUNT_CANDIDATES' WHEN NOT verified OR coalesce(n, 0) < 2 THEN 'FULL_ACCOUNT_NOT_INDEPENDENTLY_CONFIRMED' END AS reason FROM g LEFT JOIN s USING ({DOC}, account_number, account_name))
SELECT {DOC}, account_number, account_name, CASE WHEN reason IS NULL THEN chosen END AS bound_account, n_choices, reason FROM r""")
def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, inventory = _tables(spark, sf_dir, LOCAL, INVENTORY)
    return ownership.inventory_bindings(rows, inventory, rows.where("k % 4 = 0").select("case_id", "source_document_id", "page", "account_number"))


@query("j10_misread_accounts", f"""{SQL}, r AS ({MISREAD}), listed AS (SELECT DISTINCT case_id, account_number AS target, account_name FROM account),
g AS (SELECT case_id, account_number, count(*) AS n FROM r GROUP BY ALL HAVING NOT bool_or(reviewed)), free AS (SELECT * FROM g ANTI JOIN (SELECT case_id, target AS account_number FROM listed) USING (case_id, account_number)),
near AS (SELECT f.case_id, f.account_number, f.n, target, account_name FROM free f JOIN listed l ON l.case_id = f.case_id AND length(target) = length(f.account_number) AND CASE WHEN length(target) = length(f.account_number) THEN hamming(target, f.account_number) = 1 END),
u AS (SELECT *, count(*) OVER (PARTITION BY case_id, account_number, transaction_date, direction, amount_cents, balance_cents) AS alike FROM r WHERE direction <> 'UNKNOWN' AND balance_cents IS NOT NULL),
m AS (SELECT n.case_id, n.account_number, n.n, target, a.id, a.transaction_date FROM near n JOIN u a ON a.case_id = n.case_id AND a.account_number = n.account_number AND a.account_name = n.account_name AND a.alike = 1 AND a.amount_cents > 0
  JOIN u b ON b.case_id = n.case_id AND b.account_number = target AND b.account_name = n.account_name AND b.source_document_id = a.source_document_id AND b.page <> a.page AND b.transaction_date = a.transaction_date AND b.direction = a.direction AND b.amount_cents = a.amount_cents AND b.balance_cents = a.balance_cents AND (a.bank_name = '未知' OR b.bank_name = '未知' OR a.bank_name = b.bank_name) GROUP BY ALL HAVING count(*) = 1),
e AS (SELECT case_id, account_number, target, count(*) AS n_matches FROM m GROUP BY case_id, account_number, target, n HAVING count(*) >= 3 AND count(*) >= 0.8 * n AND count(DISTINCT transaction_date) >= 2)
SELECT case_id, account_number, target AS listed_account, n_matches FROM e QUALIFY count(*) OVER (PARTITION BY case_id, account_number) = 1""")
def _misread(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rows,) = _tables(spark, sf_dir, MISREAD)
    return ownership.misread_accounts(rows, demo_ledger.accounts(spark, sf_dir))


_CANON = "CASE " + " ".join(f"WHEN regexp_matches({{c}}, '{p}') THEN '{name}'" for p, name in P.BANK_CELLS) + " ELSE trim({c}) END"


@query("j11_account_issuers", f"""{SQL}, readings AS ({READINGS}), numbers AS ({NUMBERS}), headers AS ({BANKS}),
x AS (SELECT {DOC}, page, {_CANON.format(c='bank')} AS bank FROM readings WHERE complete), h AS (SELECT DISTINCT {DOC}, page, {_CANON.format(c='text')} AS bank FROM headers WHERE contains(text, '银行'))
SELECT {DOC}, number AS account_number, min(bank) AS bank, count(DISTINCT page) AS n_pages FROM x JOIN h USING ({DOC}, page, bank) JOIN numbers USING ({DOC}, page) WHERE bank <> '商业银行' GROUP BY ALL HAVING count(DISTINCT bank) = 1""")
def _issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.account_issuers(*_tables(spark, sf_dir, READINGS, NUMBERS, BANKS))


@query("j12_owner_names", f"""{SQL}, readings AS ({READINGS}), numbers AS ({NUMBERS}), headers AS ({OWNERS}), rows AS ({UNNAMED}),
x AS (SELECT {DOC}, page, list_filter(list_distinct(string_split(names, ',')), lambda n: NOT regexp_matches(n, '[0-9]')) AS ns FROM readings WHERE complete AND n_issues = 0),
p AS (SELECT DISTINCT {DOC}, page, ns[1] AS owner_name FROM x JOIN headers USING ({DOC}, page) WHERE len(ns) = 1 AND (trim(text) = ns[1] OR text = '户名：' || ns[1] OR text = '姓名 ' || ns[1] || ' 2024' OR starts_with(text, ns[1] || '510101199001011234 '))),
c AS (SELECT {DOC}, number AS account_number, min(owner_name) AS owner_name FROM p JOIN numbers USING ({DOC}, page) GROUP BY ALL HAVING count(DISTINCT owner_name) = 1)
SELECT {DOC}, id, owner_name FROM rows JOIN c USING ({DOC}, account_number) WHERE account_name = '' OR account_name = owner_name || '510101199001011234'""")
def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, numbers, headers, rows = _tables(spark, sf_dir, READINGS, NUMBERS, OWNERS, UNNAMED)
    return ownership.owner_names(rows, readings.withColumn("names", F.split("names", ",")), numbers, headers)


@query("j13_printed_owner_prefixes", f"""{SQL}, rows AS ({CLIPPED}), headers AS ({FULL}), inventory AS ({LISTED}),
n AS (SELECT {DOC}, page, unnest(CASE WHEN len(regexp_extract_all(text, '[0-9]{{12,32}}')) > 0 THEN regexp_extract_all(text, '[0-9]{{12,32}}') ELSE [replace(text, ' ', '')] END) AS number FROM headers),
c AS (SELECT r.case_id, r.source_document_id, r.page, r.id, min(number) AS full_number FROM rows r JOIN n USING ({DOC}, page) WHERE direct_owner AND length(r.account_number) BETWEEN 8 AND 11 AND starts_with(number, r.account_number) GROUP BY ALL HAVING count(DISTINCT number) = 1)
SELECT {DOC}, id, full_number FROM c WHERE EXISTS (SELECT 1 FROM rows r WHERE r.case_id = c.case_id AND r.source_document_id = c.source_document_id AND r.account_number = c.full_number AND r.page <> c.page AND r.direct_owner)
AND EXISTS (SELECT 1 FROM inventory i WHERE i.case_id = c.case_id AND i.source_document_id = c.source_document_id AND i.number = c.full_number AND i.page <> c.page)""")
def _prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.printed_owner_prefixes(*_tables(spark, sf_dir, CLIPPED, FULL, LISTED))


_BOX = "x, y, width, height"


@query("source_regions", f"""{SQL}, b AS ({BOXES}), s AS (SELECT *, CASE WHEN greatest(box_top, box_left, box_bottom, box_right) > 1 THEN 1000.0 ELSE 1.0 END AS d, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY {DOC}, page) AS m FROM b WINDOW w AS (PARTITION BY {DOC}, page ORDER BY row_index, seq)),
c AS (SELECT *, box_left::DOUBLE / d AS bx, box_top::DOUBLE / d AS by_, (least(box_right::DOUBLE / d, 1) - box_left::DOUBLE / d) AS bw, (least(box_bottom::DOUBLE / d, 1) - box_top::DOUBLE / d) AS bh FROM s),
p AS (SELECT *, coalesce(bw >= 0.03 AND bh >= 0.005, false) AS boxed FROM c),
r AS (SELECT {DOC}, id, (rotation + 360) % 360 AS turn, CASE WHEN boxed THEN 'MODEL' ELSE 'ESTIMATED' END AS origin, CASE WHEN boxed THEN 0.8::DOUBLE ELSE 0.25::DOUBLE END AS confidence, CASE WHEN boxed THEN bx ELSE 0.025 END AS x, CASE WHEN boxed THEN by_ ELSE least(0.96, 0.16 + n * 0.77 / m) END AS y,
  CASE WHEN boxed THEN bw ELSE 0.95 END AS w, CASE WHEN boxed THEN greatest(bh, 0.008) ELSE greatest(0.018, least(0.09, 0.77 / m)) END AS h FROM p)
SELECT {DOC}, id, origin, confidence, round((CASE turn WHEN 90 THEN 1 - y - h WHEN 180 THEN 1 - x - w WHEN 270 THEN y ELSE x END)::DOUBLE, 6) AS x, round((CASE turn WHEN 90 THEN x WHEN 180 THEN 1 - y - h WHEN 270 THEN 1 - x - w ELSE y END)::DOUBLE, 6) AS y,
  round((CASE WHEN turn IN (90, 270) THEN h ELSE w END)::DOUBLE, 6) AS width, round((CASE WHEN turn IN (90, 270) THEN w ELSE h END)::DOUBLE, 6) AS height FROM r""")
def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rows,) = _tables(spark, sf_dir, BOXES)
    sides = [F.col(f"box_{s}").cast("double") for s in ("top", "left", "bottom", "right")]
    found = ownership.source_regions(rows.withColumn("box", F.when(F.col("box_top").isNotNull(), F.array(*sides))))
    return found.select("case_id", "source_document_id", "id", "region.origin", "region.confidence", *[F.round(f"region.{c}", 6).alias(c) for c in _BOX.split(", ")])


#: every account's list and its pages under a clipped number, which miss or misread some rows
VIEWS = f"""SELECT {DOC}, id, account_number, true AS direct_owner, CASE WHEN a % 9 = 0 THEN 'credit' ELSE 'deposit' END AS account_kind, transaction_date, direction, amount_cents, balance_cents FROM sheets
UNION ALL SELECT {DOC}, id || '_V', substr(account_number, 4), false, CASE WHEN a % 27 = 0 THEN 'deposit' WHEN a % 9 = 0 THEN 'credit' ELSE 'deposit' END, transaction_date, direction, CASE WHEN k % 9 = 0 THEN amount_cents + 1 ELSE amount_cents END, balance_cents FROM sheets WHERE k % 7 <> 0"""
_SIG = "transaction_date, direction, amount_cents, balance_cents"


@query("j16_duplicate_views", f"""{SQL}, v AS ({VIEWS}), n AS (SELECT *, count(*) OVER (PARTITION BY {DOC}, account_kind, account_number, direct_owner) AS size, count(*) OVER (PARTITION BY {DOC}, account_kind, account_number, direct_owner, {_SIG}) AS alike FROM v)
SELECT {DOC}, account_kind, l.account_number AS left_account, r.account_number AS right_account, count(*) AS anchors, count(DISTINCT transaction_date) AS dates FROM (FROM n WHERE direct_owner AND alike = 1) l JOIN (FROM n WHERE NOT direct_owner AND alike = 1) r USING ({DOC}, account_kind, {_SIG})
GROUP BY {DOC}, account_kind, l.account_number, r.account_number, l.size, r.size HAVING count(*) >= 3 AND count(DISTINCT transaction_date) >= 2 AND count(*) >= 0.8 * least(l.size, r.size)""")
def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rows,) = _tables(spark, sf_dir, VIEWS)
    return ownership.duplicate_views(rows)


#: pages in the order of their accounts; some without quotes, sure or not, some described twice; lists of accounts are comma texts
DESCRIBED = f"""SELECT {DOC}, dense_rank() OVER (PARTITION BY {DOC} ORDER BY page) AS page, CASE WHEN page % 17 = 0 THEN 'UNKNOWN' WHEN nth = 1 AND a % 4 = 0 THEN 'ACCOUNT_INFO' ELSE 'TRANSACTIONS' END AS type, CASE WHEN nth > 1 OR a % 3 = 0 THEN 'CONTINUE' ELSE 'NEW' END AS relation, CASE WHEN page % 11 = 0 THEN cast(0.8 AS double) ELSE cast(0.95 AS double) END AS confidence,
cast(CASE WHEN page % 13 = 0 THEN 1 ELSE 0 END AS int) AS n_issues, CASE WHEN page % 5 = 0 THEN '' WHEN page % 2 = 0 THEN '中国' || bank_name ELSE bank_name END AS bank, CASE WHEN nth = 1 AND a % 10 = 0 THEN account_number || ',9' WHEN nth > 1 AND page % 3 = 0 THEN '' ELSE account_number END AS accounts, page % 7 = 0 AS unquoted, page % 19 = 0 AS twice
FROM (SELECT DISTINCT {DOC}, page, nth, a, account_number, bank_name FROM sheets) AS p"""


@query("w18_statement_groups", f"""{SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, d AS ({DESCRIBED}),
p AS (SELECT {DOC}, page, CASE WHEN twice THEN 'UNKNOWN' ELSE type END AS type, CASE WHEN twice THEN '' ELSE relation END AS relation, CASE WHEN twice THEN 0 ELSE confidence END AS confidence, CASE WHEN twice THEN 1 ELSE n_issues END AS n_issues, CASE WHEN twice THEN '' ELSE replace(bank, '中国', '') END AS bank, CASE WHEN twice OR accounts = '' THEN [] ELSE string_split(accounts, ',') END AS accounts, unquoted FROM d),
fold AS (SELECT {DOC}, 0::BIGINT AS page, 0::BIGINT AS start, false AS leads, '' AS bank, []::VARCHAR[] AS accounts, false AS conflict, false AS doubt FROM p WHERE page = 1
  UNION ALL SELECT case_id, source_document_id, page, CASE WHEN on_ THEN start ELSE page END, type IN ('TRANSACTIONS', 'ACCOUNT_INFO') AND confidence >= 0.9 AND n_issues = 0 AND NOT (clash AND relation = 'CONTINUE'), CASE WHEN on_ AND gbank <> '' THEN gbank ELSE bank END, CASE WHEN on_ AND len(gaccounts) > 0 THEN gaccounts ELSE accounts END,
    clash AND relation = 'CONTINUE', (type = 'UNKNOWN' AND NOT on_) OR len(accounts) = 0 OR n_issues > 0 OR (clash AND relation = 'CONTINUE') FROM (
    SELECT *, type = 'TRANSACTIONS' AND relation = 'CONTINUE' AND confidence >= 0.9 AND n_issues = 0 AND NOT unquoted AND len(accounts) <= 1 AND leads AND len(gaccounts) <= 1 AND NOT clash AS on_ FROM (
      SELECT x.*, s.start, s.leads, s.bank AS gbank, s.accounts AS gaccounts, (x.bank <> '' AND s.bank <> '' AND x.bank <> s.bank) OR (len(x.accounts) > 0 AND len(s.accounts) > 0 AND NOT list_has_all(s.accounts, x.accounts)) AS clash
      FROM fold s JOIN p x ON x.case_id = s.case_id AND x.source_document_id = s.source_document_id AND x.page = s.page + 1)))
SELECT {DOC}, page, start AS statement_page, conflict, bool_or(doubt) OVER (PARTITION BY {DOC}, start) AS needs_review FROM fold WHERE page > 0""")
def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = written(spark.sql(DESCRIBED.replace("FROM sheets", "FROM {sheets}"), sheets=_sheets(spark, sf_dir)), "described")
    lists = described.withColumns({"accounts": F.filter(F.split("accounts", ","), lambda x: x != ""), "quoted_pages": F.when(F.col("unquoted"), F.array("page")).otherwise(F.array(F.col("page"), F.col("page") - 1))})
    second = lists.where("twice").withColumn("relation", F.lit("NEW"))
    return pages.statement_groups(lists.unionByName(second).withColumn("page", F.col("page").cast("long")))


#: what a row says of its account, and what the document's list says: by the account's number a and the order's key k
SAID = f"""SELECT {DOC}, id, CASE WHEN k % 41 = 0 THEN '123' WHEN a % 3 = 1 THEN substr(account_number, 1 + cast(k % 5 AS int)) ELSE account_number END AS account_number, CASE WHEN k % 7 = 0 THEN '未知' ELSE holder END AS account_name,
CASE cast(k % 4 AS int) WHEN 0 THEN '' WHEN 1 THEN '工商银行' WHEN 2 THEN '商业银行' ELSE '建设银行' END AS bank_name, a, k, account_number AS whole, holder FROM sheets"""
ACCOUNT_LIST = f"""SELECT DISTINCT {DOC}, 1 AS page, account_number, holder AS account_name, CASE WHEN a % 2 = 0 THEN '中国工商银行股份有限公司' ELSE '' END AS bank_name FROM sheets WHERE a % 10 <> 9
UNION ALL SELECT DISTINCT {DOC}, 2, account_number, holder, '建设银行' FROM sheets WHERE a % 10 <> 9 AND a % 8 = 0 UNION ALL SELECT DISTINCT {DOC}, 3, '7' || substr(account_number, 2), holder, '' FROM sheets WHERE a % 10 <> 9 AND a % 6 = 1"""


@query("j9_document_owners", f"""{SQL}, said AS ({SAID}), listed AS ({ACCOUNT_LIST}),
last AS (SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY {DOC}, account_number ORDER BY page DESC) = 1),
x AS (SELECT {DOC}, id, l.account_number AS f, page, l.bank_name AS lb, 'EXACT' AS how FROM said s JOIN last l USING ({DOC}, account_number) WHERE length(s.account_number) >= 8),
y AS (SELECT s.case_id, s.source_document_id, id, l.account_number AS f, page, l.bank_name AS lb, 'SUFFIX' AS how FROM said s JOIN last l ON s.case_id = l.case_id AND s.source_document_id = l.source_document_id AND s.account_name = l.account_name AND suffix(l.account_number, s.account_number) AND length(l.account_number) - length(s.account_number) BETWEEN 1 AND 4
  WHERE length(s.account_number) >= 12 AND s.account_name <> '未知' AND NOT EXISTS (SELECT 1 FROM x WHERE x.case_id = s.case_id AND x.source_document_id = s.source_document_id AND x.id = s.id)),
g AS (SELECT {DOC}, id, count(DISTINCT f) AS n, max(f) AS f, arg_max(page, (page, f)) AS page, arg_max(lb, (page, f)) AS lb, min(how) AS how FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY ALL),
z AS (SELECT s.*, n, g.page AS listed_page, lb, f, CASE WHEN length(s.account_number) < 8 THEN 'UNRELIABLE' WHEN n IS NULL THEN 'NONE' WHEN n > 1 THEN 'AMBIGUOUS' ELSE how END AS outcome FROM said s LEFT JOIN g USING ({DOC}, id)),
w AS (SELECT *, CASE WHEN n = 1 AND bank_name IN ('', '商业银行') AND lb <> '' THEN 'FILLED' WHEN n = 1 AND bank_name NOT IN ('', '商业银行') AND lb <> '' AND (bank_name = '工商银行') <> (lb LIKE '%工商%') THEN 'CONFLICT' END AS bank_outcome FROM z)
SELECT {DOC}, id, CASE WHEN n = 1 THEN f ELSE account_number END AS account_number, CASE bank_outcome WHEN 'FILLED' THEN lb WHEN 'CONFLICT' THEN '待核验银行' ELSE bank_name END AS bank_name, outcome, bank_outcome, CASE WHEN n = 1 THEN listed_page END AS inventory_page FROM w""")
def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.resolved_owners(*_tables(spark, sf_dir, SAID, ACCOUNT_LIST))
