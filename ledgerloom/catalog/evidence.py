"""Queries on printed types, aliases, shared sources, repairs proved by text, and gates, derived from the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, patterns, printed
from ..operators import evidence, sequence
from ..plans import demo_ledger
from ..plans.demo_ledger import ORACLE
from ..plans.storage import written
from .paging import COSTS, DOC, _typed
from .registry import query

#: description and purpose of every so many rows
PRINTED = (
    ("信用卡还款", ""), ("转账", "归还贷款"), ("信用卡还款", "贷款本息"), ("消费", "花呗还款"), ("还款", ""), ("自动还款", ""), ("分期付款退货", ""), ("消费退货", ""), ("退款", ""),
    ("电费", ""), ("住房公积金对公12", ""), ("实时代收", "中国电信股份有限公司四川分公司"), ("薪资-三月", ""), ("往来款", ""), ("", "往来款"), ("转账收入", "工资款"), ("小额普通", "代发工资业务待付结算款"),
    ("跨行转账", ""), ("超网汇兑来账", ""), ("汇兑往账（直通）", ""), ("存现", ""), ("柜面取现", ""), ("银联入账", ""), ("提现", "微信零钱提现"), ("快捷支付-商户", ""), ("快捷支付", ""), ("入金", "财付通支付"),
    ("充值", "支付宝余额充值"), ("结息", ""), ("入 息", ""), ("贷款放款--1", ""), ("还贷-", ""), ("AB1 还贷-", ""), ("个人贷款结息", ""), ("个人贷款", ""), ("账单分期", ""), ("分期付款利息", ""), ("网上消费", ""),
    ("消费转分期", ""), ("消费（利息）", ""), ("手续费", ""), ("扣划", ""), ("年费\n减免", ""), ("其他", "其他"), ("代发工资", "代发工资"), ("转账支出", ""), ("支付宝-消费", ""),
)


def _case(which: int) -> str:
    return f"CASE cast(row_index % {len(PRINTED)} AS int) " + " ".join(f"WHEN {i} THEN '{pair[which]}'" for i, pair in enumerate(PRINTED)) + " END"


#: the same text for Spark and DuckDB
DESCRIBED = f"""SELECT case_id, id, direction, CASE WHEN row_index % 5 = 0 THEN 'credit' ELSE 'deposit' END AS account_kind, {_case(0)} AS description, {_case(1)} AS purpose,
CASE WHEN row_index % 7 = 0 THEN '平安保险股份有限公司' ELSE counterparty_name END AS party, coalesce(counterparty_account, '') AS party_account FROM ledger"""
D = f"{ORACLE}, d0 AS ({DESCRIBED}), d AS (SELECT *, regexp_replace(description, '\\s|\\\\n', '', 'g') AS s, regexp_replace(purpose, '\\s|\\\\n', '', 'g') AS e FROM d0)"


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DESCRIBED.replace("FROM ledger", "FROM {ledger}"), ledger=demo_ledger.ledger(spark, sf_dir))


def _side_sql(ways: str, kind: str) -> list[str]:
    return [f"direction IN ({', '.join(repr(w) for w in ways.split())})"] * bool(ways) + [f"account_kind = '{kind}'"] * bool(kind)


def _printed_sql(column: int) -> str:
    whens = []
    for rule in patterns.PRINTED_RULES:
        holds = _side_sql(rule[2], rule[3]) + [f"regexp_matches(s, '{rule[4]}')"] * bool(rule[4]) + [f"(regexp_matches(s, '{x}') OR regexp_matches(e, '{x}'))" for x in rule[5]] + ["regexp_matches(party_account, '^[0-9]{8,32}$')"] * rule[6]
        if rule[1] == "PRINTED_REPAYMENT_KIND_UNRESOLVED":
            holds.append(f"NOT regexp_matches(s, '{patterns.KNOWN_REPAYMENT}')")
        whens.append(f"WHEN {' AND '.join(holds)} THEN '{rule[column]}'")
    return "CASE " + " ".join(whens) + " END"


def _described_sql() -> str:
    whens = ["WHEN regexp_matches(s, '消费') AND NOT regexp_matches(s, '转分期|利息') THEN '消费'"]
    for kind_of, ways, kind, described, party in reversed(patterns.DESCRIPTION_RULES):
        holds = _side_sql(ways, kind) + [f"regexp_matches(s, '{described}')"] * bool(described) + [f"regexp_matches(party, '{party}')"] * bool(party)
        whens.append(f"WHEN {' AND '.join(holds)} THEN '{kind_of}'")
    words = " ".join(f"WHEN s = '{a}' THEN '{b}'" for a, b in patterns.DESCRIBED_TYPES)
    return "CASE " + " ".join(whens) + " " + words + " END"


def _decided(value: Column) -> Column:
    """Only rows with a value: a filter on it would be pushed below and make the long expression twice."""
    return F.explode(F.array_compact(F.array(value)))


def _type_columns() -> tuple[Column, Column]:
    evidence_of = F.array("description", "purpose")
    return (
        printed.printed_type(F.col("description"), evidence_of, F.col("direction"), F.col("account_kind"), F.col("party_account")),
        printed.described_type(F.col("description"), F.col("direction"), F.col("account_kind"), F.col("party")),
    )


@query("printed_transaction_type", f"{D}, t AS (SELECT case_id, id, {_printed_sql(0)} AS type, {_printed_sql(1)} AS basis FROM d) SELECT *, basis = 'PRINTED_REPAYMENT_KIND_UNRESOLVED' AS review FROM t WHERE basis IS NOT NULL")
def _printed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _described(spark, sf_dir).select("case_id", "id", _decided(_type_columns()[0]).alias("t"))
    return found.select("case_id", "id", "t.type", "t.basis", "t.review")


@query("transaction_type_dictionary", f"""{D}, t AS (SELECT case_id, id, {_described_sql()} AS described, {_printed_sql(0)} AS p, {_printed_sql(1)} AS basis FROM d)
SELECT case_id, id, described, CASE WHEN basis IS NOT NULL AND NOT (basis = 'PRINTED_REPAYMENT_KIND_UNRESOLVED' AND p = '' AND described IS NOT NULL) THEN p ELSE described END AS type FROM t""")
def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, described = _type_columns()
    found = _described(spark, sf_dir).withColumns({"p": told, "described": described})
    return found.select("case_id", "id", "described", printed.transaction_type(F.col("described"), F.col("p")).alias("type"))


@query("auxiliary_purpose", f"""{D}, t AS (SELECT case_id, id, CASE WHEN direction = 'IN' AND s = '代发工资' THEN '工资收入' WHEN direction = 'IN' AND s = '银联入账' THEN '第三方支付' WHEN direction = 'OUT' AND s = '支付宝-消费' THEN '消费'
WHEN direction = 'IN' AND s = '转账收入' OR direction = 'OUT' AND s = '转账支出' THEN '账户转账' END AS type FROM d WHERE account_kind = 'deposit' AND {_described_sql()} IS NULL) SELECT * FROM t WHERE type IS NOT NULL""")
def _merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = printed.merchant_type(F.col("description"), F.col("direction"), F.col("account_kind"), _type_columns()[1])
    return _described(spark, sf_dir).select("case_id", "id", _decided(kind).alias("type"))


RULES = (("结息", "deposit", "存款结息"), ("转账", "any", "账户转账"), ("往来款", "any", "账户转账"), ("信用卡还款", "any", "信用卡还款"), ("贷款本息", "any", "贷款还款"), ("年费减免", "credit", "费用减免"), ("消费", "any", "消费"), ("花呗还款", "credit", "贷款还款"))


@query("type_from_rules", f"""{D}, r(t, k, type) AS (VALUES {', '.join(map(str, RULES))}), h AS (SELECT DISTINCT id, type FROM d JOIN r ON t IN (s, e) AND k IN ('any', account_kind)) SELECT id, min(type) AS type FROM h GROUP BY 1 HAVING count(*) = 1""")
def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "text string, account_kind string, type string")
    return evidence.types_from_rules(_described(spark, sf_dir).withColumn("descriptions", F.array("description", "purpose")), rules)


PARTIES = """SELECT case_id, id, CASE cast(row_index % 9 AS int) WHEN 0 THEN counterparty_name || '/' || coalesce(counterparty_account, '') WHEN 1 THEN coalesce(counterparty_account, '') || '｜' || counterparty_name WHEN 2 THEN coalesce(counterparty_account, '无')
WHEN 3 THEN counterparty_name WHEN 4 THEN '--' WHEN 5 THEN counterparty_name || '/' || counterparty_name WHEN 6 THEN counterparty_name || '/' || coalesce(counterparty_account, '') || '/1' WHEN 7 THEN '6222****0001/' ELSE NULL END AS cell,
counterparty_name AS n, coalesce(counterparty_account, '') AS a, row_index % 9 AS k FROM ledger"""


@query("split_party", f"""{ORACLE}, c AS ({PARTIES}) SELECT case_id, id, CASE WHEN k IN (4, 8) OR (k = 2 AND a = '') THEN '' WHEN k IN (0, 1) AND a <> '' OR k = 2 THEN a WHEN k = 7 THEN '6222****0001' END AS account,
CASE WHEN k IN (0, 1) AND a <> '' THEN n WHEN k IN (2, 4, 7, 8) THEN '' END AS name FROM c""")
def _parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.sql(PARTIES.replace("FROM ledger", "FROM {ledger}"), ledger=demo_ledger.ledger(spark, sf_dir))
    return cells.withColumn("p", printed.split_party("cell")).select("case_id", "id", "p.account", "p.name")


CLOCKS = """SELECT event_id, CASE cast(event_id % 5 AS int) WHEN 0 THEN cast(cast(ts AS date) AS string) || ' 09:15:30' WHEN 1 THEN '09:15' WHEN 2 THEN '091530' WHEN 3 THEN '09:16:30' END AS clock,
CASE cast(event_id % 4 AS int) WHEN 0 THEN cast(cast(ts AS date) AS string) WHEN 1 THEN replace(cast(cast(ts AS date) AS string), '-', '') WHEN 2 THEN replace(cast(cast(ts AS date) AS string), '-', '/') END AS day, cast(cast(ts AS date) AS string) AS d FROM events"""


@query("norm_timestamp", f"""WITH c AS ({CLOCKS}), t AS (SELECT *, CASE cast(event_id % 5 AS int) WHEN 0 THEN '09:15:30' WHEN 1 THEN '09:15' WHEN 3 THEN '09:16:30' ELSE '' END AS time_of_day FROM c)
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '9999-99-99' ELSE d END || ' ' || CASE cast(event_id % 5 AS int) WHEN 0 THEN '09:15:30' WHEN 1 THEN '09:15' WHEN 2 THEN '09:15:30' WHEN 3 THEN '09:16:30' ELSE '00:00:00' END AS stamp, time_of_day,
time_of_day IN ('', '09:15', '09:15:30') AS fits, CASE WHEN event_id % 4 = 0 THEN abs(date_diff('day', DATE '2024-01-15', d::DATE)) ELSE 0 END::INT AS days FROM t""")
def _stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(CLOCKS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    clock = printed.time_of_day("clock")
    return rows.select("event_id", printed.norm_timestamp("day", "clock").alias("stamp"), clock.alias("time_of_day"), printed.times_compatible(clock, F.lit("09:15:30")).alias("fits"), printed.days_between(F.col("day"), F.lit("2024-01-15")).cast("int").alias("days"))


BANKS = ("工行北京", "中国农业银行", "建行", "某建行", "光大银行", "绵商银行", "绵阳商业银行", "兴业银行股份有限公司", "重庆银行股份有限公司", "商业银行", "ABCDEFGH")
BANK_CELL = "CASE cast(row_index % 11 AS int) " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BANKS)) + " END"


@query("bank_names", f"""{ORACLE}, b(i, cell, header, key) AS (VALUES (0, '中国工商银行', '中国工商银行', '工行北京'), (1, '中国农业银行', '中国农业银行', '农业银行'), (2, '中国建设银行', '建行', '建行'), (3, '某建行', '某建行', '某建行'), (4, '中国光大银行', '中国光大银行', '光大银行'),
(5, '绵阳市商业银行', '绵商银行', '绵商银行'), (6, '绵阳市商业银行', '绵阳商业银行', '绵阳商业银行'), (7, '兴业银行', '兴业银行', '兴业银行'), (8, '重庆银行股份有限公司', '重庆银行', '重庆银行'), (9, '商业银行', '', '商业银行'), (10, 'ABCDEFGH', 'ABCDEFGH', 'ABCDEFGH'))
SELECT id, cell AS bank_name, header AS header_bank, key AS bank_key FROM ledger JOIN b ON i = row_index % 11""")
def _banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo_ledger.ledger(spark, sf_dir).withColumn("bank", F.expr(BANK_CELL))
    return rows.select("id", money.bank_name("bank").alias("bank_name"), money.header_bank("bank").alias("header_bank"), money.bank_key("bank").alias("bank_key"))


ALIASED = """SELECT case_id, source_document_id, account_number FROM account UNION ALL SELECT case_id, source_document_id, substr(account_number, 3) FROM account WHERE cast(substr(account_number, 5) AS bigint) % 7 = 0
UNION ALL SELECT case_id, source_document_id, substr(account_number, 6) FROM account WHERE cast(substr(account_number, 5) AS bigint) % 11 = 0 UNION ALL SELECT case_id, source_document_id, '9' || account_number FROM account WHERE cast(substr(account_number, 5) AS bigint) % 13 = 0
UNION ALL SELECT case_id, source_document_id, '8' || account_number FROM account WHERE cast(substr(account_number, 5) AS bigint) % 26 = 0"""


@query("j6_alias_accounts", f"""{ORACLE}, a AS (SELECT DISTINCT case_id, source_document_id, account_number AS n FROM ({ALIASED})),
h AS (SELECT a.case_id, a.source_document_id, a.n, b.n AS long FROM a JOIN a b USING (case_id, source_document_id) WHERE length(b.n) - length(a.n) BETWEEN 1 AND 4 AND length(a.n) >= 10 AND ends_with(b.n, a.n)),
t AS (SELECT * FROM h QUALIFY length(long) = max(length(long)) OVER (PARTITION BY case_id, source_document_id, n)), o AS (SELECT case_id, source_document_id, n, min(long) AS long FROM t GROUP BY ALL HAVING count(*) = 1)
SELECT case_id, source_document_id, n AS account_number, coalesce(long, n) AS canonical_number FROM a LEFT JOIN o USING (case_id, source_document_id, n)""")
def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.alias_accounts(spark.sql(ALIASED.replace("FROM account", "FROM {account}"), account=demo_ledger.accounts(spark, sf_dir)))


@query("j7_near_duplicate_accounts", f"""{ORACLE}, own AS (SELECT case_id, bank_name AS bank, account_number AS n FROM account UNION ALL SELECT case_id, bank_name, '7' || substr(account_number, 2) FROM account WHERE cast(substr(account_number, 5) AS bigint) % 5 = 0),
a AS (SELECT DISTINCT case_id, bank, n, right(n, 4) AS tail FROM own)
SELECT a.case_id, a.bank, a.n AS one, b.n AS other, levenshtein(a.n, b.n)::INT AS distance FROM a JOIN a b USING (case_id, bank, tail) WHERE a.n < b.n AND levenshtein(a.n, b.n) <= 2""")
def _near_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = demo_ledger.accounts(spark, sf_dir)
    misread = own.where("cast(substr(account_number, 5) as bigint) % 5 = 0").withColumn("account_number", F.concat(F.lit("7"), F.expr("substr(account_number, 2)")))
    return evidence.near_duplicate_accounts(own.unionByName(misread))


@query("j19_source_overlap", f"""{ORACLE}, rows AS (SELECT id AS row_id, unnest([source_document_id || ':' || page || ':' || case_id, case_id || ':' || account_number]) AS s FROM ledger),
alerts AS (SELECT DISTINCT 'A' || case_id || '_' || source_document_id || '_' || page AS alert_id, source_document_id || ':' || page || ':' || case_id AS s FROM ledger WHERE page % 10 = 1 UNION ALL SELECT DISTINCT 'B' || account_number, case_id || ':' || account_number FROM ledger WHERE row_index % 50 = 0)
SELECT DISTINCT alert_id, row_id FROM alerts JOIN rows USING (s)""")
def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo_ledger.ledger(spark, sf_dir)
    place, account = F.concat_ws(":", "source_document_id", "page", "case_id"), F.concat_ws(":", "case_id", "account_number")
    alerts = rows.where("page % 10 = 1").select(F.concat(F.lit("A"), F.concat_ws("_", "case_id", "source_document_id", "page")).alias("alert_id"), F.array(place).alias("sources"))
    more = rows.where("row_index % 50 = 0").select(F.concat(F.lit("B"), "account_number").alias("alert_id"), F.array(account).alias("sources"))
    return evidence.source_overlap(alerts.unionByName(more).distinct(), rows.select(F.col("id").alias("row_id"), F.array(place, account).alias("sources")))


@query("v1d_evidence_gaps", f"""{ORACLE} SELECT DISTINCT case_id, unnest(['核对流水 ' || account_number, '调取 ' || summary || ' 凭证']) AS gap FROM ledger WHERE amount_cents > 5000000""")
def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = demo_ledger.ledger(spark, sf_dir).where("amount_cents > 5000000")
    return evidence.evidence_gaps(hits.withColumn("checklist", F.array(F.concat(F.lit("核对流水 "), "account_number"), F.concat(F.lit("调取 "), "summary", F.lit(" 凭证")))))


#: amounts read from the summary instead of the amount's column
MISREAD = """SELECT case_id, source_document_id, account_number, bank_name, id, seq, page, row_index, direction, balance_cents, counterparty_name, transaction_type,
CASE WHEN row_index % 9 = 0 THEN amount_cents + 12300 ELSE amount_cents END AS amount_cents, CASE WHEN row_index % 27 = 0 THEN '透支' WHEN row_index % 9 = 0 THEN '单价' || cast((amount_cents + 12300 - (amount_cents + 12300) % 100) / 100 AS bigint) || '.' || lpad(cast((amount_cents + 12300) % 100 AS string), 2, '0') ELSE summary END AS summary,
'行 ' || cast((amount_cents - amount_cents % 100) / 100 AS bigint) || '.' || lpad(cast(amount_cents % 100 AS string), 2, '0') || ' 元' AS raw_text FROM single"""
SINGLE = """SELECT * EXCEPT (balance_cents), sum(CASE direction WHEN 'IN' THEN amount_cents WHEN 'OUT' THEN -amount_cents END) OVER (PARTITION BY case_id, source_document_id ORDER BY page, row_index, seq ROWS UNBOUNDED PRECEDING) + 100000000 AS balance_cents FROM ledger WHERE direction <> 'UNKNOWN'"""


@query("w8_amount_heal_summary", f"""{ORACLE}, single AS ({SINGLE.replace("EXCEPT", "EXCLUDE")}), m AS ({MISREAD}), b AS (SELECT *, lag(balance_cents) OVER (PARTITION BY case_id, source_document_id ORDER BY page, row_index, seq) AS before FROM m),
cards AS (SELECT case_id, source_document_id, account_number FROM m GROUP BY ALL HAVING count(*) FILTER (balance_cents < 0) >= ceil(count(*) / 2) AND count(*) FILTER (summary = '透支') >= least(2, count(*)))
SELECT case_id, id, amount_cents, (amount_cents - 12300)::BIGINT AS repaired_cents FROM b ANTI JOIN cards USING (case_id, source_document_id, account_number) WHERE before IS NOT NULL AND row_index % 9 = 0 AND row_index % 27 <> 0""")
def _heals(spark: SparkSession, sf_dir: str) -> DataFrame:
    single = spark.sql(SINGLE.replace("FROM ledger", "FROM {ledger}"), ledger=demo_ledger.ledger(spark, sf_dir))
    rows = written(spark.sql(MISREAD.replace("FROM single", "FROM {single}"), single=single), "misread")
    cards = sequence.credit_card_ledgers(rows).where("is_credit_card")
    return evidence.summary_heals(rows, cards).select("case_id", "id", "amount_cents", F.col("repaired_cents").cast("long").alias("repaired_cents"))


CHAIN = """SELECT case_id, source_document_id, account_number, id, seq, transaction_date, CASE WHEN summary = '结息' AND direction = 'IN' THEN 'UNKNOWN' ELSE direction END AS direction, amount_cents, summary,
CASE WHEN cast(substr(account_number, 5) AS bigint) % 6 = 0 THEN 'credit' ELSE 'deposit' END AS account_kind,
sum(CASE direction WHEN 'IN' THEN amount_cents ELSE -amount_cents END) OVER (PARTITION BY case_id, source_document_id, account_number ORDER BY transaction_date, seq ROWS UNBOUNDED PRECEDING) + CASE WHEN row_index % 41 = 0 THEN 1 ELSE 0 END AS balance_cents FROM firsts"""
FIRSTS = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, source_document_id, account_number, transaction_date ORDER BY seq) AS nth FROM ledger WHERE direction <> 'UNKNOWN') WHERE nth = 1"""


@query("w21_interest_direction_chain", f"""{ORACLE}, firsts AS ({FIRSTS}), c AS ({CHAIN}), s AS (SELECT *, balance_cents - lag(balance_cents) OVER w AS step, CASE WHEN direction = 'OUT' THEN -amount_cents ELSE amount_cents END AS adds FROM c WINDOW w AS (PARTITION BY case_id, source_document_id, account_number ORDER BY transaction_date, seq)),
g AS (SELECT case_id, source_document_id, account_number FROM s GROUP BY ALL HAVING count(*) >= 3 AND bool_and(coalesce(step = adds, true)) AND bool_and(account_kind = 'deposit')) SELECT case_id, id FROM s JOIN g USING (case_id, source_document_id, account_number) WHERE direction = 'UNKNOWN'""")
def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = spark.sql(FIRSTS.replace("FROM ledger", "FROM {ledger}"), ledger=demo_ledger.ledger(spark, sf_dir))
    return evidence.interest_chain_directions(spark.sql(CHAIN.replace("FROM firsts", "FROM {firsts}"), firsts=firsts))


#: two table rows for each statement row; some tables lack a continuation, some have two dates in a row
TABLE_ROWS = """SELECT account_number, seq * 2 + part AS row_no, CASE WHEN part = 0 OR (account_key % 8 = 0 AND seq % 40 = 0) THEN cast(transaction_date AS string) ELSE '' END AS date_text, CASE WHEN part = 0 OR (account_key % 8 = 0 AND seq % 40 = 0) THEN cast(amount_cents AS string) ELSE '续' END AS amount_text, account_key, seq, part
FROM (SELECT *, cast(substr(account_number, 5) AS bigint) AS account_key FROM ledger) CROSS JOIN parts WHERE NOT (part = 1 AND account_key % 4 = 1 AND seq % 24 = 0)"""


@query("w22_row_group_repair", f"""{ORACLE}, parts AS (SELECT unnest([0, 1]) AS part), r AS ({TABLE_ROWS}), o AS (SELECT *, row_number() OVER (PARTITION BY account_number ORDER BY row_no) AS n, lead(row_no) OVER (PARTITION BY account_number ORDER BY row_no) AS second_row FROM r),
g AS (SELECT account_number FROM o GROUP BY 1 HAVING count(*) % 2 = 0 AND bool_and((date_text <> '') = (n % 2 = 1))) SELECT account_number, row_no AS first_row, second_row FROM o JOIN g USING (account_number) WHERE n % 2 = 1""")
def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo_ledger.ledger(spark, sf_dir).withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    cells = spark.sql(TABLE_ROWS.replace("FROM ledger", "FROM {ledger}").replace(" CROSS JOIN parts", ""), ledger=rows)
    return evidence.row_pairs(cells, ["account_number"])


@query("business_accounts", f"{ORACLE} SELECT case_id, account_number FROM account WHERE NOT (owner_type = 'UNKNOWN' AND cast(substr(account_number, 5) AS bigint) % 9 = 2)")
def _business(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = demo_ledger.accounts(spark, sf_dir)
    key = F.expr("cast(substr(account_number, 5) as bigint)")
    marked = own.withColumns({"printed": F.col("account_number"), "account_number": F.when(key % 18 == 2, F.concat("account_number", F.lit("待处理页面"))).otherwise(F.col("account_number")), "account_name": F.when(key % 18 == 11, "待归属页面").otherwise(F.col("account_name"))})
    return evidence.business_accounts(marked).select("case_id", F.col("printed").alias("account_number"))


WARNINGS = """SELECT DISTINCT case_id, source_document_id AS document_id, CASE cast(page % 4 AS int) WHEN 0 THEN '第 ' || page || ' 页连续识别失败' WHEN 1 THEN '第' || page || '页余额不清' WHEN 2 THEN 'PDF 解析不完整：第' || page || '页' ELSE '未能完整获取' END AS warning, page FROM ledger"""


@query("recognition_gate", f"{ORACLE}, w AS ({WARNINGS}) SELECT DISTINCT case_id, document_id, page FROM w WHERE page % 4 IN (0, 2)")
def _incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.incomplete_pages(spark.sql(WARNINGS.replace("FROM ledger", "FROM {ledger}"), ledger=demo_ledger.ledger(spark, sf_dir)), ["case_id", "document_id"])


@query("recognition_gate_issues", f"{ORACLE}, w AS ({WARNINGS}) SELECT case_id, document_id, page FROM w WHERE page % 4 <> 1 AND page % 5 < 2 AND page % 3 > 0")
def _blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.sql(WARNINGS.replace("FROM ledger", "FROM {ledger}"), ledger=demo_ledger.ledger(spark, sf_dir))
    issues = told.withColumns({"category": F.lit("PAGE_INTEGRITY"), "severity": F.when(F.col("page") % 3 > 0, "REQUIRED").otherwise("OPTIONAL"), "status": F.element_at(F.array(*[F.lit(x) for x in ("PENDING", "UNRESOLVED", "RESOLVED", "CONFIRMED", "IGNORED")]), (F.col("page") % 5 + 1).cast("int")), "title": F.lit(None).cast("string"), "description": F.col("warning")})
    return evidence.blocking_issues(issues).select("case_id", "document_id", "page")


@query("page_blank_decision", f"""{COSTS} SELECT {DOC}, page, n_rows < 2 AS pixel_blank, page % 5 = 0 AND n_rows < 2 AND page % 2 = 0 AS blank_confirmed, CASE WHEN page % 5 = 0 OR page % 6 > 3 THEN 0 ELSE (page % 6) * 90 END AS clockwise_rotation, page % 5 <> 0 AND page % 6 > 3 AS orientation_uncertain FROM costs""")
def _blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _typed(spark, sf_dir).withColumns({"page_kind": F.expr("CASE WHEN page % 5 = 0 THEN 'blank' ELSE 'statement' END"), "dark_160": F.expr("n_rows * 0.00003"), "dark_210": F.expr("n_rows * 0.00006"), "has_text": F.expr("page % 2 = 1"), "upright": F.expr("element_at(array('A', 'B', 'C', 'D', '?', null), cast(page % 6 as int) + 1)")})
    return evidence.page_blank_decision(found).select("case_id", "document_id", "page", "pixel_blank", "blank_confirmed", "clockwise_rotation", "orientation_uncertain")


#: milestones of every account's case: some missing, some in the wrong order
TIMELINES = """SELECT account_number AS case_id, t0, CASE WHEN k % 5 = 0 THEN NULL ELSE t1 END AS t1, t2, CASE WHEN k % 3 = 0 THEN date '1997-06-01' ELSE t3 END AS t3, t4, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 2 = 0 THEN date '1998-06-01' ELSE date '2000-01-01' END AS t6, k
FROM (SELECT *, cast(substr(account_number, 5) AS bigint) AS k FROM account) JOIN legal_case USING (case_id)"""


@query("timeline_validate", f"""{ORACLE}, c AS ({TIMELINES}) SELECT case_id, 'T1 诉讼立案/财产保全日' AS problem FROM c WHERE k % 5 = 0 UNION ALL SELECT case_id, 'T6 执行和解协议签署日' FROM c WHERE k % 7 = 0
UNION ALL SELECT case_id, 't2>t3' FROM c WHERE k % 5 > 0 AND k % 7 > 0 AND k % 3 = 0 UNION ALL SELECT case_id, 't3>t6' FROM c WHERE k % 5 > 0 AND k % 7 > 0 AND t3 > t6""")
def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = TIMELINES.replace("FROM account", "FROM {account}").replace("JOIN legal_case", "JOIN {legal_case}")
    return evidence.timeline_problems(spark.sql(text, account=demo_ledger.accounts(spark, sf_dir), legal_case=demo_ledger.cases(spark, sf_dir)))


@query("a12e_dataset_summary", f"""{COSTS} SELECT {DOC}, count(*) AS n_pages, count(*) FILTER (page_type = 'BLANK') AS blank_pages, count(*) FILTER (page_type = 'STATEMENT') AS statement_pages, count(*) FILTER (coalesce(page_type, 'UNKNOWN') = 'UNKNOWN') AS unknown_pages,
sum(n_rows)::BIGINT AS n_rows, count(DISTINCT account) AS n_accounts, count(*) FILTER (NOT (page % 3 > 0)) AS pending_pages FROM costs GROUP BY {DOC}""")
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(_typed(spark, sf_dir), "typed-pages")
    return evidence.dataset_summary(found, found.where("not pending"), ["case_id", "document_id"])
