"""Queries on rows made from printed cells: the derived ledger printed as tables, with faults planted by the order's key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mapping
from ..plans import demo_ledger
from ..plans.demo_ledger import ORACLE
from ..plans.storage import written
from .registry import query

CENTS = "concat(cast((abs({0}) - abs({0}) % 100) / 100 AS bigint), '.', lpad(cast(abs({0}) % 100 AS string), 2, '0'))"
#: The same text runs in Spark and in DuckDB. m plants the faults; rows from 1,000,000 on and row 1 are no transactions.
BODY = f"""body AS (
  SELECT account_number AS document_id, 1 + row_number() OVER (PARTITION BY account_number ORDER BY seq) AS row_id, cast(row_index % 97 AS int) AS m, direction, transaction_date AS d, summary, counterparty_name AS party, coalesce(counterparty_account, '') AS party_account,
         {CENTS.format("amount_cents")} AS amount, CASE WHEN balance_cents IS NULL THEN '--' WHEN balance_cents < 0 THEN concat('-', {CENTS.format("balance_cents")}) ELSE {CENTS.format("balance_cents")} END AS balance
  FROM ledger),
docs AS (SELECT DISTINCT document_id FROM body)"""
CELLS = """
SELECT document_id, cast(1 AS bigint) AS cell_id, 1 AS page, cast(NULL AS int) AS table_no, cast(NULL AS bigint) AS row_id, cast(NULL AS int) AS col_no, document_id AS text FROM docs
UNION ALL SELECT document_id, 2, 1, NULL, NULL, NULL, '1990-01-01 10:00:00' FROM docs
UNION ALL SELECT document_id, 10 + c, 1, 1, 1, c, t FROM docs CROSS JOIN (VALUES (1, '交易时间'), (2, '借贷'), (3, '金额'), (4, '余额'), (5, '摘要'), (6, '对方户名'), (7, '对方账号'), (8, '备注')) heads(c, t)
UNION ALL SELECT document_id, row_id * 10 + 1, 1, 1, row_id, 1, CASE WHEN m = 6 THEN '1995-13-40' ELSE concat(cast(d AS string), ' 09:15:00') END FROM body
UNION ALL SELECT document_id, row_id * 10 + 2, 1, 1, row_id, 2, CASE direction WHEN 'IN' THEN '贷' WHEN 'OUT' THEN '借' ELSE '' END FROM body
UNION ALL SELECT document_id, row_id * 10 + 3, 1, 1, row_id, 3, CASE m WHEN 1 THEN '12x' WHEN 22 THEN concat('金额 ', amount) ELSE amount END FROM body
UNION ALL SELECT document_id, row_id * 10 + 4, 1, 1, row_id, 4, balance FROM body
UNION ALL SELECT document_id, row_id * 10 + 5, 1, 1, row_id, 5, CASE WHEN m = 9 THEN '消费' ELSE summary END FROM body
UNION ALL SELECT document_id, row_id * 10 + 6, 1, 1, row_id, 6, CASE WHEN m = 23 THEN concat(party, chr(10), '备注') ELSE party END FROM body
UNION ALL SELECT document_id, row_id * 10 + 7, 1, 1, row_id, 7, party_account FROM body
UNION ALL SELECT document_id, row_id * 10 + 8, 1, 1, row_id, 8, CASE WHEN m = 31 THEN '工资' ELSE '' END FROM body
UNION ALL SELECT document_id, 10000001, 1, 1, 1000000, 1, '合计' FROM docs
UNION ALL SELECT document_id, 10000011, 1, 1, 1000001, 1, CASE WHEN right(document_id, 1) = '7' THEN 'x' ELSE ' ' END FROM docs
UNION ALL SELECT document_id, 10000021, 1, 1, 1000002, 1, '工商银行' FROM docs"""
OUTS = """SELECT document_id, row_id - 1 AS out_no, m, CASE WHEN m = 4 THEN 'X' WHEN m = 5 AND direction = 'IN' THEN 'OUT' WHEN m = 5 AND direction = 'OUT' THEN 'IN' WHEN m % 2 = 0 AND direction <> 'UNKNOWN' THEN direction WHEN m = 35 OR m = 37 THEN 'IN' ELSE '' END AS direction,
CASE WHEN m = 7 THEN 'FOO' WHEN m = 8 THEN '消费' WHEN m = 9 THEN '第三方支付' WHEN summary IN ('手续费', '消费') THEN summary ELSE '' END AS type FROM body WHERE m NOT IN (16, 19, 20)"""
USES = """SELECT document_id, row_id - 1 AS out_no, row_id FROM body WHERE m NOT IN (16, 19, 20) UNION ALL SELECT document_id, row_id - 1, 999999 FROM body WHERE m = 15 UNION ALL SELECT document_id, row_id - 1, row_id + 1 FROM body WHERE m = 17"""
PICKS = """SELECT document_id, out_no, field, pos, cell_id, fragment, line FROM (
SELECT document_id, m, row_id - 1 AS out_no, 0 AS field, 0 AS pos, cast(1 AS bigint) AS cell_id, cast(NULL AS string) AS fragment, cast(NULL AS int) AS line FROM body
UNION ALL SELECT document_id, m, row_id - 1, 2, 0, 10000021, NULL, NULL FROM body WHERE m BETWEEN 24 AND 30
UNION ALL SELECT document_id, m, row_id - 1, 11, 0, 10000021, NULL, NULL FROM body WHERE m BETWEEN 24 AND 30
UNION ALL SELECT document_id, m, row_id - 1, 3, 0, row_id * 10 + 1, NULL, NULL FROM body
UNION ALL SELECT document_id, m, row_id - 1, 3, 1, 2, NULL, NULL FROM body WHERE m = 21
UNION ALL SELECT document_id, m, row_id - 1, 4, 0, row_id * 10 + 1, NULL, NULL FROM body
UNION ALL SELECT document_id, m, row_id - 1, 5, 0, row_id * 10 + 2, NULL, NULL FROM body WHERE m <> 37
UNION ALL SELECT document_id, m, row_id - 1, 6, 0, row_id * 10 + 3, CASE m WHEN 22 THEN amount WHEN 12 THEN 'zz' END, NULL FROM body WHERE m <> 2
UNION ALL SELECT document_id, m, row_id - 1, 6, 1, row_id * 10 + 4, NULL, NULL FROM body WHERE m = 3
UNION ALL SELECT document_id, m, row_id - 1, 7, 0, row_id * 10 + 4, NULL, NULL FROM body
UNION ALL SELECT document_id, m, row_id - 1, 7, 1, 77777777, NULL, NULL FROM body WHERE m = 14
UNION ALL SELECT document_id, m, row_id - 1, 8, 0, row_id * 10 + 5, NULL, NULL FROM body WHERE m <> 8
UNION ALL SELECT document_id, m, row_id - 1, 9, 0, row_id * 10 + 6, CASE WHEN m = 23 THEN party END, CASE WHEN m = 23 THEN 0 END FROM body WHERE m NOT IN (10, 13)
UNION ALL SELECT document_id, m, row_id - 1, 9, 0, 10000001, NULL, NULL FROM body WHERE m = 13
UNION ALL SELECT document_id, m, row_id - 1, 9, 1, row_id * 10 + 5, NULL, NULL FROM body WHERE m = 11
UNION ALL SELECT document_id, m, row_id - 1, 10, 0, row_id * 10 + 7, NULL, NULL FROM body WHERE m NOT IN (10, 11)) WHERE m NOT IN (16, 19, 20)"""
IGNORED = """SELECT document_id, cast(1 AS bigint) AS pos, cast(1 AS bigint) AS row_id, 'header' AS kind FROM docs UNION ALL SELECT document_id, 2, 1000000, 'total' FROM docs UNION ALL SELECT document_id, 3, 1000001, 'blank' FROM docs UNION ALL SELECT document_id, 4, 1000002, 'account' FROM docs
UNION ALL SELECT document_id, 5, 888888, 'header' FROM docs WHERE right(document_id, 1) = '7' UNION ALL SELECT document_id, 10 + row_id * 2, row_id, 'other' FROM body WHERE m IN (18, 19, 20) UNION ALL SELECT document_id, 11 + row_id * 2, row_id, 'total' FROM body WHERE m = 19"""


def _sql(select: str, body: DataFrame, docs: DataFrame) -> DataFrame:
    return body.sparkSession.sql(select.replace("FROM body", "FROM {body}").replace("FROM docs", "FROM {docs}"), body=body, docs=docs)


def _printed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    # written, since nearly every part of the texts reads them: Spark would number the rows anew for each
    body = written(spark.sql(f"WITH {BODY.replace('FROM ledger', 'FROM {ledger}')} SELECT * FROM body", ledger=demo_ledger.ledger(spark, sf_dir)), "body")
    docs = written(body.select("document_id").distinct(), "docs")
    found = {k: _sql(v, body, docs) for k, v in (("cells", CELLS), ("outs", OUTS), ("uses", USES), ("picks", PICKS), ("ignored", IGNORED))}
    found["outs"] = found["outs"].drop("m").join(found["uses"].groupBy("document_id", "out_no").agg(F.array_sort(F.collect_list("row_id")).alias("source_rows")), ["document_id", "out_no"])
    return found | {"cells": written(found["cells"], "printed-cells"), "body": body}


def _assembly(spark: SparkSession, sf_dir: str) -> mapping.Assembly:
    t = _printed(spark, sf_dir)
    return mapping.assembled(t["cells"], t["outs"], t["picks"], t["ignored"])


EMPTY = r"regexp_matches(trim({0}), '^(|[（(]空[）)]|无|--?|—|N/A|null)$', 'i')"
#: the rules of the fields, over each pick and its cell; then what each output's picks say together
ASSEMBLED = f"""{ORACLE}, {BODY}, cells AS ({CELLS}), outs AS ({OUTS}), uses AS ({USES}), picks AS ({PICKS}), ignored AS ({IGNORED}),
src AS (SELECT document_id, row_id, bool_and({EMPTY.format('text')}) AS all_empty, bool_or(regexp_matches(text, '(19|20)[0-9][0-9]-[0-9]{{1,2}}-[0-9]{{1,2}}') AND try_cast(left(text, 10) AS DATE) IS NOT NULL) AND bool_or(regexp_matches(text, '^[+-]?[0-9]+[.][0-9]{{1,2}}$')) AS dated FROM cells WHERE row_id IS NOT NULL GROUP BY 1, 2),
ign AS (SELECT i.*, s.row_id IS NOT NULL AS here, all_empty, dated, row_number() OVER (PARTITION BY i.document_id, i.row_id ORDER BY pos) AS nth, last_value(kind) OVER (PARTITION BY i.document_id, i.row_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM ignored i LEFT JOIN src s USING (document_id, row_id)),
disposed AS (SELECT DISTINCT document_id, row_id, final FROM ign WHERE here),
r AS (SELECT o.document_id, o.out_no, o.direction AS d, o.type AS t, (SELECT list_sort(list_distinct(list(u.row_id))) FROM uses u WHERE u.document_id = o.document_id AND u.out_no = o.out_no) AS rows FROM outs o),
p0 AS (SELECT p.*, c.text AS cell, c.row_id AS at, c.cell_id IS NOT NULL AS known, coalesce(p.fragment, c.text) AS v, coalesce(p.fragment IS NULL OR (p.line IS NOT NULL AND trim(string_split(c.text, chr(10))[p.line + 1]) = p.fragment) OR (p.line IS NULL AND length(c.text) - length(replace(c.text, p.fragment, '')) = length(p.fragment)), false) AS good, x.final FROM picks p LEFT JOIN cells c USING (document_id, cell_id) LEFT JOIN disposed x ON x.document_id = p.document_id AND x.row_id = c.row_id),
p AS (SELECT *, CASE WHEN field IN (0, 10) THEN CASE WHEN {EMPTY.format('v')} THEN '' WHEN regexp_matches(v, '^[0-9*]{{8,32}}$') THEN v END WHEN field IN (6, 7) THEN CASE WHEN {EMPTY.format('v')} THEN '' WHEN regexp_matches(v, '^[+-]?[0-9]+([.][0-9]{{1,2}})?$') THEN CASE WHEN field = 6 THEN ltrim(v, '-') ELSE v END END
  WHEN field = 5 THEN CASE v WHEN '贷' THEN 'IN' WHEN '借' THEN 'OUT' END WHEN field = 4 THEN CASE WHEN {EMPTY.format('v')} THEN '' ELSE try_cast(left(v, 10) AS DATE)::VARCHAR END WHEN {EMPTY.format('v')} THEN '' WHEN field IN (2, 11) THEN CASE WHEN v LIKE '%工商银行%' THEN '中国工商银行' ELSE v END ELSE trim(v) END AS norm,
  try_cast(left(v, 10) AS DATE)::VARCHAR AS day, nullif(regexp_extract(v, '[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}'), '') AS clock FROM p0 WHERE known AND good),
f AS (SELECT document_id, out_no, field, coalesce(first(norm ORDER BY pos), '') AS v, count(*) AS n, count(DISTINCT nullif(norm, '')) AS k, bool_or(norm IS NULL) AS unread, list_sort(list_distinct(list(cell_id))) AS cells, list_sort(list_distinct(list(cell_id) FILTER (norm IS NULL))) AS bad, count(DISTINCT day) AS days, count(DISTINCT clock) AS clocks,
  first(day ORDER BY day IS NULL, pos) AS day, first(clock ORDER BY clock IS NULL, pos) AS clock, bool_or(v LIKE '%消费%') AS spends FROM (SELECT *, norm AS nn FROM p) GROUP BY 1, 2, 3),
w AS (SELECT r.*, {', '.join(f"f{i}.v AS v{i}, coalesce(f{i}.n, 0) AS n{i}, coalesce(f{i}.k, 0) AS k{i}, coalesce(f{i}.unread, false) AS u{i}, coalesce(f{i}.cells, []) AS c{i}, coalesce(f{i}.bad, []) AS b{i}" for i in range(12))}, coalesce(f3.days, 0) AS days, coalesce(f3.clocks, 0) AS clocks, f3.day, f3.clock, coalesce(f8.spends, false) AS spends
  FROM r {' '.join(f"LEFT JOIN f f{i} ON f{i}.document_id = r.document_id AND f{i}.out_no = r.out_no AND f{i}.field = {i}" for i in range(12))})"""
TYPE_LIST = "'账户转账', '存款结息', '手续费', '工资收入', '司法扣划', '保险支出', '贷款放款', '贷款还款', '信用卡还款', '消费', '退款', '缴费', '第三方支付', '分期', '分期转换', '分期退款', '费用减免', '违约金', '透支利息', '现金存入', '现金支取'"


@query("d17_assemble_rows", f"""{ASSEMBLED} SELECT document_id, out_no, array_to_string(rows, ',') AS source_rows, coalesce(v0, '') AS account_number, coalesce(v1, '') AS account_name, coalesce(v2, '') AS bank_name, coalesce(coalesce(day, nullif(v4, '')) || ' ' || clock, '') AS transaction_time, coalesce(v4, '') AS transaction_date,
CASE WHEN coalesce(v5, '') <> '' THEN v5 WHEN d IN ('IN', 'OUT') THEN d ELSE '' END AS direction, coalesce(v6, '') AS amount, coalesce(v7, '') AS balance, CASE WHEN t IN ({TYPE_LIST}) THEN t ELSE '' END AS transaction_type, coalesce(v9, '') AS counterparty_name, coalesce(v10, '') AS counterparty_account, coalesce(v11, '') AS counterparty_bank FROM w""")
def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembly(spark, sf_dir).rows.withColumn("source_rows", F.array_join("source_rows", ","))


NAMES = dict(enumerate(("account_number", "account_name", "bank_name", "transaction_time", "transaction_date", "direction", "amount", "balance", "transaction_type", "counterparty_name", "counterparty_account", "counterparty_bank")))


def _code(code: str, field: int | None, when: str, cells: str = "[]", severity: str = "'REQUIRED'") -> str:
    return f"SELECT document_id, '{code}' AS code, {'NULL' if field is None else repr(NAMES[field])} AS field, {severity} AS severity, [out_no] AS out_rows, rows AS source_rows, {cells} AS source_cells FROM w WHERE {when}"


ISSUES = " UNION ALL ".join([
    "SELECT document_id, 'INVALID_IGNORED_ROW' AS code, NULL AS field, 'REQUIRED' AS severity, [] AS out_rows, [row_id] AS source_rows, [] AS source_cells FROM ign WHERE NOT here",
    "SELECT document_id, 'DUPLICATE_DISPOSITION', NULL, 'REQUIRED', [], [row_id], [] FROM ign WHERE here AND nth > 1",
    "SELECT document_id, 'NONEMPTY_IGNORED_ROW', NULL, 'REQUIRED', [], [row_id], [] FROM ign WHERE here AND kind = 'blank' AND NOT all_empty",
    "SELECT document_id, 'POSSIBLE_OMITTED_TRANSACTION', NULL, 'REQUIRED', [], [row_id], [] FROM ign WHERE here AND dated AND kind NOT IN ('total', 'account')",
    "SELECT u.document_id, 'INVALID_ROW_SOURCE', NULL, 'REQUIRED', [out_no], [u.row_id], [] FROM uses u ANTI JOIN src s ON s.document_id = u.document_id AND s.row_id = u.row_id",
    "SELECT document_id, 'TRANSACTION_IGNORED_CONFLICT', NULL, 'REQUIRED', [out_no], [row_id], [] FROM uses SEMI JOIN disposed USING (document_id, row_id)",
    "SELECT document_id, 'SOURCE_ROW_REUSED', NULL, 'REQUIRED', list_sort(list(DISTINCT out_no)), [row_id], [] FROM uses GROUP BY document_id, row_id HAVING count(*) > 1",
    "SELECT document_id, 'UNASSIGNED_SOURCE_ROW', NULL, 'REQUIRED', [], [row_id], [] FROM src ANTI JOIN uses USING (document_id, row_id) ANTI JOIN disposed USING (document_id, row_id)".replace("FROM src ANTI JOIN uses USING (document_id, row_id) ANTI JOIN disposed USING (document_id, row_id)", "FROM (SELECT document_id, row_id FROM src EXCEPT SELECT document_id, row_id FROM uses EXCEPT SELECT document_id, row_id FROM disposed)"),
    *[f"SELECT q.document_id, '{code}', CASE q.field {' '.join(f'WHEN {i} THEN {n!r}' for i, n in NAMES.items())} END, 'REQUIRED', [q.out_no], {rows}, [q.cell_id] FROM {source} q JOIN r ON r.document_id = q.document_id AND r.out_no = q.out_no WHERE {when}" for code, source, rows, when in (
        ("INVALID_CELL_SOURCE", "p0", "r.rows", "NOT known"), ("INVALID_SOURCE_FRAGMENT", "p0", "r.rows", "known AND NOT good"),
        ("OUTSIDE_TRANSACTION_SOURCES", "p", "list_sort(list_distinct(list_append(r.rows, q.at)))", "q.at IS NOT NULL AND NOT list_contains(r.rows, q.at) AND NOT (q.field <= 2 AND coalesce(q.final, '') IN ('header', 'account')) AND NOT (q.field IN (9, 11) AND r.t IN ('手续费', '分期', '分期转换', '费用减免', '违约金', '透支利息', '存款结息') AND EXISTS (SELECT 1 FROM p b WHERE b.document_id = q.document_id AND b.out_no = q.out_no AND b.field = 2 AND b.cell_id = q.cell_id))"))],
    *[_code("MISSING_KEY_SOURCE", i, f"coalesce(v{i}, '') = ''") for i in (0, 6)],
    *[_code("UNREADABLE_SOURCE", i, f"u{i}", f"b{i}") for i in (0, 6, 7, 10)],
    *[_code("SOURCE_VALUE_CONFLICT", i, f"k{i} > 1", f"c{i}") for i in (0, 5, 6, 7, 10)],
    _code("INVALID_DIRECTION", 5, "d NOT IN ('', 'IN', 'OUT')"), _code("DIRECTION_CONTRADICTION", 5, "coalesce(v5, '') <> '' AND d <> '' AND v5 <> d", "c5"),
    _code("DIRECTION_REQUIRES_INDEPENDENT_READ", 5, "coalesce(v5, '') = ''", "c5", "CASE WHEN d IN ('IN', 'OUT') AND n5 > 0 THEN 'AUTOMATIC_CHECK' ELSE 'REQUIRED' END"),
    _code("TIME_SOURCE_CONFLICT", 3, "days > 1 OR clocks > 1", "c3"), _code("PARTIAL_DATE", 4, "u4", "c4"), _code("INVALID_TYPE", 8, f"t <> '' AND t NOT IN ({TYPE_LIST})"), _code("MISSING_TYPE_SOURCE", 8, "t <> '' AND n8 = 0"),
    _code("TYPE_SOURCE_CONTRADICTION", 8, "t = '第三方支付' AND spends", "c8"), _code("COUNTERPARTY_IDENTITY_MISSING", 9, "coalesce(v10, '') = '' AND coalesce(v9, '') = ''"), _code("COUNTERPARTY_NAME_CONFLICT", 9, "coalesce(v10, '') = '' AND k9 > 1"),
])


@query("d17_assembly_issues", f"{ASSEMBLED}, issues AS ({ISSUES}) SELECT document_id, code, field, severity, array_to_string(out_rows, ',') AS out_rows, array_to_string(source_rows, ',') AS source_rows, array_to_string(source_cells, ',') AS source_cells FROM issues")
def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _assembly(spark, sf_dir).issues
    return found.select("document_id", "code", "field", "severity", *[F.array_join(c, ",").alias(c) for c in ("out_rows", "source_rows", "source_cells")])


@query("d17_complete_documents", f"""{ASSEMBLED}, issues AS ({ISSUES}) SELECT document_id, count(code) AS n_issues, NOT coalesce(bool_or(code IN ('INVALID_ROW_SOURCE', 'INVALID_CELL_SOURCE', 'UNASSIGNED_SOURCE_ROW', 'SOURCE_ROW_REUSED', 'TRANSACTION_IGNORED_CONFLICT', 'DUPLICATE_DISPOSITION')), false) AS complete FROM docs LEFT JOIN issues USING (document_id) GROUP BY 1""")
def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembly(spark, sf_dir).documents


MAPPED = f"""{ORACLE}, {BODY}, good AS (SELECT *, row_id - 1 AS n, right(document_id, 1) AS digit, row_number() OVER (PARTITION BY document_id ORDER BY row_id) AS out_no FROM body WHERE m <> 16 AND right(document_id, 1) <> '9')"""
RULES = (("any", "手续费", "手续费"), ("deposit", "消 费", "消费"), ("any", "工资", "工资收入"), ("credit", "结息", "存款结息"), ("any", "保费", "保险支出"), ("credit", "保费", "消费"))


def _mapped_tables(body: DataFrame) -> DataFrame:
    """One table of transactions per account; m and the account's last digit plant what the mapping does."""

    def selector(row: int | None = None, col: int | None = None, line: int | None = None, part: str | None = None, fixed: int | None = None) -> str:
        values = (("row", row, "int"), ("col", col, "int"), ("line", line, "int"), ("part", f"'{part}'" if part else None, "string"), ("fixed", fixed, "bigint"), ("text", None, "string"))
        return "named_struct(" + ", ".join(f"'{n}', cast({'null' if v is None else v} as {t})" for n, v, t in values) + ")"

    names = {"account_number": selector(fixed=1), "transaction_time": selector(0, 1), "transaction_date": selector(0, 1), "direction": selector(0, 2), "amount": selector(0, 3), "balance": selector(0, 4), "description": selector(0, 5), "counterparty_name": selector(0, 6), "counterparty_account": selector(0, 7)}
    fields = "map(" + ", ".join(f"'{k}', {v}" for k, v in names.items()) + ")"
    with_owner = f"map_concat({fields}, map('account_name', {selector(0, 6)}))"
    nothing = f"cast(null as struct<row: int, col: int, line: int, part: string, fixed: bigint, text: string>)"
    override = f"case m when 23 then map('counterparty_name', {selector(0, 6, line=0)}) when 3 then map('counterparty_account', {selector(0, 6, part='account')}) else map('amount', {nothing}) end"
    tables = body.groupBy("document_id").agg(F.array_sort(F.collect_list(F.expr("case when m <> 16 then array(row_id) end"))).alias("groups"), F.array_sort(F.collect_list(F.expr("case when m in (1, 3, 23) then row_id end"))).alias("_o"), F.collect_list(F.expr(f"case when m in (1, 3, 23) then named_struct('first_row', row_id, 'fields', {override}) end")).alias("overrides"))
    digit = F.right("document_id", F.lit(1))
    ignored = F.expr("array(named_struct('rows', array(1L), 'kind', 'header'), named_struct('rows', array(1000000L), 'kind', 'total'), named_struct('rows', array(1000001L), 'kind', 'blank'), named_struct('rows', array(1000002L), 'kind', 'account'))")
    tables = tables.select("document_id", F.lit(1).alias("page"), F.lit(1).alias("table_no"), F.lit("transactions").alias("kind"), F.when(digit.cast("int") % 2 == 0, "deposit").otherwise("credit").alias("account_kind"), F.when(digit == "3", F.expr(with_owner)).otherwise(F.expr(fields)).alias("fields"), F.expr("map('贷', 'IN', '借', 'OUT')").alias("direction_codes"), "groups", ignored.alias("ignored"), "overrides")
    return tables.unionByName(tables.where(digit == "9")).unionByName(tables.where(digit == "5").withColumn("table_no", F.lit(7)))


def _plan(spark: SparkSession, sf_dir: str) -> mapping.Plan:
    t = _printed(spark, sf_dir)
    return mapping.materialized(t["cells"], written(_mapped_tables(t["body"]), "mapping"), spark.createDataFrame(RULES, "account_kind string, text string, type string"))


@query("d17_mapped_picks", f"""{MAPPED} SELECT document_id, out_no, field, pos::INT AS pos, cell_id, fragment, line FROM (
SELECT *, unnest([0, 3, 4, 5, 6, 7, 8, 9, 10]) AS field, 0 AS pos, unnest([1, row_id * 10 + 1, row_id * 10 + 1, row_id * 10 + 2, row_id * 10 + 3, row_id * 10 + 4, row_id * 10 + 5, row_id * 10 + 6, row_id * 10 + 7]) AS cell_id, NULL::VARCHAR AS fragment, NULL::INT AS line FROM good WHERE m <> 23
UNION ALL SELECT *, unnest([0, 3, 4, 5, 6, 7, 8, 9, 10]), 0, unnest([1, row_id * 10 + 1, row_id * 10 + 1, row_id * 10 + 2, row_id * 10 + 3, row_id * 10 + 4, row_id * 10 + 5, row_id * 10 + 6, row_id * 10 + 7]), unnest([NULL, NULL, NULL, NULL, NULL, NULL, NULL, party, NULL]), unnest([NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, NULL]) FROM good WHERE m = 23
UNION ALL SELECT *, 8, 1, row_id * 10 + 8, NULL, NULL FROM good WHERE m = 31) WHERE NOT (field = 6 AND m = 1) AND NOT (field = 10 AND m = 3)""")
def _mapped_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).picks


@query("d17_mapped_outputs", f"""{MAPPED}, rules(k, t, type) AS (VALUES {', '.join(map(str, RULES))}), s AS (SELECT *, CASE WHEN m = 9 THEN '消费' ELSE summary END AS description, CASE WHEN digit IN ('0', '2', '4', '6', '8') THEN 'deposit' ELSE 'credit' END AS account_kind FROM good),
ruled AS (SELECT document_id, out_no, min(type) AS type FROM s JOIN rules ON replace(t, ' ', '') = description AND k IN ('any', account_kind) GROUP BY 1, 2 HAVING count(DISTINCT type) = 1)
SELECT document_id, out_no, row_id::VARCHAR AS source_rows, CASE direction WHEN 'UNKNOWN' THEN '' ELSE direction END AS direction, coalesce(type, '') AS type, account_kind, description, false AS direct_owner FROM s LEFT JOIN ruled USING (document_id, out_no)""")
def _mapped_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).outputs.select("document_id", "out_no", F.array_join("source_rows", ",").alias("source_rows"), "direction", "type", "account_kind", "description", "direct_owner")


@query("d17_mapping_remarks", f"""{MAPPED} SELECT document_id, 'MAPPED_TWICE' AS remark, NULL AS field, NULL::BIGINT AS out_no FROM docs, range(2) WHERE right(document_id, 1) = '9' UNION ALL SELECT document_id, 'NO_SUCH_TABLE', NULL, NULL FROM docs WHERE right(document_id, 1) = '5'
UNION ALL SELECT DISTINCT document_id, 'OWNER_COLUMN_OF_PARTY', 'account_name', NULL::BIGINT FROM good WHERE digit = '3' UNION ALL SELECT document_id, 'AMBIGUOUS_PARTY_FRAGMENT', 'counterparty_account', out_no FROM good WHERE m = 3""")
def _remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir)
    none = F.lit(None).cast("bigint").alias("out_no")
    found = plan.rejected.select("document_id", F.col("reason").alias("remark"), F.lit(None).cast("string").alias("field"), none)
    found = found.unionByName(plan.corrected.select("document_id", F.lit("OWNER_COLUMN_OF_PARTY").alias("remark"), "field", none))
    return found.unionByName(plan.issues.select("document_id", F.col("code").alias("remark"), "field", F.element_at("out_rows", 1).alias("out_no")))
