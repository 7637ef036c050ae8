"""Queries on the order of statement rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import sequence
from ..plans import demo_ledger
from ..plans.demo_ledger import ORACLE
from ..plans.storage import written
from .registry import query


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ledger, written: operators that join it with itself start from a table."""
    return written(demo_ledger.ledger(spark, sf_dir), "ledger")


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ledger in printed pages, written."""
    return written(demo_ledger.printed(spark, sf_dir), "printed")


KEY = "case_id, source_document_id, account_number"
SIGNED = "CASE direction WHEN 'IN' THEN amount_cents WHEN 'OUT' THEN -amount_cents END"
PAGES = f"{ORACLE}, printed AS ({demo_ledger.PRINTED_SQL.format(columns='* EXCLUDE (page, row_index, n)', ledger='ledger')})"


def _physical_sql(rows: str) -> str:
    """CTEs: orient, and physical, which is rows with physical_rank."""
    return f"""lagged AS (SELECT *, lag(transaction_date) OVER (PARTITION BY {KEY} ORDER BY page, row_index, seq) AS before FROM {rows}),
orient AS (SELECT {KEY}, count(*) FILTER (before < transaction_date) AS forward_pairs, count(*) FILTER (before > transaction_date) AS reverse_pairs, count(*) FILTER (before > transaction_date) > count(*) FILTER (before < transaction_date) AS is_reversed FROM lagged GROUP BY ALL),
physical AS (SELECT l.*, CASE WHEN is_reversed THEN count(*) OVER (PARTITION BY {KEY}) - row_number() OVER w + 1 ELSE row_number() OVER w END AS physical_rank FROM {rows} l JOIN orient USING ({KEY}) WINDOW w AS (PARTITION BY {KEY} ORDER BY page, row_index, seq))"""


ORIENT = f"{ORACLE}, {_physical_sql('ledger')}"


def _chrono_sql(rows: str) -> str:
    """CTEs up to chrono, which is rows with chrono_rank; days are folded by recursion."""
    inside = f"PARTITION BY {KEY}, transaction_date ORDER BY seq"
    error = lambda way: f"CASE WHEN ub IS NOT NULL THEN CASE WHEN last_value(ub IGNORE NULLS) OVER ({inside} {way} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT NULL THEN least(abs(last_value(ub IGNORE NULLS) OVER ({inside} {way} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + delta - balance_cents), 100000000) END END"
    mean = lambda e, n, at: f"coalesce((x.{e} + CASE WHEN s.balance IS NULL OR x.{at}_b IS NULL THEN 0 ELSE least(abs(s.balance + x.{at}_d - x.{at}_b), 100000000) END) / nullif(x.{n} + CASE WHEN s.balance IS NULL OR x.{at}_b IS NULL THEN 0 ELSE 1 END, 0), 0)"
    back = f"(x.k > 1 AND {mean('eb', 'nb', 'last')} + 1 < {mean('ef', 'nf', 'first')})"
    counts = lambda rank, f, b: f"SELECT {KEY}, count(*) FILTER (off < 100) AS {f}, count(*) FILTER (off >= 100) AS {b} FROM (SELECT *, abs(lag(balance_cents) OVER (PARTITION BY {KEY} ORDER BY {rank}) + {SIGNED} - balance_cents) AS off FROM both_ranks) GROUP BY ALL"
    return f"""{_physical_sql(rows)},
u AS (SELECT *, {SIGNED} AS delta, CASE WHEN direction IN ('IN', 'OUT') THEN balance_cents END AS ub FROM physical),
e AS (SELECT *, {error('')} AS ef, {error('DESC')} AS eb FROM u),
days AS (SELECT {KEY}, transaction_date AS day, row_number() OVER (PARTITION BY {KEY} ORDER BY transaction_date) AS n, count(*) AS k, coalesce(sum(ef), 0) AS ef, count(ef) AS nf, coalesce(sum(eb), 0) AS eb, count(eb) AS nb,
  arg_min(balance_cents, seq) FILTER (ub IS NOT NULL) AS first_b, arg_min(delta, seq) FILTER (ub IS NOT NULL) AS first_d, arg_max(balance_cents, seq) FILTER (ub IS NOT NULL) AS last_b, arg_max(delta, seq) FILTER (ub IS NOT NULL) AS last_d,
  arg_max(balance_cents, seq) FILTER (balance_cents IS NOT NULL) AS end_f, arg_min(balance_cents, seq) FILTER (balance_cents IS NOT NULL) AS end_b FROM e GROUP BY {KEY}, transaction_date),
fold AS (SELECT {KEY}, NULL::DATE AS day, 0::BIGINT AS n, NULL::BIGINT AS balance, false AS back FROM days WHERE n = 1
  UNION ALL SELECT x.case_id, x.source_document_id, x.account_number, x.day, x.n, coalesce(CASE WHEN {back} THEN x.end_b ELSE x.end_f END, s.balance), {back} FROM fold s JOIN days x ON x.case_id = s.case_id AND x.source_document_id = s.source_document_id AND x.account_number = s.account_number AND x.n = s.n + 1),
both_ranks AS (SELECT e.*, row_number() OVER (PARTITION BY {', '.join('e.' + c for c in KEY.split(', '))} ORDER BY transaction_date, CASE WHEN back THEN -seq ELSE seq END) AS dated_rank FROM e JOIN fold f ON f.case_id = e.case_id AND f.source_document_id = e.source_document_id AND f.account_number = e.account_number AND f.day = e.transaction_date),
chrono AS (SELECT b.*, CASE WHEN pb < db OR (pf > 0 AND pb = 0 AND db > 0) THEN physical_rank ELSE dated_rank END AS chrono_rank
  FROM both_ranks b JOIN ({counts('physical_rank', 'pf', 'pb')}) USING ({KEY}) JOIN ({counts('dated_rank', 'df', 'db')}) USING ({KEY}))"""


@query("w1_statement_orientation", f"{ORIENT} SELECT * FROM orient")
def _orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.statement_orientation(ledger(spark, sf_dir))


@query("w1_physical_rank", f"{ORIENT} SELECT case_id, id, physical_rank FROM physical")
def _physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.physical_rank(ledger(spark, sf_dir)).select("case_id", "id", F.col("physical_rank").cast("long").alias("physical_rank"))


@query("w2_chronological_rank", ORACLE.replace("WITH ", "WITH RECURSIVE ", 1) + f", {_chrono_sql('ledger')} SELECT case_id, id, chrono_rank FROM chrono")
def _chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.chronological_rank(ledger(spark, sf_dir)).select("case_id", "id", F.col("chrono_rank").cast("long").alias("chrono_rank"))


@query("w3_balance_breaks", f"""{ORIENT} SELECT case_id, id, expected_cents, balance_cents, days_apart, coalesce(days_apart, 0) > 30 AS long_interval FROM (
SELECT *, lag(balance_cents) OVER w + {SIGNED} AS expected_cents, abs(transaction_date - lag(transaction_date) OVER w) AS days_apart FROM physical WINDOW w AS (PARTITION BY {KEY} ORDER BY physical_rank)) WHERE expected_cents <> balance_cents""")
def _breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.balance_breaks(sequence.physical_rank(ledger(spark, sf_dir)), "physical_rank").withColumn("days_apart", F.col("days_apart").cast("long"))


@query("w3_chronological_breaks", ORACLE.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_chrono_sql('ledger')} SELECT case_id, id, expected_cents, balance_cents, days_apart, coalesce(days_apart, 0) > 30 AS long_interval FROM (
SELECT *, lag(balance_cents) OVER w + {SIGNED} AS expected_cents, abs(transaction_date - lag(transaction_date) OVER w) AS days_apart FROM chrono WINDOW w AS (PARTITION BY {KEY} ORDER BY chrono_rank)) WHERE expected_cents <> balance_cents""")
def _chronological_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.balance_breaks(sequence.chronological_rank(ledger(spark, sf_dir))).withColumn("days_apart", F.col("days_apart").cast("long"))


@query("w4_printed_balance_checks", f"""{PAGES}, rows AS (SELECT *, lag(transaction_date) OVER w AS pd, lag(row_index) OVER w AS pr, lag(balance_cents) OVER w AS pb, lag({SIGNED}) OVER w AS ps FROM printed WINDOW w AS (PARTITION BY {KEY}, page ORDER BY row_index, seq)),
ways AS (SELECT {KEY}, page, min(sign(transaction_date - pd)) AS way FROM rows WHERE transaction_date <> pd GROUP BY ALL HAVING min(sign(transaction_date - pd)) = max(sign(transaction_date - pd))),
checked AS (SELECT case_id, id, CASE WHEN way > 0 THEN pb + {SIGNED} - balance_cents ELSE pb - (balance_cents + ps) END AS off_cents FROM rows JOIN ways USING ({KEY}, page) WHERE row_index - pr = 1)
SELECT case_id, id, unnest(['direction', 'amount', 'balance', 'date']) AS field, off_cents FROM checked WHERE off_cents <> 0""")
def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.printed_balance_checks(printed(spark, sf_dir))


@query("w5_direction_calibrate", f"""{PAGES}, turned AS (SELECT * REPLACE (CASE WHEN k % 29 = 0 AND direction = 'IN' THEN 'OUT' WHEN k % 29 = 0 THEN 'IN' ELSE direction END AS direction) FROM printed), {_physical_sql('turned')}, d AS (SELECT *, abs(lag(balance_cents) OVER w + amount_cents - balance_cents) AS di, abs(lag(balance_cents) OVER w - amount_cents - balance_cents) AS dout FROM physical WINDOW w AS (PARTITION BY {KEY} ORDER BY physical_rank)),
c AS (SELECT case_id, id, direction, CASE WHEN di <= 4 AND dout > 4 THEN 'IN' WHEN dout <= 4 AND di > 4 THEN 'OUT' END AS calibrated FROM d WHERE amount_cents > 0) SELECT * FROM c WHERE calibrated <> direction""")
def _calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    swapped = F.when(F.col("direction") == "IN", "OUT").otherwise("IN")
    return sequence.calibrated_directions(printed(spark, sf_dir).withColumn("direction", F.when(F.col("k") % 29 == 0, swapped).otherwise(F.col("direction"))))


@query("w6_page_direction_flip", f"""{ORACLE}, d AS (SELECT {KEY}, page, abs(lag(balance_cents) OVER w + {SIGNED} - balance_cents) AS a, abs(lag(balance_cents) OVER w - {SIGNED} - balance_cents) AS b FROM ledger WINDOW w AS (PARTITION BY {KEY}, page ORDER BY page, row_index, seq)),
g AS (SELECT {KEY}, page, count(a) AS comparisons, count(*) FILTER (a <= 1) AS direct, count(*) FILTER (b <= 1) AS flipped FROM d GROUP BY ALL)
SELECT *, comparisons >= 2 AND flipped >= 0.65 * comparisons AND direct <= 0.25 * comparisons AS flip FROM g""")
def _flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.page_direction_flip(ledger(spark, sf_dir))


#: summaries of rows without a direction, by the order's key: words of payments, of receipts, of both, of neither
WORDS = ("司法划扣", "ATM取现", "缴费", "汇款", "贷款归还", "退款", "年费减免", "还款", "利息收入", "收款转出", "对账", "存入")
SAID = "SELECT * {0} (summary), CASE WHEN direction = 'UNKNOWN' AND row_index % 7 <> 0 THEN CASE cast(row_index % 12 AS int) " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " END ELSE summary END AS summary FROM ledger"


@query("w7_missing_direction", f"""{ORACLE}, said AS ({SAID.format("EXCLUDE")}), d AS (SELECT *, balance_cents - lag(balance_cents) OVER (PARTITION BY {KEY} ORDER BY page, row_index, seq) AS ch, greatest(2.0, amount_cents * 0.002) AS slack FROM said)
SELECT case_id, id, CASE WHEN abs(ch - amount_cents) <= slack THEN 'IN' WHEN abs(ch + amount_cents) <= slack THEN 'OUT' WHEN regexp_matches(summary, '司法划扣|冻结扣划|扣划|消费|支取|取现|手续费|转出|汇款|扣款|代扣|缴费|贷款归还|还贷') THEN 'OUT' WHEN regexp_matches(summary, '结息|利息收入|工资|退款|退汇|存入|入账|收款|转入|还款|年费减免|费用减免') THEN 'IN' ELSE 'UNKNOWN' END AS suggested FROM d WHERE direction = 'UNKNOWN'""")
def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.missing_directions(spark.sql(SAID.format("EXCEPT").replace("FROM ledger", "FROM {ledger}"), ledger=ledger(spark, sf_dir)))


def _odd_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger within three years, with a misread year in some rows."""
    rows = ledger(spark, sf_dir).where("year(transaction_date) between 1996 and 1998")
    return rows.withColumn("transaction_date", F.when(F.col("row_index") % 101 == 0, F.add_months("transaction_date", 240)).otherwise(F.col("transaction_date")))


@query("w11_outlier_year_repair", f"""{ORACLE}, odd AS (SELECT * REPLACE (CASE WHEN row_index % 101 = 0 THEN cast(transaction_date + INTERVAL 20 YEAR AS DATE) ELSE transaction_date END AS transaction_date) FROM ledger WHERE year(transaction_date) BETWEEN 1996 AND 1998),
p AS (SELECT a.case_id, a.source_document_id, a.account_number, a.id, a.seq, a.transaction_date, min(year(b.transaction_date)) AS peer_min, max(year(b.transaction_date)) AS peer_max, count(*) AS n FROM odd a JOIN odd b USING ({KEY}) WHERE a.id <> b.id GROUP BY ALL)
SELECT case_id, id, transaction_date, peer_min::INT AS peer_min, peer_max::INT AS peer_max,
  try_cast(CASE WHEN year(transaction_date) < peer_min THEN peer_min ELSE peer_max END || strftime(transaction_date, '-%m-%d') AS DATE) AS repaired_date
FROM p WHERE n >= 4 AND peer_max - peer_min <= 3 AND (year(transaction_date) < peer_min - 2 OR year(transaction_date) > peer_max + 2)""")
def _outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.outlier_years(_odd_years(spark, sf_dir))


@query("w12_raw_date_restore", f"""{ORACLE} SELECT case_id, id, transaction_date, cast(transaction_date + INTERVAL 10 YEAR AS DATE) AS printed_date FROM ledger WHERE row_index % 7 = 0 AND year(transaction_date) BETWEEN 1990 AND 2080 AND strftime(transaction_date, '%m-%d') <> '02-29'""")
def _restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).where("date_format(transaction_date, 'MM-dd') <> '02-29'")
    return sequence.restored_dates(rows.withColumn("raw_text", F.when(F.col("row_index") % 7 == 0, F.concat(F.lit("行"), F.date_format(F.add_months("transaction_date", 120), "yyyyMMdd"), F.lit("号 12345678901")))))


@query("zero_settlement_confirmed", f"""{ORACLE}, z AS (SELECT * REPLACE (CASE WHEN row_index % 6 = 0 THEN 0 ELSE amount_cents END AS amount_cents, balance_cents - balance_cents % 100000000 AS balance_cents) FROM ledger),
w AS (SELECT *, lag(balance_cents) OVER v AS b, lead(balance_cents) OVER v AS a FROM z WINDOW v AS (PARTITION BY {KEY} ORDER BY page, row_index, seq))
SELECT case_id, id, regexp_matches(concat(summary, ' ', coalesce(counterparty_name, '')), '{P.FEE_WAIVER}') OR (regexp_matches(summary, '{P.SETTLEMENT}') AND coalesce(b = balance_cents OR a = balance_cents, false)) AS confirmed FROM w WHERE amount_cents = 0""")
def _zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).withColumns({"amount_cents": F.when(F.col("row_index") % 6 == 0, 0).otherwise(F.col("amount_cents")), "balance_cents": F.col("balance_cents") - F.col("balance_cents") % 100_000_000})
    return sequence.zero_settlements(rows)


@query("is_credit_card_ledger", f"""{ORACLE}, g AS (SELECT {KEY}, bool_or(regexp_matches(concat_ws(' ', bank_name, summary, counterparty_name), '信用卡|贷记卡|牡丹卡')) AS w, count(*) FILTER (regexp_matches(concat_ws(' ', summary, counterparty_name), '透支|年费|自动转[账帐]还款|分期付款|消费转分期|分期利息|分期费用')) AS c, count(balance_cents) AS b, count(*) FILTER (balance_cents < 0) AS neg, count(*) AS n FROM ledger GROUP BY ALL)
SELECT {KEY}, w OR (b > 0 AND neg >= ceil(b / 2) AND c >= least(2, n)) AS is_credit_card FROM g""")
def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.credit_card_ledgers(ledger(spark, sf_dir))


@query("a6_balance_audit", f"""{ORIENT}, f AS (SELECT {KEY}, arg_min(balance_cents - coalesce({SIGNED}, 0), physical_rank) FILTER (balance_cents IS NOT NULL) AS start_cents, arg_max(balance_cents, physical_rank) FILTER (balance_cents IS NOT NULL) AS end_cents,
  sum(CASE WHEN direction = 'IN' THEN amount_cents ELSE 0 END)::BIGINT AS in_cents, sum(CASE WHEN direction = 'OUT' THEN amount_cents ELSE 0 END)::BIGINT AS out_cents, count(*) FILTER (direction = 'UNKNOWN' OR amount_cents <= 0) AS suspicious_rows FROM physical GROUP BY ALL)
SELECT {KEY}, in_cents, out_cents, start_cents, end_cents, start_cents + in_cents - out_cents AS calculated_end_cents, suspicious_rows, end_cents IS NOT NULL AS is_auditable, coalesce(start_cents + in_cents - out_cents = end_cents, false) AS is_balanced FROM f""")
def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.account_audit(sequence.physical_rank(ledger(spark, sf_dir)), "physical_rank").withColumn("is_balanced", F.coalesce("is_balanced", F.lit(False)))


#: conversions in every statement: runs of three rows get the words, most of them also the ways and the day
CONVERTED = """SELECT case_id, source_document_id, account_number, id, seq, page, row_index, CASE WHEN (row_index - 1) % 3 = 0 AND k % 7 <> 0 THEN 'IN' WHEN k % 11 <> 0 THEN 'OUT' ELSE direction END AS direction,
cast(date '1997-01-01' + cast(page * 20 + (row_index - row_index % 6) / 6 AS int) AS date) AS transaction_date, CASE WHEN right(account_number, 1) = '4' THEN 'deposit' ELSE 'credit' END AS account_kind,
CASE cast((row_index - 1) % 3 AS int) WHEN 0 THEN CASE WHEN k % 2 = 0 THEN '账单分期' ELSE '普通消费转分期' END WHEN 1 THEN CASE WHEN k % 13 = 0 THEN '网上消费' ELSE '消费' END ELSE CASE WHEN k % 3 = 0 THEN '费用' ELSE '消费（利息）' END END AS summary FROM printed"""


@query("w20_installment_sequence", f"""{PAGES}, c AS ({CONVERTED}), l AS (SELECT *, lead(id) OVER w AS i1, lead(id, 2) OVER w AS i2, lead(summary) OVER w AS s1, lead(summary, 2) OVER w AS s2, lead(direction) OVER w AS d1, lead(direction, 2) OVER w AS d2,
  lead(account_number) OVER w AS a1, lead(account_number, 2) OVER w AS a2, lead(transaction_date) OVER w AS t1, lead(transaction_date, 2) OVER w AS t2 FROM c WINDOW w AS (PARTITION BY case_id, source_document_id ORDER BY page, row_index, seq)),
h AS (SELECT * FROM l WHERE account_kind = 'credit' AND summary IN ('账单分期', '普通消费转分期') AND s1 = '消费' AND s2 IN ('费用', '消费（利息）', '消费(利息)') AND direction = 'IN' AND d1 = 'OUT' AND d2 = 'OUT' AND a1 = account_number AND a2 = account_number AND t1 = transaction_date AND t2 = transaction_date)
SELECT case_id, id, 'conversion' AS part FROM h UNION ALL SELECT case_id, i1, 'purchase' FROM h UNION ALL SELECT case_id, i2, 'interest' FROM h WHERE s2 <> '费用'""")
def _installments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.installment_sequences(spark.sql(CONVERTED.replace("FROM printed", "FROM {printed}"), printed=printed(spark, sf_dir)))


@query("w14_consolidated_account_split", f"""{ORACLE}, j AS (SELECT *, coalesce(regexp_matches(lag(summary) OVER w, '{P.SETTLEMENT}') AND abs(lag(balance_cents) OVER w + {SIGNED} - balance_cents) >= greatest(100000, 20 * amount_cents), false) AS edge FROM ledger WINDOW w AS (PARTITION BY {KEY} ORDER BY page, row_index, seq))
SELECT case_id, id, sum(edge::INT) OVER (PARTITION BY {KEY} ORDER BY page, row_index, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM j""")
def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.consolidated_split(ledger(spark, sf_dir))


def _two(c: str) -> str:
    return f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || cast((abs({c}) - abs({c}) % 100) / 100 AS bigint) || '.' || lpad(cast(abs({c}) % 100 AS string), 2, '0'))"


#: amounts and balances misread, some amounts printed in the raw text, closures that took the rest, credit cards
HURT = f"""SELECT case_id, source_document_id, account_number, CASE WHEN right(account_number, 2) IN ('09', '39') THEN '信用卡中心' ELSE bank_name END AS bank_name, id, seq, page, row_index, k, transaction_date, direction, counterparty_name, transaction_type,
CASE WHEN k % 9 = 0 THEN amount_cents + 10000 WHEN k % 11 = 0 THEN amount_cents * 2 WHEN summary = '销户' AND direction = 'OUT' AND k % 2 = 1 THEN amount_cents - 30000 ELSE amount_cents END AS amount_cents,
CASE WHEN k % 7 = 0 THEN balance_cents + 1000000 WHEN k % 13 = 0 THEN balance_cents + 7 ELSE balance_cents END AS balance_cents, summary, CASE WHEN k % 22 = 0 THEN '行 ' || {_two('amount_cents')} || ' 元' END AS raw_text FROM printed"""


def _near(a: str, b: str) -> str:
    return f"(CASE WHEN length({_two(a)}) = length({_two(b)}) THEN hamming({_two(a)}, {_two(b)}) <= 1 ELSE false END)"


def _shown(c: str) -> str:
    return " OR ".join(f"contains(coalesce({t}, ''), regexp_replace({_two(c)}, '\\.?0+$', ''))" for t in ("raw_text", "summary"))


def _healed_sql(ranked: str, rank: str) -> str:
    """CTEs up to repaired: the rows of an account one after the other, each seeing the repaired balance before."""
    way = "(CASE x.direction WHEN 'IN' THEN 1 WHEN 'OUT' THEN -1 END)"
    implied = "abs(x.after - s.balance)"
    bridge = f"""coalesce(x.before IS NOT NULL AND (abs(s.balance + {way} * x.amount_cents - x.balance_cents) >= 50 OR abs(x.after - x.balance_cents) >= 50) AND {implied} > 0 AND abs(s.balance + {way} * {implied} - x.after) < 5
      AND ({_near('x.amount_cents', implied)} OR {_shown(implied)}) AND {_near('x.balance_cents', 'x.after')}, false)"""
    return f"""cards AS (SELECT {KEY} FROM {ranked} GROUP BY ALL HAVING bool_or(contains(bank_name, '信用卡')) OR (count(balance_cents) > 0 AND count(*) FILTER (balance_cents < 0) >= ceil(count(balance_cents) / 2) AND count(*) FILTER (regexp_matches(concat_ws(' ', summary, counterparty_name, raw_text), '透支|年费|自动转[账帐]还款|分期付款|消费转分期|分期利息|分期费用')) >= least(2, count(*)))),
numbered AS (SELECT *, {rank} AS r, lag(balance_cents) OVER w AS before, lead(balance_cents - {SIGNED}) OVER w AS after FROM {ranked} ANTI JOIN cards USING ({KEY}) WINDOW w AS (PARTITION BY {KEY} ORDER BY {rank})),
walk AS (SELECT {KEY}, r, id, amount_cents AS old_amount, balance_cents AS old_balance, amount_cents AS amount, balance_cents AS balance, NULL::BIGINT AS previous, false AS bridged FROM numbered WHERE r = 1
  UNION ALL SELECT x.case_id, x.source_document_id, x.account_number, x.r, x.id, x.amount_cents, x.balance_cents, CASE WHEN {bridge} THEN {implied} ELSE x.amount_cents END, CASE WHEN {bridge} THEN x.after ELSE x.balance_cents END, s.balance, {bridge}
  FROM walk s JOIN numbered x ON x.case_id = s.case_id AND x.source_document_id = s.source_document_id AND x.account_number = s.account_number AND x.r = s.r + 1),
second AS (SELECT w.*, n.direction, n.summary, n.counterparty_name, n.raw_text, abs(w.balance - w.previous) AS implied, abs(w.previous + (CASE n.direction WHEN 'IN' THEN 1 WHEN 'OUT' THEN -1 END) * w.amount - w.balance) AS off FROM walk w JOIN numbered n USING (case_id, id)),
judged AS (SELECT *, coalesce(off >= 50 AND implied > 0 AND ({_near('amount', 'implied')} OR {_shown('implied')} OR (direction = 'OUT' AND regexp_matches(concat_ws(' ', summary, counterparty_name, raw_text), '{P.CLOSING}') AND implied >= amount AND off >= 100)), false) AS paired FROM second),
repaired AS (SELECT case_id, id, old_amount AS amount_cents, old_balance AS balance_cents, CASE WHEN bridged THEN amount ELSE implied END AS repaired_cents, balance AS repaired_balance_cents, CASE WHEN bridged THEN 'bridge' ELSE 'pair' END AS reason FROM judged WHERE bridged OR paired)"""


RECURSIVE_PAGES = PAGES.replace("WITH ", "WITH RECURSIVE ", 1)


def hurt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark.sql(HURT.replace("FROM printed", "FROM {printed}"), printed=demo_ledger.printed(spark, sf_dir)), "hurt")


@query("w9_bridge_heal", f"{RECURSIVE_PAGES}, hurt AS ({HURT}), {_chrono_sql('hurt')}, {_healed_sql('chrono', 'chrono_rank')} SELECT * FROM repaired")
def _heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.bridge_heal(sequence.chronological_rank(hurt(spark, sf_dir)))


#: corrections as a run before made them: bridges, of which some replaced more than a digit, and pairs
CORRECTED = """SELECT case_id, source_document_id, account_number, bank_name, transaction_type, counterparty_name, summary, raw_text, direction, id, amount_cents, balance_cents,
CASE cast(k % 4 AS int) WHEN 0 THEN amount_cents + 100 WHEN 1 THEN amount_cents * 3 + 1 WHEN 2 THEN NULL ELSE amount_cents END AS original_amount_cents, CASE WHEN k % 3 = 0 THEN balance_cents - 1 ELSE balance_cents END AS original_balance_cents,
CASE cast(k % 5 AS int) WHEN 0 THEN 'pair' WHEN 1 THEN 'year' ELSE 'bridge' END AS reason FROM hurt"""


@query("w13_unsupported_correction_undo", f"""{PAGES}, hurt AS ({HURT}), c AS ({CORRECTED}),
cards AS (SELECT {KEY}, true AS card FROM c GROUP BY ALL HAVING bool_or(contains(bank_name, '信用卡')) OR (count(balance_cents) > 0 AND count(*) FILTER (balance_cents < 0) >= ceil(count(balance_cents) / 2) AND count(*) FILTER (regexp_matches(concat_ws(' ', summary, counterparty_name, raw_text), '透支|年费|自动转[账帐]还款|分期付款|消费转分期|分期利息|分期费用')) >= least(2, count(*))))
SELECT case_id, id, coalesce(original_amount_cents, amount_cents) AS amount_cents, coalesce(original_balance_cents, balance_cents) AS balance_cents FROM c LEFT JOIN cards USING ({KEY})
WHERE reason = 'pair' AND card OR reason = 'bridge' AND (card OR NOT coalesce({_near('original_amount_cents', 'amount_cents')} AND {_near('original_balance_cents', 'balance_cents')} AND original_amount_cents IS NOT NULL AND original_balance_cents IS NOT NULL, false))""")
def _undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.undo_unsupported(spark.sql(CORRECTED.replace("FROM hurt", "FROM {hurt}"), hurt=hurt(spark, sf_dir)))


#: settlements in every other row, some with a misread year, some without amount, some with their date printed
SETTLED = """SELECT case_id, source_document_id, account_number, id, seq, page, row_index, direction, counterparty_name, raw_text, k % 23 = 0 AS date_printed,
CASE WHEN row_index % 4 < 3 THEN '结息' ELSE summary END AS summary, CASE WHEN row_index % 4 < 3 AND k % 5 = 0 THEN 0 ELSE amount_cents END AS amount_cents, CASE WHEN k % 31 = 0 THEN balance_cents + 900000000 ELSE balance_cents END AS balance_cents,
CASE WHEN row_index % 4 < 3 AND k % 6 = 0 AND date_format(transaction_date, 'MM-dd') <> '02-29' THEN cast(add_months(transaction_date, CASE WHEN k % 12 = 0 THEN 120 ELSE -48 END) AS date) WHEN k % 47 = 0 THEN NULL ELSE transaction_date END AS transaction_date FROM printed"""
_SETTLED = SETTLED.replace("date_format(transaction_date, 'MM-dd')", "strftime(transaction_date, '%m-%d')").replace("add_months(transaction_date, CASE WHEN k % 12 = 0 THEN 120 ELSE -48 END)", "transaction_date + to_months(CASE WHEN k % 12 = 0 THEN 120 ELSE -48 END)")


def _in_year(year: str) -> str:
    """The row's month and day in another year, null where there is no such day."""
    return f"try_cast(({year})::VARCHAR || strftime(x.transaction_date, '-%m-%d') AS DATE)"


_AT = f"coalesce({_in_year('year(s.last)')}, make_date(year(s.last), 3, 1))"
_NEXT = f"CASE WHEN x.way > 0 AND {_AT} <= s.last THEN {_in_year('year(s.last) + 1')} WHEN x.way < 0 AND {_AT} >= s.last THEN {_in_year('year(s.last) - 1')} ELSE {_in_year('year(s.last)')} END"
_KEEP = "s.last IS NULL OR x.edge OR NOT x.settles OR coalesce(x.date_printed, false) OR x.way = 0 OR abs(year(x.transaction_date) - year(s.last)) < 2 OR (x.way > 0 AND x.transaction_date > s.last) OR (x.way < 0 AND x.transaction_date < s.last)"


@query("w10_settlement_repair", f"""{RECURSIVE_PAGES}, settled AS ({_SETTLED}),
z AS (SELECT *, regexp_matches(concat_ws(' ', summary, counterparty_name, raw_text), '{P.SETTLEMENT}') AS settles, lag(balance_cents) OVER w AS pb, row_number() OVER w AS n, {SIGNED} AS delta,
  CASE WHEN abs(year(transaction_date) - year(lag(transaction_date) OVER w)) < 2 THEN sign(transaction_date - lag(transaction_date) OVER w) END AS vote FROM settled WINDOW w AS (PARTITION BY {KEY} ORDER BY page, row_index, seq)),
numbered AS (SELECT *, coalesce(settles AND lag(settles) OVER w AND abs(pb + delta - balance_cents) >= greatest(100000, 20 * abs(amount_cents)), false) AS edge, CASE WHEN sum(vote) OVER v >= 2 THEN 1 WHEN sum(vote) OVER v <= -2 THEN -1 ELSE 0 END AS way,
  CASE WHEN settles AND amount_cents <= 0 AND CASE direction WHEN 'IN' THEN balance_cents > pb WHEN 'OUT' THEN balance_cents < pb END THEN abs(balance_cents - pb) END AS repaired_cents FROM z WINDOW w AS (PARTITION BY {KEY} ORDER BY n), v AS (PARTITION BY {KEY})),
walk AS (SELECT {KEY}, 0::BIGINT AS n, NULL::VARCHAR AS id, NULL::DATE AS old, NULL::DATE AS day, NULL::DATE AS last FROM numbered WHERE n = 1
  UNION ALL SELECT case_id, source_document_id, account_number, n, id, old, day, coalesce(day, CASE WHEN NOT edge THEN before END) FROM (
    SELECT x.*, s.last AS before, x.transaction_date AS old, CASE WHEN {_KEEP} THEN x.transaction_date WHEN abs(year({_NEXT}) - year(x.transaction_date)) >= 2 THEN {_NEXT} ELSE x.transaction_date END AS day
    FROM walk s JOIN numbered x ON x.case_id = s.case_id AND x.source_document_id = s.source_document_id AND x.account_number = s.account_number AND x.n = s.n + 1))
SELECT case_id, id, CASE WHEN day <> old THEN day END AS repaired_date, repaired_cents::BIGINT AS repaired_cents FROM walk JOIN (SELECT case_id, id, repaired_cents FROM numbered) USING (case_id, id) WHERE coalesce(day <> old, false) OR repaired_cents IS NOT NULL""")
def _settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(SETTLED.replace("FROM printed", "FROM {printed}"), printed=demo_ledger.printed(spark, sf_dir))
    return sequence.settlement_repairs(written(rows, "settled"))
