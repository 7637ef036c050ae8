"""Queries on whole cases: flow, phases, events, netting, counterparties, key figures, rules, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import aggregates, events, flow, graph, netting, rules
from ..plans import demo_ledger
from ..plans.evaluate_case import Evaluation, evaluate_case
from ..plans.storage import written
from .registry import query


def _evaluation(spark: SparkSession, sf_dir: str) -> Evaluation:
    return evaluate_case(demo_ledger.ledger(spark, sf_dir), demo_ledger.accounts(spark, sf_dir), written(demo_ledger.cases(spark, sf_dir), "cases"))


def _likes(column: str, pattern: str) -> str:
    return f"regexp_matches(coalesce({column}, ''), '{pattern}')"


_FLOW_LADDER = "\n".join(f"WHEN direction = '{d}' AND regexp_matches(words, '{w}') THEN '{c}'" for d, w, c in P.FLOW_WORDS)
_FLOW_NAMES = ", ".join(f"('{c}', '{label}', '{d}', {p})" for c, label, d, p in P.FLOW_CODES)


def flow_sql(rows: str, internal: str = "false") -> str:
    """CTEs: flows is rows with flow_code."""
    return f"""
worded AS (SELECT *, lower(concat(coalesce(summary, ''), ' ', coalesce(counterparty_name, ''), ' ', coalesce(counterparty_bank, ''), ' ', coalesce(raw_text, ''))) AS words FROM {rows}),
flows AS (SELECT *, CASE WHEN {internal} OR direction = 'UNKNOWN' THEN NULL
  WHEN direction = 'OUT' AND regexp_matches(concat(coalesce(summary, ''), ' ', coalesce(raw_text, '')), '{P.JUDICIAL}') THEN 'JUDICIAL_DEDUCTION'
  {_FLOW_LADDER}
  WHEN direction = 'IN' AND (regexp_matches(words, '{P.TRANSFER_IN_WORDS}') OR counterparty_name <> '' OR counterparty_account <> '') THEN 'TRANSFER_IN'
  WHEN direction = 'OUT' AND (regexp_matches(words, '{P.TRANSFER_OUT_WORDS}') OR counterparty_name <> '' OR counterparty_account <> '') THEN 'TRANSFER_OUT'
  WHEN direction = 'IN' THEN 'OTHER_IN' ELSE 'OTHER_OUT' END AS flow_code FROM worded)"""


EVENTS_SQL = """
blocks AS (SELECT *, count(*) OVER (PARTITION BY case_id, account_number, transaction_date, direction, amount_cents) AS n FROM ledger),
scored AS (
  SELECT a.case_id, a.id AS a_id, b.id AS b_id,
         CASE WHEN a.balance_cents IS NOT NULL AND b.balance_cents IS NOT NULL THEN 4 ELSE 0 END
         + CASE WHEN a.counterparty_account <> '' AND b.counterparty_account <> '' THEN 3 ELSE 0 END
         + CASE WHEN a.summary = b.summary THEN 1 ELSE 0 END + CASE WHEN a.counterparty_name = b.counterparty_name THEN 1 ELSE 0 END AS points
  FROM blocks a JOIN blocks b USING (case_id, account_number, transaction_date, direction, amount_cents)
  WHERE a.n = 2 AND a.seq < b.seq AND direction IN ('IN', 'OUT') AND a.source_document_id <> b.source_document_id
    AND coalesce(a.balance_cents = b.balance_cents, true) AND coalesce(a.counterparty_account = b.counterparty_account, true)),
led AS (
  SELECT l.*, coalesce(s.a_id, l.id) AS leader, coalesce(s.points, t.points) AS points
  FROM ledger l LEFT JOIN scored s ON s.case_id = l.case_id AND s.b_id = l.id AND s.points >= 4
  LEFT JOIN scored t ON t.case_id = l.case_id AND t.a_id = l.id AND t.points >= 4),
named AS (
  SELECT *, first_value(id) OVER g AS representative_id, min(seq) OVER h AS event_seq, count(*) OVER h AS n_observations,
         CASE WHEN max(points) OVER h IS NULL THEN 1.0 ELSE least(0.99, 0.8 + 0.02 * max(points) OVER h) END AS confidence
  FROM led WINDOW h AS (PARTITION BY case_id, leader),
  g AS (PARTITION BY case_id, leader ORDER BY CASE WHEN balance_cents IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN counterparty_account <> '' THEN 5 ELSE 0 END DESC, id)),
event_ids AS (
  SELECT case_id, leader, 'event_' || left(sha256(concat_ws('|', account_number, cast(transaction_date AS varchar), direction, cast(amount_cents AS varchar),
         coalesce(cast(balance_cents AS varchar), ''), coalesce(counterparty_account, ''), lower(summary), id)), 16) AS event_id
  FROM named WHERE id = representative_id),
events AS (SELECT case_id, id, event_id, representative_id, event_seq, n_observations, confidence FROM named JOIN event_ids USING (case_id, leader)),
event_txn AS (SELECT l.* REPLACE (e.event_seq AS seq), e.event_id, e.n_observations FROM ledger l JOIN events e USING (case_id, id) WHERE e.id = e.representative_id)"""

_PHASE = "CASE " + " ".join(f"WHEN transaction_date >= {c} THEN '{tag}'" for c, tag in reversed(P.PHASES)) + f" WHEN transaction_date < t0 THEN '{P.PHASE_BEFORE_DEBT}' WHEN transaction_date >= t0 THEN '{P.PHASE_BEFORE_SUIT}' ELSE '{P.PHASE_DEFAULT}' END AS phase_tag"

EDGES_SQL = """
own AS (SELECT t.* FROM event_txn t SEMI JOIN (SELECT * FROM account WHERE owner_type = 'DEBTOR_MAIN') USING (case_id, account_number) WHERE direction IN ('IN', 'OUT')),
edges AS (
  SELECT DISTINCT a.case_id, amount_cents, a.id AS left_id, a.seq AS left_seq, b.id AS right_id, b.seq AS right_seq, abs(a.transaction_date - b.transaction_date) AS days,
         coalesce(a.counterparty_account = b.account_number AND b.counterparty_account = a.account_number, false) AS reciprocal
  FROM own a JOIN own b USING (case_id, amount_cents)
  WHERE a.seq < b.seq AND a.direction <> b.direction AND a.account_number <> b.account_number AND abs(a.transaction_date - b.transaction_date) <= 2
    AND (a.counterparty_account = b.account_number OR b.counterparty_account = a.account_number)
    AND coalesce(a.counterparty_account = b.account_number, true) AND coalesce(b.counterparty_account = a.account_number, true))"""

#: Pairs by mutual uniqueness: enough wherever no row has two possible partners, as in the derived ledger.
NETTED_SQL = f"""{EDGES_SQL},
pairs AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY case_id, left_id) AS dl, count(*) OVER (PARTITION BY case_id, right_id) AS dr FROM edges)
  WHERE dl = 1 AND dr = 1),
sides AS (SELECT case_id, left_id AS id, right_id AS internal_pair_id FROM pairs UNION ALL SELECT case_id, right_id, left_id FROM pairs),
analysed AS (
  SELECT t.*, internal_pair_id, internal_pair_id IS NOT NULL AS is_internal, {_PHASE}
  FROM event_txn t JOIN legal_case USING (case_id) LEFT JOIN sides USING (case_id, id))"""

PARTIES_SQL = f"""
parties AS (
  SELECT *, CASE WHEN counterparty_account <> '' THEN 'account:' || counterparty_account WHEN party_name <> '' AND NOT regexp_matches(party_name, '{P.UNKNOWN_PARTY}') THEN party_name
              ELSE concat_ws(':', 'unknown', source_document_id, id) END AS party_key
  FROM (SELECT *, CASE WHEN {_likes('summary', P.JUDICIAL)} AND (coalesce(trim(counterparty_name), '') = '' OR regexp_matches(counterparty_name, '{P.JUDICIAL_PARTY}')) THEN '{P.JUDICIAL_NAME}'
                    WHEN trim(counterparty_name) <> '' THEN trim(counterparty_name)
                    WHEN {_likes('summary', P.CASH_CONTEXT)} THEN '{P.CASH_NAME}' ELSE '{P.UNKNOWN_NAME}' END AS party_name
        FROM analysed WHERE NOT is_internal)),
kin AS (
  SELECT *, coalesce(respondent_name <> '' AND starts_with(party_name, left(respondent_name, 1)) AND length(party_name) <= 4 AND party_name <> respondent_name, false) OR {_likes('summary', P.RELATIVE_SUMMARY)} AS is_kin
  FROM parties LEFT JOIN (SELECT case_id, trim(coalesce(respondent_name, '')) AS respondent_name FROM legal_case) USING (case_id)),
summary AS (
  SELECT case_id, party_key, arg_min(counterparty_role_tag, seq) FILTER (counterparty_role_tag <> '') AS role_tag, arg_min(is_kin, seq) AS suspected_relative, arg_min(party_name, seq) AS name, arg_min(counterparty_account, seq) AS account,
         sum(CASE WHEN direction = 'IN' THEN amount_cents ELSE 0 END)::BIGINT AS in_cents, sum(CASE WHEN direction = 'OUT' THEN amount_cents ELSE 0 END)::BIGINT AS out_cents,
         count(*) AS n_rows, count(DISTINCT party_name) AS n_aliases, min(transaction_date) AS earliest_date, max(transaction_date) AS latest_date,
         sum(CASE WHEN direction = 'OUT' THEN amount_cents WHEN direction = 'IN' THEN -amount_cents ELSE 0 END)::BIGINT AS net_out_cents
  FROM kin GROUP BY 1, 2)"""

CASE_SQL = f"{demo_ledger.ORACLE}, {EVENTS_SQL}, {NETTED_SQL}, {PARTIES_SQL}"


@query("a7_flow_category_totals", f"""{demo_ledger.ORACLE}, {flow_sql('ledger')}, names(flow_code, label, direction, priority) AS (VALUES {_FLOW_NAMES})
SELECT case_id, flow_code, label, n.direction, priority, sum(amount_cents)::BIGINT AS total_cents, count(*) AS n_rows FROM flows JOIN names n USING (flow_code) GROUP BY ALL""")
def _a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.flow_category_totals(demo_ledger.ledger(spark, sf_dir).withColumn("is_internal", F.lit(False)))


@query("demo_ledger", f"{demo_ledger.ORACLE} SELECT * FROM ledger")
def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo_ledger.ledger(spark, sf_dir)


@query("classify_flow", f"{demo_ledger.ORACLE}, {flow_sql('ledger')} SELECT case_id, id, flow_code FROM flows")
def _classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.classify_flow(demo_ledger.ledger(spark, sf_dir).withColumn("is_internal", F.lit(False))).select("case_id", "id", "flow_code")


@query("phase_tag", f"{demo_ledger.ORACLE} SELECT case_id, id, {_PHASE} FROM ledger JOIN legal_case USING (case_id)")
def _phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.tag_phases(demo_ledger.ledger(spark, sf_dir), demo_ledger.cases(spark, sf_dir)).select("case_id", "id", "phase_tag")


@query("d3_canonical_events", f"{demo_ledger.ORACLE}, {EVENTS_SQL} SELECT * FROM events")
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.canonical_events(demo_ledger.ledger(spark, sf_dir))


#: Copies of the rows with a copy in another document: C declares its row, X in the same document doesn't; D declares C with
#: another amount, and is verified. The rest of k sets their order.
DECLARED = """
base AS (SELECT * FROM ledger WHERE row_index % 11 = 0 AND seq % 4 = 0 AND id NOT LIKE '%B'),
copies AS (
  SELECT case_id, id, seq * 10 AS place, row_index AS k, account_number, transaction_date, direction, amount_cents, balance_cents, summary, counterparty_name, counterparty_account, source_document_id, raw_text, cast(NULL AS string) AS duplicate_of, cast(NULL AS string) AS review_status FROM base
  UNION ALL SELECT case_id, concat(id, '_B'), seq * 10 + 5, row_index, account_number, transaction_date, direction, amount_cents, balance_cents, summary, counterparty_name, counterparty_account, 'DOC_B', raw_text, NULL, NULL FROM base
  UNION ALL SELECT case_id, concat(id, '_C'), seq * 10 + CASE WHEN row_index % 3 = 0 THEN 7 ELSE 2 END, row_index, account_number, transaction_date, direction, amount_cents, balance_cents, summary, counterparty_name, counterparty_account, 'DOC_C', raw_text, id, NULL FROM base
  UNION ALL SELECT case_id, concat(id, '_X'), seq * 10 + CASE WHEN row_index % 2 = 0 THEN 9 ELSE 1 END, row_index, account_number, transaction_date, direction, amount_cents, balance_cents, summary, counterparty_name, counterparty_account, 'DOC_C', raw_text, NULL, NULL FROM base
  UNION ALL SELECT case_id, concat(id, '_D'), seq * 10 + 3, row_index, account_number, transaction_date, direction, amount_cents + 1, balance_cents, summary, counterparty_name, counterparty_account, source_document_id, raw_text, concat(id, '_C'), 'VERIFIED' FROM base WHERE row_index % 5 = 0 AND row_index % 3 <> 0)"""


@query("d3_declared_events", f"""{demo_ledger.ORACLE}, {DECLARED}, f AS (SELECT *, CASE WHEN id LIKE '%\\_B' ESCAPE '\\' THEN 'B' WHEN id LIKE '%\\_C' ESCAPE '\\' THEN 'C' WHEN id LIKE '%\\_X' ESCAPE '\\' THEN 'X' WHEN id LIKE '%\\_D' ESCAPE '\\' THEN 'D' ELSE 'A' END AS kind, k % 5 = 0 AND k % 3 <> 0 AS d, 'TX_' || k AS a,
CASE WHEN balance_cents IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN counterparty_account <> '' THEN 3 ELSE 0 END + 2 AS p FROM copies), g AS (SELECT *, p >= 4 AND direction <> 'UNKNOWN' AS m FROM f),
l AS (SELECT *, CASE WHEN kind IN ('A', 'C', 'D') OR (kind = 'B' AND m AND NOT d) OR (kind = 'X' AND m AND k % 2 = 1) THEN a WHEN kind = 'X' AND m AND d THEN a || '_B' ELSE id END AS leader FROM g)
SELECT case_id, id, CASE WHEN leader = a AND d THEN a || '_D' ELSE leader END AS representative_id, count(*) OVER w AS n_observations, min(place) OVER w AS event_seq,
least(CASE WHEN leader = a THEN 0.98 ELSE 1.0 END, CASE WHEN max(CASE WHEN kind IN ('B', 'X') AND id <> leader THEN 1 ELSE 0 END) OVER w = 1 THEN least(0.99, 0.8 + 0.02 * p) ELSE 1.0 END)::DOUBLE AS confidence FROM l WINDOW w AS (PARTITION BY case_id, leader)""")
def _declared_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"WITH {DECLARED.replace('FROM ledger', 'FROM {ledger}')} SELECT * FROM copies", ledger=demo_ledger.ledger(spark, sf_dir)).withColumnRenamed("place", "seq")
    return events.canonical_events(written(rows, "copies")).select("case_id", "id", "representative_id", "n_observations", "event_seq", "confidence")


@query("d4_representatives", f"{demo_ledger.ORACLE}, {EVENTS_SQL} SELECT case_id, event_id, representative_id, max(n_observations) AS n_observations FROM events GROUP BY ALL")
def _representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.canonical_events(demo_ledger.ledger(spark, sf_dir)).select("case_id", "event_id", "representative_id", "n_observations").distinct()


@query("d5_project_events_back", f"""{CASE_SQL}
SELECT l.case_id, l.id, e.event_id, CASE WHEN e.id <> e.representative_id THEN e.representative_id END AS duplicate_of_id, e.id <> e.representative_id AS excluded,
       a.phase_tag, CASE WHEN e.id = e.representative_id THEN a.is_internal END AS is_internal
FROM ledger l JOIN events e USING (case_id, id) JOIN analysed a ON a.case_id = l.case_id AND a.id = e.representative_id""")
def _project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).projected().select("case_id", "id", "event_id", "duplicate_of_id", "excluded", "phase_tag", "is_internal")


@query("g4_duplicate_groups", f"{demo_ledger.ORACLE}, {EVENTS_SQL} SELECT case_id, event_id, string_agg(id, ',' ORDER BY id) AS observation_ids FROM events WHERE n_observations > 1 GROUP BY ALL")
def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.duplicate_groups(events.canonical_events(demo_ledger.ledger(spark, sf_dir)))


@query("j2_duplicate_of", f"""{demo_ledger.ORACLE} SELECT l.case_id, l.id, t.id AS duplicate_of, t.source_document_id AS target_document FROM ledger l JOIN ledger t ON l.case_id = t.case_id AND l.id = t.id || '_B'""")
def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo_ledger.ledger(spark, sf_dir)
    return events.declared_duplicates(rows.withColumn("duplicate_of", F.when(F.endswith("id", F.lit("_B")), F.regexp_replace("id", "_B$", ""))))


@query("j3_internal_transfer_edges", f"{demo_ledger.ORACLE}, {EVENTS_SQL}, {EDGES_SQL} SELECT * FROM edges")
def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).transfer_edges.withColumn("days", F.col("days").cast("long"))


@query("d6_internal_netting", f"{CASE_SQL} SELECT case_id, id, internal_pair_id FROM analysed WHERE is_internal")
def _netting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).analysed.where("is_internal").select("case_id", "id", "internal_pair_id")


FAST_SQL = """fast AS (
  SELECT i.case_id, account_number, i.id AS left_id, i.seq AS left_seq, o.id AS right_id, o.seq AS right_seq, i.amount_cents AS in_cents, o.amount_cents AS out_cents
  FROM analysed i JOIN analysed o USING (case_id, account_number)
  WHERE NOT i.is_internal AND NOT o.is_internal AND i.direction = 'IN' AND o.direction = 'OUT' AND o.seq > i.seq AND i.amount_cents >= 3000000
    AND o.transaction_date - i.transaction_date BETWEEN 0 AND 2 AND abs(o.amount_cents - i.amount_cents) * 100 <= 15 * i.amount_cents)"""
#: enough wherever no receipt or pay-out has two possible partners, as in the derived ledger
LONE_SQL = "lone AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY case_id, account_number, left_id) AS dl, count(*) OVER (PARTITION BY case_id, account_number, right_id) AS dr FROM fast) WHERE dl = 1 AND dr = 1)"


@query("j4_fast_in_out_edges", f"{CASE_SQL}, {FAST_SQL} SELECT * FROM fast")
def _fast_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netting.fast_in_out_edges(_evaluation(spark, sf_dir).analysed)


@query("a1_counterparty_summary", f"{CASE_SQL} SELECT * FROM summary")
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).summary.drop("frequent_summaries")


@query("a1_frequent_summaries", f"""{CASE_SQL}, firsts AS (SELECT case_id, party_key, summary, min(seq) AS first_at FROM parties WHERE summary <> '' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id, party_key ORDER BY first_at, summary) AS r FROM firsts)
SELECT case_id, party_key, string_agg(summary, ',' ORDER BY r) AS frequent_summaries FROM ranked WHERE r <= 5 GROUP BY ALL""")
def _frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).summary.select("case_id", "party_key", F.array_join("frequent_summaries", ",").alias("frequent_summaries"))


@query("j5_counterparty_lookup", f"""{CASE_SQL} SELECT p.case_id, p.id, s.in_cents FROM parties p LEFT JOIN summary s ON s.case_id = p.case_id AND s.party_key = p.party_key WHERE p.direction = 'OUT'""")
def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _evaluation(spark, sf_dir)
    return aggregates.counterparty_lookup(found.context.external.where("direction = 'OUT'"), found.summary, ["in_cents"]).select("case_id", "id", "in_cents")


@query("a5_case_kpis", f"""{CASE_SQL}, s AS (
SELECT case_id, sum(amount_cents) FILTER (direction = 'IN') AS raw_in, sum(amount_cents) FILTER (direction = 'OUT') AS raw_out, sum(amount_cents) FILTER (direction = 'IN' AND is_internal) AS internal,
  count(*) FILTER (is_internal) AS internal_rows, sum(amount_cents) FILTER (direction = 'OUT' AND NOT is_internal AND transaction_date >= t3) AS pe, sum(amount_cents) FILTER (direction = 'OUT' AND NOT is_internal AND transaction_date >= t4) AS pr,
  sum(amount_cents) FILTER (direction = 'IN' AND NOT is_internal AND transaction_date >= t3) AS inc, count(*) AS canonical_rows FROM analysed JOIN legal_case USING (case_id) GROUP BY 1),
o AS (SELECT case_id, count(*) AS observation_rows FROM ledger GROUP BY 1)
SELECT case_id, target_cents, coalesce(raw_in, 0)::BIGINT AS raw_in_cents, coalesce(raw_out, 0)::BIGINT AS raw_out_cents, coalesce(internal, 0)::BIGINT AS internal_cents, coalesce(internal_rows, 0) AS internal_rows,
  coalesce(pe, 0)::BIGINT AS post_execution_out_cents, coalesce(pr, 0)::BIGINT AS post_report_out_cents, coalesce(inc, 0)::BIGINT AS execution_income_cents, coalesce(canonical_rows, 0) AS canonical_rows,
  coalesce(observation_rows, 0) AS observation_rows, (coalesce(raw_in, 0) - coalesce(internal, 0))::BIGINT AS net_in_cents, (coalesce(raw_out, 0) - coalesce(internal, 0))::BIGINT AS net_out_cents,
  coalesce(observation_rows, 0) - coalesce(canonical_rows, 0) AS duplicate_rows, coalesce(inc, 0)::DOUBLE / target_cents AS solvency_ratio
FROM legal_case LEFT JOIN s USING (case_id) LEFT JOIN o USING (case_id)""")
def _kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).kpis()


@query("a8_top_counterparties", f"""{CASE_SQL} SELECT * FROM (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY out_cents DESC, party_key) AS rank, party_key, name, in_cents, out_cents, net_out_cents FROM summary) WHERE rank <= 10""")
def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_counterparties(_evaluation(spark, sf_dir).summary)


@query("a8_sankey_links", f"""{demo_ledger.ORACLE}, {flow_sql('ledger')}
SELECT case_id, CASE WHEN direction = 'IN' THEN flow_code ELSE 'POOL' END AS source, CASE WHEN direction = 'IN' THEN 'POOL' ELSE flow_code END AS target, sum(amount_cents)::BIGINT AS total_cents FROM flows WHERE flow_code IS NOT NULL GROUP BY ALL""")
def _sankey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.sankey_links(_a7(spark, sf_dir))


@query("a13_diagnostics", f"""{demo_ledger.ORACLE} SELECT case_id, count(DISTINCT source_document_id) AS files, count(DISTINCT account_number) AS accounts, count(*) AS n_rows, count(*) FILTER (balance_cents IS NULL) AS no_balance,
count(*) FILTER (direction = 'UNKNOWN') AS unknown_direction, count(*) FILTER (amount_cents <= 0) AS no_amount FROM ledger GROUP BY 1""")
def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.diagnostics(demo_ledger.ledger(spark, sf_dir))


FACTS = ["id", "account_number", "transaction_date", "direction", "amount_cents", "balance_cents", "summary", "counterparty_name", "counterparty_account"]


@query("a15_analysis_fingerprint", f"""{demo_ledger.ORACLE}, h AS (SELECT case_id, ('0x' || left(md5(concat_ws('|', {', '.join(f"coalesce(cast({f} AS varchar), '')" for f in FACTS)})), 15))::BIGINT AS h FROM ledger),
s AS (SELECT case_id, count(*) AS n_rows, sum(h)::VARCHAR AS hash_sum, bit_xor(h) AS hash_xor FROM h GROUP BY 1) SELECT *, sha256(concat_ws('|', n_rows, hash_sum, hash_xor)) AS fingerprint FROM s""")
def _fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.fingerprint(demo_ledger.ledger(spark, sf_dir), FACTS)


@query("a17_ownership_groups", f"{demo_ledger.ORACLE} SELECT case_id, account_name, count(DISTINCT account_number) AS n_accounts, string_agg(DISTINCT owner_type, ',' ORDER BY owner_type) AS owner_types FROM account GROUP BY 1, 2")
def _ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.ownership_groups(demo_ledger.accounts(spark, sf_dir))


@query("a3_account_totals", f"""{demo_ledger.ORACLE}, names AS (SELECT case_id, source_document_id, account_number, account_name, row_number() OVER (PARTITION BY case_id, source_document_id, account_number ORDER BY count(*) DESC, length(account_name), account_name) AS r FROM ledger GROUP BY 1, 2, 3, 4),
banks AS (SELECT case_id, source_document_id, account_number, bank_name, row_number() OVER (PARTITION BY case_id, source_document_id, account_number ORDER BY count(*) DESC, length(bank_name), bank_name) AS r FROM ledger GROUP BY 1, 2, 3, 4)
SELECT case_id, source_document_id, account_number, sum(CASE WHEN direction = 'IN' THEN amount_cents ELSE 0 END)::BIGINT AS in_cents, sum(CASE WHEN direction = 'OUT' THEN amount_cents ELSE 0 END)::BIGINT AS out_cents, count(*) AS n_rows,
  min(transaction_date) AS start_date, max(transaction_date) AS end_date, count(DISTINCT page) AS n_pages, bool_or(balance_cents IS NOT NULL) AS has_balance, any_value(n.account_name) AS account_name, any_value(b.bank_name) AS bank_name
FROM ledger l JOIN names n USING (case_id, source_document_id, account_number) JOIN banks b USING (case_id, source_document_id, account_number) WHERE n.r = 1 AND b.r = 1 GROUP BY 1, 2, 3""")
def _account_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.account_totals(demo_ledger.ledger(spark, sf_dir))


@query("a4_zero_txn_accounts", f"{demo_ledger.ORACLE} SELECT case_id, account_number, account_name, owner_type FROM account ANTI JOIN ledger USING (case_id, account_number)")
def _zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.accounts_without_rows(demo_ledger.accounts(spark, sf_dir), demo_ledger.ledger(spark, sf_dir))


@query("j1_txn_to_account", f"""{demo_ledger.ORACLE} SELECT case_id, id, account_number AS matched_account, source_document_id AS matched_document FROM ledger JOIN account USING (case_id, account_number, source_document_id)""")
def _txn_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.transaction_accounts(demo_ledger.ledger(spark, sf_dir), demo_ledger.accounts(spark, sf_dir))


def _rule_sql(rule: str, ident: str, severity: str, kind: str, n: str, total: str, phase: str, party: str, rest: str) -> str:
    return f"{CASE_SQL} SELECT case_id, '{rule}_' || {ident} AS match_id, '{rule}' AS rule_id, {severity} AS severity, {kind} AS match_type, ({n})::BIGINT AS n_rows, ({total})::BIGINT AS total_cents, {phase} AS time_phase, {party} AS counterparty {rest}"


def _single_sql(rule: str, where: str, severity: str = "'L1'", phase: str = "phase_tag", joins: str = "") -> str:
    return _rule_sql(rule, "id", severity, "'SINGLE'", "1", "amount_cents", phase, "counterparty_name", f"FROM analysed {joins} WHERE {where}")


_R08 = f"""(SELECT *, CASE WHEN {_likes('counterparty_name', P.R08_INSURANCE_PARTY)} OR {_likes('summary', P.R08_INSURANCE_SUMMARY)} THEN '保险保单'
  WHEN {_likes('counterparty_name', P.R08_SECURITIES_PARTY)} OR {_likes('summary', P.R08_SECURITIES_SUMMARY)} THEN '证券/基金/信托' WHEN {_likes('counterparty_name', P.R08_WEALTH)} OR {_likes('summary', P.R08_WEALTH)} THEN '银行理财/大额存单' END AS kind
  FROM analysed JOIN legal_case USING (case_id) WHERE NOT is_internal AND direction = 'OUT')"""
RULE_SQL = {
    "R01": _single_sql("R01", "NOT is_internal AND direction = 'OUT' AND amount_cents >= 5000000 AND transaction_date >= t3", "CASE WHEN transaction_date >= t4 THEN 'L0' ELSE 'L1' END", "CASE WHEN transaction_date >= t4 THEN '《报告财产令》送达后' ELSE '执行立案后' END", "JOIN legal_case USING (case_id)"),
    "R02": _rule_sql("R02", "'GROUP_ALL'", "'L0'", "'GROUP'", "count(*)", "sum(amount_cents)", "arg_min(phase_tag, seq)", "'【现金取现/ATM】'", f"FROM analysed WHERE NOT is_internal AND direction = 'OUT' AND ({_likes('summary', P.R02_SUMMARY)} OR {_likes('counterparty_name', P.R02_PARTY)}) AND amount_cents BETWEEN 4500000 AND 5000000 GROUP BY case_id HAVING count(*) >= 2"),
    "R03": _rule_sql("R03", "party_key", "CASE WHEN net_out_cents >= 10000000 THEN 'L0' ELSE 'L1' END", "'GROUP'", "n_rows", "net_out_cents", "'多阶段累计'", "name", f"FROM summary WHERE (suspected_relative OR {_likes('role_tag', '亲属|配偶')}) AND n_rows >= 3 AND net_out_cents >= 3000000"),
    "R05": _rule_sql("R05", "p.id", "CASE WHEN s.in_cents * 10 < p.amount_cents * 3 THEN 'L1' ELSE 'L2' END", "'SINGLE'", "1", "p.amount_cents", "p.phase_tag", "p.counterparty_name", f"FROM parties p JOIN summary s USING (case_id, party_key) WHERE direction = 'OUT' AND amount_cents >= 100000 AND {_likes('summary', P.R05_REPAYMENT)}").replace("p.summary", "summary"),
    "R04": _rule_sql("R04", "left_id || '_' || right_id", "'L1'", "'GROUP'", "2", "i.amount_cents", "i.phase_tag", "coalesce(i.counterparty_name, '未知来源') || ' -> ' || coalesce(o.counterparty_name, '未知去向')", "FROM lone JOIN (SELECT case_id, id AS left_id, amount_cents, phase_tag, counterparty_name FROM analysed) i USING (case_id, left_id) JOIN (SELECT case_id, id AS right_id, counterparty_name FROM analysed) o USING (case_id, right_id)"),
    "R06": _rule_sql("R06", "p.id", "'L1'", "'SINGLE'", "1", "p.amount_cents", "p.phase_tag", "p.counterparty_name", f"FROM parties p JOIN summary s USING (case_id, party_key) WHERE direction = 'OUT' AND amount_cents >= 2000000 AND {_likes('summary', P.R06_TRADE)} AND {_likes('role_tag', '关联|独资')}"),
    "R07": _single_sql("R07", _likes("summary", P.R07_CLOSURE)),
    "R08": _rule_sql("R08", "key", "'L1'", "CASE WHEN count(*) > 1 THEN 'GROUP' ELSE 'SINGLE' END", "count(*)", "sum(amount_cents)",
                     "CASE WHEN count(*) = count(*) FILTER (transaction_date < t5) THEN '冻结前购买/缴费（冻结日 ' || max(t5) || '）' WHEN count(*) FILTER (transaction_date < t5) > 0 THEN '冻结前后均有交易（冻结日 ' || max(t5) || '）' ELSE arg_min(phase_tag, (transaction_date, seq)) END",
                     "coalesce(arg_min(counterparty_name, (transaction_date, seq)), '相关金融机构')", f"FROM (SELECT *, kind || '::' || coalesce(nullif(counterparty_name, ''), summary) AS key FROM {_R08} WHERE amount_cents >= CASE WHEN kind = '保险保单' THEN 50000 ELSE 500000 END AND kind IS NOT NULL) GROUP BY case_id, key"),
    "R09": _rule_sql("R09", "'GROUP_ALL'", "'L2'", "'GROUP'", "sum(n)", "sum(total)", "'全执行周期'", "'【持续性收入来源方】'", f"FROM (SELECT case_id, counterparty_name, count(*) AS n, sum(amount_cents) AS total FROM analysed JOIN legal_case USING (case_id) WHERE NOT is_internal AND direction = 'IN' AND transaction_date >= t3 AND counterparty_name <> '' AND ({_likes('summary', P.R09_INCOME)} OR amount_cents >= 500000) GROUP BY 1, 2 HAVING count(DISTINCT strftime(transaction_date, '%Y-%m')) >= 2) GROUP BY case_id HAVING sum(n) >= 2"),
    "R10": _single_sql("R10", f"NOT is_internal AND direction = 'OUT' AND amount_cents >= 2000000 AND NOT {_likes('summary', P.R10_REPAYMENT)} AND {_likes('summary', P.R10_LENDING)}"),
    "R11": _rule_sql("R11", "'INCOME_DISCREPANCY'", "'L0'", "'GROUP'", "count(*)", "sum(amount_cents)", "'《报告财产令》送达后'", "'【多方收入来源】'", f"FROM analysed JOIN legal_case USING (case_id) WHERE NOT is_internal AND direction = 'IN' AND transaction_date >= t4 AND declared_income_cents = 0 AND {_likes('declared_content', P.R11_NO_INCOME)} GROUP BY case_id HAVING sum(amount_cents) > 1000000"),
}


def _rule_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _evaluation(spark, sf_dir).matches(enabled=[name])

    return run


for _name in rules.RULES:
    query(f"{_name.lower()}_rule", RULE_SQL[_name].replace(CASE_SQL, f"{CASE_SQL}, {FAST_SQL}, {LONE_SQL}"))(_rule_query(_name))


@query("r12_all_rules", f"{CASE_SQL}, {FAST_SQL}, {LONE_SQL} " + " UNION ALL ".join(sql.removeprefix(CASE_SQL) for sql in RULE_SQL.values()))
def _all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).matches()


@query("r13_annotation_carry_over", RULE_SQL["R10"].replace(" AS counterparty ", " AS counterparty, CASE WHEN amount_cents % 2 = 0 THEN true END AS lawyer_adopted "))
def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = _evaluation(spark, sf_dir).matches(enabled=["R10"])
    before = matches.where("total_cents % 2 = 0").select("case_id", "match_id", F.lit(True).alias("lawyer_adopted"))
    return rules.carry_annotations(matches, before)


@query("g1_account_entities", f"""{CASE_SQL} SELECT case_id, account_number, arg_min(account_name, seq) AS account_name, string_agg(DISTINCT source_document_id, ',' ORDER BY source_document_id) AS documents, count(*) AS n_rows FROM analysed GROUP BY 1, 2""")
def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.account_entities(_evaluation(spark, sf_dir).analysed)


@query("g2_counterparty_entities", f"""{CASE_SQL} SELECT case_id, party_key, count(*) AS n_rows, count(*) FILTER (direction = 'IN') AS n_in, count(*) FILTER (direction = 'OUT') AS n_out, string_agg(DISTINCT party_name, ',' ORDER BY party_name) AS aliases FROM parties GROUP BY 1, 2""")
def _parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.counterparty_entities(_evaluation(spark, sf_dir).analysed)


@query("g3_relationships", f"""{CASE_SQL}, {flow_sql('analysed', 'is_internal')}
SELECT case_id, 'ACCOUNT_HAS_TRANSACTION' AS type, 'account|' || account_number AS from_id, event_id AS to_id, amount_cents FROM analysed
UNION ALL SELECT case_id, 'TRANSACTION_WITH_COUNTERPARTY', event_id, 'party|' || party_key, amount_cents FROM parties
UNION ALL SELECT case_id, 'TRANSACTION_CLASSIFIED_AS', event_id, 'flow|' || flow_code, amount_cents FROM flows WHERE flow_code IS NOT NULL
UNION ALL SELECT a.case_id, 'INTERNAL_TRANSFER_PAIR', a.event_id, b.event_id, a.amount_cents FROM analysed a JOIN analysed b ON a.case_id = b.case_id AND a.internal_pair_id = b.id WHERE a.id < b.id
UNION ALL SELECT case_id, 'JUDICIAL_DEDUCTION_FROM_ACCOUNT', 'account|' || account_number, 'judicial|' || id, amount_cents FROM analysed WHERE direction = 'OUT' AND {_likes('summary', P.JUDICIAL)}
UNION ALL SELECT case_id, 'JUDICIAL_DEDUCTION_TO_AUTHORITY', 'judicial|' || id, 'party|' || party_key, amount_cents FROM parties WHERE direction = 'OUT' AND {_likes('summary', P.JUDICIAL)}""")
def _relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relationships(_evaluation(spark, sf_dir).analysed)


@query("g5_drill_down", f"{CASE_SQL}, {flow_sql('analysed', 'is_internal')} SELECT case_id, id, transaction_date, amount_cents FROM flows WHERE flow_code = 'INSURANCE'")
def _drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.drill_down(_evaluation(spark, sf_dir).analysed, "INSURANCE").select("case_id", "id", "transaction_date", "amount_cents")


@query("ledger_search", f"{demo_ledger.ORACLE} SELECT case_id, id FROM ledger WHERE lower(concat_ws(' ', account_name, counterparty_name, counterparty_account, summary, account_number, bank_name)) LIKE '%supplier#000000007%'")
def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.search(demo_ledger.ledger(spark, sf_dir), "Supplier#000000007").select("case_id", "id")
