"""Queries that score a reading of the derived ledger against the ledger itself.

The reading differs as FIXTURES.md says: an amount off by a digit, rows missing, rows read twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from ..plans import demo_ledger
from ..plans.demo_ledger import ORACLE
from ..plans.storage import written
from .registry import query


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ledger, written: operators that join it with itself start from a table."""
    return written(demo_ledger.ledger(spark, sf_dir), "ledger")


FIELDS = ["account_number", "transaction_date", "direction", "amount_cents", "balance_cents", "summary", "counterparty_name", "counterparty_account"]
DOCUMENT = ["case_id", "source_document_id"]
WRONG = 101
SQL = f"""{ORACLE}, gold AS (SELECT id AS gold_id, case_id, source_document_id, {', '.join(FIELDS)} FROM ledger),
once AS (SELECT id, row_index, case_id, source_document_id, {', '.join(FIELDS)} FROM ledger WHERE row_index % 211 <> 0),
pred AS (SELECT id || '#' || n AS pred_id, case_id, source_document_id, * EXCLUDE (id, row_index, case_id, source_document_id, n) REPLACE (CASE WHEN row_index % {WRONG} = 0 THEN amount_cents + 100 ELSE amount_cents END AS amount_cents)
  FROM (SELECT *, unnest(CASE WHEN row_index % 307 = 0 THEN [1, 2] ELSE [1] END) AS n FROM once)),
alerts AS (SELECT pred_id, 'digits' AS stage FROM pred WHERE amount_cents % 700 = 0 UNION ALL SELECT id || '#1', 'source' FROM ledger WHERE row_index % 202 = 0 AND row_index % 211 <> 0)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = ledger(spark, sf_dir)
    gold = rows.select(F.col("id").alias("gold_id"), *DOCUMENT, *FIELDS)
    copies = F.explode(F.when(F.col("row_index") % 307 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("n")
    read = rows.where("row_index % 211 <> 0").select("*", copies).withColumn("amount_cents", F.when(F.col("row_index") % WRONG == 0, F.col("amount_cents") + 100).otherwise(F.col("amount_cents")))
    pred = read.select(F.concat_ws("#", "id", "n").alias("pred_id"), *DOCUMENT, *FIELDS)
    source = rows.where("row_index % 202 = 0 and row_index % 211 <> 0").select(F.concat("id", F.lit("#1")).alias("pred_id"), F.lit("source").alias("stage"))
    return gold, pred, pred.where("amount_cents % 700 = 0").select("pred_id", F.lit("digits").alias("stage")).unionByName(source)


GRAINS = {"row": FIELDS, "money": ["account_number", "amount_cents"], "day": ["account_number", "transaction_date", "direction"]}


def _grain_sql(name: str, fields: list[str]) -> str:
    c = ", ".join(DOCUMENT + fields)
    on = " AND ".join(f"g.{f} IS NOT DISTINCT FROM p.{f}" for f in DOCUMENT + fields)
    return f"""SELECT coalesce(g.case_id, p.case_id) AS case_id, coalesce(g.source_document_id, p.source_document_id) AS source_document_id, sum(coalesce(g.n, 0))::BIGINT AS gold_rows, sum(coalesce(p.n, 0))::BIGINT AS pred_rows, sum(least(coalesce(g.n, 0), coalesce(p.n, 0)))::BIGINT AS common_rows, '{name}' AS grain
FROM (SELECT {c}, count(*) AS n FROM gold GROUP BY ALL) g FULL JOIN (SELECT {c}, count(*) AS n FROM pred GROUP BY ALL) p ON {on} GROUP BY 1, 2"""


@query("a11_first_pass_coverage", SQL + " " + " UNION ALL ".join(_grain_sql(n, f) for n, f in GRAINS.items()))
def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred, _ = _sides(spark, sf_dir)
    return scoring.multiset_overlap(gold, pred, DOCUMENT, GRAINS)


_C = "account_number", "transaction_date", "direction", "amount_cents", "balance_cents", "counterparty_account"
KEYS = [[*DOCUMENT, *[_C[i] for i in k]] for k in ((0, 1, 2, 3, 4, 5), (0, 3, 4), (0, 1, 2, 5), (0, 1, 2, 3), (1, 2, 3, 4))]
SAME = [*DOCUMENT, *FIELDS]


def _align_sql() -> str:
    ctes, left_g, left_p, out = [], "gold", "pred", []
    for i, key in enumerate(KEYS, 1):
        c, some = ", ".join(key), " AND ".join(f"{k} IS NOT NULL" for k in key)
        ctes.append(f"""a{i} AS (SELECT gold_id, pred_id, {i} AS step FROM (SELECT {c}, gold_id FROM {left_g} WHERE {some} QUALIFY count(*) OVER (PARTITION BY {c}) = 1) JOIN (SELECT {c}, pred_id FROM {left_p} WHERE {some} QUALIFY count(*) OVER (PARTITION BY {c}) = 1) USING ({c})),
g{i} AS (SELECT * FROM {left_g} ANTI JOIN a{i} USING (gold_id)), p{i} AS (SELECT * FROM {left_p} ANTI JOIN a{i} USING (pred_id))""")
        left_g, left_p = f"g{i}", f"p{i}"
        out.append(f"SELECT * FROM a{i}")
    same, number = ", ".join(SAME), lambda i: f"row_number() OVER (PARTITION BY {', '.join(SAME)} ORDER BY {i}) AS o"
    on = " AND ".join(f"g.{f} IS NOT DISTINCT FROM p.{f}" for f in SAME)
    out.append(f"SELECT gold_id, pred_id, {len(KEYS) + 1} AS step FROM (SELECT {same}, gold_id, {number('gold_id')} FROM {left_g}) g JOIN (SELECT {same}, pred_id, {number('pred_id')} FROM {left_p}) p ON g.o = p.o AND {on}")
    return f"{SQL}, {', '.join(ctes)}, pairs AS ({' UNION ALL '.join(out)})"


ALIGNED = _align_sql()


@query("j18_gold_alignment", f"{ALIGNED} SELECT * FROM pairs")
def _alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred, _ = _sides(spark, sf_dir)
    return scoring.align_unique(gold, pred, KEYS, SAME)


@query("a9_recognition_eval", ALIGNED + " " + " UNION ALL ".join(f"SELECT g.case_id, '{f}' AS field, count(g.{f}) AS true_values, count(*) FILTER (g.{f} = p.{f}) AS correct_values FROM gold g LEFT JOIN pairs USING (gold_id) LEFT JOIN pred p USING (pred_id) GROUP BY 1" for f in FIELDS))
def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred, _ = _sides(spark, sf_dir)
    return scoring.field_accuracy(gold, pred, scoring.align_unique(gold, pred, KEYS, SAME), ["case_id"], FIELDS)


CRITICAL = FIELDS[:5]
ACCEPTED = f"""{ALIGNED}, warned AS (SELECT DISTINCT pred_id, true AS alerted FROM alerts),
checked AS (SELECT g.case_id, g.source_document_id, p.pred_id, alerted, p.pred_id IS NOT NULL AND {' AND '.join(f'g.{f} IS NOT DISTINCT FROM p.{f}' for f in CRITICAL)} AS ok FROM gold g LEFT JOIN pairs USING (gold_id) LEFT JOIN pred p USING (pred_id) LEFT JOIN warned USING (pred_id)),
gs AS (SELECT case_id, source_document_id, count(*) AS gold_rows, count(*) FILTER (ok) AS correct_rows, count(*) FILTER (NOT ok AND pred_id IS NOT NULL AND alerted IS NULL) AS sw FROM checked GROUP BY 1, 2),
ps AS (SELECT case_id, source_document_id, count(*) AS pred_rows, count(alerted) AS alerted_rows, count(*) FILTER (gold_id IS NULL AND alerted IS NULL) AS se FROM pred LEFT JOIN pairs USING (pred_id) LEFT JOIN warned USING (pred_id) GROUP BY 1, 2),
reports AS (SELECT case_id, source_document_id, gold_rows, correct_rows, pred_rows, alerted_rows, correct_rows / greatest(gold_rows, pred_rows) AS critical_accuracy, alerted_rows / greatest(pred_rows, 1) AS review_rate, sw + se AS unalerted_errors,
  correct_rows / greatest(gold_rows, pred_rows) >= 0.995 AND alerted_rows / greatest(pred_rows, 1) <= 0.05 AND sw + se = 0 AS accepted FROM gs JOIN ps USING (case_id, source_document_id))"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred, alerts = _sides(spark, sf_dir)
    return scoring.acceptance(gold, pred, scoring.align_unique(gold, pred, KEYS, SAME), alerts, DOCUMENT, CRITICAL)


query("a10_acceptance_eval", f"{ACCEPTED} SELECT * FROM reports")(_reports)


@query("a12d_suite_rollup", f"{ACCEPTED} SELECT sum(gold_rows)::BIGINT AS gold_rows, sum(pred_rows)::BIGINT AS pred_rows, sum(correct_rows)::BIGINT AS correct_rows, sum(unalerted_errors)::BIGINT AS unalerted_errors, count(*) AS documents, bool_and(accepted) AS all_accepted, sum(correct_rows) / greatest(sum(gold_rows), sum(pred_rows)) AS critical_accuracy FROM reports")
def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.suite_rollup(_reports(spark, sf_dir))


@query("a12b_alert_quality", f"""{ALIGNED}, errors AS (SELECT p.pred_id, coalesce(g.amount_cents <> p.amount_cents, true) AS wrong FROM pred p LEFT JOIN pairs USING (pred_id) LEFT JOIN gold g USING (gold_id)),
r AS (SELECT stage, pred_id, count(*) AS k, any_value(wrong) AS wrong FROM alerts LEFT JOIN errors USING (pred_id) GROUP BY 1, 2)
SELECT stage, sum(k)::BIGINT AS alerts, count(*) AS rows_alerted, count(*) FILTER (wrong) AS wrong_alerted, count(*) FILTER (wrong) / count(*) AS precision, count(*) FILTER (wrong) / greatest((SELECT count(*) FILTER (wrong) FROM errors), 1) AS recall FROM r GROUP BY 1""")
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred, alerts = _sides(spark, sf_dir)
    true = gold.select("gold_id", F.col("amount_cents").alias("_true"))
    errors = pred.join(scoring.align_unique(gold, pred, KEYS, SAME), "pred_id", "left").join(true, "gold_id", "left").select("pred_id", F.coalesce(F.col("_true") != F.col("amount_cents"), F.lit(True)).alias("wrong"))
    return scoring.alert_quality(errors, alerts)


@query("a12_direction_code_votes", f"""{ORACLE}, v AS (SELECT case_id, account_number, row_index % 2 AS marker, direction, count(*) AS votes FROM ledger WHERE direction IN ('IN', 'OUT') GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS r, lead(votes) OVER w AS nxt FROM v WINDOW w AS (PARTITION BY case_id, account_number, marker ORDER BY votes DESC, direction))
SELECT case_id, account_number, marker, direction AS voted_direction, votes FROM r WHERE r = 1 AND votes > coalesce(nxt, 0)""")
def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.direction_code_votes(ledger(spark, sf_dir).withColumn("marker", F.col("row_index") % 2), ["case_id", "account_number"])


@query("d24_gold_best_match", f"""{SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(DOCUMENT + FIELDS)} ORDER BY gold_id) AS o FROM gold), p AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(DOCUMENT + FIELDS)} ORDER BY pred_id) AS o FROM pred),
exact AS (SELECT gold_id, pred_id FROM g JOIN p ON g.o = p.o AND {' AND '.join(f'g.{f} IS NOT DISTINCT FROM p.{f}' for f in DOCUMENT + FIELDS)}),
s AS (SELECT gold_id, pred_id, (CASE WHEN x.transaction_date = y.transaction_date THEN 3 ELSE 0 END + CASE WHEN x.amount_cents = y.amount_cents THEN 3 ELSE 0 END + CASE WHEN x.balance_cents IS NOT DISTINCT FROM y.balance_cents THEN 2 ELSE 0 END)::BIGINT AS score
  FROM (SELECT * FROM gold ANTI JOIN exact USING (gold_id)) x JOIN (SELECT * FROM pred ANTI JOIN exact USING (pred_id)) y USING (account_number)),
m AS (SELECT *, row_number() OVER (PARTITION BY gold_id ORDER BY score DESC, pred_id) AS a, row_number() OVER (PARTITION BY pred_id ORDER BY score DESC, gold_id) AS b FROM s WHERE score > 0)
SELECT gold_id, pred_id, NULL::BIGINT AS score FROM exact UNION ALL SELECT gold_id, pred_id, score FROM m WHERE a = 1 AND b = 1""")
def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred, _ = _sides(spark, sf_dir)
    return scoring.gold_best_match(gold, pred, [*DOCUMENT, *FIELDS], "account_number", {"transaction_date": 3, "amount_cents": 3, "balance_cents": 2})
