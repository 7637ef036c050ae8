"""Queries on pages, derived from the pages of the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages
from ..plans import demo_ledger
from ..plans.demo_ledger import ORACLE
from ..plans.storage import written
from .registry import query


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ledger, written: operators that join it with itself start from a table."""
    return written(demo_ledger.ledger(spark, sf_dir), "ledger")


DOC = "case_id, document_id"
PROFILE = f"""{ORACLE}, pages AS (SELECT case_id, source_document_id AS document_id, page, count(*) AS n_rows, count(DISTINCT account_number) AS n_accounts,
  CASE WHEN count(DISTINCT account_number) = 1 THEN min(account_number) END AS account, CASE WHEN count(DISTINCT bank_name) = 1 THEN min(bank_name) END AS bank, count(balance_cents) AS n_balances FROM ledger GROUP BY 1, 2, 3)"""
SEGMENTS = f"""{PROFILE}, f AS (SELECT *, last_value(CASE WHEN bank IS NOT NULL AND account IS NOT NULL THEN bank || '|' || account END IGNORE NULLS) OVER (PARTITION BY {DOC} ORDER BY page ROWS UNBOUNDED PRECEDING) AS i FROM pages),
c AS (SELECT *, coalesce((lag(i) OVER (PARTITION BY {DOC} ORDER BY page) <> i)::INT, 0) AS new FROM f),
segments AS (SELECT * EXCLUDE (i, new), (sum(new) OVER (PARTITION BY {DOC} ORDER BY page ROWS UNBOUNDED PRECEDING))::INT AS segment FROM c)"""


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_profile(ledger(spark, sf_dir))


query("page_profile", f"{PROFILE} SELECT * FROM pages")(_profile)


@query("w15_logical_segments", f"{SEGMENTS} SELECT {DOC}, page, segment FROM segments")
def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.logical_segments(_profile(spark, sf_dir)).select("case_id", "document_id", "page", "segment")


@query("w15b_segment_fill", f"""{SEGMENTS}, v AS (SELECT {DOC}, segment, bank, sum(n_rows) AS v FROM segments WHERE bank IS NOT NULL GROUP BY ALL),
b AS (SELECT {DOC}, segment, first(bank ORDER BY v DESC, bank) AS segment_bank FROM v GROUP BY ALL)
SELECT {DOC}, segment, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages, sum(n_rows)::BIGINT AS n_rows, any_value(segment_bank) AS segment_bank FROM segments LEFT JOIN b USING ({DOC}, segment) GROUP BY {DOC}, segment""")
def _fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.segment_fill(pages.logical_segments(_profile(spark, sf_dir)))


@query("w16_bank_runs", f"""{PROFILE}, n AS (SELECT *, last_value(bank IGNORE NULLS) OVER (PARTITION BY {DOC} ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb, first_value(bank IGNORE NULLS) OVER (PARTITION BY {DOC} ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nb FROM pages),
f AS (SELECT *, coalesce(bank, CASE WHEN pb = nb THEN pb END, 'UNKNOWN') AS run_bank FROM n),
c AS (SELECT *, coalesce(lag(run_bank) OVER w <> run_bank OR page - lag(page) OVER w <> 1, true)::INT AS new FROM f WINDOW w AS (PARTITION BY {DOC} ORDER BY page)),
r AS (SELECT *, sum(new) OVER (PARTITION BY {DOC} ORDER BY page ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT {DOC}, run_bank, min(page) AS first_page, max(page) AS last_page FROM r GROUP BY {DOC}, run, run_bank""")
def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.bank_runs(_profile(spark, sf_dir))


@query("w17_bank_group_validate", f"""{PROFILE}, d AS (SELECT {DOC}, 40 AS n_pages FROM pages GROUP BY ALL), every AS (SELECT {DOC}, unnest(range(1, n_pages + 1))::INT AS page FROM d),
g AS (SELECT {DOC}, coalesce(bank, '') AS bank, page FROM pages WHERE page % 9 <> 0), x AS (SELECT {DOC}, bank, min(page) AS lo, max(page) AS hi, count(*) AS k, row_number() OVER (PARTITION BY {DOC} ORDER BY bank)::INT AS group_no FROM g GROUP BY {DOC}, bank)
SELECT {DOC}, 'MISSING_PAGE' AS problem, page AS at FROM every ANTI JOIN g USING ({DOC}, page) UNION ALL SELECT {DOC}, 'NOT_CONTIGUOUS', group_no FROM x WHERE hi - lo + 1 <> k UNION ALL SELECT {DOC}, 'UNNAMED_GROUP', group_no FROM x WHERE bank = ''""")
def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    found = _profile(spark, sf_dir)
    groups = found.where("page % 9 <> 0").groupBy("case_id", "document_id", F.coalesce("bank", F.lit("")).alias("bank")).agg(F.collect_list("page").alias("pages"))
    numbered = groups.withColumn("group_no", F.row_number().over(Window.partitionBy("case_id", "document_id").orderBy("bank")))
    return pages.bank_group_problems(numbered, found.select("case_id", "document_id", F.lit(40).alias("n_pages")).distinct())


PAGE_TYPE = "CASE WHEN page % 17 = 0 THEN 'BLANK' WHEN page % 13 = 0 THEN 'COVER' WHEN page % 11 = 0 THEN 'UNKNOWN' WHEN page % 19 = 0 THEN NULL ELSE 'STATEMENT' END"
DENSITY = "CASE WHEN n_rows >= 6 THEN 'HIGH' WHEN n_rows >= 3 THEN 'MEDIUM' ELSE 'LOW' END"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with segment, a type, a density, and whether they are still to be read."""
    found = pages.logical_segments(_profile(spark, sf_dir)).withColumns({"page_type": F.expr(PAGE_TYPE), "density": F.expr(DENSITY), "pending": F.expr("page % 3 = 0")})
    return found.withColumn("estimated_rows", pages.estimated_rows())


COSTS = f"""{SEGMENTS}, typed AS (SELECT *, {PAGE_TYPE} AS page_type, {DENSITY} AS density, page % 3 = 0 AS pending FROM segments),
costs AS (SELECT *, CASE WHEN page_type = 'BLANK' THEN 0 WHEN page_type = 'COVER' THEN 2 WHEN coalesce(page_type, 'UNKNOWN') = 'UNKNOWN' THEN 12 ELSE CASE density WHEN 'HIGH' THEN 40 WHEN 'MEDIUM' THEN 20 ELSE 8 END END AS estimated_rows FROM typed)"""


@query("estimate_page_rows", f"{COSTS} SELECT {DOC}, page, estimated_rows FROM costs")
def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).select("case_id", "document_id", "page", "estimated_rows")


@query("w19_extraction_batches", f"""{COSTS.replace("WITH ", "WITH RECURSIVE ", 1)}, o AS (SELECT *, row_number() OVER (PARTITION BY {DOC}, segment ORDER BY page) AS n FROM costs),
b AS (SELECT {DOC}, segment, page, pending, n, estimated_rows AS total, 0 AS batch FROM o WHERE n = 1
  UNION ALL SELECT o.case_id, o.document_id, o.segment, o.page, o.pending, o.n, CASE WHEN b.total + o.estimated_rows > 40 THEN o.estimated_rows ELSE b.total + o.estimated_rows END, CASE WHEN b.total + o.estimated_rows > 40 THEN b.batch + 1 ELSE b.batch END
  FROM b JOIN o ON o.case_id = b.case_id AND o.document_id = b.document_id AND o.segment = b.segment AND o.n = b.n + 1)
SELECT {DOC}, segment, page, batch FROM b QUALIFY bool_or(pending) OVER (PARTITION BY {DOC}, segment, batch)""")
def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extraction_batches(_typed(spark, sf_dir), 30)


def _blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).withColumn("account_number", F.when((F.col("row_index") % 5 == 0) | (F.col("page") % 4 == 0), F.lit(None)).otherwise(F.col("account_number")))


@query("j14_same_page_identity_fill", f"""{ORACLE}, b AS (SELECT * REPLACE (CASE WHEN row_index % 5 = 0 OR page % 4 = 0 THEN NULL ELSE account_number END AS account_number), source_document_id AS document_id FROM ledger),
p AS (SELECT {DOC}, page, CASE WHEN count(DISTINCT account_number) = 1 THEN min(account_number) END AS a, count(DISTINCT account_number) AS k FROM b GROUP BY ALL),
f AS (SELECT *, coalesce(a, CASE WHEN k = 0 AND lag(a) OVER w = lead(a) OVER w THEN lag(a) OVER w END) AS filled_account FROM p WINDOW w AS (PARTITION BY {DOC} ORDER BY page))
SELECT b.case_id, b.id, b.page, filled_account FROM b JOIN f USING ({DOC}, page) WHERE b.account_number IS NULL""")
def _identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_identity_fill(_blanked(spark, sf_dir))


@query("j15_page_context", f"""{PROFILE}, k AS (SELECT * FROM pages WHERE length(account) BETWEEN 12 AND 32), u AS (SELECT {DOC}, account FROM k GROUP BY ALL HAVING count(DISTINCT bank) <= 1),
n AS (SELECT a.case_id, a.document_id, a.account, a.page, b.page AS context_page, abs(a.page - b.page) AS distance FROM k a JOIN k b USING ({DOC}, account) JOIN u USING ({DOC}, account) WHERE a.page <> b.page)
SELECT *, row_number() OVER (PARTITION BY {DOC}, account, page ORDER BY distance, context_page)::INT AS rank FROM n QUALIFY rank <= 2""")
def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_context(_profile(spark, sf_dir))


@query("a18_dominant_bank", f"""{SEGMENTS}, v AS (SELECT {DOC}, segment, bank, sum(greatest(0.25, (n_rows % 10) / 10)) AS weight FROM segments WHERE bank IS NOT NULL AND (n_rows % 10) / 10 >= 0.45 GROUP BY ALL)
SELECT {DOC}, segment, bank, weight FROM v QUALIFY row_number() OVER (PARTITION BY {DOC}, segment ORDER BY weight DESC, bank DESC) = 1""")
def _dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.dominant_banks(pages.logical_segments(_profile(spark, sf_dir)).withColumn("confidence", (F.col("n_rows") % 10) / 10))


@query("page_completeness", f"""{PROFILE}, d AS (SELECT {DOC}, page, n_rows + page % 3 AS declared_rows, n_rows, n_balances FROM pages)
SELECT {DOC}, page, concat_ws(',', CASE WHEN n_rows < declared_rows THEN 'MISSING_ROWS' END, CASE WHEN n_balances < n_rows THEN 'UNCERTAIN_FIELDS' END) AS flags, n_rows < declared_rows AS blocking FROM d""")
def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _profile(spark, sf_dir)
    return pages.page_completeness(found, found.select("case_id", "document_id", "page", (F.col("n_rows") + F.col("page") % 3).alias("declared_rows")))


READINGS = f"""{PROFILE}, readings AS (SELECT {DOC}, page, r::INT AS reading_id, n_rows - (page + r) % 3 AS n_rows, n_rows AS declared_rows, ((page * 7 + r) % 10) / 10 AS confidence FROM pages, range(3) t(r))"""


@query("best_page_result", f"""{READINGS} SELECT {DOC}, page, reading_id, n_rows FROM readings QUALIFY row_number() OVER (PARTITION BY {DOC}, page ORDER BY (declared_rows = n_rows) DESC, abs(declared_rows - n_rows), n_rows DESC, confidence DESC, reading_id) = 1""")
def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _profile(spark, sf_dir).withColumn("reading_id", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    made = made.select("case_id", "document_id", "page", "reading_id", F.col("n_rows").alias("declared_rows"), (F.col("n_rows") - (F.col("page") + F.col("reading_id")) % 3).alias("n_rows"), ((F.col("page") * 7 + F.col("reading_id")) % 10 / 10).alias("confidence"))
    return pages.best_page_results(made)


@query("latest_run_pages", f"""{PROFILE} SELECT {DOC}, page, 2 AS run_id, n_rows FROM pages WHERE page % 3 <> 0 UNION ALL SELECT {DOC}, page, 1, n_rows FROM pages ANTI JOIN (SELECT {DOC} FROM pages WHERE page % 3 <> 0) USING ({DOC})""")
def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _profile(spark, sf_dir)
    first = found.select("case_id", "document_id", "page", "n_rows", F.lit(1).alias("run_id"), F.lit(10).alias("run_at"), F.lit(1).alias("arrival"))
    second = found.where("page % 3 <> 0").select("case_id", "document_id", "page", "n_rows", F.lit(2).alias("run_id"), F.lit(20).alias("run_at"), F.explode(F.array(F.lit(2), F.lit(3))).alias("arrival"))
    return pages.latest_runs(first.unionByName(second)).select("case_id", "document_id", "page", "run_id", "n_rows")
