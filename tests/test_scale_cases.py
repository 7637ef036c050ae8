import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import aggregates, graph, netting


@pytest.fixture(scope="module")
def txn(spark):
    n = F.col("id")
    return spark.range(120).select(
        F.lit(1).alias("case_id"), F.concat(F.lit("r"), n).alias("id"), n.alias("seq"), F.concat(F.lit("e"), n).alias("event_id"), F.lit("D").alias("source_document_id"), F.concat(F.lit("62220000000"), n % 2).alias("account_number"),
        F.date_add(F.lit("1999-01-01").cast("date"), (n * 7 % 11).cast("int")).alias("transaction_date"), F.when(n % 2 == F.floor(n / 4) % 2, "IN").otherwise("OUT").alias("direction"), (3_000_000 + n * 31 % 17 * 50_000).alias("amount_cents"),
        F.concat(F.lit("s"), n % 7).alias("summary"), F.concat(F.lit("p"), n % 3).alias("counterparty_name"), F.lit(None).cast("string").alias("counterparty_account"), F.lit("B").alias("bank_name"), F.lit(None).cast("string").alias("counterparty_bank"),
        F.lit(None).cast("string").alias("raw_text"), F.lit(None).cast("string").alias("transaction_type"), F.lit(False).alias("is_internal"), F.lit(None).cast("string").alias("internal_pair_id"),
    )


def _reads(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Range (")


def test_a_row_gives_all_its_relationships_at_once(txn):
    """One look at the rows for five types of edges; only pairs, which need two rows, take two more."""
    found = graph.relationships(txn)
    assert _reads(found) <= 3
    assert found.groupBy("type").count().where("type = 'TRANSACTION_WITH_COUNTERPARTY'").first()["count"] == 120


def test_a_summary_reads_its_rows_once(spark, txn):
    cases = spark.createDataFrame([(1, "p")], "case_id int, respondent_name string")
    found = aggregates.counterparty_summary(txn, cases)
    assert _reads(found) == 1
    got = {r["party_key"]: r for r in found.collect()}
    assert got["p0"]["frequent_summaries"] == ["s0", "s3", "s6", "s2", "s5"] and got["p0"]["n_rows"] == 40 and got["p0"]["n_aliases"] == 1


def test_spans_of_days_find_what_single_days_would(txn):
    found = netting.fast_in_out_edges(txn)
    assert "_span" in found._jdf.queryExecution().optimizedPlan().toString()
    rows = txn.collect()
    want = {(a["id"], b["id"]) for a in rows for b in rows if (a["direction"], b["direction"]) == ("IN", "OUT") and a["account_number"] == b["account_number"] and b["seq"] > a["seq"]
            and 0 <= (b["transaction_date"] - a["transaction_date"]).days <= 2 and 100 * abs(b["amount_cents"] - a["amount_cents"]) <= 15 * a["amount_cents"]}
    got = [(r["left_id"], r["right_id"]) for r in found.collect()]
    assert want and len(got) == len(want) and set(got) == want
