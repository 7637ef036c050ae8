from pyspark.sql import functions as F

from ledgerloom.operators.events import canonical_events
from ledgerloom.plans.groups import each_group


def test_groups_are_whole_and_in_order_over_batches(spark):
    """Batches of five rows cut most groups; keys may be null."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = spark.range(200).select((F.col("id") % 9).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("part"), (-F.col("id")).alias("at"))
        got = each_group(rows, ["k", "part"], ["at"], lambda g: [(len(g), int(g[0]["at"]), int(g[-1]["at"]), [r["at"] for r in g] == sorted(r["at"] for r in g))], "n long, low long, high long, ordered boolean").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 9 and sum(r["n"] for r in got) == 200 and all(r["ordered"] for r in got)
    assert {(r["n"], r["low"], r["high"]) for r in got} == {(len(range(k, 200, 9)), -max(range(k, 200, 9)), -k) for k in range(9)}


def test_many_blocks_take_few_calls_of_python(spark):
    """2,000 blocks of three: a group each for Python is what made large tables slow."""
    n = F.floor(F.col("id") / 3)
    rows = spark.range(6_000).select(F.lit(1).alias("case_id"), F.concat(F.lit("r"), "id").alias("id"), F.col("id").alias("seq"), F.concat(F.lit("D"), F.col("id") % 3).alias("source_document_id"), F.lit("622200000001").alias("account_number"), F.lit("1999-01-01").cast("date").alias("transaction_date"), F.lit("IN").alias("direction"), (n + 1).alias("amount_cents"), (n * 10).alias("balance_cents"), F.lit("x").alias("summary"), F.lit("y").alias("counterparty_name"), F.lit("628000000010").alias("counterparty_account"), F.lit(None).cast("string").alias("raw_text"))
    found = canonical_events(rows)
    assert "MapInPandas" in found._jdf.queryExecution().toString() and "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    assert found.select("event_id").distinct().count() == 2_000 and found.where("n_observations = 3").count() == 6_000
