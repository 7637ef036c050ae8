from pyspark.sql import functions as F

from ledgerloom.plans.storage import written


def test_long_tables_that_shrink_on_disk_are_not_broadcast(spark):
    """300,000 rows of 200 bytes, a file of under 10 MB: no driver should have to hold them."""
    rows = spark.range(300_000).select("id", F.repeat(F.lit("x"), 200).alias("text"))
    one, two = written(rows, "long"), written(rows.withColumnRenamed("text", "other"), "long")
    met = one.join(two, "id")
    assert met.where("text = other").count() == 300_000
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_tables_of_a_few_rows_still_are(spark):
    met = written(spark.range(100_000), "long").join(written(spark.range(25), "short"), "id")
    assert "BroadcastHashJoin" in met._jdf.queryExecution().executedPlan().toString()
