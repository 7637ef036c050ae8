from pyspark.sql import functions as F

from ledgerloom.catalog import mapping as printed
from ledgerloom.functions import money


def test_rows_are_numbered_once_for_all_cells(spark, sf, monkeypatch):
    plans = {}
    real = printed.written

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(printed, "written", kept)
    tables = printed._printed(spark, sf)
    assert "Window" in plans["body"] and "Window" not in plans["printed-cells"]
    assert "Window" not in tables["picks"]._jdf.queryExecution().optimizedPlan().toString()


def test_a_date_takes_few_looks_at_a_text(spark):
    """Each group of each pattern was a search of its own, every one made for every cell."""
    plan = spark.createDataFrame([("x",)], "t string").select(money.parse_date("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 4


def test_odd_sums_and_dates(spark):
    texts = ["12.34", " 12.34\n", "−1,234.5", "￥12", "￥", "－－", "1,23", "12345678901234567890123", "x1", "( 空 )", "９", None, "+0"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", money.money("t").alias("m"), money.is_empty("t").alias("e")).orderBy("i").collect()
    assert [r["m"]["state"] for r in rows] == ["value", "value", "value", "value", "empty", "empty", "unreadable", "value", "unreadable", "empty", "unreadable", "empty", "value"]
    assert [r["m"]["cents"] for r in rows] == [1234, 1234, -123450, 1200, None, None, None, None, None, None, None, None, 0]
    assert [r["e"] for r in rows] == [False] * 11 + [True, False]
    dates = ["1995-13-40 19950102", "1995年1月2", "a19950102 ", "119950102", "1995/2/29", "1996.2.29x", "19950102093000", "199501020930001"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(dates)), "i int, t string").orderBy("i").select(money.parse_date("t").cast("string")).collect()]
    assert got == [None, "1995-01-02", "1995-01-02", None, None, "1996-02-29", "1995-01-02", None]
