from ledgerloom.catalog import recovery as sheets
from ledgerloom.operators import recovery

CELLS = "document_id string, page int, table_no int, row_id long, row_no int, col_no int, cell_id long, text string"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_and_readings_meet_in_one_join(spark):
    row = lambda n, *t: [("d", 1, 1, n, n, i, n * 10 + i, x) for i, x in enumerate(t)]
    cells = spark.createDataFrame(row(1, "1995-01-02", "5.00", "5.00") + row(2, "1995-01-02", "7.00", "x") + row(3, "1995-01-03", "-8.00", "9.00"), CELLS)
    readings = spark.createDataFrame([("d", 1, 1, "1995-01-02", "5.00", "5.00"), ("d", 1, 2, "1995-01-02", "7.00", "7.00"), ("d", 1, 3, "1995-01-03", "8.00", "9.00")], "document_id string, page int, reading_row int, date string, amount string, balance string")
    found = recovery.backed_rows(cells, readings)
    assert sorted((r["reading_row"], r["row_no"]) for r in found.collect()) == [(1, 1), (3, 3)]
    assert _plan(found).count("Join ") == 1


def test_pages_are_numbered_once(spark, sf, monkeypatch):
    plans = []
    real = sheets.written
    monkeypatch.setattr(sheets, "written", lambda df, name: (plans.append(_plan(df)), real(df, name))[1])
    sheets._tables(spark, sf, sheets.FIRST)
    assert "Window" in plans[0] and "Window" not in plans[-1]


def test_prints_take_the_numbered_cells(spark, sf, monkeypatch):
    plans = {}
    real = recovery.written
    monkeypatch.setattr(recovery, "written", lambda df, name: (plans.setdefault(name, _plan(df)), real(df, name))[1])
    sheets._rebased(spark, sf)
    assert "Window" in plans["occurrences"] and "Window" not in plans["unchanged-pages"]
