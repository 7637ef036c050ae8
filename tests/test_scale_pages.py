import random

from ledgerloom.catalog import ownership as sheets
from ledgerloom.operators import pages

DESCRIBED = "case_id long, source_document_id string, page long, type string, relation string, confidence double, n_issues int, bank string, accounts array<string>, quoted_pages array<long>"


def _planned(described):
    """The statements of one document's pages, page by page."""
    out, group, last, before = {}, None, None, None
    for page in sorted({d[2] for d in described}):
        alike = [d for d in described if d[2] == page]
        kind, relation, confidence, issues, bank, accounts, quoted = alike[0][3:] if len(alike) == 1 else ("UNKNOWN", "UNKNOWN", 0.0, 1, "", [], [])
        bank, accounts = (bank or "").replace("中国", ""), list(dict.fromkeys(accounts or []))
        conflict = bool(group and (bank and group["bank"] and bank != group["bank"] or accounts and group["accounts"] and not set(accounts) <= set(group["accounts"])))
        goes_on = group and last == page - 1 and relation == "CONTINUE" and confidence >= 0.9 and not issues and not conflict and before and {page, page - 1} <= set(quoted or []) and kind == "TRANSACTIONS" and len(group["accounts"]) <= 1 and len(accounts) <= 1
        if not goes_on:
            group = {"start": page, "bank": bank, "accounts": accounts, "doubt": kind == "UNKNOWN"}
        told = conflict and relation == "CONTINUE"
        group["bank"], group["accounts"] = group["bank"] or bank, group["accounts"] or accounts
        group["doubt"] = group["doubt"] or not accounts or issues > 0 or told
        last, before = page, kind in ("TRANSACTIONS", "ACCOUNT_INFO") and confidence >= 0.9 and not issues and not told
        out[page] = (group, told)
    return {(*described[0][:2], page, g["start"], told, g["doubt"]) for page, (g, told) in out.items()}


def _pages(seed):
    of = random.Random(seed)
    page = lambda n: (seed, f"D{seed}", n, of.choices(["TRANSACTIONS", "ACCOUNT_INFO", "UNKNOWN", "BLANK"], [12, 2, 1, 1])[0], of.choices(["CONTINUE", "START", "UNKNOWN"], [12, 1, 1])[0], of.choices([0.95, 0.9, 0.5], [9, 3, 1])[0], of.choices([0, 1], [12, 1])[0],
        of.choices(["中国甲银行", "甲银行", "乙银行", "", None], [5, 5, 1, 3, 1])[0], of.choices([["1"], ["1", "1"], ["2"], ["1", "2"], [], None], [20, 2, 2, 1, 4, 1])[0], of.choices([[n, n - 1], [n], None], [12, 1, 1])[0])
    return [page(n) for n in range(1, 160) if of.random() > 0.03 for _ in range(1 if of.random() > 0.04 else 2)]


def test_statements_equal_a_plan_page_by_page(spark):
    """Batches of seven rows cut documents, statements and pages that are described twice."""
    rows = [d for seed in range(12) for d in _pages(seed)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in pages.statement_groups(spark.createDataFrame(rows, DESCRIBED)).select("case_id", "source_document_id", "page", "statement_page", "conflict", "needs_review").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(set(got)) and set(got) == set().union(*[_planned(_pages(seed)) for seed in range(12)])
    assert len({r[:2] + (r[3],) for r in got}) < len(got) * 0.8 and any(r[4] for r in got)


def test_a_document_is_no_list_that_each_page_copies(spark):
    plan = pages.statement_groups(spark.createDataFrame(_pages(1), DESCRIBED))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_append" not in plan and "collect_set" not in plan and "MapInArrow" in plan


def test_statements_write_pages_instead_of_rows(spark, sf, monkeypatch):
    names, real = [], sheets.written
    monkeypatch.setattr(sheets, "written", lambda df, name: (names.append((name, df.columns)), real(df, name))[1])
    sheets._statements(spark, sf)
    assert [n for n, _ in names] == ["described"] and "id" not in names[0][1]
