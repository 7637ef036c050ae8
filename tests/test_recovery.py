"""Rows from cells, consolidated views, second readings, columns and issues on small cases and odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog
from ledgerloom.operators import columns, consolidation, events, mapping, ownership, pending, recognition, recovery, sequence
from ledgerloom.sources import statements

from .test_cases import make, row  # noqa: F401

CELLS = "document_id string, cell_id long, page int, table_no int, row_id long, col_no int, text string, extra int"
PICKS = "document_id string, out_no long, field int, pos int, cell_id long, fragment string, line int"


def _line(doc, row_id, *texts):
    return [(doc, row_id * 10 + c, 1, 1, row_id, c, t, 1) for c, t in enumerate(texts, 1)]


def test_rows_from_cells_and_what_is_wrong(spark):
    cells = spark.createDataFrame([("a", 1, 1, None, None, None, "6222000000001234", 1), *_line("a", 2, "2024-01-02 10:11:12", "贷", "1,234.50", None), *_line("a", 3, "2024/2/30", "?", "12 3x", "甲乙 甲乙"), *_line("b", 5, "x")], CELLS)
    outputs = spark.createDataFrame([("a", 1, [2], None, None), ("a", 2, [3], "IN", "消费"), ("a", 3, [], "", "")], "document_id string, out_no long, source_rows array<long>, direction string, type string")
    picks = spark.createDataFrame([("a", 1, 0, 0, 1, None, None), ("a", 1, 3, 0, 21, None, None), ("a", 1, 4, 0, 21, None, None), ("a", 1, 5, 0, 22, None, None), ("a", 1, 6, 0, 23, None, None), ("a", 1, 9, 0, 24, None, None),
                                   ("a", 2, 4, 0, 31, None, None), ("a", 2, 5, 0, 32, None, None), ("a", 2, 6, 0, 33, None, None), ("a", 2, 9, 0, 34, "甲乙", None), ("a", 2, 10, 0, 99, None, None)], PICKS)
    ignored = spark.createDataFrame([], "document_id string, pos long, row_id long, kind string")
    got = mapping.assembled(cells, outputs, picks, ignored)
    rows = {r["out_no"]: r for r in got.rows.collect()}
    assert (rows[1]["transaction_time"], rows[1]["direction"], rows[1]["amount"], rows[1]["counterparty_name"]) == ("2024-01-02 10:11:12", "IN", "1234.50", "")
    assert rows[2]["transaction_type"] == "消费" and rows[2]["direction"] == "IN" and rows[2]["amount"] == "" and rows[3]["account_number"] == ""
    codes = {(r["code"], r["field"], tuple(r["out_rows"])) for r in got.issues.collect()}
    assert {("PARTIAL_DATE", "transaction_date", (2,)), ("INVALID_SOURCE_FRAGMENT", "counterparty_name", (2,)), ("INVALID_CELL_SOURCE", "counterparty_account", (2,)), ("MISSING_TYPE_SOURCE", "transaction_type", (2,)),
            ("UNREADABLE_SOURCE", "amount", (2,)), ("DIRECTION_REQUIRES_INDEPENDENT_READ", "direction", (2,)), ("MISSING_KEY_SOURCE", "account_number", (3,)), ("UNASSIGNED_SOURCE_ROW", None, ())} <= codes
    assert {r["document_id"]: r["complete"] for r in got.documents.collect()} == {"a": False, "b": False}
    empty = mapping.assembled(cells.where("false"), outputs.where("false"), picks.where("false"), ignored)
    assert empty.rows.count() == empty.issues.count() == empty.documents.count() == 0


def test_every_issue_code_occurs(spark, sf):
    found = {r["code"] for r in catalog.queries()["d17_assembly_issues"](spark, sf).select("code").distinct().collect()}
    assert found == {
        "INVALID_IGNORED_ROW", "DUPLICATE_DISPOSITION", "NONEMPTY_IGNORED_ROW", "POSSIBLE_OMITTED_TRANSACTION", "INVALID_ROW_SOURCE", "TRANSACTION_IGNORED_CONFLICT", "SOURCE_ROW_REUSED", "UNASSIGNED_SOURCE_ROW", "INVALID_CELL_SOURCE",
        "INVALID_SOURCE_FRAGMENT", "OUTSIDE_TRANSACTION_SOURCES", "MISSING_KEY_SOURCE", "UNREADABLE_SOURCE", "SOURCE_VALUE_CONFLICT", "INVALID_DIRECTION", "DIRECTION_CONTRADICTION", "DIRECTION_REQUIRES_INDEPENDENT_READ",
        "TIME_SOURCE_CONFLICT", "PARTIAL_DATE", "INVALID_TYPE", "MISSING_TYPE_SOURCE", "TYPE_SOURCE_CONTRADICTION", "COUNTERPARTY_IDENTITY_MISSING", "COUNTERPARTY_NAME_CONFLICT",
    }


VIEW = "document_id string, obs long, account_kind string, direct_owner boolean, account_number string, account_name string, bank_name string, transaction_time string, transaction_date string, direction string, amount string, balance string, transaction_type string, counterparty_name string, counterparty_account string, counterparty_bank string"


def _view(obs, direct, account, day, amount, balance, party="p", doc="d"):
    return (doc, obs, "deposit", direct, account, None, "", "", f"2024-01-{day:02d}", "IN", amount, balance, "", party, "", "")


def test_views_are_matched_by_place_and_alone(spark):
    rows = [_view(i, True, "A", i, str(i), str(100 + i)) for i in range(1, 13)]
    rows += [_view(100 + i, False, "A", i, str(i), str(100 + i) if i not in (4, 5) else "9", party="" if i == 7 else "p") for i in range(1, 13) if i != 6]
    rows += [_view(200 + i * 37 % 13, False, "", i, str(i), str(100 + i) if i != 9 else "") for i in range(1, 13)]
    rows += [_view(1, True, "Z", 1, "1", "1", doc="other")]
    found = consolidation.consolidated(spark.createDataFrame(rows, VIEW).repartition(3))
    basis = {(r["left_obs"], r["right_obs"]): r["basis"] for r in found.matches.collect()}
    assert basis[(4, 104)] == basis[(5, 105)] == "ORDERED" and basis[(9, 200 + 9 * 37 % 13)] == "UNIQUE_CONFLICT" and basis[(1, 101)] == "EXACT" and len(basis) == 11 + 12
    got = {(r["document_id"], r["event"]): r for r in found.events.collect()}
    assert len(got) == 13 and got["d", 4]["observations"] == [4, 104, 200 + 4 * 37 % 13] and got["d", 7]["counterparty_name"] == "p"
    assert [(c["field"], c["values"]) for c in got["d", 4]["conflicts"]] == [("balance", ["104", "9"])] and got["other", 1]["conflicts"] == []
    nothing = consolidation.consolidated(spark.createDataFrame([], VIEW))
    assert nothing.events.count() == nothing.matches.count() == 0


def test_no_event_holds_two_rows_of_a_stream(spark):
    """Two detailed views and two with heads, in which one row's partners belong to different rows."""
    rows = [(_id, stream, order) for _id, stream, order in ((1, "a", 1), (2, "a", 1), (11, "b", 11), (21, "c", 21))]
    df = spark.createDataFrame([("d", i, s, o) for i, s, o in rows], "document_id string, obs long, stream string, first_obs long")
    links = spark.createDataFrame([("d", "a", "b", 1, 11, "EXACT"), ("d", "a", "c", 2, 21, "EXACT"), ("d", "c", "b", 21, 11, "ORDERED")], "document_id string, left_stream string, right_stream string, left_obs long, right_obs long, basis string")
    got = {r["obs"]: r["event"] for r in consolidation._untangled(df, consolidation._groups(df, links), links).collect()}
    assert got == {1: 1, 11: 1, 2: 2, 21: 2}


def test_a_declared_repeat_takes_its_document_out_of_the_event(make):  # noqa: F811
    txn = make(row("a", 0, balance_cents=5), row("b", 1, balance_cents=5, source_document_id="D2"), row("x", 2, balance_cents=5, source_document_id="D2"), row("z", 3, balance_cents=5, source_document_id="D3"))
    told = txn.withColumn("duplicate_of", F.when(F.col("id") == "b", "a").when(F.col("id") == "x", "later"))
    got = {r["id"]: (r["representative_id"], r["n_observations"]) for r in events.canonical_events(told).collect()}
    assert got == {"a": ("a", 3), "b": ("a", 3), "z": ("a", 3), "x": ("x", 1)}


def test_a_declared_repeat_of_another_amount_represents_its_event(make):  # noqa: F811
    rows = make(row("a", 0, balance_cents=5), row("b", 1, amount_cents=7, balance_cents=5, source_document_id="D2"), row("c", 2, amount_cents=7, balance_cents=5, source_document_id="D3"), row("e", 3, balance_cents=5, source_document_id="D4"))
    told = rows.withColumns({"duplicate_of": F.when(F.col("id") == "b", "a"), "review_status": F.when(F.col("id") == "b", "VERIFIED")})
    got = {r["id"]: r["representative_id"] for r in events.canonical_events(told).collect()}
    assert got == {"a": "b", "b": "b", "c": "b", "e": "e"}  # c is scored against b, e no longer against a


def test_rows_without_a_date_repeat_nothing(make):  # noqa: F811
    txn = make(row("a", 0, transaction_date=None, balance_cents=5, summary="s"), row("b", 1, transaction_date=None, balance_cents=5, summary="s")).withColumns({"page": F.lit(1), "row_index": F.col("seq")})
    assert recognition.dedup_in_document(txn).count() == 0


def test_words_tell_directions(make):  # noqa: F811
    said = {"退款": "IN", "缴费": "OUT", "汇款": "OUT", "年费减免": "IN", "贷款归还": "OUT", "对账": "UNKNOWN"}
    txn = make(*[row(w, i, direction="UNKNOWN", summary=w) for i, w in enumerate(said)]).withColumns({"page": F.lit(1), "row_index": F.col("seq")})
    assert {r["id"]: r["suggested"] for r in sequence.missing_directions(txn).collect()} == said


def test_printed_headers_are_known(spark):
    heads = ["账务日期", "付出金额", "入账金额", "账户余额", "收款人名称", "收款人账号", "交易说明"]
    cells = spark.createDataFrame([("t", 1, c, h) for c, h in enumerate(heads)], "t string, row_no int, col_no int, text string")
    got = {r["field"]: r["col_no"] for r in statements.header_fields(cells, ["t"]).collect()}
    assert got == {"date": 0, "debit": 1, "credit": 2, "balance": 3, "party_name": 4, "party_account": 5, "summary": 6, "amount": 1}


GRID = "document_id string, page int, table_no int, row_id long, row_no int, col_no int, cell_id long, text string"


def test_mappings_of_unchanged_pages_are_carried_over(spark):
    def cells(*pages):
        out, n = [], 0
        for page, lines in enumerate(pages, 1):
            for line, texts in enumerate(lines, 1):
                for c, t in enumerate(texts, 1):
                    n += 1
                    out.append(("d", page, 1, page * 100 + line + len(pages[0]), line, c, n, t))
        return spark.createDataFrame(out, GRID)

    before, after = cells([["a", "b"]], [["x", "x"], ["y", None]], [["z"]]), cells([["a", "b"], ["new", "row"]], [["x", "x"], ["y", None]], [["z"]])
    tables = spark.createDataFrame([("d", 1, 1), ("d", 2, 1), ("d", 3, 1)], "document_id string, page int, table_no int")
    refs = spark.createDataFrame([("d", 1, 1, "r", "row", 102), ("d", 2, 1, "r", "row", 203), ("d", 2, 1, "c", "cell", 6), ("d", 3, 1, "c", "cell", 999)], "document_id string, page int, table_no int, slot string, kind string, ref long")
    out, kept = recovery.rebased_mapping(before, after, tables, refs, tables.where("page = 1"))
    assert {r["page"]: r["taken"] for r in out.collect()} == {1: "NEW", 2: "KEPT", 3: "LOST"}
    assert {(r["slot"], r["ref"], r["new_ref"]) for r in kept.collect()} == {("r", 203, 204), ("c", 6, 8)}


def test_evidence_needs_two_cells(spark):
    cells = spark.createDataFrame([("d", 1, 1, 1, 1, 1, 1, "5.00"), ("d", 1, 1, 1, 1, 2, 2, "x"), ("d", 1, 1, 2, 2, 1, 3, "5.00"), ("d", 1, 1, 2, 2, 2, 4, "5.00"), ("d", 1, None, None, None, None, 5, "7.00")], GRID)
    wanted = spark.createDataFrame([("d", 1, 500, 500), ("d", 2, 700, 700), ("d", 3, None, 500)], "document_id string, item long, amount_cents long, balance_cents long")
    got = {r["item"]: (r["row_no"], r["found"]) for r in recovery.cell_evidence(wanted, cells).collect()}
    assert got == {1: (2, True), 2: (None, False), 3: (None, False)}


def test_budgets_take_pages_once(spark):
    rows = [("d", p, "UNASSIGNED_SOURCE_ROW" if p == 9 else "INDEPENDENT_VALUE_CONFLICT", "amount", "REQUIRED", p) for p in range(1, 10) for _ in range(2)] + [("d", 20, "UNASSIGNED_SOURCE_ROW", None, "ADVISORY", 1)]
    got = recovery.primary_plan(spark.createDataFrame(rows, "document_id string, page int, code string, field string, severity string, out_no long")).orderBy("rank").collect()
    assert [r["page"] for r in got] == [9, *range(1, 9)] and [r["state"] for r in got].count("SELECTED") == 6


def test_issues_without_rows_stay_pending(spark):
    issues = spark.createDataFrame([("d", 1, "PARTY", None, []), ("d", 2, "COUNTERPARTY_IDENTITY_MISSING", "counterparty_name", [1, 2]), ("d", 3, "COUNTERPARTY_IDENTITY_MISSING", None, [1])], "document_id string, issue_no long, code string, field string, observations array<long>")
    obs = spark.createDataFrame([("d", 1, 1, True, False, False, False, True, False), ("d", 2, 1, False, False, False, None, None, None)], "document_id string, obs long, event long, direct_owner boolean, name_bound boolean, placeholder boolean, cash boolean, party_present boolean, party_blank boolean")
    values = spark.createDataFrame([], "document_id string, obs long, field string, printed string, read string")
    chosen = spark.createDataFrame([], "document_id string, event long, field string, value string")
    got = pending.judged_issues(issues, obs, values, chosen, spark.createDataFrame([], "document_id string, account string"), spark.createDataFrame([], "document_id string, issuer string"))
    assert {r["issue_no"]: r["state"] for r in got.collect()} == {1: "PENDING", 2: "PENDING", 3: "RESOLVED"}


def test_owners_and_columns_of_no_rows(spark):
    rows = spark.createDataFrame([(1, "D", "r", None, None, None)], "case_id int, source_document_id string, id string, account_number string, account_name string, bank_name string")
    listed = spark.createDataFrame([], "case_id int, source_document_id string, page int, account_number string, account_name string, bank_name string")
    assert [r["outcome"] for r in ownership.resolved_owners(rows, listed).collect()] == ["UNRELIABLE"]
    cells, tables = spark.createDataFrame([], GRID), spark.createDataFrame([], "document_id string, page int, table_no int, kind string, account_kind string, description_col int")
    heads = spark.createDataFrame([], "document_id string, page int, table_no int, row_id long")
    assert columns.recovered_columns(cells, tables, heads, heads.withColumn("group_no", F.lit(1))).count() == 0


@pytest.mark.parametrize("name", ["d3_declared_events", "w7_missing_direction", "d17_mapped_picks", "d9_view_conflicts", "d11_reread_pages", "d13_critical_fields", "d19_judged_issues", "j9_document_owners"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = catalog.queries()[name](spark, sf)
    quoted = ", ".join(f'"{c}"' for c in df.columns)
    found = con.execute(f"SELECT {quoted} FROM ({catalog.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)
    assert plain(df.collect()) == plain(found) and found
