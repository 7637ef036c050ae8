"""Reading and writing statements, printed text, sequences, alignment, streams."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import identity, money
from ledgerloom.operators import pages, recognition, scoring, sequence
from ledgerloom.sources import statements
from ledgerloom.streaming import ledger as streams


def values(spark, expr, rows, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r["v"] for r in frame.select("i", expr("c").alias("v")).orderBy("i").collect()]


def test_money(spark):
    got = values(spark, money.money, ["1,234.50", "￥ -3", "1,23.0", "", "--", "0012.3", "-0.00", "1.234", None, "－5.10", "（空）", "N/A", "null", "/"])
    assert [(g["state"], g["cents"]) for g in got] == [("value", 123450), ("value", -300), ("unreadable", None), ("empty", None), ("empty", None), ("value", 1230), ("value", 0), ("unreadable", None), ("empty", None), ("value", -510), ("empty", None), ("empty", None), ("empty", None), ("unreadable", None)]
    assert values(spark, money.money_loose, ["1,234.5元", "(12.00)", "abc", None]) == [123450, -1200, 0, 0]


def test_dates_directions_banks(spark):
    got = values(spark, money.parse_date, ["2023-2-28", "2023年02月30日", "20230105", "20230105123456", "1/2", None])
    assert got == [dt.date(2023, 2, 28), None, dt.date(2023, 1, 5), dt.date(2023, 1, 5), None, None]
    assert values(spark, money.parse_time, ["2023-01-01 9:05", "20230105123456", "25:00", ""]) == ["09:05:00", "12:34:56", None, None]
    assert values(spark, money.direction, ["贷", "支出", "+5", "-5", "?", None]) == ["IN", "OUT", "IN", "OUT", None, None]
    assert values(spark, money.bank_name, ["工行北京", "本行", "某建行", "ABCDEFGH", None]) == ["中国工商银行", "本行", "某建行", "ABCDEFGH", ""]
    assert values(spark, money.header_bank, ["中国光大银行 成都", "商业银行", "重庆银行股份有限公司"]) == ["中国光大银行", "", "重庆银行"]
    assert values(spark, money.holder_clean, ["张三银行流水.pdf", "张三"]) == ["张三", "张三"]
    assert values(spark, money.page_selection, ["1-3,5, 2", "3-1", "x", "7"]) == [[1, 2, 3, 5], None, None, [7]]


def test_accounts(spark):
    assert values(spark, money.account_no, ["尾号1234", "账号 62220000000001 元", "12345678/87654321", "6222****0001", "ABCDEFGH", "AB1234567", "无", "1" * 33, "见尾号1234"]) == ["尾号1234", "62220000000001", None, "6222****0001", None, "AB1234567", "", None, None]
    reliable = values(spark, lambda c: identity.is_reliable_account(c), ["6222-0000 0001", "1234567", "110101199001011234", "账号待核验未知账户"])
    assert reliable == [True, False, False, False]
    pairs = spark.createDataFrame([("6222021234567890", "1234567890"), ("6222021234567890", "021234567890"), ("12", "12"), ("a1234567890", "1234567890")], "a string, b string")
    assert [r["v"] for r in pairs.select(identity.account_alias_suffix("a", "b").alias("v")).collect()] == [False, True, True, False]
    near = spark.createDataFrame([("1234", "1244"), ("1234", "1243"), ("123", "1234")], "a string, b string")
    assert [tuple(r) for r in near.select(identity.ocr_digit_variant("a", "b"), identity.bounded_edit_distance("a", "b")).collect()] == [(True, True), (False, True), (False, True)]


def test_standard_csv(spark, tmp_path):
    head = ",".join(statements.COLUMNS)
    good = ["﻿" + head, '62220001,"张,三",银行,2023-01-02 10:00:00,2023-01-02,IN,"1,000.50",2000,工资,"多\n行",,', "62220001,张三,银行,,2023-13-01,,5.00,,,,,", ",,,,,,,,,,,", "62220001,张三,银行,,2023-01-03,OUT,-5,,,,,", "62220001,张三,银行,,2023-01-03,SIDE,5,,,,,", "62220001,张三,银行,,2023-01-03,OUT,5x,,,,,"]
    (tmp_path / "good.csv").write_text("\r\n".join(good), encoding="utf-8")
    (tmp_path / "bad.csv").write_text("date,amount\n2023-01-01,5\n", encoding="utf-8")
    rows, rejects = statements.read_standard_csv(spark, str(tmp_path))
    got = rows.orderBy("amount_cents").collect()
    assert [(r["amount_cents"], r["balance_cents"], r["direction"], list(r["data_quality_issues"])) for r in got] == [(500, None, "UNKNOWN", ["INVALID_DATE", "INVALID_DIRECTION"]), (100050, 200000, "IN", [])]
    assert got[1]["account_name"] == "张,三" and "\n" in got[1]["counterparty_name"]
    assert sorted(r["reason"] for r in rejects.collect()) == ["AMOUNT", "DIRECTION", "HEADER", "HEADER", "NEGATIVE_AMOUNT"]


def test_ledger_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('户名：张三,\n卡号：6222000011112222,\n\n交易日期,支出,存入,余额,对方户名,摘要\n2023-01-01,"1,000.00",,500,李四,"转,账"\n2023-01-02,,20,520,,工资\nx,1,,1,,\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("交易日期,交易金额,摘要\n20230103,-7.5,消费\n20230104,8,收\n", encoding="utf-8")
    got = {(str(r["transaction_date"]), r["direction"], r["amount_cents"], r["balance_cents"], r["counterparty_name"], r["summary"], r["account_number"]) for r in statements.read_ledger_csv(spark, str(tmp_path)).collect()}
    assert got == {("2023-01-01", "OUT", 100000, 50000, "李四", "转,账", "6222000011112222"), ("2023-01-02", "IN", 2000, 52000, "", "工资", "6222000011112222"), ("2023-01-03", "OUT", 750, None, None, "消费", None), ("2023-01-04", "IN", 800, None, None, "收", None)}


def test_html_and_blocks(spark, tmp_path):
    page = spark.createDataFrame([(1, '<table><tr><th colspan="2">a&amp;b</th><td>c</td></tr><tr><td>1<br/>2</td></tr></table><TABLE><tr><td>z</td></tr></TABLE>')], "k int, html string")
    got = sorted((r["table_no"], r["row_no"], r["col_no"], r["text"]) for r in statements.extract_html_tables(page, "k").collect())
    assert got == [(0, 0, 0, "a&b"), (0, 0, 1, ""), (0, 0, 2, "c"), (0, 1, 0, "1\n2"), (1, 0, 0, "z")]
    (tmp_path / "p.json").write_text('{"pages": [{"page_index": 0, "blocks": [{"type": "text", "text": " hi "}, {"type": "table", "table_body": "<table/>"}]}]}')
    blocks = [(r["page"], r["block_no"], r["type"], r["text"], r["table_html"]) for r in statements.read_structured_blocks(spark, str(tmp_path / "p.json")).collect()]
    assert blocks == [(1, 0, "text", "hi", None), (1, 1, "table", "", "<table/>")]
    ident = statements.identify_sources(spark, str(tmp_path / "p.json")).first()
    assert len(ident["document_id"]) == 68 and ident["bytes"] > 0


LEDGER = "case_id int, source_document_id string, account_number string, id string, seq long, page int, row_index long, transaction_date date, direction string, amount_cents long, balance_cents long, summary string, counterparty_name string, raw_text string, transaction_type string, bank_name string"


def statement(spark, moves, start=10_000, reverse_days=()):
    """moves: (day, signed cents). Days in reverse_days are printed newest first."""
    rows, balance = [], start
    for i, (day, cents) in enumerate(moves):
        balance += cents
        rows.append([day, cents, balance, i])
    out = []
    for day in sorted({r[0] for r in rows}):
        out += [r for r in rows if r[0] == day][:: -1 if day in reverse_days else 1]
    data = [(1, "D", "622200001", f"t{r[3]}", n, 1, n, dt.date(2023, 1, r[0]), "IN" if r[1] > 0 else "OUT", abs(r[1]), r[2], "转账", None, None, None, "B") for n, r in enumerate(out)]
    return spark.createDataFrame(data, LEDGER)


def test_chronology_turns_single_days(spark):
    moves = [(1, 500), (1, -200), (1, 300), (2, -50), (2, 70), (3, 10)]
    for turned in ((), (1,), (2,), (1, 2)):
        txn = statement(spark, moves, reverse_days=turned)
        got = [r["id"] for r in sequence.chronological_rank(txn).orderBy("chrono_rank").collect()]
        assert got == [f"t{i}" for i in range(6)], turned
        assert sequence.balance_breaks(sequence.chronological_rank(txn)).count() == 0


def test_one_cent_break_is_found(spark):
    txn = statement(spark, [(1, 500), (2, -200), (3, 300)]).withColumn("balance_cents", F.when(F.col("id") == "t1", F.col("balance_cents") + 1).otherwise(F.col("balance_cents")))
    assert sorted(r["id"] for r in sequence.balance_breaks(sequence.chronological_rank(txn)).collect()) == ["t1", "t2"]
    fields = sequence.printed_balance_checks(txn).groupBy("id").count().collect()
    assert {(r["id"], r["count"]) for r in fields} == {("t1", 4), ("t2", 4)}
    audit = sequence.account_audit(sequence.chronological_rank(txn)).first()
    assert audit["is_auditable"] and audit["is_balanced"] and audit["start_cents"] == 10_000


def test_repairs(spark):
    txn = statement(spark, [(1, 500), (2, -200), (3, 300), (4, 1000)])
    wrong = txn.withColumn("direction", F.when(F.col("id") == "t1", "IN").otherwise(F.col("direction")))
    assert [(r["id"], r["calibrated"]) for r in sequence.calibrated_directions(wrong).collect()] == [("t1", "OUT")]
    digit = txn.withColumn("amount_cents", F.when(F.col("id") == "t2", 800).otherwise(F.col("amount_cents")))
    assert [(r["id"], r["repaired_cents"], r["reason"]) for r in sequence.bridge_heal(sequence.chronological_rank(digit)).collect()] == [("t2", 300, "bridge")]
    unknown = txn.withColumn("direction", F.when(F.col("id") == "t2", "UNKNOWN").otherwise(F.col("direction")))
    assert [(r["id"], r["suggested"]) for r in sequence.missing_directions(unknown).collect()] == [("t2", "IN")]


def plain_heal(rows):
    """Bridges, then pairs, row after row; rows are (id, direction, amount, balance)."""
    rows, out = [dict(zip(("id", "direction", "amount", "balance"), r, strict=True)) for r in rows], {}
    sign = lambda r: {"IN": 1, "OUT": -1}.get(r["direction"])
    near = lambda a, b: len(f"{a / 100:.2f}") == len(f"{b / 100:.2f}") and sum(x != y for x, y in zip(f"{a / 100:.2f}", f"{b / 100:.2f}", strict=True)) <= 1
    for p, c, n in zip(rows, rows[1:], rows[2:], strict=False):
        if None in (p["balance"], c["balance"], n["balance"], sign(c), sign(n)):
            continue
        after = n["balance"] - sign(n) * n["amount"]
        implied = abs(after - p["balance"])
        if abs(p["balance"] + sign(c) * c["amount"] - c["balance"]) < 50 and abs(after - c["balance"]) < 50:
            continue
        if implied > 0 and abs(p["balance"] + sign(c) * implied - after) < 5 and near(c["amount"], implied) and near(c["balance"], after):
            c["amount"], c["balance"], out[c["id"]] = implied, after, (implied, after, "bridge")
    for p, c in zip(rows, rows[1:], strict=False):
        if None in (p["balance"], c["balance"], sign(c)) or abs(p["balance"] + sign(c) * c["amount"] - c["balance"]) < 50:
            continue
        implied = abs(c["balance"] - p["balance"])
        if implied > 0 and near(c["amount"], implied):
            out[c["id"]] = (implied, c["balance"], "pair")
    return out


def test_bridges_equal_a_scan(spark):
    """Balances and amounts with digits misread in rows that follow each other, so that bridges lean on bridges."""
    rng, data, want, chained = np.random.default_rng(7), [], {}, 0
    for a in range(60):
        balance, rows = 500_000, []
        for i in range(30):
            move = int(rng.integers(100, 9_000)) * (1 if rng.random() < 0.6 else -1)
            balance += move
            amount, seen = abs(move), balance
            if rng.random() < 0.3:
                amount += int(rng.choice([1_000, 200, -100]))
            if rng.random() < 0.3:
                seen += int(rng.choice([10_000, 1_000, -1_000, 200]))
            rows.append((f"a{a}_{i}", rng.choice(["IN", "OUT", "UNKNOWN"], p=[0.02, 0.02, 0.96]) if rng.random() < 0.05 else "IN" if move > 0 else "OUT", max(amount, 1), None if rng.random() < 0.03 else seen))
        healed = plain_heal(rows)
        want |= healed
        chained += sum(healed.get(x[0], (0, 0, ""))[2] == healed.get(y[0], (0, 0, ""))[2] == "bridge" for x, y in zip(rows, rows[1:], strict=False))
        data += [(1, "D", f"6222{a:08d}", r[0], i, 1, i, None, str(r[1]), r[2], r[3], "转账", None, None, None, "B") for i, r in enumerate(rows)]
    got = sequence.bridge_heal(spark.createDataFrame(data, LEDGER).withColumn("rank", F.col("row_index")), "rank")
    assert {r["id"]: (r["repaired_cents"], r["repaired_balance_cents"], r["reason"]) for r in got.collect()} == want
    assert chained >= 5 and {v[2] for v in want.values()} == {"bridge", "pair"}


def test_closures_and_cards(spark):
    txn = statement(spark, [(1, 500), (2, -9_000), (3, 100)]).withColumn("amount_cents", F.when(F.col("id") == "t1", 7_000).otherwise(F.col("amount_cents")))
    heal = lambda t: [(r["id"], r["repaired_cents"], r["reason"]) for r in sequence.bridge_heal(t.withColumn("r", F.col("row_index")), "r").collect()]
    assert heal(txn) == [("t1", 9_000, "bridge")]
    far = txn.withColumn("amount_cents", F.when(F.col("id") == "t1", 123).otherwise(F.col("amount_cents")))
    closing = far.withColumn("summary", F.when(F.col("id") == "t1", "销户").otherwise(F.col("summary")))
    assert heal(far) == [] and heal(closing) == [("t1", 9_000, "pair")]
    assert heal(far.withColumn("raw_text", F.lit("行 90 元"))) == [("t1", 9_000, "bridge")]
    assert heal(closing.withColumn("bank_name", F.lit("信用卡中心"))) == []


def test_settlement_years_follow_each_other(spark):
    day = lambda *d: dt.date(*d)
    days = [day(2020, 1, 1), day(2020, 3, 1), day(2010, 3, 21), day(2011, 6, 21), None, day(2031, 1, 5), day(2012, 2, 29), day(2021, 3, 1), day(2021, 4, 1)]
    kinds = ["转账", "转账", "结息", "结息", "转账", "结息", "结息", "转账", "转账"]
    data = [(1, "D", "622200001", f"t{i}", i, 1, i, d, "IN", 0 if i == 3 else 10, 1_000 + 10 * i, k, None, None, None, "B") for i, (d, k) in enumerate(zip(days, kinds, strict=True))]
    got = {r["id"]: (r["repaired_date"], r["repaired_cents"]) for r in sequence.settlement_repairs(spark.createDataFrame(data, LEDGER)).collect()}
    assert got == {"t2": (day(2020, 3, 21), None), "t3": (day(2020, 6, 21), 10)}  # 2031 is in order, 2031 has no 29 February
    leap = [(day(2023, 5, 1), "转账"), (day(2012, 2, 29), "结息"), (day(2024, 3, 5), "转账"), (day(2024, 4, 1), "转账"), (day(2024, 5, 1), "转账")]
    data = [(1, "D", "622200001", f"t{i}", i, 1, i, d, "IN", 10, None, k, None, None, None, "B") for i, (d, k) in enumerate(leap)]
    assert [(r["id"], r["repaired_date"]) for r in sequence.settlement_repairs(spark.createDataFrame(data, LEDGER)).collect()] == [("t1", day(2024, 2, 29))]
    printed = spark.createDataFrame(data, LEDGER).withColumn("date_printed", F.lit(True))
    assert sequence.settlement_repairs(printed).count() == 0
    assert sequence.settlement_repairs(spark.createDataFrame([], LEDGER)).count() == 0


def test_installments(spark):
    data = [(1, "D", "622200001", f"t{i}", i, 1, i, dt.date(2023, 1, 1), w, 10, None, k, None, None, None, "B") for i, (w, k) in enumerate([("IN", "账单分期"), ("OUT", "消费"), ("OUT", "消费（利息）"), ("IN", "账单分期"), ("OUT", "消费"), ("OUT", "费用"), ("OUT", "账单分期"), ("OUT", "消费"), ("OUT", "费用")])]
    txn = spark.createDataFrame(data, LEDGER).withColumn("account_kind", F.lit("credit"))
    assert sorted((r["id"], r["part"]) for r in sequence.installment_sequences(txn).collect()) == [("t0", "conversion"), ("t1", "purchase"), ("t2", "interest"), ("t3", "conversion"), ("t4", "purchase")]
    assert sequence.installment_sequences(txn.withColumn("account_kind", F.lit("deposit"))).count() == 0


def brute_alignment(a, b):
    """All best alignments by plain recursion; the pairs that every one of them holds."""
    s = recognition._score(a, b)

    def best(i, j):
        if i == len(a) and j == len(b):
            return 0.0, [frozenset()]
        options = []
        if i < len(a) and j < len(b) and s[i, j] > -np.inf:
            v, w = best(i + 1, j + 1)
            options.append((v + s[i, j], [x | {(i, j)} for x in w]))
        for di, dj in ((1, 0), (0, 1)):
            if i + di <= len(a) and j + dj <= len(b):
                v, w = best(i + di, j + dj)
                options.append((v + recognition.GAP, w))
        top = max(v for v, _ in options)
        return top, [x for v, w in options if v == top for x in w]

    every = best(0, 0)[1]
    return sorted((i, j) for i, j in frozenset.intersection(*every) if all(x == (i, j) for w in every for x in w if x[0] == i or x[1] == j))


def test_points_of_a_pair_of_rows():
    """Account 3, date 2, direction 1, amount 3, balance 3, other party's account 2; a disagreement costs one; empty fields say nothing."""
    base = ["a", "d", "IN", "5", "9", "p"]
    cases = [(base, base, 14), (base, ["a", "d", "IN", "6", "", ""], 5), (base, ["", "d", "IN", "", "", "p"], 5), (base, ["x", "d", "IN", "y", "", "p"], -np.inf), (base, ["a", "", "", "5", "", ""], -np.inf)]
    for a, b, want in cases:
        assert recognition._score(np.array([a], object), np.array([b], object))[0, 0] == want


def test_repeats_inside_a_document(spark):
    """Rows of one page may repeat, wording may be contained in other wording, and times must be able to be one."""
    rows = [("p1", 1, 500, "转账", None), ("p2", 1, 500, "转账", None), ("q1", 2, 700, "转账汇款", None), ("q2", 9, 700, "转账", None), ("r1", 3, None, "", "09:15:30"), ("r2", 4, None, "x", "09:15:31"), ("s1", 5, 800, "a", "09:15"), ("s2", 6, 800, "b", "09:15")]
    schema = "id string, page int, balance_cents long, summary string, transaction_time string"
    txn = spark.createDataFrame(rows, schema).selectExpr("*", "1 as case_id", "'D' as source_document_id", "date '2023-01-01' as transaction_date", "cast(unhex(substr(hex(id), 1, 2)) as string) as k")
    txn = txn.selectExpr("*", "ascii(k) * 100 as amount_cents", "id as seq", "page as row_index", "'6222' as account_number", "'IN' as direction", "'' as counterparty_name", "'' as raw_text")
    assert sorted((r["id"], r["duplicate_of_id"]) for r in recognition.dedup_in_document(txn).collect()) == [("p2", "p1"), ("q2", "q1"), ("s2", "s1")]


def test_alignment_against_recursion():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a = rng.integers(0, 2 + _ % 2, (rng.integers(0, 5), 6)).astype(str).astype(object)
        b = np.array([r for r in a if rng.random() < 0.8] + list(rng.integers(0, 3, (1, 6)).astype(str).astype(object)), object).reshape(-1, 6)
        assert recognition.align(a, b) == brute_alignment(a, b)


def test_one_missing_row_shifts_nothing(spark):
    rows = [(1, "D", 1, i, str(100 + i), str(i), f"d{i}", "IN", "s", "p") for i in range(5)]
    schema = "case_id int, document_id string, page int, row int, amount string, balance string, date string, direction string, account string, party_account string"
    left, right = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[:2] + rows[3:], schema)
    pairs = recognition.align_readings(left, right)
    assert sorted((r["left_row"], r["right_row"]) for r in pairs.collect()) == [(0, 0), (1, 1), (3, 3), (4, 4)]
    assert [(r["issue"], r["left_row"]) for r in recognition.compare_readings(left, right, pairs).collect()] == [("UNMATCHED_ROW", 2)]


def test_acceptance_needs_an_alert_for_every_error(spark):
    gold = spark.createDataFrame([(f"g{i}", 1, i, f"a{i}") for i in range(1000)], "gold_id string, doc int, amount int, account string")
    pred = gold.select(F.regexp_replace("gold_id", "g", "p").alias("pred_id"), "doc", "amount", F.when(F.col("amount") == 7, "wrong").otherwise(F.col("account")).alias("account"))
    pairs = scoring.align_unique(gold, pred, [["doc", "amount"]])
    for warned, accepted in ((["p7"], True), (["p8"], False)):
        alerts = spark.createDataFrame([(p,) for p in warned], "pred_id string")
        got = scoring.acceptance(gold, pred, pairs, alerts, ["doc"], ["amount", "account"]).first()
        assert (got["critical_accuracy"], got["review_rate"], got["accepted"]) == (0.999, 0.001, accepted)


def test_batches_and_runs(spark):
    frame = spark.createDataFrame([(1, "D", p, n, b, b) for p, n, b in ((1, 50, "x"), (2, 100, None), (3, 60, "x"), (4, 10, "y"), (6, 300, "y"))], "case_id int, document_id string, page int, n_rows long, bank string, account string")
    costs = frame.selectExpr("*", "0 as segment", "cast(n_rows as int) as estimated_rows", "page < 4 as pending")
    assert [(r["page"], r["batch"]) for r in pages.extraction_batches(costs).orderBy("page").collect()] == [(1, 0), (2, 0), (3, 1), (4, 1)]
    assert [r["batch"] for r in pages.extraction_batches(costs, 1).orderBy("page").collect()] == [0, 1, 2]
    assert sorted((r["run_bank"], r["first_page"], r["last_page"]) for r in pages.bank_runs(frame).collect()) == [("x", 1, 3), ("y", 4, 4), ("y", 6, 6)]


def test_streams(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=i), i % 3, "purchase" if i % 2 else "click", 50.0 + i % 4, "{}") for i in range(60)]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    for n, part in enumerate((events[:40], events[30:], events[:10])):
        spark.createDataFrame(part, streams.EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        (src,) = (tmp_path / f"in{n}").glob("*.parquet")
        (tmp_path / "all").mkdir(exist_ok=True)
        src.rename(tmp_path / "all" / f"{n}.parquet")

    def drained(frame, name):
        q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name)

    source = streams.read_stream(spark, str(tmp_path / "all"))
    assert drained(streams.ingest(source, late="30 days"), "once").count() == 60
    batch = streams.from_events(spark.createDataFrame(events, streams.EVENTS))
    single = streams.read_stream(spark, str(tmp_path / "all"), 10)
    got = drained(streams.fast_in_out(single, late="30 days"), "pairs").select("in_id", "out_id").distinct().count()
    a, b = batch.where("direction = 'IN'").alias("a"), batch.where("direction = 'OUT'").alias("b")
    near = (F.col("a.account") == F.col("b.account")) & (F.col("b.ts") >= F.col("a.ts")) & (F.col("b.ts") <= F.col("a.ts") + F.expr("interval 2 days")) & (100 * F.abs(F.col("a.amount_cents") - F.col("b.amount_cents")) <= 15 * F.col("a.amount_cents"))
    assert got == a.join(b, near).where(F.col("a.amount_cents") >= 3000).count()
    assert streams.daily_flows(batch).agg(F.sum("n_rows")).first()[0] == 60


@pytest.mark.parametrize("name", ["j3_internal_transfer_edges", "j4_fast_in_out_edges", "d3_canonical_events", "a1_counterparty_summary"])
def test_plans_have_no_cross_joins(spark, sf, name):
    from ledgerloom import catalog

    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_page_context_at_any_distance(spark):
    rows = [(1, "D", p, "622200000001", b) for p, b in ((1, "中国工商银行"), (42, None), (128, "工商银行"), (129, ""))] + [(1, "D", p, "622200000002", b) for p, b in ((2, "X"), (3, "X"), (90, "Y"))] + [(1, "D", 5, None, None), (1, "D", 6, "622200000003", "X")] + [(1, "D", p, "12345678", "X") for p in (7, 8)]
    got = pages.page_context(spark.createDataFrame(rows, "case_id int, document_id string, page int, account string, bank string")).collect()
    assert sorted((r["account"], r["page"], r["rank"], r["context_page"], r["distance"]) for r in got) == [
        ("622200000001", 1, 1, 42, 41), ("622200000001", 1, 2, 128, 127), ("622200000001", 42, 1, 1, 41), ("622200000001", 42, 2, 128, 86), ("622200000001", 128, 1, 129, 1), ("622200000001", 128, 2, 42, 86), ("622200000001", 129, 1, 128, 1), ("622200000001", 129, 2, 42, 87)]
