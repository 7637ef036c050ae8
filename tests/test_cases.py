"""Events, netting, phases, flows and rules on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import aggregates, events, flow, netting, rules
from ledgerloom.plans.evaluate_case import evaluate_case

TXN = (
    "case_id int, id string, seq long, account_number string, account_name string, bank_name string, transaction_date date, direction string, amount_cents long, balance_cents long, "
    "summary string, counterparty_name string, counterparty_account string, source_document_id string, transaction_type string, counterparty_bank string, raw_text string"
)
OWN, SECOND, SPOUSE = "622200000001", "622200000002", "622200000003"


def row(ident, seq, **k):
    base = {"account_number": OWN, "account_name": "张三", "bank_name": "B", "transaction_date": dt.date(1999, 8, 1), "direction": "OUT", "amount_cents": 100_000, "balance_cents": None, "summary": None,
            "counterparty_name": None, "counterparty_account": None, "source_document_id": "D1", "transaction_type": None, "counterparty_bank": None, "raw_text": None} | k
    return (1, ident, seq, *[base[f.split()[0]] for f in TXN.split(", ")[3:]])


@pytest.fixture(scope="module")
def make(spark):
    return lambda *rows: spark.createDataFrame(list(rows), TXN)


@pytest.fixture(scope="module")
def accounts(spark):
    rows = [(1, OWN, "张三", "DEBTOR_MAIN"), (1, SECOND, "张三", "DEBTOR_MAIN"), (1, SPOUSE, "李四", "SPOUSE")]
    return spark.createDataFrame(rows, "case_id int, account_number string, account_name string, owner_type string")


def cases(spark, content="无收入", income=0):
    d = dt.date
    rows = [(1, "张三", 10_000_000, d(1996, 1, 1), d(1997, 1, 1), d(1998, 1, 1), d(1999, 1, 1), d(1999, 6, 1), d(1999, 7, 1), None, income, content)]
    return spark.createDataFrame(rows, "case_id int, respondent_name string, target_cents long, t0 date, t1 date, t2 date, t3 date, t4 date, t5 date, t6 date, declared_income_cents long, declared_content string")


def ids(frame):
    return sorted(r["id"] for r in frame.collect())


def test_netting_needs_account_evidence(make, accounts):
    txn = make(
        row("a", 1, counterparty_account=SECOND), row("b", 2, account_number=SECOND, direction="IN", counterparty_account=OWN),
        row("c", 3, account_number=SPOUSE, direction="IN", amount_cents=200_000, counterparty_account=OWN), row("d", 4, amount_cents=200_000), row("e", 5, amount_cents=300_000),
    )
    net = netting.net_internal(txn, accounts)
    assert ids(net.where("is_internal")) == ["a", "b"]


def test_name_only_pairs_are_candidates(make, accounts):
    txn = make(row("a", 1, counterparty_name="张 三"), row("b", 2, account_number=SECOND, direction="IN"))
    assert ids(netting.net_internal(txn, accounts).where("is_internal")) == []
    pairs = netting.internal_pairs(txn, accounts)
    assert [(r["left_id"], r["right_id"]) for r in netting.internal_candidates(txn, accounts, pairs).collect()] == [("a", "b")]


def test_greedy_pairs_take_each_row_once(make, accounts):
    txn = make(*[row(f"o{i}", i, counterparty_account=SECOND) for i in range(3)], *[row(f"i{i}", 10 + i, account_number=SECOND, direction="IN") for i in range(2)])
    got = [(r["left_id"], r["right_id"]) for r in netting.internal_pairs(txn, accounts).collect()]
    assert sorted(got) == [("o0", "i0"), ("o1", "i1")]


def test_same_row_in_two_documents_is_one_event(make):
    txn = make(row("a", 1, balance_cents=5), row("b", 2, balance_cents=5, source_document_id="D2"), row("c", 3), row("d", 4, source_document_id="D2", summary="其他"), row("e", 5, amount_cents=7))
    found = {r["id"]: r for r in events.canonical_events(txn.where("id < 'c'")).collect()}
    assert found["a"]["event_id"] == found["b"]["event_id"] and found["a"]["representative_id"] == "a" and found["b"]["n_observations"] == 2
    apart = events.canonical_events(txn.where("id in ('c', 'd')"))
    assert apart.select("event_id").distinct().count() == 2


def test_three_documents_and_declared_repeats(make):
    txn = make(*[row(f"x{i}", i, balance_cents=9, source_document_id=f"D{i}", summary="转账") for i in range(3)], row("y", 9, balance_cents=9, source_document_id="D0", summary="转账"))
    got = events.canonical_events(txn)
    assert sorted(r["n_observations"] for r in got.collect()) == [1, 3, 3, 3]
    declared = events.canonical_events(txn.withColumn("duplicate_of", F.when(F.col("id") == "y", "x0")))
    assert {r["n_observations"] for r in declared.collect()} == {4}


def test_long_chains_of_declared_repeats_stay_in_one_event(make):
    txn = make(*[row(f"c{i}", i, amount_cents=1000 + i) for i in range(9)], row("z", 20))
    got = {r["id"]: r for r in events.canonical_events(txn.withColumn("duplicate_of", F.when(F.col("seq").between(1, 8), F.concat(F.lit("c"), F.col("seq") - 1)))).collect()}
    assert len(got) == 10 and {got[f"c{i}"]["event_id"] for i in range(9)} == {got["c0"]["event_id"]} != {got["z"]["event_id"]}
    assert got["c8"]["n_observations"] == 9 and got["c8"]["confidence"] == 0.98


def test_unknown_direction_never_merges(make):
    txn = make(row("a", 1, direction="UNKNOWN", balance_cents=5), row("b", 2, direction="UNKNOWN", balance_cents=5, source_document_id="D2"))
    assert events.canonical_events(txn).select("event_id").distinct().count() == 2


def test_flow_codes(make):
    texts = [("工资", "IN", "SALARY_INCOME"), ("贷款放款", "IN", "LOAN_DISBURSEMENT"), ("ATM取款", "OUT", "CASH_WITHDRAWAL"), ("在 ATM 机", "OUT", "CASH_WITHDRAWAL"), ("POS消费", "OUT", "CONSUMPTION"), ("司法划扣", "OUT", "JUDICIAL_DEDUCTION"), ("xyz", "OUT", "OTHER_OUT"), ("保费", "OUT", "INSURANCE")]
    txn = make(*[row(f"r{i}", i, summary=s, direction=d) for i, (s, d, _) in enumerate(texts)], row("typed", 50, summary="工资", direction="IN", transaction_type="退款"), row("u", 51, direction="UNKNOWN"))
    got = {r["id"]: r["flow_code"] for r in flow.classify_flow(txn.withColumn("is_internal", F.lit(False))).collect()}
    assert [got[f"r{i}"] for i in range(len(texts))] == [c for _, _, c in texts]
    assert got["typed"] == "REFUND_REVERSAL" and got["u"] is None


def test_phases(spark, make):
    days = {"1995-01-01": "【债务形成前】", "1996-06-01": "【债务形成后至起诉前】", "1997-01-01": "【诉讼保全期间】", "1999-06-15": "【报告财产令后】", "2001-01-01": "【查封冻结后】"}
    txn = make(*[row(d, i, transaction_date=dt.date.fromisoformat(d)) for i, d in enumerate(days)])
    assert {r["id"]: r["phase_tag"] for r in flow.tag_phases(txn, cases(spark)).collect()} == days


def test_counterparties(spark, make):
    same = "622800000009"
    txn = make(row("a", 1, counterparty_account=same, counterparty_name="张四", direction="IN", amount_cents=50), row("b", 2, counterparty_account=same, counterparty_name="张四有限公司", amount_cents=100), row("c", 3, counterparty_account="628000000010", counterparty_name="张四"), row("d", 4, summary="司法划扣"), row("e", 5))
    got = {r["party_key"]: r for r in aggregates.counterparty_summary(txn.withColumn("is_internal", F.lit(False)), cases(spark)).collect()}
    both = got[f"account:{same}"]
    assert (both["in_cents"], both["out_cents"], both["net_out_cents"], both["n_aliases"], both["suspected_relative"]) == (50, 100, 50, 2, True)
    assert got["【司法机关划扣】"]["n_rows"] == 1 and got["unknown:D1:e"]["n_rows"] == 1 and len(got) == 4


def test_rules_end_to_end(spark, make, accounts):
    txn = make(
        row("big", 1, amount_cents=6_000_000, counterparty_name="某人"), row("cash1", 2, amount_cents=4_600_000, summary="ATM取现"), row("cash2", 3, amount_cents=4_700_000, summary="取现"), row("repay", 4, amount_cents=200_000, summary="还借款", counterparty_name="王五"),
        row("lend", 5, amount_cents=2_500_000, summary="借出款"), row("life", 6, amount_cents=60_000, summary="保费", transaction_date=dt.date(1998, 1, 1)), row("close", 7, summary="销户", direction="IN", amount_cents=1), row("pay", 8, direction="IN", amount_cents=3_000_000, counterparty_name="公司", transaction_date=dt.date(1999, 9, 1)),
        row("out", 9, amount_cents=2_900_000, counterparty_name="李", transaction_date=dt.date(1999, 9, 2)), row("out2", 10, account_number=SECOND, amount_cents=2_900_000, transaction_date=dt.date(1999, 9, 2)),
    )
    found = evaluate_case(txn, accounts, cases(spark))
    got = {}
    for r in found.matches().collect():
        got.setdefault(r["rule_id"], []).append(r)
    assert sorted(got) == ["R01", "R02", "R04", "R05", "R07", "R08", "R10", "R11"]
    assert [m["match_id"] for m in got["R04"]] == ["R04_pay_out"] and got["R02"][0]["n_rows"] == 2 and got["R05"][0]["severity"] == "L1" and got["R08"][0]["time_phase"].startswith("冻结前")
    assert got["R11"][0]["total_cents"] == 3_000_001
    none = evaluate_case(txn, accounts, cases(spark, content=None, income=None))
    assert "R11" not in {r["rule_id"] for r in none.matches().collect()}
    kept = rules.carry_annotations(found.matches(enabled=["R10"]), spark.createDataFrame([(1, "R10_lend", "note"), (1, "R10_gone", "x")], "case_id int, match_id string, lawyer_notes string"))
    assert [r["lawyer_notes"] for r in kept.collect()] == ["note"]
    kpi = found.kpis().first()
    assert kpi["net_in_cents"] == kpi["raw_in_cents"] - kpi["internal_cents"] and kpi["duplicate_rows"] == 0


def test_a_broken_rule_stops_no_other(spark, make, accounts):
    found = evaluate_case(make(row("lend", 5, amount_cents=2_500_000, summary="借出款")), accounts, cases(spark))
    broken = {"BAD": lambda c: c.txn.select("no_such_column"), "R10": rules.RULES["R10"]}
    assert rules.evaluate(found.context, rules=broken).count() == 1


def test_fingerprint_ignores_order(spark, make):
    rows = [row(f"r{i}", i, amount_cents=i) for i in range(20)]
    one, two, three = (aggregates.fingerprint(make(*r), ["id", "amount_cents"]).first()["fingerprint"] for r in (rows, rows[::-1], rows[1:]))
    assert one == two != three
