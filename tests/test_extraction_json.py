"""Answers of a model: malformed ones and broken parts are rejected, the rest is read."""

import json

from ledgerloom.sources import extraction_json

SCHEMA = "document_id string, total_pages int, respondent string, answer string"


def test_answers_and_their_rejects(spark):
    good = {
        "accounts": [{"ac": "6222 0000 0000 1234", "holder": "", "bk": "商业银行", "p": 2}, {"ac": "6222000000001234", "holder": "later"}, {"ac": "12"}, 5],
        "transactions": [
            {"p": 1, "tm": "2024-01-02 10:11", "amt": "-1,234.50", "bal": 10, "dir": "out", "ac": "6222000000001234", "cf": 0.9, "cp": " 李四 ", "nested": {"x": [1]}},
            {"page": "2", "row": 7, "transactionTime": "soon", "amount": "12x", "direction": "?", "confidence": ""},
            {"p": 3}, {"p": 0}, {"p": 1.5}, [], None, "text",
        ],
        "pageChecks": [{"p": 1, "extracted": 3, "status": "needs_review"}, {"page": 9, "transactionCount": 4}, {"p": 2, "extracted": -2}],
        "warnings": "none",
    }
    rows = [("good", 2, "张三", json.dumps(good, ensure_ascii=False)), ("cut", 1, None, json.dumps(good)[:200]), ("list", 1, None, "[1]"), ("null", 1, None, None), ("empty", 2, None, "{}"), ("shape", 1, None, '{"transactions": {"a": 1}}')]
    found = extraction_json.read_extraction_json(spark.createDataFrame(rows, SCHEMA))
    first, second = found.rows.orderBy("position").collect()
    assert (first["amount_cents"], first["balance_cents"], first["direction"], first["transaction_clock"], first["counterparty_name"], first["review_status"], list(first["issues"])) == (123450, 1000, "OUT", "10:11:00", "李四", "AUTO_PASSED", [])
    assert (second["row"], second["account_number"], second["confidence"], second["review_status"]) == (7, "待核验账号-第2页", 0.0, "PENDING") and list(second["issues"]) == ["INVALID_DATE", "INVALID_AMOUNT", "UNKNOWN_DIRECTION"]
    assert [tuple(r) for r in found.accounts.collect()] == [("good", "6222000000001234", "张三", "待核验银行", 2)]
    rejects = {(r["document_id"], r["part"], r["position"], r["reason"]) for r in found.rejects.collect()}
    assert rejects == {
        ("cut", "answer", None, "NOT_A_JSON_OBJECT"), ("list", "answer", None, "NOT_A_JSON_OBJECT"), ("null", "answer", None, "NOT_A_JSON_OBJECT"), ("shape", "transactions", None, "NOT_AN_ARRAY"), ("good", "warnings", None, "NOT_AN_ARRAY"),
        ("good", "accounts", 2, "NO_ACCOUNT_NUMBER"), ("good", "accounts", 3, "NOT_AN_OBJECT"), *[("good", "transactions", i, "NO_PAGE_OF_THE_DOCUMENT") for i in (2, 3, 4)], *[("good", "transactions", i, "NOT_AN_OBJECT") for i in (5, 6, 7)],
    }
    warnings = {(r["document_id"], r["warning"], r["page"], r["count"]) for r in found.warnings.collect()}
    assert warnings == {("good", "PAGE_NEEDS_REVIEW", 1, None), ("good", "COUNT_DIFFERS", None, 1), ("empty", "PAGE_NOT_CHECKED", 1, None), ("empty", "PAGE_NOT_CHECKED", 2, None), ("shape", "PAGE_NOT_CHECKED", 1, None)}
    nothing = extraction_json.read_extraction_json(spark.createDataFrame([], SCHEMA))
    assert nothing.rows.count() == nothing.rejects.count() == nothing.warnings.count() == 0
