"""Statement rows from the JSON that a model answers for a document: accounts, rows, page checks, and what is wrong with them.

Answers are parsed in two steps, the object and then each array's elements one by one, so a broken element costs itself
only. Everything that isn't read is in the rejects, with the reason. Keys have a short and a long form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.identity import is_reliable_account, text
from ..functions.money import money, parse_date, parse_time
from ..plans.storage import written

DOC = "document_id"
PARTS = ("accounts", "transactions", "pageChecks", "warnings")


@dataclass(frozen=True)
class Extraction:
    """rows: (document_id, page, row, position, account_number, account_name, bank_name, transaction_date, transaction_clock,
    direction, amount_cents, balance_cents, counterparty_name, counterparty_account, counterparty_bank, summary, raw_text,
    confidence, issues, review_status). accounts: (document_id, account_number, account_name, bank_name, page). warnings:
    (document_id, warning, page, count). rejects: (document_id, part, position, reason)."""

    rows: DataFrame
    accounts: DataFrame
    warnings: DataFrame
    rejects: DataFrame


def _value(*keys: str) -> Column:
    """The first of the keys that the element has with a value, trimmed; null without one."""
    return F.trim(F.coalesce(*[F.try_element_at("e", F.lit(k)) for k in keys]))


def _number(*keys: str) -> Column:
    """A positive whole number, or null."""
    n = _value(*keys).try_cast("decimal(20,4)")
    return F.when((n > 0) & (n == F.floor(n)) & (n < 2**31), n).cast("int")


def _elements(parsed: DataFrame, part: str) -> DataFrame:
    """(document_id, total_pages, position, raw, e) of a part's array; e is null where an element is no object."""
    each = parsed.where(F.col(part).startswith("[")).select(DOC, "total_pages", "respondent", F.posexplode(F.from_json(part, "array<string>")).alias("position", "raw"))
    return each.withColumn("e", F.when(F.trim("raw").startswith("{"), F.from_json("raw", "map<string,string>")))


def read_extraction_json(answers: DataFrame) -> Extraction:
    """answers: (document_id, total_pages, respondent, answer), one row for a document.

    An answer that is no JSON object, or whose parts are no arrays, is rejected as a whole or in that part; missing parts
    are empty. A row needs a page of the document; without a useful account number it gets its page's placeholder. Dates,
    amounts and directions that can't be read stay null or UNKNOWN and are issues; a row with issues or a confidence
    below 0.8 (0.65 where none is given) waits for review. Accounts count once, by number. Warnings say which pages
    weren't checked or need review, and where the checks' count isn't the rows'.
    """
    answer = F.trim(text("answer"))
    top = F.from_json(answer, ", ".join(f"{p} string" for p in PARTS) + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    parsed = answers.select(DOC, "total_pages", "respondent", top.alias("t"), answer.startswith("{").alias("_object")).select(DOC, "total_pages", "respondent", "_object", F.col("t._bad").alias("_bad"), *[F.trim(F.col(f"t.{p}")).alias(p) for p in PARTS])
    parsed = written(parsed.withColumn("_ok", F.col("_object") & F.col("_bad").isNull()), "answers")
    good = parsed.where("_ok")
    nothing = F.lit(None).cast("int").alias("position")
    rejects = parsed.where("not _ok").select(DOC, F.lit("answer").alias("part"), nothing, F.lit("NOT_A_JSON_OBJECT").alias("reason"))
    shapes = F.explode(F.array_compact(F.array(*[F.when(F.col(p).isNotNull() & ~F.col(p).startswith("["), F.lit(p)) for p in PARTS]))).alias("part")
    rejects = rejects.unionByName(good.select(DOC, shapes, nothing, F.lit("NOT_AN_ARRAY").alias("reason")))
    given = {p: written(_elements(good, p), f"answer-{p}") for p in ("accounts", "transactions", "pageChecks")}
    for part, df in given.items():
        rejects = rejects.unionByName(df.where("e is null").select(DOC, F.lit(part).alias("part"), "position", F.lit("NOT_AN_OBJECT").alias("reason")))
    number = lambda *keys: F.regexp_replace(text(_value(*keys)), r"(?U)\s", "")
    blank = lambda c: F.when(text(c) != "", c)
    known_bank = lambda c: F.when(~((text(c) == "") | text(c).rlike(P.UNKNOWN_BANK)), c)
    named = F.coalesce(blank(_value("holder", "accountName")), blank(F.col("respondent")), F.lit(P.HOLDER_TO_CONFIRM))
    bank = F.coalesce(known_bank(_value("bk", "bankName")), F.lit(P.BANK_TO_CONFIRM))
    listed = given["accounts"].where("e is not null").select(DOC, "position", number("ac", "accountNumber").alias("account_number"), named.alias("account_name"), bank.alias("bank_name"), F.coalesce(_number("p", "page"), F.lit(1)).alias("page"))
    rejects = rejects.unionByName(listed.where(~is_reliable_account("account_number")).select(DOC, F.lit("accounts").alias("part"), "position", F.lit("NO_ACCOUNT_NUMBER").alias("reason")))
    accounts = listed.where(is_reliable_account("account_number")).groupBy(DOC, "account_number").agg(F.min_by(F.struct("account_name", "bank_name", "page"), "position").alias("a")).select(DOC, "account_number", "a.account_name", "a.bank_name", "a.page")
    page = _number("p", "page", "rawPageNumber")
    lines = given["transactions"].where("e is not null").withColumn("page", page)
    here = F.coalesce(F.col("page") <= F.col("total_pages"), F.lit(False))
    rejects = rejects.unionByName(lines.where(~here).select(DOC, F.lit("transactions").alias("part"), "position", F.lit("NO_PAGE_OF_THE_DOCUMENT").alias("reason")))
    stamp, amount, balance = text(_value("tm", "transactionTime")), money(_value("amt", "amount")), money(_value("bal", "balance"))
    said = F.upper(text(_value("dir", "direction")))
    sure = _value("cf", "confidence")
    part = sure.try_cast("double")
    confidence = F.when(sure == "", 0.0).when(part.isNull() | F.isnan(part), 0.65).otherwise(F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)))
    typed = lines.where(here).select(
        DOC, "page", F.coalesce(_number("r", "row", "rawRowIndex"), F.col("position") + 1).alias("row"), "position", number("ac", "accountNumber").alias("_number"), named.alias("account_name"), bank.alias("bank_name"),
        parse_date(stamp).alias("transaction_date"), parse_time(stamp).alias("transaction_clock"), F.when(said.isin("IN", "OUT"), said).otherwise("UNKNOWN").alias("direction"), F.abs(amount["cents"]).alias("amount_cents"), balance["cents"].alias("balance_cents"),
        text(_value("cp", "counterpartyName")).alias("counterparty_name"), blank(number("ca", "counterpartyAccount")).alias("counterparty_account"), blank(_value("cb", "counterpartyBank")).alias("counterparty_bank"), text(_value("sm", "summary")).alias("summary"), text(_value("src", "rawText")).alias("raw_text"), confidence.alias("confidence"),
    )
    issues = F.array_compact(F.array(F.when(F.col("transaction_date").isNull(), "INVALID_DATE"), F.when(F.col("amount_cents").isNull(), "INVALID_AMOUNT"), F.when(F.col("direction") == "UNKNOWN", "UNKNOWN_DIRECTION")))
    own = F.when(is_reliable_account("_number"), F.col("_number")).otherwise(F.concat(F.lit(P.ACCOUNT_TO_CONFIRM), F.col("page").cast("string"), F.lit("页")))
    rows = typed.withColumns({"issues": issues, "account_number": own}).withColumn("review_status", F.when((F.size("issues") > 0) | (F.col("confidence") < 0.8), "PENDING").otherwise("AUTO_PASSED"))
    rows = written(rows.select(DOC, "page", "row", "position", "account_number", *[c for c in typed.columns[5:]], "issues", "review_status"), "answer-rows")
    checks = given["pageChecks"].where("e is not null").withColumn("page", _number("p", "page")).where(here)
    checks = written(checks.select(DOC, "page", F.greatest(F.coalesce(_value("extracted", "transactionCount").try_cast("int"), F.lit(0)), F.lit(0)).alias("n"), F.upper(text(_value("status"))).alias("status")), "answer-checks")
    none = F.lit(None).cast("long").alias("count")
    expected = good.select(DOC, F.explode(F.sequence(F.lit(1), "total_pages")).alias("page"))
    unchecked = expected.join(checks.select(DOC, "page").distinct(), [DOC, "page"], "left_anti").select(DOC, F.lit("PAGE_NOT_CHECKED").alias("warning"), "page", none)
    review = checks.where("status = 'NEEDS_REVIEW'").select(DOC, F.lit("PAGE_NEEDS_REVIEW").alias("warning"), "page", none).distinct()
    counts = good.select(DOC).join(checks.groupBy(DOC).agg(F.sum("n").alias("_said")), DOC, "left").join(rows.groupBy(DOC).agg(F.count("*").alias("_got")), DOC, "left").fillna(0, ["_said", "_got"])
    differs = counts.where("_said <> _got").select(DOC, F.lit("COUNT_DIFFERS").alias("warning"), F.lit(None).cast("int").alias("page"), (F.col("_said") - F.col("_got")).alias("count"))
    return Extraction(rows, accounts, unchecked.unionByName(review).unionByName(differs), written(rejects, "answer-rejects"))
