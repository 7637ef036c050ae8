"""Column expressions on account numbers, names and counterparties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def text(c: str | Column) -> Column:
    """The column, empty where null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def joined(*names: str) -> Column:
    """Texts with a blank between them, nulls as empty texts."""
    return F.concat_ws(" ", *[text(n) for n in names])


def norm_part(c: str | Column) -> Column:
    """Without blanks, dashes and dots, lower-case: what account numbers and names are compared by."""
    return F.lower(F.regexp_replace(text(c), r"(?U)[\s\-_—–·•]", ""))


def is_reliable_account(c: str | Column) -> Column:
    """Eight characters or more, no national id, no placeholder."""
    return is_reliable_number(norm_part(c))


def is_reliable_number(n: Column) -> Column:
    """The same of a number that norm_part has made."""
    return (F.length(n) >= 8) & ~n.rlike(P.NATIONAL_ID) & ~n.rlike(P.PLACEHOLDER_ACCOUNT)


def account_key(number: str, bank: str, document: str, file: str) -> Column:
    """Key of an account: by document and number, by number, or unverified by bank, number and file."""
    n = norm_part(number)
    has_document = text(document) != ""
    return (
        F.when(is_reliable_account(number) & has_document, F.concat_ws("|", F.lit("source-account"), F.col(document), n))
        .when(is_reliable_account(number), F.concat_ws("|", F.lit("account"), n))
        .otherwise(F.concat_ws("|", F.lit("unverified"), norm_part(bank), n, norm_part(file)))
    )


def is_fee_waiver(kind: str, *names: str) -> Column:
    return (text(kind) == "费用减免") | joined(*names).rlike(P.FEE_WAIVER)


def is_judicial_deduction(direction: str = "direction", kind: str = "transaction_type", summary: str = "summary", raw: str = "raw_text") -> Column:
    return (F.col(direction) == "OUT") & ((text(kind) == "司法扣划") | joined(summary, raw).rlike(P.JUDICIAL))


def effective_counterparty(name: str = "counterparty_name", kind: str = "transaction_type", summary: str = "summary", raw: str = "raw_text") -> Column:
    """The party's name, or a placeholder that says why there is none."""
    own, context = F.trim(text(name)), joined(kind, summary, raw)
    return (
        F.when(context.rlike(P.JUDICIAL) & ((own == "") | own.rlike(P.JUDICIAL_PARTY)), P.JUDICIAL_NAME)
        .when(own != "", own)
        .when(context.rlike(P.CASH_CONTEXT), P.CASH_NAME)
        .otherwise(P.UNKNOWN_NAME)
    )


def counterparty_key(name: Column, account: str = "counterparty_account", bank: str = "counterparty_bank", own_bank: str = "bank_name", document: str = "source_document_id", row: str = "id") -> Column:
    """A whole account number identifies a party across names; else a local identifier, else the name, else the row."""
    number = F.regexp_replace(text(account), r"(?U)\s", "")
    known = F.when(name.rlike(P.UNKNOWN_PARTY), "").otherwise(name)
    return (
        F.when(number.rlike("^[0-9]{12,32}$") & ~number.rlike("^0+$"), F.concat(F.lit("account:"), number))
        .when(number != "", F.to_json(F.array(F.lit("local-identifier"), F.coalesce(F.when(text(bank) != "", F.col(bank)), text(own_bank)), number, known)))
        .when(known != "", known)
        .otherwise(F.concat_ws(":", F.lit("unknown"), F.col(document), F.col(row)))
    )


def ocr_digit_variant(a: str | Column, b: str | Column) -> Column:
    """Equally long and at most one character apart."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    apart = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (F.length(a) == F.length(b)) & (apart <= 1)


def account_alias_suffix(a: str | Column, b: str | Column) -> Column:
    """Both all digits, the shorter of ten digits or more, and the longer ends with it after one to four more."""
    a, b = norm_part(a), norm_part(b)
    longer, shorter = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    extra = F.length(longer) - F.length(shorter)
    return (a == b) | (a.rlike("^[0-9]+$") & b.rlike("^[0-9]+$") & (F.length(shorter) >= 10) & extra.between(1, 4) & F.endswith(longer, shorter))


def bounded_edit_distance(a: str | Column, b: str | Column, most: int = 2) -> Column:
    return F.levenshtein(a, b, most) >= 0
