"""Column expressions on printed descriptions, purposes, parties and times of statement rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns
from .identity import text


def semantic_text(c: str | Column) -> Column:
    """Without white space and written-out line breaks: wrapping is not part of a meaning."""
    return F.regexp_replace(text(c), r"(?U)\\n|\s", "")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _any_like(texts: Column, pattern: str) -> Column:
    return F.exists(texts, lambda x: x.rlike(pattern))


def _side(direction: Column, kind: Column, ways: str, account_kind: str) -> list[Column]:
    return [direction.isin(*ways.split())] * bool(ways) + [kind == account_kind] * bool(account_kind)


def printed_type(description: Column, evidence: Column, direction: Column, kind: Column, party_account: Column) -> Column:
    """STRUCT<type, basis, review> of what is printed, null if nothing decides: the purpose comes before the mechanism.

    evidence is an array of texts. A repayment of a kind that the texts leave open has an empty type, or stays a
    purchase, and needs review.
    """
    summary = semantic_text(description)
    pieces = F.transform(F.coalesce(evidence, F.array().cast("array<string>")), lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\\n|\s", ""))
    cases = []
    for kind_of, basis, ways, account_kind, described, proofs, numbered in patterns.PRINTED_RULES:
        holds = _side(direction, kind, ways, account_kind) + [summary.rlike(described)] * bool(described)
        holds += [_any_like(pieces, p) for p in proofs] + [text(party_account).rlike(patterns.PARTY_NUMBER)] * numbered
        open_kind = basis == "PRINTED_REPAYMENT_KIND_UNRESOLVED"
        holds += [~summary.rlike(patterns.KNOWN_REPAYMENT)] * open_kind
        cases.append(F.when(_all(holds), F.struct(F.lit(kind_of).alias("type"), F.lit(basis).alias("basis"), F.lit(open_kind).alias("review"))))
    return F.coalesce(*cases)


def described_type(description: Column, direction: Column, kind: Column, party: Column) -> Column:
    """Type by the description alone; null if it has no fixed meaning. Of several rules that hold, the last decides."""
    summary = semantic_text(description)
    purchase = F.when(summary.rlike(patterns.PURCHASE) & ~summary.rlike(patterns.NO_PURCHASE), "消费")
    rules = [F.when(_all(_side(direction, kind, ways, k) + [summary.rlike(d)] * bool(d) + [semantic_text(party).rlike(p)] * bool(p)), t) for t, ways, k, d, p in patterns.DESCRIPTION_RULES]
    words = F.create_map(*[F.lit(x) for pair in patterns.DESCRIBED_TYPES for x in pair])
    return F.coalesce(purchase, *reversed(rules), F.try_element_at(words, summary))


def transaction_type(described: Column, printed: Column) -> Column:
    """The printed purpose over the description, unless it only asks for review and names no type."""
    unsure = printed["review"] & (printed["type"] == "") & described.isNotNull()
    return F.when(printed.isNotNull() & ~unsure, printed["type"]).otherwise(described)


def merchant_type(label: Column, direction: Column, kind: Column, known: Column) -> Column:
    """Type by a whole label in the merchant column of a deposit account's row that has no type yet; null otherwise."""
    s = semantic_text(label)
    cases = F.coalesce(*[F.when((direction == way) & s.rlike(p), t) for t, way, p in patterns.MERCHANT_LABELS])
    return F.when((text(known) == "") & (kind == "deposit"), cases)


def split_party(c: str | Column) -> Column:
    """STRUCT<account, name> of a cell that holds both: parts at a slash or bar, else at a line break.

    '' is a part that isn't there; the whole is null if the cell doesn't say which part is which.
    """
    whole = text(c)
    number = r"^[0-9*＊xX]{8,32}$"
    bare = F.regexp_replace(whole, r"(?U)\s", "")
    cut = F.when(whole.rlike("[/／|｜]"), F.split(whole, "[/／|｜]", -1)).otherwise(F.split(whole, r"(?:\r?\n|\\n)+", -1))
    parts = F.transform(cut, lambda x: F.regexp_replace(x, r"(?U)^(?:\s|\\n)+|(?:\s|\\n)+$", ""))
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    account = lambda x: F.regexp_replace(x, r"(?U)\s|\\n", "").rlike(number)
    other = lambda x: ~account(x) & ((x == "") | ~x.rlike(r"(?U)^[0-9\s*＊]+$"))
    both = lambda x, y: F.struct(x.alias("account"), y.alias("name"))
    return (
        F.when((F.trim(bare) == "") | bare.rlike("^(?:--?|—|无)$"), both(F.lit(""), F.lit("")))
        .when(bare.rlike(number), both(whole, F.lit("")))
        .when((F.size(parts) == 2) & account(a) & other(b), both(a, b))
        .when((F.size(parts) == 2) & account(b) & other(a), both(b, a))
    )


def time_of_day(c: str | Column) -> Column:
    """HH:mm or HH:mm:ss in a text, '' without one."""
    return F.regexp_extract(text(c), "([0-9]{2}:[0-9]{2}(?::[0-9]{2})?)", 1)


def times_compatible(a: Column, b: Column) -> Column:
    """Whether two times of day can be one: equal as far as both go, or one missing."""
    n = F.least(F.length(a), F.length(b))
    return (F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n)) | (n == 0)


def norm_timestamp(day: str | Column, clock: str | Column) -> Column:
    """Text that sorts by time: a missing date comes last, a missing time is midnight, unknown notations stay."""
    d, t = F.trim(text(day)), F.trim(text(clock))
    date = F.when(d.rlike("^[0-9]{4}/[0-9]{2}/[0-9]{2}$"), F.replace(d, F.lit("/"), F.lit("-"))).when(d.rlike("^[0-9]{8}$"), F.regexp_replace(d, "^(....)(..)(..)$", "$1-$2-$3")).when(d == "", "9999-99-99").otherwise(d)
    time = F.when(t.contains(":"), F.element_at(F.split(t, " ", -1), -1)).when(t.rlike("^[0-9]{6}$"), F.regexp_replace(t, "^(..)(..)(..)$", "$1:$2:$3")).when(t == "", "00:00:00").otherwise(t)
    return F.trim(F.concat(date, F.lit(" "), time))


def days_between(a: Column, b: Column) -> Column:
    """Calendar days between two texts of dates; 0 if either can't be read."""
    return F.coalesce(F.abs(F.datediff(F.to_date(F.try_to_timestamp(a, F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(b, F.lit("yyyy-MM-dd"))))), F.lit(0))
