"""Column expressions that read money, dates, directions and banks from printed text. No Python runs per row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns
from .identity import text

#: a mark for nothing with white space of any kind around it
EMPTY = r"(?iU)^\s*" + patterns.EMPTY_CELL.removeprefix("^").removesuffix("$") + r"\s*$"
#: a number as most are printed, and all that can be one once white space, commas and currency are gone
NUMBER = r"^[+-]?[0-9]{1,17}(\.[0-9]{1,2})?$"
NUMERIC = r"(?U)^[\s0-9+\-−－.,，￥¥]+$"


def is_empty(c: str | Column) -> Column:
    """Whether a cell is blank or holds one of the marks for nothing."""
    return text(c).rlike(EMPTY)


def _plain(c: str | Column) -> Column:
    """Without white space and the sign of the currency in front; signs and commas in one form."""
    return F.regexp_replace(F.translate(F.regexp_replace(text(c), r"(?U)\s", ""), "−－，", "--,"), "^[￥¥]", "")


def money(c: str | Column, absolute: bool = False) -> Column:
    """STRUCT<state, cents>: state is empty, value or unreadable. Strict: thousands in threes, two decimals at most."""
    s, t = _plain(c), text(c)
    read = lambda number: (number.try_cast("decimal(20,2)") * 100).cast("long")
    plain, numeric = t.rlike(NUMBER), t.rlike(NUMERIC)
    ok = s.rlike(r"^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]{1,2})?$")
    cents = F.when(plain, read(t)).when(numeric & ok, read(F.regexp_replace(s, ",", "")))
    state = F.when(plain, "value").when(is_empty(s), "empty").when(numeric & ok, "value").otherwise("unreadable")
    return F.struct(state.alias("state"), (F.abs(cents) if absolute else cents).alias("cents"))


def money_loose(c: str | Column) -> Column:
    """Cents of a forgiving reading: signs of currency dropped, parentheses are negative, else zero."""
    s = F.translate(F.regexp_replace(text(c), r"(?U)[\s￥¥$]", ""), "－−，．", "--,.")
    inner = F.regexp_replace(s, "[(),（）]", "")
    number = F.regexp_extract(inner, r"^([+-]?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("decimal(20,4)")
    cents = F.round(F.coalesce(number, F.lit(0)) * 100).cast("long")
    return F.when(s.rlike("^[(（].*[)）]$"), -cents).otherwise(cents)


def account_no(c: str | Column) -> Column:
    """The account number of a cell: '' for an empty one; a printed tail; a masked or plain number; letters with digits;
    else the only run of 8 to 32 digits; null if there is none, or several."""
    s = F.regexp_replace(text(c), r"(?U)\s|\\n", "")
    runs = F.regexp_extract_all(s, F.lit("(?<![0-9])([0-9]{8,32})(?![0-9])"), F.lit(1))
    mixed = s.rlike("^[A-Za-z0-9]{8,32}$") & s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    masked = F.regexp_replace(s, "＊", "*")
    return F.when(is_empty(c), "").when(s.rlike("^尾号[0-9]{2,8}$"), s).when(s.rlike("^[0-9*＊xX]{8,32}$"), masked).when(mixed, s).when(F.size(runs) == 1, F.get(runs, F.lit(0)))


def parse_date(c: str | Column) -> Column:
    """A calendar date of this or the last century anywhere in a cell, in several notations or as eight digits; null if there is no such day."""
    s = text(c)
    parts, digits = r"(?<![0-9])(?:19|20)[0-9]{2}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}(?![0-9])", r"(?<![0-9])(?:19|20)[0-9]{6}(?=[0-9]{6}(?![0-9])|\s|$)"
    named = F.translate(F.regexp_extract(s, parts, 0), "/.年月", "----").try_cast("date")
    plain = F.regexp_replace(F.regexp_extract(s, digits, 0), "^(....)(..)(..)$", "$1-$2-$3").try_cast("date")
    # texts without such a year, and those of a bad date with separators, need no other look
    return F.when((F.length(s) >= 8) & s.rlike("(?<![0-9])(?:19|20)[0-9]{2}"), F.coalesce(named, F.when(~s.rlike(parts), plain)))


def parse_time(c: str | Column) -> Column:
    """HH:mm:ss from a clock time or the six digits behind a date; null without one or out of range."""
    s = text(c)
    clock = [F.regexp_extract(s, r"(?:^|[^0-9])([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?", i) for i in (1, 2, 3)]
    digits = [F.regexp_extract(s, r"^(?:[0-9]{8})?([0-9]{2})([0-9]{2})([0-9]{2})$", i) for i in (1, 2, 3)]
    h, m, sec = (F.when(clock[0] != "", a).otherwise(b) for a, b in zip(clock, digits, strict=True))
    ok = (h.try_cast("int") < 24) & (m.try_cast("int") < 60) & (F.when(sec == "", "0").otherwise(sec).try_cast("int") < 60)
    return F.when(ok, F.concat_ws(":", F.lpad(h, 2, "0"), m, F.when(sec == "", "00").otherwise(sec)))


def source_time(c: str | Column) -> Column:
    """HH:mm:ss of a cell: a clock time with seconds anywhere, else six digits alone or behind a date of eight; null without one or from hour 24 on."""
    s = text(c)
    clock = [F.regexp_extract(s, r"(?<![0-9])([0-2]?[0-9]):([0-5][0-9]):([0-5][0-9])(?![0-9])", i) for i in (1, 2, 3)]
    digits = [F.regexp_extract(s, r"(?<![0-9])(?:[0-9]{8})?([0-2][0-9])([0-5][0-9])([0-5][0-9])(?![0-9])", i) for i in (1, 2, 3)]
    h, m, sec = (F.when(clock[0] != "", a).otherwise(b) for a, b in zip(clock, digits, strict=True))
    return F.when(h.try_cast("int") < 24, F.concat_ws(":", F.lpad(h, 2, "0"), m, sec))


def direction(c: str | Column) -> Column:
    """IN or OUT from a printed word, or from the sign of an amount; null otherwise, as for a bank's own codes."""
    s = _plain(c)
    signed = s.rlike("^[+-]") & (money(s)["state"] == "value")
    return F.when(s.isin(*patterns.IN_WORDS), "IN").when(s.isin(*patterns.OUT_WORDS), "OUT").when(signed, F.when(s.startswith("-"), "OUT").otherwise("IN"))


def _named(s: Column, names: Iterable[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(s.rlike(p), name) for p, name in names])


def bank_name(c: str | Column) -> Column:
    """Canonical name of a bank cell; other texts stay."""
    return F.coalesce(_named(text(c), patterns.BANK_CELLS), F.trim(text(c)))


def header_bank(c: str | Column) -> Column:
    """Canonical name of a bank in a printed header: '' for a generic word, other names without their legal form."""
    s = F.regexp_replace(text(c), r"(?U)\s", "")
    found = _named(s, [*((n, n) for n in patterns.BANK_HEADERS), *patterns.BANK_SHORT])
    return F.when(s.rlike(patterns.BANK_GENERIC), "").otherwise(F.coalesce(found, F.regexp_replace(s, patterns.BANK_LEGAL_FORM, "")))


def bank_key(c: str | Column) -> Column:
    """What two forms of a bank's name share: no country, no legal form, no white space."""
    return F.regexp_replace(text(c), r"(?U)中国|股份有限公司|\s", "")


def holder_clean(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), r"(?i)\.(pdf|xlsx?|csv)$", ""), "(银行)?(交易)?流水$", ""))


def normalize_statement_fields(cells: DataFrame) -> DataFrame:
    """Typed fields of a table of printed statement columns, one pass of expressions.

    cells has account, bank, date, direction, amount and balance as text; the result adds typed columns and the
    list of fields that can't be read.
    """
    read = cells.withColumns({"_amount": money("amount", True), "_balance": money("balance"), "transaction_date": parse_date("date"), "transaction_clock": parse_time("date"), "account_number": account_no("account"), "canonical_bank": bank_name("bank"), "flow_direction": F.coalesce(direction("direction"), F.when(_plain("amount").rlike("^-[0-9]"), "OUT"))})
    bad = F.array_compact(F.array(*[F.when(cond, name) for name, cond in (("amount", F.col("_amount.state") == "unreadable"), ("balance", F.col("_balance.state") == "unreadable"), ("date", F.col("transaction_date").isNull()), ("direction", F.col("flow_direction").isNull()), ("account", F.col("account_number").isNull()))]))
    return read.withColumns({"amount_cents": F.col("_amount.cents"), "balance_cents": F.col("_balance.cents"), "unreadable": bad}).drop("_amount", "_balance")


def page_selection(c: str | Column) -> Column:
    """Sorted distinct pages of a selection such as 1-3,5; null if any part can't be read."""
    parts = F.split(F.regexp_replace(text(c), r"(?U)\s", ""), "[,，]")
    ok = F.forall(parts, lambda p: p.rlike("^[1-9][0-9]{0,5}(-[1-9][0-9]{0,5})?$") & (F.get(F.split(p, "-"), F.lit(0)).try_cast("int") <= F.coalesce(F.get(F.split(p, "-"), F.lit(1)), F.get(F.split(p, "-"), F.lit(0))).try_cast("int")))
    pages = F.flatten(F.transform(parts, lambda p: F.sequence(F.get(F.split(p, "-"), F.lit(0)).cast("int"), F.coalesce(F.get(F.split(p, "-"), F.lit(1)), F.get(F.split(p, "-"), F.lit(0))).cast("int"))))
    return F.when(ok, F.array_sort(F.array_distinct(pages)))


def page_ranges(pages: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """Runs of following pages per key, by page minus its rank."""
    from pyspark.sql.window import Window

    island = F.col(page) - F.dense_rank().over(Window.partitionBy(*keys).orderBy(page))
    return pages.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.countDistinct(page).alias("n_pages")).drop("_island")


def printed_cents(cents: str | Column) -> Column:
    """Cents as a statement prints them, without separators: 1234 is 12.34."""
    c = F.col(cents) if isinstance(cents, str) else cents
    size = F.abs(c)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.floor(size / 100).cast("long").cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def mentions(where: str, cents: Column) -> Column:
    """Does the text hold the amount, with two decimals or without trailing zeros?"""
    return F.coalesce(F.contains(F.col(where), F.regexp_replace(printed_cents(cents), r"\.?0+$", "")), F.lit(False))
