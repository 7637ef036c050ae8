"""Operators on the order of a statement's rows: orientation, chronology, balance checks and repairs.

All are windows over one account of one document. Only settlement years, which follow dates that were just repaired,
are scanned in Python, in sorted chains with one date of state.
"""

from __future__ import annotations

import datetime as dt
from calendar import isleap
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.identity import is_fee_waiver, joined, ocr_digit_variant, text
from ..functions.money import mentions, printed_cents

ACCOUNT = ("case_id", "source_document_id", "account_number")
PRINTED = ("page", "row_index", "seq")


def printed_order(*extra: str) -> Window:
    return Window.partitionBy(*ACCOUNT, *extra).orderBy(*PRINTED)


def signed(amount: str = "amount_cents", direction: str = "direction") -> Column:
    """What a row adds to the balance; null if its direction is unknown."""
    return F.when(F.col(direction) == "IN", F.col(amount)).when(F.col(direction) == "OUT", -F.col(amount))


def statement_orientation(txn: DataFrame) -> DataFrame:
    """Per account of a document: pairs of neighbouring rows with rising and falling dates; reversed if more fall."""
    before = F.lag("transaction_date").over(printed_order())
    pairs = txn.withColumn("_before", before)
    counts = pairs.groupBy(*ACCOUNT).agg(F.count_if(F.col("_before") < F.col("transaction_date")).alias("forward_pairs"), F.count_if(F.col("_before") > F.col("transaction_date")).alias("reverse_pairs"))
    return counts.withColumn("is_reversed", F.col("reverse_pairs") > F.col("forward_pairs"))


def physical_rank(txn: DataFrame) -> DataFrame:
    """txn with physical_rank: printed order, from the end if the statement is reversed."""
    flagged = txn.join(statement_orientation(txn).select(*ACCOUNT, "is_reversed"), list(ACCOUNT))
    number = F.row_number().over(printed_order())
    size = F.count("*").over(Window.partitionBy(*ACCOUNT))
    return flagged.withColumn("physical_rank", F.when(F.col("is_reversed"), size - number + 1).otherwise(number)).drop("is_reversed")


def _break_counts(txn: DataFrame, rank: str) -> DataFrame:
    """Per account: comparable neighbours in an order whose balances fit, and that don't (by a unit or more)."""
    order = Window.partitionBy(*ACCOUNT).orderBy(rank)
    off = F.abs(F.lag("balance_cents").over(order) + signed() - F.col("balance_cents"))
    rows = txn.withColumn("_off", off)
    return rows.groupBy(*ACCOUNT).agg(F.count_if(F.col("_off") < 100).alias("fit"), F.count_if(F.col("_off") >= 100).alias("broken"))


def chronological_rank(txn: DataFrame) -> DataFrame:
    """txn with chrono_rank: days ascending, each day forward or backward, whichever fits the balances better.

    Windows give each day one struct for either direction: the sum of errors inside the day and their number, the
    first comparable row, and the balance it ends with. A fold per account carries the balance from day to day and
    chooses. In the end printed order stands if it breaks less often.
    """
    day = Window.partitionBy(*ACCOUNT, "transaction_date")
    inside = day.orderBy("seq")
    rows = txn.withColumn("_usable", F.col("balance_cents").isNotNull() & F.col("direction").isin("IN", "OUT"))
    rows = rows.withColumn("_n", F.row_number().over(inside)).withColumn("_delta", signed())
    usable = F.when(F.col("_usable"), F.col("balance_cents"))
    off = lambda w: F.abs(F.last(usable, True).over(w) + F.col("_delta") - F.col("balance_cents"))
    error = lambda w: F.when(F.col("_usable") & off(w).isNotNull(), F.least(off(w), F.lit(100_000_000)))
    forward, backward = inside.rowsBetween(Window.unboundedPreceding, -1), day.orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_ef": error(forward), "_eb": error(backward)})
    some = F.col("balance_cents").isNotNull()
    days = rows.groupBy(*ACCOUNT, "transaction_date").agg(
        F.count("*").alias("k"), F.coalesce(F.sum("_ef"), F.lit(0)).alias("ef"), F.count("_ef").alias("nf"), F.coalesce(F.sum("_eb"), F.lit(0)).alias("eb"), F.count("_eb").alias("nb"),
        F.min_by(F.struct(F.col("balance_cents").alias("b"), F.col("_delta").alias("d")), F.when(F.col("_usable"), F.col("_n"))).alias("first"),
        F.max_by(F.struct(F.col("balance_cents").alias("b"), F.col("_delta").alias("d")), F.when(F.col("_usable"), F.col("_n"))).alias("last"),
        F.max_by("balance_cents", F.when(some, F.col("_n"))).alias("end_f"), F.min_by("balance_cents", F.when(some, F.col("_n"))).alias("end_b"),
    )
    ordered = days.groupBy(*ACCOUNT).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("transaction_date", F.lit("9999-12-31").cast("date")).alias("day"), "k", "ef", "nf", "eb", "nb", "first", "last", "end_f", "end_b"))).alias("days"))
    step = """
      aggregate(days, named_struct('balance', cast(null as bigint), 'back', filter(array(cast(null as date)), d -> d is not null)), (s, x) ->
        named_struct(
          'balance', coalesce(if({back}, x.end_b, x.end_f), s.balance),
          'back', if({back}, array_append(s.back, x.day), s.back)))"""
    mean = lambda e, n, at: f"coalesce((x.{e} + if(s.balance is null or x.{at} is null, 0, least(abs(s.balance + x.{at}.d - x.{at}.b), 100000000))) / nullif(x.{n} + if(s.balance is not null and x.{at} is not null, 1, 0), 0), 0)"
    back = f"(x.k > 1 and {mean('eb', 'nb', 'last')} + 1 < {mean('ef', 'nf', 'first')})"
    chosen = ordered.select(*ACCOUNT, F.expr(step.format(back=back))["back"].alias("back"))
    placed = rows.join(chosen, list(ACCOUNT)).withColumn("_day", F.coalesce("transaction_date", F.lit("9999-12-31").cast("date")))
    turned = F.when(F.array_contains("back", F.col("_day")), -F.col("seq")).otherwise(F.col("seq"))
    dated = placed.withColumn("_turn", turned).withColumn("dated_rank", F.row_number().over(Window.partitionBy(*ACCOUNT).orderBy("_day", "_turn")))
    dated = physical_rank(dated.select(*txn.columns, "dated_rank"))
    printed = _break_counts(dated, "physical_rank").withColumnsRenamed({"fit": "pf", "broken": "pb"})
    by_date = _break_counts(dated, "dated_rank").withColumnsRenamed({"fit": "df", "broken": "db"})
    prefer = (F.col("pb") < F.col("db")) | ((F.col("pf") > 0) & (F.col("pb") == 0) & (F.col("db") > 0))
    return dated.join(printed, list(ACCOUNT)).join(by_date, list(ACCOUNT)).withColumn("chrono_rank", F.when(prefer, F.col("physical_rank")).otherwise(F.col("dated_rank"))).select(*txn.columns, "chrono_rank")


def balance_breaks(ranked: DataFrame, rank: str = "chrono_rank") -> DataFrame:
    """Rows whose balance isn't the one before plus their amount, with the expected balance and the days between."""
    order = Window.partitionBy(*ACCOUNT).orderBy(rank)
    rows = ranked.withColumn("expected_cents", F.lag("balance_cents").over(order) + signed()).withColumn("days_apart", F.abs(F.datediff("transaction_date", F.lag("transaction_date").over(order))))
    found = rows.where(F.col("expected_cents") != F.col("balance_cents"))
    return found.select("case_id", "id", "expected_cents", "balance_cents", "days_apart", (F.coalesce("days_apart", F.lit(0)) > 30).alias("long_interval"))


def printed_balance_checks(txn: DataFrame) -> DataFrame:
    """Breaks between printed neighbours of tables whose dates run one way: four field issues for each.

    Neighbours are rows whose row numbers follow one another on a page.
    """
    table = Window.partitionBy(*ACCOUNT, "page").orderBy("row_index", "seq")
    rows = txn.withColumns({"_pd": F.lag("transaction_date").over(table), "_pr": F.lag("row_index").over(table), "_pb": F.lag("balance_cents").over(table)})
    ways = rows.groupBy(*ACCOUNT, "page").agg(F.array_remove(F.collect_set(F.signum(F.datediff("transaction_date", "_pd"))), F.lit(0.0)).alias("_ways"))
    rows = rows.join(ways.where(F.size("_ways") == 1), [*ACCOUNT, "page"])
    up = F.element_at("_ways", 1) > 0
    order_end = F.when(up, F.col("_pb") + signed() - F.col("balance_cents"))
    following = Window.partitionBy(*ACCOUNT, "page").orderBy("row_index", "seq")
    down = F.col("_pb") - (F.col("balance_cents") + F.lag(signed()).over(following))
    off = F.when(up, order_end).otherwise(down)
    bad = rows.withColumn("_off", off).where((F.col("row_index") - F.col("_pr") == 1) & (F.col("_off") != 0))
    return bad.select("case_id", "id", F.explode(F.array(*[F.lit(x) for x in ("direction", "amount", "balance", "date")])).alias("field"), F.col("_off").alias("off_cents"))


def calibrated_directions(txn: DataFrame) -> DataFrame:
    """Rows whose direction the neighbouring balances contradict: only the other one fits, to four cents."""
    ranked = physical_rank(txn)
    order = Window.partitionBy(*ACCOUNT).orderBy("physical_rank")
    before = F.lag("balance_cents").over(order)
    rows = ranked.withColumns({"_in": F.abs(before + F.col("amount_cents") - F.col("balance_cents")), "_out": F.abs(before - F.col("amount_cents") - F.col("balance_cents"))})
    right = F.when((F.col("_in") <= 4) & (F.col("_out") > 4), "IN").when((F.col("_out") <= 4) & (F.col("_in") > 4), "OUT")
    return rows.withColumn("calibrated", right).where((F.col("amount_cents") > 0) & (F.col("calibrated") != F.col("direction"))).select("case_id", "id", "direction", "calibrated")


def page_direction_flip(txn: DataFrame) -> DataFrame:
    """Per page: how many comparisons fit as printed and with directions swapped; flip if swapping clearly fits."""
    order = printed_order("page")
    before = F.lag("balance_cents").over(order)
    rows = txn.withColumns({"_direct": F.abs(before + signed() - F.col("balance_cents")), "_flipped": F.abs(before - signed() - F.col("balance_cents"))})
    pages = rows.groupBy(*ACCOUNT, "page").agg(F.count("_direct").alias("comparisons"), F.count_if(F.col("_direct") <= 1).alias("direct"), F.count_if(F.col("_flipped") <= 1).alias("flipped"))
    flip = (F.col("comparisons") >= 2) & (F.col("flipped") >= 0.65 * F.col("comparisons")) & (F.col("direct") <= 0.25 * F.col("comparisons"))
    return pages.withColumn("flip", flip)


def missing_directions(txn: DataFrame) -> DataFrame:
    """Rows of unknown direction with the one that the change of the balance, else the summary, suggests."""
    order = printed_order()
    change = F.col("balance_cents") - F.lag("balance_cents").over(order)
    slack = F.greatest(F.lit(2.0), F.col("amount_cents") * 0.002)
    by_balance = F.when(F.abs(change - F.col("amount_cents")) <= slack, "IN").when(F.abs(change + F.col("amount_cents")) <= slack, "OUT")
    by_words = F.when(text("summary").rlike(P.SUMMARY_OUT), "OUT").when(text("summary").rlike(P.SUMMARY_IN), "IN")
    rows = txn.withColumn("suggested", F.coalesce(by_balance, by_words, F.lit("UNKNOWN")))
    return rows.where("direction = 'UNKNOWN'").select("case_id", "id", "suggested")


def outlier_years(txn: DataFrame) -> DataFrame:
    """Rows whose year lies more than two outside the span of the account's other rows, if these span three at most.

    A histogram of years per account is enough: taking a row away only matters where its year occurs once.
    """
    years = txn.where("transaction_date is not null").groupBy(*ACCOUNT, F.year("transaction_date").alias("y")).agg(F.count("*").alias("n"))
    spans = years.groupBy(*ACCOUNT).agg(F.sum("n").alias("_rows"), F.array_sort(F.collect_list(F.struct("y", "n"))).alias("_years"))
    rows = txn.join(spans.where("_rows >= 5"), list(ACCOUNT)).withColumn("_y", F.year("transaction_date"))
    rows = rows.withColumn("_peers", F.expr("transform(filter(_years, x -> x.y <> _y or x.n > 1), x -> x.y)"))
    rows = rows.withColumns({"peer_min": F.array_min("_peers"), "peer_max": F.array_max("_peers")})
    out = rows.where((F.col("peer_max") - F.col("peer_min") <= 3) & ((F.col("_y") < F.col("peer_min") - 2) | (F.col("_y") > F.col("peer_max") + 2)))
    near = F.when(F.col("_y") < F.col("peer_min"), F.col("peer_min")).otherwise(F.col("peer_max"))
    return out.select("case_id", "id", "transaction_date", "peer_min", "peer_max", F.try_make_timestamp(near, F.month("transaction_date"), F.dayofmonth("transaction_date"), F.lit(0), F.lit(0), F.lit(0)).cast("date").alias("repaired_date"))


def restored_dates(txn: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Rows whose raw text prints the same month and day in a year two or more away, and not the row's own date."""
    printed = F.expr(f"regexp_extract_all(concat(' ', coalesce({raw}, ''), ' '), '(?<![0-9])(20[0-9]{{6}})(?![0-9])', 1)")
    dates = F.filter(F.transform(printed, lambda x: F.try_to_timestamp(x, F.lit("yyyyMMdd")).cast("date")), lambda d: d.isNotNull())
    rows = txn.withColumn("_dates", dates).where(~F.array_contains("_dates", F.col("transaction_date")))
    rows = rows.withColumn("printed_date", F.expr("get(filter(_dates, d -> date_format(d, 'MM-dd') = date_format(transaction_date, 'MM-dd')), 0)"))
    return rows.where(F.abs(F.year("printed_date") - F.year("transaction_date")) >= 2).select("case_id", "id", "transaction_date", "printed_date")


def zero_settlements(txn: DataFrame) -> DataFrame:
    """Rows without amount: a fee waiver, or a settlement next to a row with the same balance, is confirmed."""
    order = printed_order()
    same = (F.lag("balance_cents").over(order) == F.col("balance_cents")) | (F.lead("balance_cents").over(order) == F.col("balance_cents"))
    settled = joined("transaction_type", "summary", "counterparty_name", "raw_text").rlike(P.SETTLEMENT) & F.coalesce(same, F.lit(False))
    rows = txn.withColumn("confirmed", is_fee_waiver("transaction_type", "summary", "counterparty_name", "raw_text") | settled)
    return rows.where("amount_cents = 0").select("case_id", "id", "confirmed")


def credit_card_ledgers(txn: DataFrame) -> DataFrame:
    """Per account: is it a credit card's? By words, or by negative balances together with card rows."""
    words = joined("bank_name", "summary", "counterparty_name", "raw_text").rlike("信用卡|贷记卡|牡丹卡")
    card = text("transaction_type").isin("透支利息", "分期", "分期转换", "分期退款", "违约金") | joined("summary", "counterparty_name", "raw_text").rlike("透支|年费|自动转[账帐]还款|分期付款|消费转分期|分期利息|分期费用")
    groups = txn.groupBy(*ACCOUNT).agg(F.bool_or(words).alias("_w"), F.count_if(card).alias("_c"), F.count("balance_cents").alias("_b"), F.count_if(F.col("balance_cents") < 0).alias("_neg"), F.count("*").alias("_n"))
    return groups.select(*ACCOUNT, (F.col("_w") | ((F.col("_b") > 0) & (F.col("_neg") >= F.ceil(F.col("_b") / 2)) & (F.col("_c") >= F.least(F.lit(2), F.col("_n"))))).alias("is_credit_card"))


def account_audit(ranked: DataFrame, rank: str = "chrono_rank") -> DataFrame:
    """Per account: does the first balance plus everything in, less everything out, give the last? Ranked rows in.

    Accounts without a balance and credit cards can't be audited.
    """
    known = F.col("balance_cents").isNotNull()
    at = F.when(known, F.col(rank))
    first = F.min_by(F.struct("balance_cents", signed().alias("d")), at)
    groups = ranked.groupBy(*ACCOUNT).agg(
        F.sum(F.when(F.col("direction") == "IN", F.col("amount_cents")).otherwise(0)).alias("in_cents"), F.sum(F.when(F.col("direction") == "OUT", F.col("amount_cents")).otherwise(0)).alias("out_cents"),
        first.alias("_first"), F.max_by("balance_cents", at).alias("end_cents"), F.count_if((F.col("direction") == "UNKNOWN") | (F.col("amount_cents") <= 0)).alias("suspicious_rows"),
    ).join(credit_card_ledgers(ranked), list(ACCOUNT))
    start = F.col("_first.balance_cents") - F.coalesce(F.col("_first.d"), F.lit(0))
    out = groups.withColumn("start_cents", start).withColumn("calculated_end_cents", F.col("start_cents") + F.col("in_cents") - F.col("out_cents"))
    auditable = F.col("end_cents").isNotNull() & ~F.col("is_credit_card")
    return out.select(*ACCOUNT, "in_cents", "out_cents", "start_cents", "end_cents", "calculated_end_cents", "suspicious_rows", auditable.alias("is_auditable"), (auditable & (F.col("calculated_end_cents") == F.col("end_cents"))).alias("is_balanced"))


def installment_sequences(txn: DataFrame) -> DataFrame:
    """Conversion (IN), purchase (OUT), fee or interest (OUT) of one day, in consecutive rows of a credit account.

    Returned are the rows that a conversion to instalments explains, with their part: conversion, purchase, and the
    third row only where it is interest.
    """
    order = Window.partitionBy("case_id", "source_document_id").orderBy(*PRINTED)
    at = lambda c, n: F.lead(c, n).over(order)
    same = reduce(lambda x, y: x & y, [at(c, n).eqNullSafe(F.col(c)) for c in ("account_number", "transaction_date") for n in (1, 2)])
    ways = (F.col("direction") == "IN") & (at("direction", 1) == "OUT") & (at("direction", 2) == "OUT")
    words = text("summary").rlike(P.CONVERSION) & (at("summary", 1) == P.PURCHASE) & at("summary", 2).rlike(P.CONVERSION_COST)
    rows = txn.withColumns({"_hit": F.coalesce((F.col("account_kind") == "credit") & words & ways & same, F.lit(False)), "_interest": at("summary", 2).rlike(P.CONVERSION_INTEREST)})
    parts = F.array(
        F.struct(F.col("id").alias("id"), F.lit("conversion").alias("part")), F.struct(at("id", 1).alias("id"), F.lit("purchase").alias("part")),
        F.struct(F.when(F.col("_interest"), at("id", 2)).alias("id"), F.lit("interest").alias("part")),
    )
    found = rows.withColumn("_parts", parts).where("_hit").select("case_id", F.explode("_parts").alias("_p")).select("case_id", "_p.id", "_p.part")
    return found.where("id is not null")


def consolidated_split(txn: DataFrame, factor: int = 20, least_cents: int = 100_000) -> DataFrame:
    """Segments of rows that a settlement row with a great jump of the balance separates: several accounts in one list."""
    order = printed_order()
    jump = F.abs(F.lag("balance_cents").over(order) + signed() - F.col("balance_cents"))
    boundary = F.coalesce(F.lag(text("summary").rlike(P.SETTLEMENT)).over(order) & (jump >= F.greatest(F.lit(least_cents), factor * F.col("amount_cents"))), F.lit(False))
    running = F.sum(F.col("_boundary").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return txn.withColumn("_boundary", boundary).withColumn("segment", running).select("case_id", "id", "segment")


def bridge_heal(ranked: DataFrame, rank: str = "chrono_rank") -> DataFrame:
    """Amounts and balances that their neighbours' balances contradict, with those that they imply; ranked rows in.

    First the bridge: a row whose balance doesn't fit the row before or after gets the balance that the next row implies
    and the amount between, if each is as printed, a digit apart, or (amounts) printed in the raw text or summary. Then
    the pair: a row whose amount still doesn't fit gets the one between the two balances, if a digit apart, printed, or a
    closure or judicial deduction that took the rest. Breaks below 50 cents and credit cards are left alone.

    Whether a row is bridged depends on the row before only through "was that one bridged", so each row is a function of
    one bit: constant, the same or the opposite. A window composes these from the last constant on; no row is scanned
    in Python, and the balances that a bridged row passes on are right for any number of bridged rows in a row.
    """
    order = Window.partitionBy(*ACCOUNT).orderBy(rank)
    rows = ranked.join(credit_card_ledgers(ranked).where("is_credit_card"), list(ACCOUNT), "left_anti")
    amount, balance, way = F.col("amount_cents"), F.col("balance_cents"), F.when(F.col("direction") == "IN", 1).when(F.col("direction") == "OUT", -1)
    rows = rows.withColumns({"_way": way, "_before": F.lag(balance).over(order), "_after": F.lead(balance - signed()).over(order)})
    near = lambda a, b: ocr_digit_variant(printed_cents(a), printed_cents(b))
    printed = lambda c: mentions("raw_text", c) | mentions("summary", c)

    def bridged(before: Column) -> Column:
        implied = F.abs(F.col("_after") - before)
        breaks = (F.abs(before + signed() - balance) >= 50) | (F.abs(F.col("_after") - balance) >= 50)
        fits = (F.abs(before + F.col("_way") * implied - F.col("_after")) < 5) & (implied > 0)
        return F.coalesce(breaks & fits & (near(amount, implied) | printed(implied)) & near(balance, F.col("_after")), F.lit(False))

    passed_on = balance - signed()  # the balance before, if that row was bridged
    rows = rows.withColumns({"_then": F.col("_before").isNotNull() & bridged(passed_on), "_else": bridged(F.col("_before"))})
    rows = rows.withColumn("_run", F.sum((F.col("_then") == F.col("_else")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = Window.partitionBy(*ACCOUNT, "_run")
    start = F.max(F.when(F.col("_then") == F.col("_else"), F.col("_then"))).over(run)
    turns = F.sum((F.col("_else") & ~F.col("_then")).cast("int")).over(run.orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_bridged", start != (turns % 2 == 1))
    before = F.when(F.lag("_bridged").over(order), passed_on).otherwise(F.col("_before"))
    rows = rows.withColumn("_before", before).withColumns({
        "_amount": F.when(F.col("_bridged"), F.abs(F.col("_after") - F.col("_before"))).otherwise(amount), "_balance": F.when(F.col("_bridged"), F.col("_after")).otherwise(balance)})
    off = F.abs(F.col("_before") + F.col("_way") * F.col("_amount") - F.col("_balance"))
    implied = F.abs(F.col("_balance") - F.col("_before"))
    closes = (F.col("direction") == "OUT") & joined("summary", "counterparty_name", "raw_text").rlike(P.CLOSING) & (implied >= F.col("_amount")) & (off >= 100)
    paired = F.coalesce((off >= 50) & (implied > 0) & (near(F.col("_amount"), implied) | printed(implied) | closes), F.lit(False))
    reason = F.when(F.col("_bridged"), "bridge").when(paired, "pair")
    out = rows.withColumn("reason", reason).withColumn("repaired_cents", F.when(F.col("reason") == "pair", implied).otherwise(F.col("_amount")))
    return out.where("reason is not null").select("case_id", "id", "amount_cents", "balance_cents", "repaired_cents", F.col("_balance").alias("repaired_balance_cents"), "reason")


def undo_unsupported(corrected: DataFrame) -> DataFrame:
    """Rows with reason, original_amount_cents and original_balance_cents whose correction does not hold, with what they go back to.

    A bridge holds if amount and balance are each a digit from their originals, a pair always; on credit cards neither
    holds. Rows with other reasons aren't touched. An account's kind is judged by its corrected rows.
    """
    cards = credit_card_ledgers(corrected).where("is_credit_card").select(*ACCOUNT, F.lit(True).alias("_card"))
    near = lambda a, b: F.coalesce(ocr_digit_variant(printed_cents(a), printed_cents(b)), F.lit(False))
    strict = near("original_amount_cents", "amount_cents") & near("original_balance_cents", "balance_cents")
    keeps = F.col("_card").isNull() & ((F.col("reason") == "pair") | strict)
    rows = corrected.where("reason in ('bridge', 'pair')").join(cards, list(ACCOUNT), "left").where(~keeps)
    return rows.select("case_id", "id", F.coalesce("original_amount_cents", "amount_cents").alias("amount_cents"), F.coalesce("original_balance_cents", "balance_cents").alias("balance_cents"))


def _same_day(date: dt.date, year: int) -> dt.date:
    """The day in another year; the first of March where that year has no 29 February."""
    return dt.date(year, 3, 1) if (date.month, date.day) == (2, 29) and not isleap(year) else date.replace(year=year)


def _years(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Settlement rows of sorted chains with the year that follows the row before; one date is carried on."""
    key, last = None, None
    for batch in batches:
        dates = []
        for now, start, date, way in zip(zip(batch["case_id"], batch["source_document_id"], batch["account_number"], batch["_chain"], strict=True), batch["_start"], batch["transaction_date"], batch["_way"], strict=True):
            if now != key:
                key, last = now, None if pd.isna(start) else start
            if last is not None and way and abs(date.year - last.year) >= 2 and not (date > last if way > 0 else date < last):
                moved = _same_day(date, last.year)
                if moved <= last if way > 0 else moved >= last:
                    moved = _same_day(date, last.year + int(way))
                if moved.month == date.month and abs(moved.year - date.year) >= 2:
                    date = moved
            last = date
            dates.append(date)
        yield pd.DataFrame({"case_id": batch["case_id"], "id": batch["id"], "repaired_date": dates})


def settlement_repairs(txn: DataFrame) -> DataFrame:
    """Interest settlements with a year out of printed order, or without an amount: (case_id, id, repaired_date, repaired_cents).

    A missing amount is the exact change of the balance, if its sign is the row's direction. A year two or more off moves
    to the one that follows the dated row before, if the account's dates run one way (by two votes of neighbours less
    than two years apart) and the row doesn't print its date (date_printed). Between two settlements with a jump of the
    balance another account begins: nothing is carried over.

    Only settlements change, so the state is known at every other dated row: chains of settlements between these are
    scanned each on its own, and a long account is many chains.
    """
    order = printed_order()
    day = F.col("transaction_date")
    before = F.lag(day).over(order)
    close = F.abs(F.year(day) - F.year(before)) < 2
    rows = txn.withColumns({"_settles": joined("summary", "counterparty_name", "raw_text").rlike(P.SETTLEMENT), "_vote": F.when(close & (day > before), 1).when(close & (day < before), -1), "_balance": F.lag("balance_cents").over(order)})
    jump = F.abs(F.col("_balance") + signed() - F.col("balance_cents")) >= F.greatest(F.lit(100_000), 20 * F.abs(F.col("amount_cents")))
    change = F.col("balance_cents") - F.col("_balance")
    amounts = F.when(F.col("_settles") & (F.col("amount_cents") <= 0) & F.when(F.col("direction") == "IN", change > 0).when(F.col("direction") == "OUT", change < 0), F.abs(change))
    votes = F.sum("_vote").over(Window.partitionBy(*ACCOUNT))
    rows = rows.withColumns({
        "_edge": F.coalesce(F.col("_settles") & F.lag("_settles").over(order) & jump, F.lit(False)), "repaired_cents": amounts,
        "_way": F.when(votes >= 2, 1).when(votes <= -2, -1).otherwise(0)})
    fixed = F.col("_settles") & ~F.coalesce(F.col("date_printed"), F.lit(False)) if "date_printed" in txn.columns else F.col("_settles")
    anchor = day.isNotNull() & ~fixed
    rows = rows.withColumn("_anchor", anchor)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_chain", F.sum((F.col("_anchor") | F.col("_edge")).cast("int")).over(running))
    rows = rows.withColumn("_start", F.max(F.when(F.col("_anchor"), day)).over(Window.partitionBy(*ACCOUNT, "_chain")))
    chained = rows.where(fixed & day.isNotNull()).select(*ACCOUNT, "_chain", "_start", *PRINTED, "id", "transaction_date", "_way")
    dealt = chained.repartition(*[F.col(c) for c in (*ACCOUNT, "_chain")]).sortWithinPartitions(*ACCOUNT, "_chain", *PRINTED)
    dates = dealt.mapInPandas(_years, f"case_id {dict(txn.dtypes)['case_id']}, id string, repaired_date date")
    moved = dates.join(txn.select("case_id", "id", "transaction_date"), ["case_id", "id"]).where("repaired_date <> transaction_date").drop("transaction_date")
    filled = rows.where("repaired_cents is not null").select("case_id", "id", "repaired_cents")
    return moved.join(filled, ["case_id", "id"], "full").select("case_id", "id", "repaired_date", "repaired_cents")
