"""What a second reading of pages may change: mappings carried over, pages replaced, fields confirmed, pages chosen to be read again.

Cells are (document_id, page, table_no, row_id, row_no, col_no, cell_id, text); table_no, row_id, row_no and col_no are
null beside tables. Every key starts with the document; the largest group that is gathered is one page's cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identity import text
from ..functions.money import money, parse_date
from ..plans.storage import written

DOC = "document_id"
PAGE = [DOC, "page"]
TABLE = [DOC, "page", "table_no"]


def _occurrences(cells: DataFrame) -> DataFrame:
    """cells with nth: which of its page's cells of the same place and text it is, by id."""
    same = Window.partitionBy(*PAGE, "table_no", "row_no", "col_no", "text").orderBy("cell_id")
    return cells.withColumn("text", text("text")).withColumn("nth", F.row_number().over(same))


def page_prints(cells: DataFrame) -> DataFrame:
    """(document_id, page, print): a hash of places and texts of the page's cells in the order of their ids, whatever the ids are."""
    return _prints(_occurrences(cells))


def _prints(numbered: DataFrame) -> DataFrame:
    place = F.struct("cell_id", F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in ("table_no", "row_no", "col_no")], "text", "nth")).alias("x"))
    gathered = numbered.groupBy(*PAGE).agg(F.array_sort(F.collect_list(place)).alias("all"))
    return gathered.select(*PAGE, F.sha2(F.array_join(F.transform("all", lambda c: c["x"]), "\n"), 256).alias("print"))


def unchanged_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """(document_id, page) of the pages that read the same, in the same order, in both readings."""
    return page_prints(before).join(page_prints(after), [*PAGE, "print"]).select(*PAGE)


def rebased_mapping(before: DataFrame, after: DataFrame, tables: DataFrame, references: DataFrame, latest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mapped tables after a page was read again, and the references of those that are kept.

    tables and latest: (document_id, page, table_no) of the mapping before and of a new one. references: (document_id,
    page, table_no, slot, kind, ref), a row's or a cell's id in the table's mapping, the cell perhaps on another page.

    Tables of unchanged pages keep their mapping: a row is found again by its place, a cell by its place, its text and
    which of several such it is. If one of a table's references has no counterpart, the new mapping of the table is
    taken, and if there is none the table is lost. Other pages take the new mapping. First result: (document_id, page,
    table_no, taken), taken being KEPT, NEW or LOST; second: references of kept tables with new_ref.
    """
    a, b = (written(_occurrences(c), "occurrences") for c in (before, after))
    same = written(_prints(a).join(_prints(b), [*PAGE, "print"]).select(*PAGE), "unchanged-pages")
    row_of = lambda c, name: c.where("row_id is not null").select(DOC, "page", "table_no", "row_no", F.col("row_id").alias(name)).distinct()
    rows = row_of(a, "ref").join(row_of(b, "new_ref"), [*TABLE, "row_no"]).select(DOC, F.lit("row").alias("kind"), "ref", "new_ref")
    marks = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(f"_{c}") for c in ("table_no", "row_no", "col_no")]
    cell_of = lambda c, name: c.select(*PAGE, *marks, "text", "nth", F.col("cell_id").alias(name))
    cells = cell_of(a, "ref").join(cell_of(b, "new_ref"), [*PAGE, "_table_no", "_row_no", "_col_no", "text", "nth"]).select(DOC, F.lit("cell").alias("kind"), "ref", "new_ref")
    kept = tables.select(*TABLE).distinct().join(same, PAGE)
    found = written(references.join(kept, TABLE).join(rows.unionByName(cells), [DOC, "kind", "ref"], "left"), "rebased")
    whole = found.groupBy(*TABLE).agg(F.bool_and(F.col("new_ref").isNotNull()).alias("_whole"))
    every = kept.select(*TABLE, F.lit(True).alias("_kept")).unionByName(latest.select(*TABLE, F.lit(False).alias("_kept"))).groupBy(*TABLE).agg(F.bool_or("_kept").alias("_kept"), F.bool_or(~F.col("_kept")).alias("_new"))
    taken = F.when(F.col("_kept") & F.coalesce("_whole", F.lit(True)), "KEPT").when(F.col("_new"), "NEW").otherwise("LOST")
    out = every.join(whole, TABLE, "left").select(*TABLE, taken.alias("taken"))
    return out, found.join(out.where("taken = 'KEPT'").select(*TABLE), TABLE).select(*TABLE, "slot", "kind", "ref", "new_ref")


def backed_rows(cells: DataFrame, readings: DataFrame) -> DataFrame:
    """(document_id, page, reading_row, table_no, row_no): table rows that one row of another reading backs, and no other.

    The reading's date, amount and balance must stand in three cells of the row: equal amount and balance need two of
    them, one for each. readings: (document_id, page, reading_row, date, amount, balance) as text. Pairs of cells are made
    within a row; rows and readings meet by equal date, amount and balance, not per page.
    """
    return _backed(_table_rows(cells), _own(readings))


def _own(readings: DataFrame) -> DataFrame:
    return readings.select(*PAGE, "reading_row", parse_date("date").alias("_date"), money("amount", True)["cents"].alias("_amount"), money("balance")["cents"].alias("_balance"))


def _table_rows(cells: DataFrame) -> DataFrame:
    """(document_id, page, table_no, row_no, cells, dates, sums): table rows with their cells in order of columns, each text read once."""
    read = cells.where("row_no is not null").select(*TABLE, "row_no", "col_no", "cell_id", text("text").alias("t"), parse_date("text").alias("_date"), money("text")["cents"].alias("_cents"))
    return read.groupBy(*TABLE, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "t"))).alias("cells"), F.collect_set("_date").alias("dates"), F.collect_list(F.when(F.col("_cents").isNotNull(), F.struct("cell_id", F.col("_cents").alias("cents")))).alias("sums"))


def _backed(rows: DataFrame, own: DataFrame) -> DataFrame:
    row = [*TABLE, "row_no"]
    each = rows.where("table_no is not null and size(dates) > 0 and size(sums) > 1").select(*row, "dates", F.explode("sums").alias("_a"), "sums").select(*row, "dates", "_a", F.explode("sums").alias("_b")).where("_a.cell_id <> _b.cell_id")
    shown = each.select(*row, F.abs("_a.cents").alias("_amount"), F.col("_b.cents").alias("_balance"), F.explode("dates").alias("_date"))
    pairs = own.dropna(subset=["_date", "_amount", "_balance"]).join(shown, [*PAGE, "_amount", "_balance", "_date"]).select(*row, "reading_row").distinct()
    n = lambda *keys: F.count("*").over(Window.partitionBy(*keys))
    return pairs.withColumns({"_r": n(*PAGE, "reading_row"), "_t": n(*row)}).where("_r = 1 and _t = 1").select(*PAGE, "reading_row", "table_no", "row_no")


def reread_pages(before: DataFrame, after: DataFrame, readings: DataFrame, complete: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which pages take their second reading, and the rows of it that keep the first.

    A page is replaced unless that loses a row which the independent reading backs. If rows are lost, but both readings
    have the same grid (equal numbers of tables, rows and columns, five rows at least, the same head without a date), the
    independent reading is complete, all other backed rows stand where they stood, three of them in the same table, and
    the new row still shows the date and the balance, the page is replaced but for those rows. complete: (document_id,
    page) of complete independent readings without issues. First result: (document_id, page, decision, n_before, n_after,
    n_lost), decision being REPLACED, RETAINED or REPLACED_IN_PART; second: (document_id, page, table_no, row_no).
    """
    row = ["table_no", "row_no"]
    own = written(_own(readings), "readings")
    before_rows, after_rows = written(_table_rows(before), "rows-before"), written(_table_rows(after), "rows-after")
    old = written(_backed(before_rows, own), "backed-before")
    new = written(_backed(after_rows, own).withColumnsRenamed({"table_no": "_t", "row_no": "_r"}), "backed-after")
    met = written(old.join(new, [*PAGE, "reading_row"], "left").withColumns({"_lost": F.col("_t").isNull(), "_moved": (F.col("_t") != F.col("table_no")) | (F.col("_r") != F.col("row_no"))}), "backed-both")

    def grid(rows: DataFrame) -> DataFrame:
        lines = rows.select(*TABLE, "row_no", "cells", F.size("cells").alias("w"), (F.size("dates") > 0).alias("d"))
        per = lines.groupBy(*TABLE).agg(F.count("*").alias("n"), F.min("w").alias("w"), F.max("w").alias("v"), F.to_json(F.min_by("cells", "row_no")).alias("h"), F.min_by("d", "row_no").alias("d"))
        return per.groupBy(*PAGE).agg(F.to_json(F.array_sort(F.collect_list(F.struct("table_no", "n", "w", "h")))).alias("g"), F.bool_and((F.col("n") >= 5) & (F.col("w") == F.col("v")) & ~F.col("d")).alias("_even"))

    alike = grid(before_rows).join(grid(after_rows), [*PAGE, "g", "_even"]).where("_even").select(*PAGE, F.lit(True).alias("_alike"))
    heads = before_rows.groupBy(*TABLE).agg(F.min("row_no").alias("_head"))
    steady = met.where("not _lost and not _moved").groupBy(*TABLE).agg(F.count("*").alias("_steady"))
    lost = met.where("_lost").select(*PAGE, "reading_row", *row)
    has = lambda name: F.coalesce(F.expr(name), F.lit(False))
    fresh = after_rows.join(lost, [*TABLE, "row_no"]).join(own, [*PAGE, "reading_row"]).groupBy(*PAGE, "reading_row", *row).agg(F.bool_or(has("array_contains(dates, _date)")).alias("_dated"), F.bool_or(has("exists(sums, x -> x.cents = _balance)")).alias("_summed"))
    taken = new.select(*PAGE, F.col("_t").alias("table_no"), F.col("_r").alias("row_no"), F.lit(True).alias("_taken"))
    judged = lost.join(fresh, [*PAGE, "reading_row", *row], "left").join(heads, TABLE, "left").join(steady, TABLE, "left").join(taken, [*TABLE, "row_no"], "left")
    safe = F.coalesce(F.col("_dated") & F.col("_summed"), F.lit(False)) & (F.col("row_no") > F.col("_head")) & (F.coalesce("_steady", F.lit(0)) >= 3) & F.col("_taken").isNull()
    per_lost = judged.groupBy(*PAGE).agg(F.bool_and(safe).alias("_safe"))
    counts = met.groupBy(*PAGE).agg(F.count("*").alias("n_before"), F.count_if("_lost").alias("n_lost"), F.bool_or(F.coalesce("_moved", F.lit(False))).alias("_any_moved"))
    pages = after.select(*PAGE).distinct().join(counts, PAGE, "left").join(new.groupBy(*PAGE).agg(F.count("*").alias("n_after")), PAGE, "left").join(per_lost, PAGE, "left").join(alike, PAGE, "left").join(complete.select(*PAGE).distinct().withColumn("_complete", F.lit(True)), PAGE, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    in_part = F.coalesce(F.col("_alike") & F.col("_complete") & F.col("_safe") & ~F.col("_any_moved"), F.lit(False))
    decision = F.when(zero("n_lost") == 0, "REPLACED").when(in_part, "REPLACED_IN_PART").otherwise("RETAINED")
    pages = written(pages.select(*PAGE, decision.alias("decision"), zero("n_before").alias("n_before"), zero("n_after").alias("n_after"), zero("n_lost").alias("n_lost")), "reread-pages")
    return pages, lost.join(pages.where("decision = 'REPLACED_IN_PART'").select(*PAGE), PAGE).select(*TABLE, "row_no")


#: Issues that put in doubt which rows a page has, and fields whose conflicts ask for another reading.
STRUCTURAL = ("INDEPENDENT_ROW_UNMATCHED", "INDEPENDENT_EXTRA_OBSERVATION", "UNASSIGNED_SOURCE_ROW", "SOURCE_ROW_REUSED", "INDEPENDENT_PAGE_INCOMPLETE")
KEY_FIELDS = ("account_number", "counterparty_account", "amount", "balance", "transaction_date", "direction")
CRITICAL_FIELDS = ("account_number", "transaction_date", "direction", "amount", "balance", "counterparty_name", "counterparty_account")


def _budget(pages: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first pages of each document are selected, the rest deferred. A document's pages with issues are what a window holds."""
    rank = F.row_number().over(Window.partitionBy(DOC).orderBy(*order, "page"))
    return pages.withColumn("rank", rank).withColumn("state", F.when(F.col("rank") <= most, "SELECTED").otherwise("DEFERRED")).select(*PAGE, "rank", "state", F.array_sort("reasons").alias("reasons"))


def primary_plan(issues: DataFrame, most: int = 6) -> DataFrame:
    """(document_id, page, rank, state, reasons): pages to read again for their rows or key values.

    Pages with doubts about which rows there are come first, but for pages merely incomplete; then those with more rows
    concerned; then by number. issues: (document_id, page, code, field, severity, out_no), a row for each page and row
    that an issue names; advisory ones don't count.
    """
    wanted = F.col("code").isin(*STRUCTURAL, "SOURCE_BALANCE_DISCONTINUITY") | ((F.col("code") == "INDEPENDENT_VALUE_CONFLICT") & text("field").isin(*KEY_FIELDS))
    structural = F.col("code").isin(*[c for c in STRUCTURAL if c != "INDEPENDENT_PAGE_INCOMPLETE"])
    per = issues.where(wanted & (text("severity") != "ADVISORY")).groupBy(*PAGE).agg(F.collect_set("code").alias("reasons"), F.max(structural.cast("int")).alias("_s"), F.countDistinct("out_no").alias("_n"))
    return _budget(per, [F.desc("_s"), F.desc("_n")], most)


def account_plan(issues: DataFrame, supporting: DataFrame, attempted: DataFrame, most: int = 12) -> DataFrame:
    """The same for owners' accounts: pages of issues on accounts or banks first, then, if there are any, pages that list accounts.

    supporting and attempted: (document_id, page) of pages that name an own account, and of pages read again before.
    """
    direct = issues.where(text("field").isin("account_number", "bank_name") & (text("severity") != "ADVISORY")).select(*PAGE, "code", F.lit(1).alias("_d")).join(attempted.select(*PAGE).distinct(), PAGE, "left_anti")
    more = supporting.select(*PAGE).distinct().join(attempted.select(*PAGE).distinct(), PAGE, "left_anti").join(direct.select(DOC).distinct(), DOC, "left_semi").select(*PAGE, F.lit("ACCOUNT_INVENTORY_SUPPORTS_DISPUTED_OWNER").alias("code"), F.lit(0).alias("_d"))
    return _budget(direct.unionByName(more).groupBy(*PAGE).agg(F.collect_set("code").alias("reasons"), F.max("_d").alias("_d")), [F.desc("_d")], most)


def critical_plan(issues: DataFrame, most: int = 12) -> DataFrame:
    """The same for single fields that two readings differ in or one is unsure of, by page; reasons name the field."""
    wanted = F.col("code").isin("INDEPENDENT_VALUE_CONFLICT", "INDEPENDENT_SOURCE_UNCERTAIN") & text("field").isin(*CRITICAL_FIELDS) & (text("severity") != "ADVISORY")
    return _budget(issues.where(wanted).groupBy(*PAGE).agg(F.collect_set(F.concat_ws(":", "code", "field")).alias("reasons")), [], most)


def critical_fields(rows: DataFrame, first: DataFrame, second: DataFrame, pages: DataFrame, least_anchors: int = 3) -> DataFrame:
    """(document_id, page, out_no, field, before, after): doubts about printed values that a third reading settles.

    The printed value stays; a reading that differed or was unsure takes it over, if a second independent reading gives
    the same without doubt, each printed source shows the value (proven), and three other fields agree between print and
    second reading without doubt. Names count only where no reading has an account. Only pages of which both readings
    are complete and have as many rows as the print are looked at.

    rows: (document_id, page, out_no, field, value, proven); first, second: (document_id, page, out_no, field, value,
    doubted) of the aligned rows; pages: (document_id, page, n_rows, first_rows, second_rows, usable).
    """
    key = [*PAGE, "out_no"]
    good = pages.where(F.col("usable") & (F.col("n_rows") == F.col("first_rows")) & (F.col("n_rows") == F.col("second_rows"))).select(*PAGE)
    one = first.select(*key, "field", text("value").alias("_first"), F.coalesce("doubted", F.lit(False)).alias("_d1"))
    two = second.select(*key, "field", text("value").alias("_second"), F.coalesce("doubted", F.lit(False)).alias("_d2"))
    both = rows.join(good, PAGE).withColumn("value", text("value")).join(one, [*key, "field"]).join(two, [*key, "field"])
    agrees = (F.col("value") != "") & (F.col("value") == F.col("_second")) & ~F.col("_d2")
    own = Window.partitionBy(*key)
    is_anchor = agrees & F.col("field").isin("account_number", "transaction_date", "direction", "amount", "balance", "counterparty_account")
    party = F.max(F.when((F.col("field") == "counterparty_account") & ((F.col("value") != "") | (F.col("_first") != "") | (F.col("_second") != "")), 1).otherwise(0)).over(own)
    seen = both.withColumns({"_anchors": F.sum(is_anchor.cast("int")).over(own) - is_anchor.cast("int"), "_party": party})
    doubtful = F.col("_d1") | (F.col("_first") != F.col("value"))
    fits = F.col("field").isin(*CRITICAL_FIELDS) & agrees & doubtful & F.coalesce("proven", F.lit(False)) & (F.col("_anchors") >= least_anchors) & ((F.col("field") != "counterparty_name") | (F.col("_party") == 0))
    return seen.where(fits).select(*key, "field", F.col("_first").alias("before"), F.col("value").alias("after"))


def cell_evidence(wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """(document_id, item, page, table_no, row_no, found): for wanted amounts and balances the first table row that shows both in two cells.

    Equal amount and balance need two cells. wanted: (document_id, item, amount_cents, balance_cents); found is false
    where no row does. Cells meet by equal cents within a row, so nothing is compared but equals.
    """
    row = [*TABLE, "row_no"]
    sums = cells.where("row_no is not null").select(*row, "cell_id", money("text")["cents"].alias("_cents")).where("_cents is not null")
    left, right = sums.select(*row, F.abs("_cents").alias("amount_cents"), F.col("cell_id").alias("_a")), sums.select(*row, F.col("_cents").alias("balance_cents"), F.col("cell_id").alias("_b"))
    hits = wanted.join(left, [DOC, "amount_cents"]).join(right, [*row, "balance_cents"]).where("_a <> _b").groupBy(DOC, "item").agg(F.min(F.struct("page", "table_no", "row_no")).alias("at"))
    return wanted.select(DOC, "item").join(hits, [DOC, "item"], "left").select(DOC, "item", "at.page", "at.table_no", "at.row_no", F.col("at").isNotNull().alias("found"))
