"""What the columns of a mapped table say: the side of amounts, a forgotten description column, columns that hold two things.

cells: (document_id, page, table_no, row_id, row_no, col_no, cell_id, text). tables: (document_id, page, table_no, kind,
account_kind). headers: (document_id, page, table_no, row_id). rows: (document_id, page, table_no, group_no, row_id), the
rows of each group. A table's convention is one grouped aggregate over its cells; no table is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.identity import text
from ..functions.money import money
from ..functions.printed import semantic_text

DOC = "document_id"
TABLE = [DOC, "page", "table_no"]


def _bare(c: str) -> Column:
    return F.regexp_replace(text(c), r"(?U)\s", "")


def _heads(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Header cells with the width of their row."""
    width = cells.where("row_id is not null").groupBy(*TABLE, "row_id").agg(F.count("*").alias("width"))
    return cells.join(headers, [*TABLE, "row_id"]).join(width, [*TABLE, "row_id"])


def paired_directions(cells: DataFrame, tables: DataFrame, headers: DataFrame, outputs: DataFrame) -> DataFrame:
    """(document_id, out_no, direction): rows without a direction whose amount stands on one side of a debit and a credit column.

    A deposit table must have one column of either kind, under rows of one width. The row's two cells must both be
    readable, one positive, the other an explicit zero (an empty cell may be a lost one), and the positive one the row's
    amount. outputs: (document_id, out_no, page, table_no, row_id, direction, amount_cents), rows of one source row.
    """
    deposit = tables.where("kind = 'transactions' and account_kind = 'deposit'").select(*TABLE)
    heads = _heads(cells, headers).join(deposit, TABLE)
    side = F.when(_bare("text").rlike(patterns.DEBIT_HEADER), "OUT").when(_bare("text").rlike(patterns.CREDIT_HEADER), "IN")
    of = lambda s, f: f(F.when(F.col("side") == s, F.struct("col_no", "width")))
    pairs = heads.withColumn("side", side).where("side is not null").groupBy(*TABLE).agg(of("OUT", F.count).alias("_no"), of("IN", F.count).alias("_ni"), of("OUT", F.max).alias("_o"), of("IN", F.max).alias("_i"))
    pairs = pairs.where("_no = 1 and _ni = 1 and _o.col_no <> _i.col_no and _o.width = _i.width").select(*TABLE, F.col("_o.col_no").alias("_oc"), F.col("_i.col_no").alias("_ic"), F.col("_o.width").alias("width"))
    wanted = outputs.where(text("direction") == "").join(pairs, TABLE)
    held = wanted.join(cells.select(*TABLE, "row_id", "col_no", money("text")["cents"].alias("_c")), [*TABLE, "row_id"]).groupBy(DOC, "out_no", "amount_cents", "width")
    seen = held.agg(F.count("*").alias("_w"), F.max(F.when(F.col("col_no") == F.col("_oc"), F.col("_c"))).alias("_out"), F.max(F.when(F.col("col_no") == F.col("_ic"), F.col("_c"))).alias("_in")).where("_w = width")
    found = F.when((F.col("_out") > 0) & (F.col("_in") == 0) & (F.col("_out") == F.col("amount_cents")), "OUT").when((F.col("_in") > 0) & (F.col("_out") == 0) & (F.col("_in") == F.col("amount_cents")), "IN")
    return seen.select(DOC, "out_no", found.alias("direction")).where("direction is not null")


def signed_income(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """(document_id, out_no): rows without a direction that are income, as their table's amounts carry signs.

    An amount without a sign is income only where another row of the deposit table is printed negative and both print
    and an independent reading call it a payment; the row's own reading must say income. Both rows must agree with
    their reading in amount and balance, and in the date or else in account and other party, without doubt. The column's
    header must be plain, and the page's reading complete.

    tables: (document_id, page, table_no, kind, account_kind, amount_header, complete). rows: aligned pairs of print and
    reading, (document_id, page, table_no, out_no, printed, and each of direction, amount, balance, transaction_date,
    account_number, counterparty_account with the reading's as i_..., doubted).
    """
    plain = tables.where("kind = 'transactions' and account_kind = 'deposit' and complete").where(_bare("amount_header").rlike(patterns.PLAIN_AMOUNT_HEADER)).select(*TABLE)
    agree = lambda f: (text(f) != "") & (text(f) == text(f"i_{f}"))
    exact = agree("amount") & agree("balance") & ((text("transaction_date") == text("i_transaction_date")) | (agree("account_number") & agree("counterparty_account"))) & ~F.coalesce("doubted", F.lit(False))
    sums = money("printed")
    seen = rows.join(plain, TABLE).withColumns({"_exact": exact, "_cents": sums["cents"]})
    shows = F.col("_exact") & (F.col("_cents") < 0) & (text("direction") == "OUT") & (text("i_direction") == "OUT")
    signed = seen.where(shows).select(*TABLE).distinct()
    income = F.col("_exact") & (text("direction") == "") & (F.col("_cents") > 0) & ~_bare("printed").startswith("+") & (text("i_direction") == "IN")
    return seen.where(income).join(signed, TABLE).select(DOC, "out_no")


def recovered_columns(cells: DataFrame, tables: DataFrame, headers: DataFrame, rows: DataFrame) -> DataFrame:
    """(document_id, page, table_no, what, col_no): columns of transaction tables that their headers name beyond doubt.

    DESCRIPTION: one column with a literal header of descriptions, if none is mapped, or another is though the only
    header row is as wide as every row. DETACHED_DESCRIPTION: such a label beside the page's only table, whose rows all
    have one column more than its only header row, and none is mapped. PARTY: one column whose header names account and
    name of the other party. PARTY_SUFFIX: one column of the other party's information, in which three cells or more,
    and all that aren't empty, are a name with four digits behind. Only tables whose groups are single rows count.

    tables has description_col besides, the mapped column of the group's first row, null if none.
    """
    groups = rows.groupBy(*TABLE, "group_no").agg(F.count("*").alias("n")).groupBy(*TABLE).agg(F.max("n").alias("_most"), F.count("*").alias("_groups"))
    single = tables.where("kind = 'transactions'").join(groups.where("_most = 1").select(*TABLE, "_groups"), TABLE)
    heads = _heads(cells, headers)
    rank = heads.groupBy(*TABLE).agg(F.countDistinct("row_id").alias("_heads"), F.max("width").alias("_hw"))
    widths = cells.join(rows.select(*TABLE, "row_id"), [*TABLE, "row_id"]).groupBy(*TABLE, "row_id").agg(F.count("*").alias("w")).groupBy(*TABLE).agg(F.min("w").alias("_low"), F.max("w").alias("_high"))
    known = single.join(rank, TABLE).join(widths, TABLE)

    def one_column(label: Column, pattern: str) -> DataFrame:
        return heads.where(label.rlike(pattern)).groupBy(*TABLE).agg(F.min("col_no").alias("col_no"), F.max("col_no").alias("_other")).where("col_no = _other").drop("_other")

    named = one_column(semantic_text("text"), patterns.DESCRIPTION_HEADER)
    even = (F.col("_heads") == 1) & (F.col("_low") == F.col("_hw")) & (F.col("_high") == F.col("_hw"))
    open_ = F.col("description_col").isNull()
    direct = known.join(named, TABLE).where((open_ | even) & (F.coalesce("description_col", F.lit(-1)) != F.col("col_no")))
    lone = cells.where("table_no is not null").groupBy(DOC, "page").agg(F.countDistinct("table_no").alias("_t")).where("_t = 1").select(DOC, "page")
    beside = cells.where(F.col("row_id").isNull() & F.trim(text("text")).rlike(patterns.DETACHED_HEADER)).groupBy(DOC, "page").agg(F.count("*").alias("_l")).where("_l = 1").select(DOC, "page")
    detached = known.where(open_ & (F.col("_heads") == 1) & (F.col("_low") == F.col("_hw") + 1) & (F.col("_high") == F.col("_hw") + 1)).join(named.select(*TABLE), TABLE, "left_anti").join(lone, [DOC, "page"]).join(beside, [DOC, "page"]).withColumn("col_no", (F.col("_hw") + 1).cast("int"))
    party = single.join(one_column(_bare("text"), patterns.COMBINED_PARTY_HEADER), TABLE)
    info = single.where("_groups >= 3").join(one_column(semantic_text("text"), "^对方信息$"), TABLE)
    held = info.select(*TABLE, "col_no").join(rows.select(*TABLE, "row_id"), TABLE).join(cells.select(*TABLE, "row_id", "col_no", F.trim(text("text")).alias("text")), [*TABLE, "row_id", "col_no"]).where("text <> ''")
    suffix = held.groupBy(*TABLE, "col_no").agg(F.count("*").alias("_n"), F.bool_and(F.col("text").rlike("^[^0-9]+[0-9]{4}$")).alias("_all")).where("_n >= 3 and _all")
    out = lambda df, what: df.select(*TABLE, F.lit(what).alias("what"), "col_no")
    return out(direct, "DESCRIPTION").unionByName(out(detached, "DETACHED_DESCRIPTION")).unionByName(out(party, "PARTY")).unionByName(out(suffix, "PARTY_SUFFIX"))
