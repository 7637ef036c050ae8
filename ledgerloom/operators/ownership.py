"""Operators that decide whose account a row belongs to: inventories, misread digits, issuers, owners, clipped numbers.

All keys are a case with a document or account, so every join is an equi-join; a suffix or prefix is tested after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.identity import is_reliable_account, norm_part, text
from ..functions.money import account_no, bank_name, header_bank

DOCUMENT = ["case_id", "source_document_id"]
SIGNATURE = ["transaction_date", "direction", "amount_cents", "balance_cents"]


def inventory_bindings(rows: DataFrame, inventory: DataFrame, readings: DataFrame) -> DataFrame:
    """(document, account_number, account_name, bound_account, n_choices, reason): local accounts and the full ones of an account list.

    The full account ends with the local one after one to four more digits, has the same owner, the balance of the
    local account's last row and a date no earlier; it must be the only one, verified, and two rows of another reading
    of the same pages must bear the local number. Else reason says what is missing; without any choice there is no row.
    inventory: document, account_number, account_name, balance_cents, as_of, verified. readings: document, page, account_number.
    """
    own = rows.where(text("account_number").rlike("^[0-9]{12,28}$") & (text("account_name") != ""))
    own = own.join(inventory.select(*DOCUMENT, "account_number"), [*DOCUMENT, "account_number"], "left_anti")
    group = [*DOCUMENT, "account_number", "account_name"]
    known = F.when(F.col("transaction_date").isNotNull() & F.col("balance_cents").isNotNull(), F.struct("transaction_date", "page", "row_index", "seq"))
    last = own.groupBy(*group).agg(F.count(known).alias("_n"), F.max_by("balance_cents", known).alias("balance_cents"), F.max(known)["transaction_date"].alias("_last")).where("_n >= 2")
    full = inventory.select(*DOCUMENT, F.col("account_number").alias("_full"), F.trim("account_name").alias("account_name"), "balance_cents", "as_of", "verified")
    extra = F.length("_full") - F.length("account_number")
    choices = last.join(full, [*DOCUMENT, "account_name", "balance_cents"]).where(F.endswith("_full", "account_number") & extra.between(1, 4) & (F.col("as_of") >= F.col("_last")))
    found = choices.groupBy(*group).agg(F.countDistinct("_full").alias("n_choices"), F.min("_full").alias("_only"), F.bool_or(F.coalesce("verified", F.lit(False))).alias("_verified"))
    pages = own.select(*group, "page").distinct()
    support = readings.join(pages, [*DOCUMENT, "page", "account_number"]).groupBy(*group).agg(F.count("*").alias("_support"))
    judged = found.join(support, group, "left")
    sure = F.col("_verified") & (F.coalesce("_support", F.lit(0)) >= 2)
    reason = F.when(F.col("n_choices") > 1, "MULTIPLE_FULL_ACCOUNT_CANDIDATES").when(~sure, "FULL_ACCOUNT_NOT_INDEPENDENTLY_CONFIRMED")
    return judged.withColumn("reason", reason).select(*group, F.when(F.col("reason").isNull(), F.col("_only")).alias("bound_account"), "n_choices", "reason")


def _with_gaps(numbers: DataFrame, number: str) -> DataFrame:
    """Each number with every form in which one character is left open."""
    return numbers.withColumn("_open", F.explode(F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.overlay(F.col(number), F.lit("*"), i, F.lit(1)))))


def misread_accounts(rows: DataFrame, inventory: DataFrame, least_matches: int = 3, least_share: float = 0.8) -> DataFrame:
    """(case_id, account_number, listed_account, n_matches): unlisted accounts that are a listed one with one digit misread.

    A near number alone merges nothing. At least three rows and four fifths of the unlisted account's rows, of two dates
    or more, must each occur exactly once in either account with equal date, direction, amount and balance, in one
    document on other pages, under the listed owner's name and no other bank. Reviewed accounts stay.
    inventory: case_id, account_number, account_name. Candidates meet by forms with one open digit, never all by all.
    """
    listed = inventory.select("case_id", norm_part("account_number").alias("_listed"), F.trim("account_name").alias("_owner")).distinct()
    numbered = rows.withColumns({"_number": norm_part("account_number"), "_owner": F.trim(text("account_name"))})
    groups = numbered.groupBy("case_id", "_number").agg(F.count("*").alias("_rows"), F.bool_or(F.coalesce("reviewed", F.lit(False))).alias("_reviewed"))
    free = groups.where(F.col("_number").rlike("^[0-9]{12,32}$") & ~F.col("_reviewed")).join(listed.select("case_id", F.col("_listed").alias("_number")), ["case_id", "_number"], "left_anti")
    near = _with_gaps(free, "_number").join(_with_gaps(listed, "_listed"), ["case_id", "_open"]).drop("_open")
    usable = F.col("transaction_date").isNotNull() & (F.col("direction") != "UNKNOWN") & F.col("amount_cents").isNotNull() & F.col("balance_cents").isNotNull()
    kept = numbered.where(usable).select(*DOCUMENT, *SIGNATURE, "_number", "_owner", "id", "page", "bank_name")
    alone = Window.partitionBy("case_id", "_number", *SIGNATURE)
    own = kept.withColumn("_n", F.count("*").over(alone)).where((F.col("_n") == 1) & (F.col("amount_cents") > 0) & (F.col("_owner") != "") & ~F.col("_owner").rlike("待核|未知")).drop("_n")
    other = kept.select(*DOCUMENT, *SIGNATURE, F.col("_number").alias("_listed"), "_owner", F.col("page").alias("_page"), F.col("bank_name").alias("_bank"))
    unknown = lambda c: (text(c) == "") | F.col(c).rlike("待核|未知")
    met = near.join(own, ["case_id", "_number", "_owner"]).join(other, [*DOCUMENT, *SIGNATURE, "_listed", "_owner"]).where((F.col("page") != F.col("_page")) & (unknown("bank_name") | unknown("_bank") | (bank_name("bank_name") == bank_name("_bank"))))
    once = met.groupBy("case_id", "_number", "_rows", "_listed", "id", "transaction_date").agg(F.count("*").alias("_n")).where("_n = 1")
    enough = once.groupBy("case_id", "_number", "_rows", "_listed").agg(F.count("*").alias("n_matches"), F.countDistinct("transaction_date").alias("_dates"))
    enough = enough.where((F.col("n_matches") >= least_matches) & (F.col("n_matches") >= least_share * F.col("_rows")) & (F.col("_dates") >= 2))
    only = enough.withColumn("_n", F.count("*").over(Window.partitionBy("case_id", "_number"))).where("_n = 1")
    return only.select("case_id", F.col("_number").alias("account_number"), F.col("_listed").alias("listed_account"), "n_matches")


def account_issuers(readings: DataFrame, numbers: DataFrame, headers: DataFrame) -> DataFrame:
    """(document, account_number, bank, n_pages): the one bank that complete readings and printed headers give an account.

    readings: document, page, complete, bank. numbers: document, page, number. headers: document, page, text.
    Accounts with two banks and names of no certain bank give nothing.
    """
    page = [*DOCUMENT, "page"]
    read = readings.where("complete").select(*page, bank_name("bank").alias("bank")).where((text("bank") != "") & ~F.col("bank").rlike(P.BANK_UNCERTAIN)).distinct()
    printed = headers.where(F.contains(text("text"), F.lit("银行"))).select(*page, bank_name("text").alias("bank")).where(text("bank") != "").distinct()
    own = numbers.select(*page, account_no("number").alias("account_number")).where(F.col("account_number").rlike("^[0-9]{8,32}$")).distinct()
    seen = read.join(printed, [*page, "bank"]).join(own, page)
    found = seen.groupBy(*DOCUMENT, "account_number").agg(F.count_distinct("bank").alias("_n"), F.min("bank").alias("bank"), F.count_distinct("page").alias("n_pages"))
    return found.where("_n = 1").drop("_n")


def owner_names(rows: DataFrame, readings: DataFrame, numbers: DataFrame, headers: DataFrame) -> DataFrame:
    """(document, id, owner_name): owners of rows without a name, or with the name and an identifier in one cell.

    A page gives a name if its reading is complete and without issues, has one name without digits, and a header prints
    it once: alone, after a label, or before an identity number with an identifier of the page. Accounts with two names
    give nothing. readings: document, page, complete, n_issues, names. numbers: document, page, number. headers: document, page, text.
    """
    page = [*DOCUMENT, "page"]
    names = F.filter(F.array_distinct("names"), lambda n: (F.trim(n) != "") & ~n.rlike("[0-9]"))
    read = readings.where("complete and n_issues = 0").withColumn("_names", names).where(F.size("_names") == 1).select(*page, F.col("_names")[0].alias("owner_name"))
    cells = headers.join(read, page).where(F.length(F.regexp_replace("text", r"(?U)\s", "")) > 0)
    rest = F.regexp_replace("text", P.OWNER_LABEL, "")
    after = lambda c: F.substr(c, F.length("owner_name") + 1)
    labelled = F.col("text").rlike(P.OWNER_LABEL) & ((rest == F.col("owner_name")) | (F.startswith(rest, "owner_name") & after(rest).rlike(r"(?U)^(?:\s|[0-9])")))
    listed = numbers.groupBy(*page).agg(F.collect_set("number").alias("_numbers"))
    cells = cells.join(listed, page, "left")
    identified = F.startswith("text", "owner_name") & after("text").rlike(r"(?U)^[0-9]{15}(?:[0-9]{2}[0-9Xx])?(?:\s|$)") & F.coalesce(F.exists("_numbers", lambda n: F.contains(F.col("text"), n)), F.lit(False))
    once = F.length(F.replace("text", "owner_name", F.lit(""))) == F.length("text") - F.length("owner_name")
    proved = cells.where(((F.trim("text") == F.col("owner_name")) | labelled | identified) & once).select(*page, "owner_name").distinct()
    own = numbers.select(*page, account_no("number").alias("account_number")).where(F.col("account_number").rlike("^[0-9]{8,32}$")).distinct()
    choices = proved.join(own, page).groupBy(*DOCUMENT, "account_number").agg(F.count_distinct("owner_name").alias("_n"), F.min("owner_name").alias("owner_name")).where("_n = 1").drop("_n")
    met = rows.join(choices, [*DOCUMENT, "account_number"])
    combined = F.startswith("account_name", "owner_name") & after("account_name").rlike("^[0-9]{15,18}[Xx]?$")
    return met.where((text("account_name") == "") | combined).select(*DOCUMENT, "id", "owner_name")


def printed_owner_prefixes(rows: DataFrame, headers: DataFrame, inventory: DataFrame) -> DataFrame:
    """(document, id, full_number): rows whose owner column is clipped to 8 to 11 digits, with the one header number of the page that begins so.

    The number must own a row on another page and be an owner's identifier on another page of an inventory.
    rows: document, page, id, account_number, direct_owner. headers: document, page, text. inventory: document, page, number.
    """
    page = [*DOCUMENT, "page"]
    clipped = rows.where(F.col("direct_owner") & F.col("account_number").rlike("^[0-9]{8,11}$")).select(*page, "account_number").distinct()
    literal = F.regexp_extract_all("text", F.lit("(?<![0-9])([0-9]{12,32})(?![0-9])"))
    cells = headers.where(text("text") != "").select(*page, literal.alias("_literal"), account_no("text").alias("_read"))
    met = clipped.join(cells, page)
    fits = F.filter("_literal", lambda n: F.startswith(n, F.col("account_number")))
    read = F.when(F.col("_read").rlike("^[0-9]{12,32}$") & F.startswith("_read", "account_number"), F.array("_read")).otherwise(F.array().cast("array<string>"))
    choices = met.withColumn("_number", F.explode(F.when(F.size(fits) > 0, fits).otherwise(read))).groupBy(*page, "account_number").agg(F.count_distinct("_number").alias("_n"), F.min("_number").alias("full_number")).where("_n = 1").drop("_n")

    def elsewhere(t: DataFrame, number: str) -> DataFrame:
        spans = t.groupBy(*DOCUMENT, F.col(number).alias("full_number")).agg(F.min("page").alias("_first"), F.max("page").alias("_last"))
        return choices.join(spans, [*DOCUMENT, "full_number"]).where((F.col("_first") != F.col("page")) | (F.col("_last") != F.col("page"))).select(*page, "account_number", "full_number")

    sure = elsewhere(rows.where("direct_owner"), "account_number").join(elsewhere(inventory, "number"), [*page, "account_number", "full_number"])
    return rows.where("direct_owner").join(sure, [*page, "account_number"]).select(*DOCUMENT, "id", "full_number")


def _clamp(c: Column, low: float | Column = 0.0, high: float | Column = 1.0) -> Column:
    return F.greatest(F.lit(low) if isinstance(low, float) else low, F.least(F.lit(high) if isinstance(high, float) else high, c))


def source_regions(rows: DataFrame) -> DataFrame:
    """rows (document, page, row_index, seq, box, rotation) with region: x, y, width, height, origin, confidence.

    box is top, left, bottom, right in parts of the page or, if any exceeds one, of a thousand; null or tiny boxes give a
    band by the row's place on its page instead. Regions are turned by rotation, a multiple of 90; other angles don't turn.
    """
    place = Window.partitionBy(*DOCUMENT, "page")
    n, size = F.row_number().over(place.orderBy("row_index", "seq")) - 1, F.count("*").over(place)
    height = F.lit(P.PAGE_BODY) / size
    at = lambda i: F.get("box", F.lit(i))
    scale = F.when(F.array_max("box") > 1, 1000.0).otherwise(1.0)
    rows = rows.withColumns({"_x": _clamp(at(1) / scale), "_y": _clamp(at(0) / scale)}).withColumns({"_w": _clamp(at(3) / scale) - F.col("_x"), "_h": _clamp(at(2) / scale) - F.col("_y"), "_by": _clamp(F.lit(P.PAGE_HEAD) + n * height, 0.0, 0.96), "_bh": _clamp(height, 0.018, 0.09)})
    whole = (F.size("box") == 4) & ~F.exists("box", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    boxed = F.coalesce(whole & (F.col("_w") >= 0.03) & (F.col("_h") >= 0.005), F.lit(False))
    pick = lambda a, b: F.when(boxed, a).otherwise(b)
    rows = rows.withColumns({
        "_o": pick(F.lit("MODEL"), F.lit("ESTIMATED")), "_c": pick(F.lit(0.8), F.lit(0.25)),
        "_rx": pick(F.col("_x"), F.lit(0.025)), "_ry": pick(F.col("_y"), F.col("_by")), "_rw": pick(_clamp(F.col("_w"), 0.03, 1 - F.col("_x")), F.lit(0.95)), "_rh": pick(_clamp(F.col("_h"), 0.008, 1 - F.col("_y")), F.col("_bh"))})
    angle = F.pmod(F.coalesce("rotation", F.lit(0)), F.lit(360))
    x, y, w, h = (F.col(c) for c in ("_rx", "_ry", "_rw", "_rh"))
    turn = lambda plain, quarter, half, back: F.when(angle == 90, quarter).when(angle == 180, half).when(angle == 270, back).otherwise(plain)
    region = F.struct(
        turn(x, 1 - y - h, 1 - x - w, y).alias("x"), turn(y, x, 1 - y - h, 1 - x - w).alias("y"), turn(w, h, w, h).alias("width"), turn(h, w, h, w).alias("height"),
        F.col("_o").alias("origin"), F.col("_c").alias("confidence"))
    helpers = ["_x", "_y", "_w", "_h", "_by", "_bh", "_o", "_c", "_rx", "_ry", "_rw", "_rh"]
    return rows.withColumn("region", region).drop(*helpers)


def duplicate_views(rows: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """(document, account_kind, left_account, right_account, anchors, dates): an account's list and its pages that show the same rows.

    A stream is an account's rows whose owner stands in the row (left) or in the page's head (right). Anchors are rows
    with a date, direction, amount and balance that occur once in either stream; there must be three, of two dates, and
    four fifths of the shorter stream. rows has account_kind and direct_owner.
    """
    stream = [*DOCUMENT, "account_kind", "account_number", "direct_owner"]
    whole = rows.withColumn("_size", F.count("*").over(Window.partitionBy(*stream))).dropna(subset=SIGNATURE)
    once = whole.withColumn("_n", F.count("*").over(Window.partitionBy(*stream, *SIGNATURE))).where("_n = 1")
    side = lambda name, direct: once.where(F.col("direct_owner") == direct).select(*DOCUMENT, "account_kind", *SIGNATURE, F.col("account_number").alias(f"{name}_account"), F.col("_size").alias(f"_{name}"))
    met = side("left", True).join(side("right", False), [*DOCUMENT, "account_kind", *SIGNATURE])
    pairs = met.groupBy(*DOCUMENT, "account_kind", "left_account", "right_account", "_left", "_right").agg(F.count("*").alias("anchors"), F.countDistinct("transaction_date").alias("dates"))
    return pairs.where((F.col("anchors") >= least) & (F.col("dates") >= 2) & (F.col("anchors") >= share * F.least("_left", "_right"))).drop("_left", "_right")


def resolved_owners(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """(document, id, account_number, bank_name, outcome, bank_outcome, inventory_page): each row's account by its document's list of accounts.

    An account of the list with the row's number, else one of the same holder that ends with it after one to four more
    digits (twelve digits at least), replaces the number if it is the only one. Outcomes: EXACT, SUFFIX, AMBIGUOUS if
    several fit, NONE, or UNRELIABLE for numbers that are none. A bank that the row doesn't know is taken from the list
    (FILLED); one that differs becomes a placeholder for review (CONFLICT). Of several entries of one number that of the
    last page counts. Suffixes are joined on the holder and the last twelve digits.
    """
    unnamed = lambda c: (text(c) == "") | text(c).rlike(P.UNCONFIRMED)
    own = rows.select(*DOCUMENT, "id", "account_number", F.trim(text("account_name")).alias("_holder"), "bank_name", norm_part("account_number").alias("_n"), is_reliable_account("account_number").alias("_ok"))
    listed = inventory.select(*DOCUMENT, norm_part("account_number").alias("_full"), F.struct("page", "account_number", F.trim(text("account_name")).alias("holder"), "bank_name").alias("e"))
    latest = listed.groupBy(*DOCUMENT, "_full").agg(F.max("e").alias("e"))
    exact = own.where("_ok").join(latest.withColumn("_n", F.col("_full")), [*DOCUMENT, "_n"]).select(*DOCUMENT, "id", "_full", "e", F.lit("EXACT").alias("how"))
    tail = F.expr("right(_n, 12)")
    short = own.where(F.col("_ok") & F.col("_n").rlike("^[0-9]{12,}$") & ~unnamed("_holder")).join(exact.select(*DOCUMENT, "id"), [*DOCUMENT, "id"], "left_anti").withColumn("_tail", tail)
    longer = listed.groupBy(*DOCUMENT, "_full", F.col("e.holder").alias("_holder")).agg(F.max("e").alias("e"))
    # the digits before the tail lie in front of it, so the last twelve digits of both numbers are the same
    found = short.join(longer.withColumn("_tail", F.expr("right(_full, 12)")), [*DOCUMENT, "_holder", "_tail"]).where(F.endswith("_full", "_n") & (F.length("_full") - F.length("_n")).between(1, 4))
    found = exact.unionByName(found.select(*DOCUMENT, "id", "_full", "e", F.lit("SUFFIX").alias("how")))
    only = found.groupBy(*DOCUMENT, "id").agg(F.countDistinct("_full").alias("_k"), F.max("e").alias("e"), F.min("how").alias("how"))
    both = own.join(only, [*DOCUMENT, "id"], "left").withColumn("_hit", F.coalesce(F.col("_k") == 1, F.lit(False)))
    outcome = F.when(~F.col("_ok"), "UNRELIABLE").when(F.col("_k").isNull(), "NONE").when(F.col("_k") > 1, "AMBIGUOUS").otherwise(F.col("how"))
    blank = lambda c: (text(c) == "") | text(c).rlike(P.UNKNOWN_BANK)
    both = both.withColumn("_listed", F.col("e.bank_name"))
    bank = F.when(F.col("_hit") & blank("bank_name") & ~blank("_listed"), "FILLED").when(F.col("_hit") & ~blank("bank_name") & ~blank("_listed") & (header_bank("bank_name") != header_bank("_listed")), "CONFLICT")
    return both.withColumn("_bank", bank).select(
        *DOCUMENT, "id", F.when(F.col("_hit"), F.col("e.account_number")).otherwise(F.col("account_number")).alias("account_number"),
        F.when(F.col("_bank") == "FILLED", F.col("_listed")).when(F.col("_bank") == "CONFLICT", P.BANK_TO_CONFIRM).otherwise(F.col("bank_name")).alias("bank_name"),
        outcome.alias("outcome"), F.col("_bank").alias("bank_outcome"), F.when(F.col("_hit"), F.col("e.page")).alias("inventory_page"))
