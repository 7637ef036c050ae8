"""Operators on what supports a row: types by rules, aliases of accounts, shared sources, repairs proved by text, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns
from ..functions.identity import is_reliable_account, norm_part
from ..functions.money import bank_name, mentions, money, parse_date
from ..functions.printed import semantic_text
from .sequence import ACCOUNT, signed


def types_from_rules(rows: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """(key, type): the one type that rules (text, account_kind, type) give a row's descriptions; rows that match two types get none.

    rows has account_kind and descriptions, an array of texts; a rule of kind `any` holds for every account.
    """
    wanted = rows.select(key, "account_kind", F.explode(F.array_distinct(F.transform("descriptions", lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\\n|\s", "")))).alias("_text"))
    lean = rules.select(semantic_text("text").alias("_text"), F.col("account_kind").alias("_kind"), "type")
    hits = wanted.join(lean, "_text").where((F.col("_kind") == "any") | (F.col("_kind") == F.col("account_kind")))
    return hits.groupBy(key).agg(F.min("type").alias("type"), F.max("type").alias("_other")).where("type = _other").drop("_other")


def alias_accounts(accounts: DataFrame) -> DataFrame:
    """(case_id, source_document_id, account_number, canonical_number) of reliable numbers.

    A number of ten digits or more that a longer one of the same document ends with, up to four digits longer, stands
    for it, if only one is the longest. Blocked on the last ten digits.
    """
    keys = ["case_id", "source_document_id"]
    own = accounts.where(is_reliable_account("account_number")).select(*keys, norm_part("account_number").alias("number")).distinct()
    digits = own.where(F.col("number").rlike("^[0-9]{10,}$")).withColumn("tail", F.expr("right(number, 10)"))
    longer = digits.select(*keys, "tail", F.col("number").alias("long"))
    apart = F.length("long") - F.length("number")
    found = digits.join(longer, [*keys, "tail"]).where(apart.between(1, 4) & F.expr("endswith(long, number)"))
    best = found.withColumn("_n", F.length("long")).withColumn("_top", F.max("_n").over(Window.partitionBy(*keys, "number"))).where("_n = _top")
    only = best.groupBy(*keys, "number").agg(F.min("long").alias("long"), F.max("long").alias("_other")).where("long = _other").drop("_other")
    return own.join(only, [*keys, "number"], "left").select(*keys, F.col("number").alias("account_number"), F.coalesce("long", "number").alias("canonical_number"))


def near_duplicate_accounts(accounts: DataFrame, most: int = 2) -> DataFrame:
    """(case_id, bank, one, other, distance): numbers of 14 digits or more of one bank with the same last four, at most two edits apart."""
    own = accounts.where(F.col("account_number").rlike("^[0-9]{14,}$")).select("case_id", bank_name("bank_name").alias("bank"), F.expr("right(account_number, 4)").alias("_tail"), "account_number").distinct()
    one, other = own.withColumnRenamed("account_number", "one"), own.withColumnRenamed("account_number", "other")
    apart = F.levenshtein("one", "other", most)
    return one.join(other, ["case_id", "bank", "_tail"]).where("one < other").withColumn("distance", apart).where("distance >= 0").drop("_tail")


def source_overlap(alerts: DataFrame, rows: DataFrame, alert: str = "alert_id", row: str = "row_id", sources: str = "sources") -> DataFrame:
    """(alert, row): rows that share a source with an alert, each pair once."""
    a, b = (t.select(k, F.explode(F.array_distinct(sources)).alias("_source")) for t, k in ((alerts, alert), (rows, row)))
    return a.join(b, "_source").select(alert, row).distinct()


def evidence_gaps(hits: DataFrame, by: str = "case_id", checklist: str = "checklist") -> DataFrame:
    """The distinct items still to be verified over all hits."""
    return hits.select(by, F.explode(checklist).alias("gap")).distinct()


def summary_heals(txn: DataFrame, credit_cards: DataFrame) -> DataFrame:
    """(case_id, id, amount_cents, repaired_cents): amounts that were read from the summary while the printed line holds
    the one that the balances imply.

    Rows follow each other as printed in a document, across accounts; accounts of credit cards are left alone.
    """
    order = Window.partitionBy("case_id", "source_document_id").orderBy("page", "row_index", "seq")
    rows = txn.withColumn("_before", F.lag("balance_cents").over(order)).join(credit_cards.select(*ACCOUNT).distinct(), list(ACCOUNT), "left_anti")
    implied = F.when(F.col("direction") == "OUT", F.col("_before") - F.col("balance_cents")).when(F.col("direction") == "IN", F.col("balance_cents") - F.col("_before"))
    off = F.abs(F.col("_before") + signed() - F.col("balance_cents")) >= 100
    found = rows.withColumn("repaired_cents", implied).where(off & (F.col("repaired_cents") > 0))
    return found.where(mentions("summary", F.col("amount_cents")) & mentions("raw_text", F.col("repaired_cents"))).select("case_id", "id", "amount_cents", "repaired_cents")


def interest_chain_directions(txn: DataFrame) -> DataFrame:
    """(case_id, id): interest rows of unknown direction that came in, as the whole account proves.

    The account is a deposit of three rows at least, each of another day, and every balance follows from the one before.
    """
    order = Window.partitionBy(*ACCOUNT).orderBy("transaction_date", "seq")
    interest = F.coalesce(F.col("summary").rlike(patterns.DEPOSIT_INTEREST), F.lit(False))
    told = F.col("direction").isin("IN", "OUT")
    adds = F.when(F.col("direction") == "OUT", -F.col("amount_cents")).otherwise(F.col("amount_cents"))
    sound = (F.col("account_kind") == "deposit") & (told | interest) & F.col("amount_cents").isNotNull() & F.col("balance_cents").isNotNull()
    follows = (F.lag("transaction_date").over(order) < F.col("transaction_date")) & (F.lag("balance_cents").over(order) + adds == F.col("balance_cents"))
    first = F.row_number().over(order) == 1
    rows = txn.withColumn("_ok", F.coalesce(sound & (first | follows), F.lit(False)))
    whole = Window.partitionBy(*ACCOUNT)
    return rows.withColumns({"_all": F.min("_ok").over(whole), "_n": F.count("*").over(whole)}).where(F.col("_all") & (F.col("_n") >= 3) & ~told).select("case_id", "id")


def row_pairs(rows: DataFrame, table: list[str]) -> DataFrame:
    """(table, first_row, second_row) of tables in which, from the first row on, a row with a date and an amount and one without alternate.

    rows has row_no, date_text and amount_text; ignored rows are to be left out before. Tables that don't alternate
    throughout, or have an odd number of rows, give nothing.
    """
    begins = parse_date("date_text").isNotNull() & (money("amount_text")["state"] == "value")
    order, whole = Window.partitionBy(*table).orderBy("row_no"), Window.partitionBy(*table)
    placed = rows.withColumns({"_at": F.row_number().over(order), "_n": F.count("*").over(whole), "_begins": begins})
    checked = placed.withColumn("_ok", F.min(F.col("_begins") == (F.col("_at") % 2 == 1)).over(whole)).withColumn("second_row", F.lead("row_no").over(order))
    return checked.where(F.col("_ok") & (F.col("_n") % 2 == 0) & (F.col("_at") % 2 == 1)).select(*table, F.col("row_no").alias("first_row"), "second_row")


def business_accounts(accounts: DataFrame) -> DataFrame:
    """accounts without those that only hold pages still to be assigned."""
    placeholder = (F.col("owner_type") == "UNKNOWN") & (F.col("account_number").rlike(patterns.UNASSIGNED_PAGES) | (F.col("account_name") == patterns.UNASSIGNED_NAME))
    return accounts.where(~F.coalesce(placeholder, F.lit(False)))


def blocking_issues(issues: DataFrame) -> DataFrame:
    """Issues that stop a case: required ones on whole pages, still open, whose text tells of a hard failure."""
    words = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    return issues.where((F.col("category") == "PAGE_INTEGRITY") & (F.col("severity") == "REQUIRED") & F.col("status").isin("PENDING", "UNRESOLVED") & words.rlike(patterns.HARD_FAILURE))


def incomplete_pages(warnings: DataFrame, by: list[str]) -> DataFrame:
    """(by, page): pages whose warnings tell of a hard failure, each once; the first page that a warning names."""
    page = F.regexp_extract("warning", r"第\s*([0-9]+)\s*页", 1).try_cast("int")
    return warnings.where(F.col("warning").rlike(patterns.HARD_FAILURE)).select(*by, page.alias("page")).where("page > 0").distinct()


def page_blank_decision(pages: DataFrame) -> DataFrame:
    """pages with pixel_blank, blank_confirmed, clockwise_rotation and orientation_uncertain, from page_kind, dark fractions and upright candidate."""
    pixels = (F.col("dark_160") <= 0.00005) & (F.col("dark_210") <= 0.0001)
    blank = F.col("page_kind") == "blank"
    turn = F.array_position(F.array(*[F.lit(x) for x in "ABCD"]), F.col("upright")) - 1
    known = F.coalesce(turn >= 0, F.lit(False))
    return pages.withColumns({"pixel_blank": pixels, "blank_confirmed": blank & pixels & ~F.col("has_text"), "clockwise_rotation": F.when(blank | ~known, 0).otherwise(turn * 90).cast("int"), "orientation_uncertain": ~blank & ~known})


def timeline_problems(cases: DataFrame) -> DataFrame:
    """(case_id, problem): missing milestones; if none is missing, pairs in the wrong order."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), label) for c, label in patterns.MILESTONES]))
    wrong = F.array_compact(F.array(*[F.when(F.col(a) > F.col(b), f"{a}>{b}") for a, b in patterns.MILESTONE_ORDER]))
    return cases.select("case_id", F.explode(F.when(F.size(missing) > 0, missing).otherwise(wrong)).alias("problem"))


def dataset_summary(pages: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: pages by type, rows, accounts, and pages of pages that are not among those done."""
    left = pages.join(done.select(*keys, "page").distinct().withColumn("_done", F.lit(True)), [*keys, "page"], "left")
    kind = F.coalesce("page_type", F.lit("UNKNOWN"))
    return left.groupBy(*keys).agg(
        F.count("*").alias("n_pages"), F.count_if(kind == "BLANK").alias("blank_pages"), F.count_if(kind == "STATEMENT").alias("statement_pages"),
        F.count_if(kind == "UNKNOWN").alias("unknown_pages"), F.sum("n_rows").alias("n_rows"), F.countDistinct("account").alias("n_accounts"), F.count_if(F.col("_done").isNull()).alias("pending_pages"),
    )
