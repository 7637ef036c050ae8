"""Operators on pages of scanned documents: segments, bank runs, batches, groups, identities of pages."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns
from ..functions.money import bank_key

DOCUMENT = ("case_id", "document_id")


def _pages(*by: str) -> Window:
    return Window.partitionBy(*DOCUMENT).orderBy(*(by or ("page",)))


def page_profile(txn: DataFrame) -> DataFrame:
    """One row per printed page: rows, accounts on it, its account and bank if there is only one."""
    only = lambda c: F.when(F.countDistinct(c) == 1, F.min(c))
    return txn.groupBy("case_id", F.col("source_document_id").alias("document_id"), "page").agg(
        F.count("*").alias("n_rows"), F.countDistinct("account_number").alias("n_accounts"), only("account_number").alias("account"), only("bank_name").alias("bank"), F.count("balance_cents").alias("n_balances"),
    )


def logical_segments(pages: DataFrame) -> DataFrame:
    """pages with segment: a new one where bank or account changes; pages without identity belong to those before."""
    known = F.concat_ws("|", "bank", "account")
    identity = F.when(F.col("bank").isNotNull() & F.col("account").isNotNull(), known)
    filled = pages.withColumn("_id", F.last(identity, True).over(_pages().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    change = F.coalesce((F.lag("_id").over(_pages()) != F.col("_id")).cast("int"), F.lit(0))
    return filled.withColumn("_new", change).withColumn("segment", F.sum("_new").over(_pages().rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_id", "_new")


def segment_fill(segmented: DataFrame) -> DataFrame:
    """One row per segment: span and the bank that most of its rows show (ties: by name)."""
    votes = segmented.where("bank is not null").groupBy(*DOCUMENT, "segment", "bank").agg(F.sum("n_rows").alias("_v"))
    best = votes.groupBy(*DOCUMENT, "segment").agg(F.min_by("bank", F.struct(-F.col("_v"), "bank")).alias("segment_bank"))
    spans = segmented.groupBy(*DOCUMENT, "segment").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_pages"), F.sum("n_rows").alias("n_rows"))
    return spans.join(best, [*DOCUMENT, "segment"], "left")


def bank_runs(pages: DataFrame) -> DataFrame:
    """Runs of following pages of one bank; a page without a bank takes that of its neighbours if they agree, else stays alone."""
    before = F.last("bank", True).over(_pages().rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("bank", True).over(_pages().rowsBetween(1, Window.unboundedFollowing))
    filled = pages.withColumn("run_bank", F.coalesce("bank", F.when(before == after, before), F.lit("UNKNOWN")))
    new = F.coalesce((F.lag("run_bank").over(_pages()) != F.col("run_bank")) | (F.col("page") - F.lag("page").over(_pages()) != 1), F.lit(True))
    runs = filled.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(_pages().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*DOCUMENT, "run", "run_bank").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page")).drop("run")


def bank_group_problems(groups: DataFrame, documents: DataFrame) -> DataFrame:
    """Problems of a split of documents (pages 1 to n_pages) into groups (group_no, bank, pages): missing, duplicate and
    unknown pages, groups with gaps, groups without a bank."""
    pages = groups.select(*DOCUMENT, "group_no", F.explode("pages").alias("page"))
    every = documents.select(*DOCUMENT, F.explode(F.sequence(F.lit(1), "n_pages")).alias("page"))
    counts = pages.groupBy(*DOCUMENT, "page").agg(F.count("*").alias("_n"))
    missing = every.join(counts, [*DOCUMENT, "page"], "left_anti").select(*DOCUMENT, F.lit("MISSING_PAGE").alias("problem"), F.col("page").alias("at"))
    twice = counts.where("_n > 1").select(*DOCUMENT, F.lit("DUPLICATE_PAGE").alias("problem"), F.col("page").alias("at"))
    strange = counts.join(every, [*DOCUMENT, "page"], "left_anti").select(*DOCUMENT, F.lit("UNKNOWN_PAGE").alias("problem"), F.col("page").alias("at"))
    spans = pages.groupBy(*DOCUMENT, "group_no").agg((F.max("page") - F.min("page") + 1).alias("_span"), F.countDistinct("page").alias("_k"))
    gaps = spans.where("_span <> _k").select(*DOCUMENT, F.lit("NOT_CONTIGUOUS").alias("problem"), F.col("group_no").alias("at"))
    unnamed = groups.where("coalesce(trim(bank), '') = ''").select(*DOCUMENT, F.lit("UNNAMED_GROUP").alias("problem"), F.col("group_no").alias("at"))
    return missing.unionByName(twice).unionByName(strange).unionByName(gaps).unionByName(unnamed)


def extraction_batches(pages: DataFrame, target: int = 180) -> DataFrame:
    """pages with batch: per segment, filled in order until a page would push the estimated rows over the target.

    pages has segment, estimated_rows and pending; batches without a pending page are left out. The target is 40 at
    least. A fold over each segment's pages carries the running total; a segment's list of page costs is short.
    """
    most = max(40, target)
    lists = pages.groupBy(*DOCUMENT, "segment").agg(F.array_sort(F.collect_list(F.struct("page", F.col("estimated_rows").cast("int").alias("c"), "pending"))).alias("ps"))
    fold = f"""aggregate(ps, named_struct('sum', 0, 'k', 0, 'no', 0, 'out', cast(array() as array<struct<page:int,batch:int,pending:boolean>>)), (s, x) ->
      if(s.k > 0 and s.sum + x.c > {most}, named_struct('sum', x.c, 'k', 1, 'no', s.no + 1, 'out', array_append(s.out, named_struct('page', x.page, 'batch', s.no + 1, 'pending', x.pending))),
         named_struct('sum', s.sum + x.c, 'k', s.k + 1, 'no', s.no, 'out', array_append(s.out, named_struct('page', x.page, 'batch', s.no, 'pending', x.pending))))).out"""
    dealt = lists.select(*DOCUMENT, "segment", F.expr(fold).alias("all")).withColumn("x", F.explode("all"))
    useful = F.exists("all", lambda y: (y["batch"] == F.col("x.batch")) & y["pending"])
    return dealt.where(useful).select(*DOCUMENT, "segment", "x.page", "x.batch")


def page_identity_fill(txn: DataFrame) -> DataFrame:
    """Rows without an account get the page's only one, else the one that the pages before and after agree on."""
    docs = txn.withColumn("document_id", F.col("source_document_id"))
    per = docs.groupBy(*DOCUMENT, "page").agg(F.when(F.countDistinct("account_number") == 1, F.min("account_number")).alias("page_account"), F.countDistinct("account_number").alias("_k"))
    before, after = F.lag("page_account").over(_pages()), F.lead("page_account").over(_pages())
    filled = per.withColumn("fill", F.coalesce("page_account", F.when((F.col("_k") == 0) & (before == after), before)))
    return docs.where("account_number is null").join(filled.select(*DOCUMENT, "page", "fill"), [*DOCUMENT, "page"], "left").select("case_id", "id", "page", F.col("fill").alias("filled_account"))


def page_context(pages: DataFrame, k: int = 2) -> DataFrame:
    """For each page with one account, the k nearest other pages of its document with the same account, at any distance.

    Only accounts of 12 to 32 digits are keys, as shorter ones can be of several banks. An account whose pages name
    different banks gives none of them context. The nearest are among the k before and the
    k after, so no pages are joined.
    """
    account = Window.partitionBy(*DOCUMENT, "account")
    name = bank_key("bank")
    named = F.when(name != "", name)
    agreed = pages.where(F.col("account").rlike("^[0-9]{12,32}$")).withColumns({"_least": F.min(named).over(account), "_most": F.max(named).over(account)}).where("_least is null or _least = _most")
    around = account.orderBy("page")
    others = F.array_compact(F.array(*[f("page", i).over(around) for i in range(1, k + 1) for f in (F.lag, F.lead)]))
    pairs = agreed.withColumn("_others", others).select("case_id", "document_id", "account", "page", F.explode("_others").alias("context_page")).withColumn("distance", F.abs(F.col("page") - F.col("context_page")))
    order = Window.partitionBy(*DOCUMENT, "account", "page").orderBy("distance", "context_page")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dominant_banks(segmented: DataFrame, least: float = 0.45) -> DataFrame:
    """Bank of each segment by votes weighted with confidence; unsure pages don't vote. Forms of a name vote together, the longest stands for them."""
    sure = segmented.where((F.coalesce(F.trim("bank"), F.lit("")) != "") & (F.col("confidence") >= least)).withColumn("_key", bank_key("bank"))
    votes = sure.groupBy(*DOCUMENT, "segment", "_key").agg(F.sum(F.greatest(F.lit(0.25), F.col("confidence"))).alias("weight"), F.max_by("bank", F.struct(F.length("bank"), "bank")).alias("bank"))
    return votes.groupBy(*DOCUMENT, "segment").agg(F.max_by(F.struct("bank", "weight"), F.struct("weight", "_key")).alias("x")).select(*DOCUMENT, "segment", "x.bank", "x.weight")


def estimated_rows() -> Column:
    """How many rows a page of a type and density (HIGH, MEDIUM, LOW) may hold; 12 if nothing is known of it."""
    kind = F.col("page_type")
    by_density = F.when(F.col("density") == "HIGH", 40).when(F.col("density") == "MEDIUM", 20).otherwise(8)
    return F.when(kind.isNull() | (kind == "UNKNOWN"), 12).when(kind == "BLANK", 0).when(kind.isin(*patterns.FEW_ROWS_PAGES), 2).otherwise(by_density)


def page_completeness(pages: DataFrame, declared: DataFrame) -> DataFrame:
    """Per page: how the rows returned compare with the count declared, and whether that blocks the document."""
    both = declared.join(pages.select(*DOCUMENT, "page", "n_rows", "n_balances"), [*DOCUMENT, "page"], "left")
    got = F.coalesce("n_rows", F.lit(0))
    flags = F.array_compact(F.array(
        F.when((F.col("declared_rows") > 0) & (got == 0), "TRANSACTION_PAGE_EMPTY"), F.when((got > 0) & (got < F.col("declared_rows")), "MISSING_ROWS"),
        F.when(F.coalesce("n_balances", F.lit(0)) < got, "UNCERTAIN_FIELDS"),
    ))
    return both.select(*DOCUMENT, "page", F.array_join(flags, ",").alias("flags"), (F.array_contains(flags, "TRANSACTION_PAGE_EMPTY") | F.array_contains(flags, "MISSING_ROWS")).alias("blocking"))


def best_page_results(readings: DataFrame) -> DataFrame:
    """Of several readings of a page the one without, then with the least gap to the declared count, then most rows, then confidence."""
    gap = F.abs(F.col("declared_rows") - F.col("n_rows"))
    best = F.max_by(F.struct("reading_id", "n_rows"), F.struct((gap == 0), -gap, "n_rows", "confidence", -F.col("reading_id")))
    return readings.groupBy(*DOCUMENT, "page").agg(best.alias("x")).select(*DOCUMENT, "page", "x.reading_id", "x.n_rows")


def latest_runs(pages: DataFrame) -> DataFrame:
    """Rows of each document's latest run, and of each page its last checkpoint."""
    last = F.max(F.struct("run_at", "run_id")).over(Window.partitionBy(*DOCUMENT))
    kept = pages.withColumn("_last", last).where((F.col("run_id") == F.col("_last.run_id")) & (F.col("run_at") == F.col("_last.run_at"))).drop("_last")
    order = Window.partitionBy(*DOCUMENT, "page").orderBy(F.desc("arrival"))
    return kept.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def statement_groups(pages: DataFrame) -> DataFrame:
    """(document, page, statement_page, conflict, needs_review): the page each statement begins with.

    A page of transactions continues the statement before only with that page's neighbour, at 0.9 confidence on both
    sides, no issues, words quoted from both pages, one account at most and no other bank or account than the group's.
    A continuation that conflicts is an issue of its page. Pages described twice are of unknown type.
    pages: document, page, type, relation, confidence, n_issues, bank, accounts, quoted_pages (arrays). A document's pages
    are walked in order once, in one task that holds a batch of them; the walk carries the group's bank and accounts,
    which conflicts may replace.
    """
    doc = ["case_id", "source_document_id"]
    head = [*doc, "page"]

    def plain(column: pa.Array) -> list:
        return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()

    def lists(column: pa.Array) -> list[list]:
        values, ends = plain(column.values), column.offsets.to_pylist()
        return [values[a:b] for a, b in pairwise(ends)]

    def walk(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last, start, led, bank, accounts = None, None, None, False, "", ()
        for table in tables:
            kept, starts, conflicts, doubts = [], [], [], []
            for i, (case, document, page, ready, leads, asks, unknown, issues, own_bank, own) in enumerate(zip(*[plain(c) for c in table.columns[:-1]], lists(table.columns[-1]), strict=True)):
                if (case, document) != of:
                    of, start, led, bank, accounts = (case, document), None, False, "", ()
                elif page == last:
                    continue
                clash = bool(bank and own_bank and bank != own_bank) or bool(own and accounts and not set(accounts).issuperset(own))
                goes_on = ready and led and last == page - 1 and len(accounts) <= 1 and not clash
                conflict = clash and asks
                start = start if goes_on else page
                bank, accounts = bank if goes_on and bank else own_bank, accounts if goes_on and accounts else own
                last, led = page, leads and not conflict
                kept.append(i)
                starts.append(start)
                conflicts.append(conflict)
                doubts.append((unknown and not goes_on) or not own or issues or conflict)
            told = [*table.select(head).take(pa.array(kept, pa.int32())).columns, pa.array(starts, pa.int64()), pa.array(conflicts, pa.bool_()), pa.array(doubts, pa.bool_())]
            yield pa.RecordBatch.from_arrays(told, [*head, "statement_page", "conflict", "doubt"])

    accounts = F.array_distinct(F.coalesce("accounts", F.array().cast("array<string>")))
    sure = F.coalesce((F.col("confidence") >= 0.9) & (F.col("n_issues") == 0), F.lit(False))
    ready = sure & (F.col("type") == "TRANSACTIONS") & (F.col("relation") == "CONTINUE") & F.array_contains("quoted_pages", F.col("page")) & F.array_contains("quoted_pages", F.col("page") - 1) & (F.size(accounts) <= 1)
    once = {
        "ready": (ready, F.lit(False)), "leads": (sure & F.col("type").isin("TRANSACTIONS", "ACCOUNT_INFO"), F.lit(False)), "asks": (F.col("relation") == "CONTINUE", F.lit(False)), "unknown": (F.col("type") == "UNKNOWN", F.lit(True)),
        "issues": (F.col("n_issues") > 0, F.lit(True)), "bank": (bank_key("bank"), F.lit("")), "accounts": (accounts, F.array().cast("array<string>"))}
    marked = pages.select(*doc, F.col("page").cast("long").alias("page"), *[(own if name in ("bank", "accounts") else F.coalesce(own, F.lit(False))).alias(name) for name, (own, _) in once.items()]).repartition(*doc)
    known = marked.withColumn("_n", F.count("*").over(Window.partitionBy(*head))).select(*head, *[F.when(F.col("_n") == 1, F.col(name)).otherwise(twice).alias(name) for name, (_, twice) in once.items()])
    kinds = dict(pages.dtypes)
    found = known.sortWithinPartitions(*head).mapInArrow(walk, ", ".join(f"{c} {kinds[c]}" for c in doc) + ", page long, statement_page long, conflict boolean, doubt boolean")
    return found.withColumn("needs_review", F.max("doubt").over(Window.partitionBy(*doc, "statement_page"))).drop("doubt")
