"""Reading and writing statements: 12-column CSV, free-form CSV, HTML tables, page blocks, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identity import text
from ..functions.money import account_no, money, money_loose, parse_date

#: the twelve columns, in their order
COLUMNS = ("accountNumber", "accountName", "bankName", "transactionTime", "transactionDate", "direction", "amount", "balance", "transactionType", "counterpartyName", "counterpartyAccount", "counterpartyBank")

#: field, words in a header, words that rule a header out; tried in this order
HEADERS = (
    ("date", "交易日期|交易日|记账日期|入账日期|发生日期|账务日期|日期|交易时间|date", "对方"),
    ("credit", "收入|存入|贷方|转入|入账金额", "对方"),
    ("debit", "支出|支取|借方|转出|付出金额|取出金额", "对方"),
    ("amount", "交易金额|发生额|金额|amount", "对方"),
    ("balance", "余额|balance", "对方"),
    ("party_account", "对方账号|对手账号|对方账户|收款人账号|付款人账号", "(?!)"),
    ("party_name", "对方户名|对手户名|对方名称|对手方名称|对手名称|收款人名称|付款人名称|对方", "账号|账户|银行|行名|开户行"),
    ("summary", "摘要|用途|附言|备注|交易说明", "(?!)"),
)


def read_standard_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of 12-column CSV files with a header.

    A file whose header isn't exact is rejected whole; so is a row with malformed or negative money or a direction
    other than IN, OUT or none. Blank rows go. Invalid dates stay, marked; an empty balance is no balance.
    """
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    raw = spark.read.csv(path, schema=schema + ", _corrupt string", header=False, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").withColumn("file", F.col("_metadata.file_path"))
    head = F.regexp_replace(text("accountNumber"), "^﻿", "")
    is_header = (head == COLUMNS[0]) & (F.concat_ws(",", *COLUMNS[1:]) == ",".join(COLUMNS[1:])) & F.col("_corrupt").isNull()
    good_files = raw.where(is_header).select("file").distinct().withColumn("_good", F.lit(True))
    rows = raw.where(~is_header & ((F.concat_ws("", *COLUMNS) != "") | F.col("_corrupt").isNotNull())).join(good_files, "file", "left")
    read = rows.withColumns({"_amount": money("amount"), "_balance": money("balance"), "_direction": F.trim(text("direction"))})
    why = (
        F.when(F.col("_good").isNull(), "HEADER").when(F.col("_corrupt").isNotNull(), "COLUMN_COUNT").when(F.col("_amount.state") != "value", "AMOUNT").when(F.col("_amount.cents") < 0, "NEGATIVE_AMOUNT")
        .when(F.col("_balance.state") == "unreadable", "BALANCE").when(~F.col("_direction").isin("IN", "OUT", ""), "DIRECTION")
    )
    read = read.withColumn("reason", why)
    date = parse_date("transactionDate")
    flags = F.array_compact(F.array(F.when(date.isNull(), "INVALID_DATE"), F.when(F.col("_direction") == "", "INVALID_DIRECTION")))
    typed = read.where("reason is null").select(
        "file", F.col("accountNumber").alias("account_number"), F.col("accountName").alias("account_name"), F.col("bankName").alias("bank_name"), F.col("transactionTime").alias("transaction_time"), date.alias("transaction_date"),
        F.when(F.col("_direction") == "", "UNKNOWN").otherwise(F.col("_direction")).alias("direction"), F.col("_amount.cents").alias("amount_cents"), F.col("_balance.cents").alias("balance_cents"), F.col("transactionType").alias("transaction_type"),
        F.col("counterpartyName").alias("counterparty_name"), F.col("counterpartyAccount").alias("counterparty_account"), F.col("counterpartyBank").alias("counterparty_bank"), flags.alias("data_quality_issues"),
    )
    return typed, read.where("reason is not null").select("file", "reason", *COLUMNS)


def statement_values(txn: DataFrame) -> DataFrame:
    """The twelve columns as text, empty where a value isn't there."""
    cents = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%s%d.%02d", F.when(F.col(c) < 0, "-").otherwise(""), F.floor(F.abs(c) / 100).cast("long"), F.abs(c) % 100)).otherwise("")
    have = set(txn.columns)
    some = lambda c: text(c) if c in have else F.lit("")
    values = (some("account_number"), some("account_name"), some("bank_name"), F.coalesce(F.nullif(some("transaction_time"), F.lit("")), F.coalesce(F.col("transaction_date").cast("string"), F.lit(""))), F.coalesce(F.col("transaction_date").cast("string"), F.lit("")),
              F.when(F.col("direction").isin("IN", "OUT"), F.col("direction")).otherwise(""), cents("amount_cents"), cents("balance_cents"), some("transaction_type"), some("counterparty_name"), some("counterparty_account"), some("counterparty_bank"))
    return txn.select(*[v.alias(c) for v, c in zip(values, COLUMNS, strict=True)])


def header_fields(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_no, field, col_no): of a table's first rows, those that look like a header, with its columns.

    cells: keys, row_no, col_no, text. A row is the header if it names a date and an amount, credit or debit; the
    first of them counts. Of several columns for a field the leftmost does.
    """
    named = F.explode(F.array_compact(F.array(*[F.when(F.lower("text").rlike(words) & ~F.lower("text").rlike(no), F.lit(field)) for field, words, no in HEADERS])))
    hits = cells.where("row_no < 25").select(*keys, "row_no", "col_no", named.alias("field")).groupBy(*keys, "row_no", "field").agg(F.min("col_no").alias("col_no"))
    rows = hits.groupBy(*keys, "row_no").agg(F.bool_or(F.col("field") == "date").alias("_d"), F.bool_or(F.col("field").isin("amount", "credit", "debit")).alias("_a")).where("_d and _a")
    first = rows.groupBy(*keys).agg(F.min("row_no").alias("row_no"))
    return hits.join(first, [*keys, "row_no"])


def table_kind(cells: DataFrame, keys: list[str]) -> DataFrame:
    """TRANSACTIONS, ACCOUNT_LIST or OTHER for each table."""
    heads = header_fields(cells, keys).select(*keys).distinct().withColumn("_t", F.lit(True))
    lists = cells.groupBy(*keys).agg(F.bool_or(text("text").rlike("账号|卡号")).alias("_l"))
    return lists.join(heads, keys, "left").select(*keys, F.when(F.col("_t"), "TRANSACTIONS").when(F.col("_l"), "ACCOUNT_LIST").otherwise("OTHER").alias("kind"))


def rows_from_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Typed rows of the tables that have a header: date, direction, cents; rows without a date or an amount go."""
    heads = header_fields(cells, keys).withColumnRenamed("row_no", "head_row")
    body = cells.join(heads, [*keys, "col_no"]).where("row_no > head_row")
    wide = body.groupBy(*keys, "row_no").pivot("field", [h[0] for h in HEADERS]).agg(F.first("text"))
    credit, debit, plain = money_loose("credit"), money_loose("debit"), money_loose("amount")
    side = F.when(credit != 0, "IN").when(debit != 0, "OUT").when(plain < 0, "OUT").when(plain > 0, "IN")
    typed = wide.select(*keys, "row_no", parse_date("date").alias("transaction_date"), side.alias("direction"), F.abs(F.when(credit != 0, credit).when(debit != 0, debit).otherwise(plain)).alias("amount_cents"),
                        F.when(text("balance") != "", money_loose("balance")).alias("balance_cents"), F.col("party_account").alias("counterparty_account"), F.col("party_name").alias("counterparty_name"), "summary")
    return typed.where("transaction_date is not null and amount_cents > 0")


def read_ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of free-form CSV files: a preamble, a header somewhere in the first 25 lines, columns in any order."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), F.regexp_replace("value", "^﻿", "").alias("line"))
    order = Window.partitionBy("file").orderBy("_b", "_i")
    numbered = lines.withColumn("row_no", F.row_number().over(order) - 1)
    cells = numbered.select("file", "row_no", F.posexplode(F.split("line", ',(?=(?:[^"]*"[^"]*")*[^"]*$)')).alias("col_no", "text"))
    cells = cells.withColumn("text", F.trim(F.regexp_replace(F.regexp_replace("text", '^\\s*"|"\\s*$', ""), '""', '"')))
    preamble = cells.where("row_no < 25").groupBy("file").agg(F.first(F.when(text("text").rlike("账号|卡号"), account_no(F.regexp_replace("text", "^.*?[:：]", ""))), True).alias("account_number"), F.first(F.when(text("text").rlike("户名|客户名称"), F.trim(F.regexp_replace("text", "^.*?[:：]", ""))), True).alias("account_name"))
    return rows_from_tables(cells, ["file"]).join(preamble, "file", "left")


def extract_html_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table_no, row_no, col_no, text): the cells of all tables; a cell that spans columns is followed by empty ones."""
    grab = lambda c, tag: F.regexp_extract_all(c, F.lit(f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    tables = pages.select(key, F.posexplode(grab(F.col(html), "table")).alias("table_no", "_t"))
    rows = tables.select(key, "table_no", F.posexplode(grab(F.col("_t"), "tr")).alias("row_no", "_r"))
    whole = F.regexp_extract_all("_r", F.lit(r"(?is)(<t[dh]\b[^>]*>.*?</t[dh]>)"), F.lit(1))
    cells = rows.select(key, "table_no", "row_no", F.posexplode(whole).alias("_n", "_c"))
    span = F.least(F.greatest(F.coalesce(F.regexp_extract("_c", r'(?is)^<t[dh]\b[^>]*colspan\s*=\s*"?([0-9]{1,3})', 1).try_cast("int"), F.lit(1)), F.lit(1)), F.lit(100))
    plain = F.regexp_replace(F.regexp_replace("_c", r"(?is)<br\s*/?>", "\n"), r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    wide = cells.select(key, "table_no", "row_no", "_n", F.trim(plain).alias("_v"), span.alias("_s"))
    start = F.coalesce(F.sum("_s").over(Window.partitionBy(key, "table_no", "row_no").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = wide.withColumn("_at", start).select(key, "table_no", "row_no", "_at", F.posexplode(F.concat(F.array("_v"), F.array_repeat(F.lit(""), F.col("_s") - 1))).alias("_k", "text"))
    return spread.select(key, "table_no", "row_no", (F.col("_at") + F.col("_k")).cast("int").alias("col_no"), "text")


def read_structured_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks (file, page, block_no, type, text, table_html) of page JSON: a list, or pages or pdf_info with blocks; pages from 1."""
    block = "struct<type:string,text:string,table_body:string,page_idx:int>"
    page = f"struct<page_index:int,page_idx:int,blocks:array<{block}>>"
    schema = f"pages array<{page}>, pdf_info array<{page}>"
    raw = spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    pages = raw.select("file", F.posexplode(F.coalesce("pages", "pdf_info")).alias("_n", "p"))
    blocks = pages.select("file", (F.coalesce("p.page_index", "p.page_idx", "_n") + 1).alias("page"), F.posexplode("p.blocks").alias("block_no", "b"))
    return blocks.select("file", "page", "block_no", F.col("b.type").alias("type"), F.trim(text("b.text")).alias("text"), F.col("b.table_body").alias("table_html"))


def build_source_registry(cells: DataFrame, document: str, page: str) -> DataFrame:
    """cells with row and cell ids made of their natural place, counted from one."""
    place = lambda *cols: F.concat_ws("_", F.col(document).cast("string"), *[F.concat(F.lit(p), (F.col(c) + n).cast("string")) for p, c, n in cols])
    row = [("P", page, 0), ("T", "table_no", 1), ("R", "row_no", 1)]
    return cells.withColumns({"row_id": place(*row), "cell_id": place(*row, ("C", "col_no", 1))})


def identify_sources(spark: SparkSession, path: str) -> DataFrame:
    """(file, document_id, bytes): the id is the digest of a file's bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), F.concat(F.lit("DOC_"), F.sha2("content", 256)).alias("document_id"), F.col("length").alias("bytes"))


def attach_provenance(txn: DataFrame, document: str, run: str) -> DataFrame:
    """txn with document, run, an observation id from its place, and the fields as they were read."""
    ident = F.format_string("TX_%s_P%d_R%d_%s", F.right(F.regexp_replace(text(document), "[^A-Za-z0-9]", ""), F.lit(12)), F.coalesce("page", F.lit(0)), F.coalesce("row_index", F.lit(0)).cast("long"), F.col("id"))
    fields = ("transaction_date", "direction", "amount_cents", "balance_cents", "counterparty_name", "counterparty_account")
    evidence = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.struct(F.col(f).cast("string").alias("original"), F.col(f).cast("string").alias("current"), F.lit("EXTRACTED").alias("origin")) for f in fields]))
    return txn.withColumns({"extraction_run_id": F.lit(run), "observation_id": ident, "field_evidence": evidence})


def replace_document_version(stored: DataFrame, new: DataFrame, document: str = "source_document_id") -> DataFrame:
    """stored without the documents that new brings again, and new."""
    return stored.join(new.select("case_id", document).distinct(), ["case_id", document], "left_anti").unionByName(new)


def source_row_counts(documents: DataFrame, txn: DataFrame) -> DataFrame:
    """Rows of each document; 0 for those without any."""
    counts = txn.groupBy("case_id", "source_document_id").agg(F.count("*").alias("n_rows"))
    return documents.join(counts, ["case_id", "source_document_id"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def remap_source_pages(txn: DataFrame, pages: DataFrame) -> DataFrame:
    """txn with page numbers of a part replaced by those of the whole document. pages: source_document_id, page, original_page."""
    return txn.join(pages, ["source_document_id", "page"], "left").withColumn("page", F.coalesce("original_page", "page")).drop("original_page")


def merge_page_context(pages: DataFrame, additions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with distinct heading lines added, refused additions): an addition may hold no table and must name a page."""
    lines = lambda c: F.filter(F.transform(F.split(text(c), "\n"), F.trim), lambda x: x != "")
    joined = additions.join(pages.select("document_id", "page").withColumn("_known", F.lit(True)), ["document_id", "page"], "left")
    bad = F.col("_known").isNull() | text("addition").rlike("(?i)<table")
    good = joined.where(~bad).select("document_id", "page", "addition")
    merged = pages.join(good, ["document_id", "page"], "left").withColumn("text", F.array_join(F.array_union(lines("text"), lines("addition")), "\n")).drop("addition")
    return merged, joined.where(bad).select("document_id", "page", "addition")


def source_locations(hits: DataFrame, txn: DataFrame) -> DataFrame:
    """Places of each rule hit's rows as one text. hits: case_id, match_id, transaction_ids."""
    rows = hits.select("case_id", "match_id", F.explode("transaction_ids").alias("id")).join(txn.select("case_id", "id", "source_document_id", "page", "row_index"), ["case_id", "id"])
    place = F.format_string("%s 第%d页 / 第%d行", F.col("source_document_id"), F.col("page"), F.col("row_index").cast("long"))
    return rows.groupBy("case_id", "match_id").agg(F.array_join(F.array_sort(F.collect_set(place)), "；").alias("locations"))


def write_workbook(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each table of the evidence workbook as a folder of its name."""
    for name, frame in tables.items():
        writer = frame.write.mode("overwrite")
        writer.option("header", True).csv(f"{folder}/{name}") if form == "csv" else writer.format(form).save(f"{folder}/{name}")
