"""Statement rows made from printed cells by a mapping, with an account of every cell and row of the source.

A mapping says for each table which rows belong together and which column, cell or part of a cell a field comes from.
`materialized` turns it into picks, one row for each cell that a field of an output takes; `assembled` reads the picks
and says what is wrong with them. Both work for all documents at once: what belongs to an output, a table or a document
is put together by joins and grouped aggregates; the largest group that is gathered is the picks of one output.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns
from ..functions.identity import text
from ..functions.money import account_no, bank_name, direction, is_empty, money, parse_date, printed_cents, source_time
from ..functions.printed import semantic_text, split_party
from ..plans.storage import written

DOC = "document_id"
FIELDS = patterns.STATEMENT_FIELDS
AT = {name: i for i, name in enumerate(FIELDS)}
#: What a row of the source can be besides part of a transaction.
DISPOSITIONS = ("header", "account", "total", "blank", "no_transactions", "other")
#: With one of these issues a document isn't wholly accounted for.
INCOMPLETE = ("INVALID_ROW_SOURCE", "INVALID_CELL_SOURCE", "UNASSIGNED_SOURCE_ROW", "SOURCE_ROW_REUSED", "TRANSACTION_IGNORED_CONFLICT", "DUPLICATE_DISPOSITION")
ISSUE = "struct<code: string, field: string, severity: string, source_rows: array<bigint>, source_cells: array<bigint>>"
OWN_AND_OTHER = (("account_number", "counterparty_account"), ("account_name", "counterparty_name"), ("bank_name", "counterparty_bank"))
SELECTOR = "struct<row: int, col: int, line: int, part: string, fixed: bigint, text: string>"
FIELD_MAP = f"map<string, {SELECTOR}>"


@dataclass(frozen=True)
class Assembly:
    """rows: (document_id, out_no, source_rows, the twelve fields). issues: (document_id, code, field, severity, out_rows,
    source_rows, source_cells). documents: (document_id, n_issues, complete)."""

    rows: DataFrame
    issues: DataFrame
    documents: DataFrame


@dataclass(frozen=True)
class Plan:
    """What a mapping comes to. outputs: (document_id, out_no, source_rows, direction, type, page, table_no, account_kind,
    description, direct_owner). picks: (document_id, out_no, field, pos, cell_id, fragment, line). ignored: (document_id,
    pos, row_id, kind). issues as of an assembly; rejected: (document_id, page, table_no, reason); corrected: (document_id,
    page, table_no, field), own fields that pointed at the other party's column and are left empty."""

    outputs: DataFrame
    picks: DataFrame
    ignored: DataFrame
    issues: DataFrame
    rejected: DataFrame
    corrected: DataFrame


def _normalized(field: Column, value: Column) -> Column:
    """A cell's text in the form of its field: '' for an empty one, null where it can't be read."""
    trimmed = F.trim(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    amount, balance = money(value, True), money(value)
    as_money = lambda m: F.when(m["state"] == "empty", "").otherwise(printed_cents(m["cents"]))
    is_name = field.isin(AT["account_name"], AT["counterparty_name"])
    return (
        F.when(field.isin(AT["account_number"], AT["counterparty_account"]), account_no(value))
        .when(field == AT["amount"], as_money(amount))
        .when(field == AT["balance"], as_money(balance))
        .when(field == AT["direction"], direction(value))
        .when(is_empty(trimmed) | (is_name & trimmed.rlike("^[@*＊—-]+$")), "")
        .when(field == AT["transaction_date"], parse_date(value).cast("string"))
        .when(field.isin(AT["bank_name"], AT["counterparty_bank"]), bank_name(value))
        .otherwise(trimmed)
    )


def _issue(when: Column, code: str, field: str | None = None, rows: Column | None = None, cells: Column | None = None, severity: Column | None = None) -> Column:
    none = F.array().cast("array<bigint>")
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(field).cast("string").alias("field"), (F.lit("REQUIRED") if severity is None else severity).alias("severity"),
                                 (none if rows is None else F.array_sort(F.array_distinct(rows))).alias("source_rows"), (none if cells is None else F.array_sort(F.array_distinct(cells))).alias("source_cells")))


def _flat(df: DataFrame, found: list[Column], outputs: Column) -> DataFrame:
    """(document_id, code, field, severity, out_rows, source_rows, source_cells) of the issues that occur."""
    each = df.select(DOC, outputs.alias("out_rows"), F.explode(F.array_compact(F.array(*found))).alias("i"))
    return each.select(DOC, "i.code", "i.field", "i.severity", "out_rows", "i.source_rows", "i.source_cells")


def source_rows(cells: DataFrame) -> DataFrame:
    """(document_id, row_id, page, table_no, all_empty, dated_amount) of the table rows that the cells form."""
    amount = text("text").rlike("[.,]") & (money("text")["state"] == "value")
    held = cells.where("row_id is not null").groupBy(DOC, "row_id").agg(F.first("page").alias("page"), F.first("table_no").alias("table_no"), F.bool_and(is_empty("text")).alias("all_empty"), F.bool_or(parse_date("text").isNotNull()).alias("_d"), F.bool_or(amount).alias("_a"))
    return held.select(DOC, "row_id", "page", "table_no", "all_empty", (F.col("_d") & F.col("_a")).alias("dated_amount"))


def assembled(cells: DataFrame, outputs: DataFrame, picks: DataFrame, ignored: DataFrame) -> Assembly:
    """Statement rows and everything that is wrong with them.

    cells: (document_id, cell_id, page, table_no, row_id, text), row_id null beside tables. outputs: (document_id, out_no,
    source_rows, direction, type). picks: (document_id, out_no, field, pos, cell_id, fragment, line): in the order of pos,
    a whole cell or, with a fragment, a part that occurs once in it (with line, all of that line). ignored: (document_id,
    pos, row_id, kind) of rows that are no transactions; of several kinds the last counts.

    A field is its first readable pick; other picks may contradict it. Null texts count as empty. Repeated outputs and
    picks of one number are an error of the plan: they are read as one output with all their picks.
    """
    kept = written(source_rows(cells), "source-rows")
    known = ignored.join(kept, [DOC, "row_id"], "left")
    first = F.row_number().over(Window.partitionBy(DOC, "row_id").orderBy("pos")) == 1
    rows_of = lambda c: F.array(F.col(c).cast("long"))
    marked = known.withColumn("_first", first)
    here = F.col("page").isNotNull()
    of_ignored = _flat(marked, [
        _issue(~here, "INVALID_IGNORED_ROW", rows=rows_of("row_id")),
        _issue(here & ~F.col("_first"), "DUPLICATE_DISPOSITION", rows=rows_of("row_id")),
        _issue(here & (F.col("kind") == "blank") & ~F.col("all_empty"), "NONEMPTY_IGNORED_ROW", rows=rows_of("row_id")),
        _issue(here & F.col("dated_amount") & ~F.col("kind").isin("total", "account"), "POSSIBLE_OMITTED_TRANSACTION", rows=rows_of("row_id")),
    ], F.array().cast("array<bigint>"))
    disposed = known.where(here).groupBy(DOC, "row_id").agg(F.max_by("kind", "pos").alias("disposition"))
    uses = outputs.select(DOC, F.col("out_no").cast("long").alias("out_no"), F.explode("source_rows").alias("row_id")).join(kept.select(DOC, "row_id", "page"), [DOC, "row_id"], "left").join(disposed, [DOC, "row_id"], "left")
    of_uses = _flat(uses, [_issue(~here, "INVALID_ROW_SOURCE", rows=rows_of("row_id")), _issue(F.col("disposition").isNotNull(), "TRANSACTION_IGNORED_CONFLICT", rows=rows_of("row_id"))], F.array("out_no"))
    per_row = uses.groupBy(DOC, "row_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("out_no")).alias("outs"))
    of_reuse = _flat(per_row, [_issue(F.col("n") > 1, "SOURCE_ROW_REUSED", rows=rows_of("row_id"))], F.col("outs"))
    left_over = kept.join(per_row, [DOC, "row_id"], "left_anti").join(disposed, [DOC, "row_id"], "left_anti")
    of_rest = _flat(left_over, [_issue(F.lit(True), "UNASSIGNED_SOURCE_ROW", rows=rows_of("row_id"))], F.array().cast("array<bigint>"))
    read = written(_read_outputs(cells, outputs, picks, disposed), "assembled")
    issues = reduce(DataFrame.unionByName, [of_ignored, of_uses, of_reuse, of_rest, read.select(DOC, F.array("out_no").alias("out_rows"), F.explode("issues").alias("i")).select(DOC, "i.code", "i.field", "i.severity", "out_rows", "i.source_rows", "i.source_cells")])
    issues = written(issues, "assembly-issues")
    documents = cells.select(DOC).distinct().join(issues.groupBy(DOC).agg(F.count("*").alias("n_issues"), F.bool_or(F.col("code").isin(*INCOMPLETE)).alias("_gaps")), DOC, "left")
    documents = documents.select(DOC, F.coalesce("n_issues", F.lit(0)).alias("n_issues"), (~F.coalesce("_gaps", F.lit(False))).alias("complete"))
    return Assembly(read.select(DOC, "out_no", F.array_sort(F.array_distinct("source_rows")).alias("source_rows"), *[f"values.{f}" for f in FIELDS]), issues, documents)


def _read_outputs(cells: DataFrame, outputs: DataFrame, picks: DataFrame, disposed: DataFrame) -> DataFrame:
    """(document_id, out_no, source_rows, values, issues) of each output."""
    at = cells.select(DOC, "cell_id", text("text").alias("_cell"), F.col("row_id").alias("_row"), F.lit(True).alias("_known")).join(disposed.withColumnRenamed("row_id", "_row"), [DOC, "_row"], "left")
    found = picks.join(at, [DOC, "cell_id"], "left")
    fragment, whole = F.col("fragment"), F.col("_cell")
    place = F.expr("locate(fragment, _cell)")
    last = F.length(whole) - F.length(fragment) - F.expr("locate(reverse(fragment), reverse(_cell))") + 2
    printed_line = F.trim(F.get(F.split(whole, r"\r?\n|\\n", -1), F.col("line")))
    one_place = F.when(F.col("line").isNotNull(), F.coalesce(printed_line == fragment, F.lit(False))).otherwise(place == last)
    good = fragment.isNull() | ((F.length(fragment) > 0) & (place > 0) & one_place)
    value = F.coalesce(fragment, whole)
    is_time = F.col("field") == AT["transaction_time"]
    pick = F.struct(
        "field", "pos", F.col("cell_id").cast("long").alias("cell_id"), F.coalesce("_known", F.lit(False)).alias("known"), F.coalesce(good, F.lit(False)).alias("good"), F.col("_row").alias("row_id"),
        F.coalesce(F.col("disposition").isin("header", "account"), F.lit(False)).alias("apart"), value.alias("text"), _normalized(F.col("field"), value).alias("norm"), F.when(is_time, parse_date(value)).cast("string").alias("day"), F.when(is_time, source_time(value)).alias("clock"),
    )
    gathered = found.groupBy(DOC, "out_no").agg(F.array_sort(F.collect_list(pick)).alias("picks"))
    df = outputs.select(DOC, F.col("out_no").cast("long").alias("out_no"), "source_rows", text("direction").alias("d"), text("type").alias("t")).join(gathered.withColumn("out_no", F.col("out_no").cast("long")), [DOC, "out_no"], "left")
    empty = "array<struct<field: int, pos: int, cell_id: bigint, known: boolean, good: boolean, row_id: bigint, apart: boolean, text: string, norm: string, day: string, clock: string>>"
    df = df.withColumn("picks", F.coalesce("picks", F.array().cast(empty)))
    usable = F.filter("picks", lambda p: p["known"] & p["good"])
    df = df.withColumn("ok", usable)
    of = lambda *names: F.filter("ok", lambda p: p["field"].isin(*[AT[n] for n in names]))
    cells_of = lambda a: F.transform(a, lambda p: p["cell_id"])
    first = lambda a, part="norm": F.coalesce(F.get(F.transform(a, lambda p: p[part]), F.lit(0)), F.lit(""))
    distinct = lambda a, part="norm": F.size(F.array_distinct(F.filter(F.transform(a, lambda p: p[part]), lambda x: x.isNotNull() & (x != ""))))
    norm = {name: first(of(name)) for name in FIELDS}
    own_bank = F.col("t").isin(*patterns.BANK_AS_PARTY_TYPES)
    bank_cells = cells_of(of("bank_name"))
    stray = F.filter("ok", lambda p: p["row_id"].isNotNull() & ~F.array_contains(F.col("source_rows"), p["row_id"]) & ~((p["field"] <= AT["bank_name"]) & p["apart"])
                     & ~(own_bank & p["field"].isin(AT["counterparty_name"], AT["counterparty_bank"]) & F.array_contains(bank_cells, p["cell_id"])))
    rows = F.col("source_rows")
    found = []
    per_pick = lambda a, code: F.transform(a, lambda p: F.struct(F.lit(code).alias("code"), F.element_at(F.array(*map(F.lit, FIELDS)), p["field"] + 1).alias("field"), F.lit("REQUIRED").alias("severity"),
                                                               F.array_sort(F.array_distinct(F.when(F.lit(code == "OUTSIDE_TRANSACTION_SOURCES"), F.concat(rows, F.array(p["row_id"]))).otherwise(rows))).alias("source_rows"), F.array(p["cell_id"]).alias("source_cells")))
    for name in ("account_number", "amount"):
        found.append(_issue(F.coalesce(norm[name] == "", F.lit(True)), "MISSING_KEY_SOURCE", name, rows))
    for name in ("account_number", "direction", "amount", "balance", "counterparty_account"):
        unread = F.filter(of(name), lambda p: p["norm"].isNull())
        if name != "direction":
            found.append(_issue(F.size(unread) > 0, "UNREADABLE_SOURCE", name, rows, cells_of(unread)))
        found.append(_issue(distinct(of(name)) > 1, "SOURCE_VALUE_CONFLICT", name, rows, cells_of(of(name))))
    printed, told = norm["direction"], F.col("d").isin("IN", "OUT")
    found.append(_issue(~F.col("d").isin("", "IN", "OUT"), "INVALID_DIRECTION", "direction", rows))
    found.append(_issue((printed != "") & (F.col("d") != "") & (printed != F.col("d")), "DIRECTION_CONTRADICTION", "direction", rows, cells_of(of("direction"))))
    found.append(_issue(printed == "", "DIRECTION_REQUIRES_INDEPENDENT_READ", "direction", rows, cells_of(of("direction")), F.when(told & (F.size(of("direction")) > 0), "AUTOMATIC_CHECK").otherwise("REQUIRED")))
    found.append(_issue((distinct(of("transaction_time"), "day") > 1) | (distinct(of("transaction_time"), "clock") > 1), "TIME_SOURCE_CONFLICT", "transaction_time", rows, cells_of(of("transaction_time"))))
    found.append(_issue(F.exists(of("transaction_date"), lambda p: p["norm"].isNull()), "PARTIAL_DATE", "transaction_date", rows, cells_of(of("transaction_date"))))
    kinds = of("transaction_type")
    found.append(_issue((F.col("t") != "") & ~F.col("t").isin(*patterns.STATEMENT_TYPES), "INVALID_TYPE", "transaction_type", rows))
    found.append(_issue((F.col("t") != "") & (F.size(kinds) == 0), "MISSING_TYPE_SOURCE", "transaction_type", rows))
    found.append(_issue((F.col("t") == "第三方支付") & F.exists(kinds, lambda p: F.contains(p["text"], F.lit("消费"))), "TYPE_SOURCE_CONTRADICTION", "transaction_type", rows, cells_of(kinds)))
    party, party_name = norm["counterparty_account"], norm["counterparty_name"]
    found.append(_issue((party == "") & (party_name == ""), "COUNTERPARTY_IDENTITY_MISSING", "counterparty_name", rows))
    found.append(_issue((party == "") & (distinct(of("counterparty_name")) > 1), "COUNTERPARTY_NAME_CONFLICT", "counterparty_name", rows))
    every = F.concat(
        F.array_compact(F.array(*found)), per_pick(F.filter("picks", lambda p: ~p["known"]), "INVALID_CELL_SOURCE"), per_pick(F.filter("picks", lambda p: p["known"] & ~p["good"]), "INVALID_SOURCE_FRAGMENT"), per_pick(stray, "OUTSIDE_TRANSACTION_SOURCES"),
    )
    days, clocks = (F.array_compact(of("transaction_time")[part]) for part in ("day", "clock"))
    day = F.coalesce(F.get(days, F.lit(0)), F.when(norm["transaction_date"] != "", norm["transaction_date"]))
    clock = F.get(clocks, F.lit(0))
    values = norm | {
        "direction": F.when(printed != "", printed).otherwise(F.when(told, F.col("d")).otherwise("")),
        "transaction_time": F.when(day.isNotNull() & clock.isNotNull(), F.concat_ws(" ", day, clock)).otherwise(""),
        "transaction_type": F.when(F.col("t").isin(*patterns.STATEMENT_TYPES), F.col("t")).otherwise(""),
    }
    return df.select(DOC, "out_no", "source_rows", F.struct(*[values[f].alias(f) for f in FIELDS]).alias("values"), every.alias("issues"))


def materialized(cells: DataFrame, tables: DataFrame, rules: DataFrame) -> Plan:
    """The plan that mapped tables come to.

    cells: as for `assembled`, with row_no and col_no. tables: (document_id, page, table_no, kind, account_kind, fields,
    direction_codes, groups, ignored, overrides): fields maps a field's name to a selector (row of the group and column,
    both printed, perhaps a line or a part of the cell; or a fixed cell, perhaps with its text); groups are arrays of row
    ids; ignored (rows, kind); overrides (first_row, fields) hold for the group that starts there. rules: (account_kind,
    text, type), `any` for every kind.

    A table mapped twice, or whose rows are those of other tables, or one with overrides of no group, is rejected as a
    whole, and so is a table that isn't in the source but claims rows; its rows stay unassigned. Own fields that point at
    the other party's column are emptied. Fields not named and null selectors pick nothing.
    """
    key = [DOC, "page", "table_no"]
    kept = written(source_rows(cells).select(*key, "row_id"), "mapped-rows")
    given = tables.withColumns({"groups": F.coalesce("groups", F.array().cast("array<array<bigint>>")), "ignored": F.coalesce("ignored", F.array().cast("array<struct<rows: array<bigint>, kind: string>>")),
                                "overrides": F.coalesce("overrides", F.array().cast(f"array<struct<first_row: bigint, fields: {FIELD_MAP}>>")), "_n": F.count("*").over(Window.partitionBy(*key))})
    own_rows = kept.groupBy(*key).agg(F.collect_set("row_id").alias("_own"))
    given = given.join(own_rows, key, "left").withColumn("_own", F.coalesce("_own", F.array().cast("array<bigint>")))
    heads = F.transform("groups", lambda g: F.get(g, F.lit(0)))
    claims = (F.size("groups") > 0) | (F.size("ignored") > 0) | (F.size("overrides") > 0)
    reason = (
        F.when(F.col("_n") > 1, "MAPPED_TWICE")
        .when(~F.col("kind").isin("transactions", "account", "other"), "UNKNOWN_KIND")
        .when((F.size("_own") == 0) & (claims | (F.col("kind") == "transactions")), "NO_SUCH_TABLE")
        .when(F.exists("groups", lambda g: (F.size(g) == 0) | (F.size(F.array_except(g, F.col("_own"))) > 0)), "FOREIGN_ROWS")
        .when(F.exists("overrides", lambda o: ~F.array_contains(heads, o["first_row"])) | (F.size(F.array_distinct(F.transform("overrides", lambda o: o["first_row"]))) < F.size("overrides")), "BAD_OVERRIDE")
    )
    given = written(given.withColumn("reason", reason).drop("_own", "_n"), "mapped-tables")
    good = given.where("reason is null")
    listed = good.select(*key, F.posexplode("ignored").alias("_i", "x")).select(*key, F.col("_i").cast("long").alias("_i"), F.col("x.kind").alias("kind"), F.posexplode("x.rows").alias("_j", "row_id"))
    whole = good.where("kind <> 'transactions'").select(*key, (F.lit(1) + F.size("ignored")).cast("long").alias("_b"), "kind", F.posexplode("groups").alias("_k", "g")).select(*key, (F.col("_b") + F.col("_k")).alias("_i"), "kind", F.posexplode("g").alias("_j", "row_id"))
    order = Window.partitionBy(DOC).orderBy("page", "table_no", "_i", "_j")
    ignored = listed.unionByName(whole).withColumn("pos", F.row_number().over(order).cast("long"))
    headers = listed.where("kind = 'header'").withColumn("_h", F.row_number().over(Window.partitionBy(*key).orderBy("_i", "_j")) - 1).join(cells.select(DOC, "row_id", "col_no", semantic_text("text").alias("label")), [DOC, "row_id"])
    named = headers.groupBy(*key).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.concat_ws(":", "_h", "col_no"), "label")))).alias("_labels"), F.max("_h").alias("_heads"),
                                      F.array_sort(F.collect_set(F.when(F.col("label").isin(*patterns.TYPE_HEADERS), F.col("col_no")))).alias("_types"), F.array_sort(F.collect_set(F.when(F.col("label").isin(*patterns.MEMO_HEADERS), F.col("col_no")))).alias("_memos"))
    groups = good.where("kind = 'transactions'").join(named, key, "left").select(*key, "account_kind", "fields", "direction_codes", "overrides", "_labels", "_heads", "_types", "_memos", F.posexplode("groups").alias("_g", "source_rows"))
    groups = groups.withColumn("out_no", F.row_number().over(Window.partitionBy(DOC).orderBy("page", "table_no", "_g")).cast("long"))
    extra = F.get(F.transform(F.filter("overrides", lambda o: o["first_row"] == F.get("source_rows", F.lit(0))), lambda o: o["fields"]), F.lit(0))
    groups = groups.withColumn("_extra", F.coalesce(extra, F.map_from_arrays(F.array(), F.array()).cast(FIELD_MAP)))
    merged = F.map_concat(F.map_filter("fields", lambda k, v: ~F.map_contains_key("_extra", k)), F.col("_extra"))
    groups = groups.withColumn("_all", merged)
    label = lambda s: F.coalesce(F.try_element_at("_labels", F.concat_ws(":", s["row"], s["col"])), F.when(F.col("_heads") == 0, F.try_element_at("_labels", F.concat_ws(":", F.lit("0"), s["col"]))), F.lit(""))
    wrong = lambda own, other: F.coalesce(F.try_element_at("_all", F.lit(own))["row"].isNotNull() & ((F.to_json(F.try_element_at("_all", F.lit(own))) == F.to_json(F.try_element_at("_all", F.lit(other)))) | label(F.try_element_at("_all", F.lit(own))).rlike(patterns.PARTY_HEADER)), F.lit(False))
    groups = written(groups.withColumn("_wrong", F.array_compact(F.array(*[F.when(wrong(a, b), a) for a, b in OWN_AND_OTHER]))), "mapped-groups")
    used = F.map_filter("_all", lambda k, v: ~F.array_contains("_wrong", k) & v.isNotNull())
    chosen = groups.select(DOC, "out_no", "source_rows", F.explode(used).alias("name", "s"))
    by_place = chosen.where("s.fixed is null and s.row >= 0 and s.col >= 1").select(DOC, "out_no", "name", "s", F.get("source_rows", F.col("s.row")).alias("row_id"), F.col("s.col").alias("col_no")).join(cells.select(DOC, "row_id", "col_no", "cell_id", text("text").alias("text")), [DOC, "row_id", "col_no"])
    party = split_party("text")
    piece = F.when(F.col("s.part").isNull(), F.when(F.col("s.line").isNotNull(), F.trim(F.get(F.split("text", r"\r?\n|\\n", -1), F.col("s.line"))))).otherwise(F.when(F.col("s.part") == "account", party["account"]).otherwise(party["name"]))
    by_place = by_place.withColumns({"_piece": piece, "_partial": F.col("s.part").isNotNull() | F.col("s.line").isNotNull()})
    torn = by_place.where("s.part is not null and _piece is null")
    placed = by_place.where("not _partial or coalesce(_piece, '') <> ''").select(DOC, "out_no", "name", "cell_id", F.when((F.col("s.part").isNotNull()) & (F.col("_piece") == F.col("text")), None).otherwise(F.col("_piece")).alias("fragment"), F.col("s.line").alias("line"), "text")
    fixed = chosen.where("s.fixed is not null").select(DOC, "out_no", "name", F.col("s.fixed").alias("cell_id"), F.col("s.text").alias("fragment"), F.lit(None).cast("int").alias("line")).join(cells.select(DOC, "cell_id", text("text").alias("text")), [DOC, "cell_id"], "left")
    direct = written(placed.unionByName(fixed.select(*placed.columns)).withColumn("rank", F.lit(0).cast("long")), "direct-picks")
    days = direct.where("name = 'transaction_date'").withColumns({"name": F.lit("transaction_time"), "rank": F.lit(-1).cast("long")})
    times = direct.where("name = 'transaction_time'").join(days.select(DOC, "out_no", "cell_id", F.coalesce("fragment", F.lit("")).alias("_f")), (direct[DOC] == days[DOC]) & (direct["out_no"] == days["out_no"]) & (direct["cell_id"] == days["cell_id"]) & (F.coalesce(direct["fragment"], F.lit("")) == F.col("_f")), "left_anti")
    memo = groups.select(DOC, "out_no", "source_rows", F.explode(F.array_distinct(F.concat(F.coalesce("_types", F.array().cast("array<int>")), F.coalesce("_memos", F.array().cast("array<int>"))))).alias("col_no"), F.coalesce("_types", F.array().cast("array<int>")).alias("_types"))
    memo = memo.select(DOC, "out_no", "col_no", F.array_contains("_types", F.col("col_no")).alias("_typed"), F.posexplode("source_rows").alias("_r", "row_id")).join(cells.select(DOC, "row_id", "col_no", "cell_id", text("text").alias("text")), [DOC, "row_id", "col_no"]).where(F.trim("text") != "")
    told = direct.where("name = 'description'").select(DOC, "out_no", "cell_id")
    more = memo.join(told, [DOC, "out_no", "cell_id"], "left_anti").select(DOC, "out_no", F.lit("description").alias("name"), "cell_id", F.lit(None).cast("string").alias("fragment"), F.lit(None).cast("int").alias("line"), "text", (F.lit(1) + F.when(F.col("_typed"), 0).otherwise(100_000) + F.col("col_no") * 100 + F.col("_r")).cast("long").alias("rank"))
    every = direct.where("name <> 'transaction_time'").unionByName(times).unionByName(days).unionByName(more)
    number = F.create_map(*[x for n, i in (AT | {"description": AT["transaction_type"]}).items() for x in (F.lit(n), F.lit(i))])
    picks = every.withColumn("field", number[F.col("name")]).where("field is not null")
    picks = picks.withColumn("pos", F.row_number().over(Window.partitionBy(DOC, "out_no", "field").orderBy("rank", "cell_id")) - 1)
    first_text = lambda name: direct.where(F.col("name") == name).groupBy(DOC, "out_no").agg(F.min(F.coalesce("fragment", "text")).alias(f"_{name}"))
    described = direct.where("name = 'description'").select(DOC, "out_no", semantic_text(F.coalesce("fragment", "text")).alias("text")).unionByName(memo.where("_typed").select(DOC, "out_no", semantic_text("text").alias("text"))).distinct()
    kinds = described.join(groups.select(DOC, "out_no", "account_kind"), [DOC, "out_no"]).join(rules.select(F.col("account_kind").alias("_kind"), semantic_text("text").alias("text"), "type"), "text").where("_kind = 'any' or _kind = account_kind")
    kinds = kinds.groupBy(DOC, "out_no").agg(F.min("type").alias("type"), F.max("type").alias("_other")).where("type = _other").drop("_other")
    outputs = groups.join(first_text("direction"), [DOC, "out_no"], "left").join(first_text("description"), [DOC, "out_no"], "left").join(kinds, [DOC, "out_no"], "left")
    outputs = outputs.select(DOC, "out_no", "source_rows", F.coalesce(F.try_element_at("direction_codes", F.trim(text("_direction"))), F.lit("")).alias("direction"), text("type").alias("type"), "page", "table_no", "account_kind", semantic_text(text("_description")).alias("description"),
                             (F.coalesce(F.try_element_at("_all", F.lit("account_number"))["row"].isNotNull(), F.lit(False)) & ~F.array_contains("_wrong", "account_number")).alias("direct_owner"))
    torn_rows = torn.join(groups.select(DOC, "out_no", "source_rows"), [DOC, "out_no"])
    issues = _flat(torn_rows, [_issue(F.col("name") == n, "AMBIGUOUS_PARTY_FRAGMENT", n, F.col("source_rows"), F.array("cell_id")) for n in ("counterparty_account", "counterparty_name")], F.array("out_no"))
    corrected = groups.select(*key, F.explode("_wrong").alias("field")).distinct()
    return Plan(outputs, picks.select(DOC, "out_no", "field", "pos", "cell_id", "fragment", "line"), ignored.select(DOC, "pos", "row_id", "kind"), issues, given.where("reason is not null").select(*key, "reason"), corrected)
