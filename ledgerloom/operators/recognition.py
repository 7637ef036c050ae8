"""Operators on readings of statement pages: duplicates inside a document, alignment of two readings, checks, edits."""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identity import text
from ..plans.groups import each_group
from .sequence import signed


def dedup_locator(rows: DataFrame, locator: list[str], confidence: str = "confidence", order: str = "seq") -> DataFrame:
    """Of rows at one place, the one read with most confidence; the first of equals."""
    best = Window.partitionBy(*locator).orderBy(F.desc(confidence), order)
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def dedup_in_document(txn: DataFrame) -> DataFrame:
    """(case_id, id, duplicate_of_id) for rows that a document prints twice.

    Rows can only be one if document, date and amount agree, so these are blocks; account, direction and time of day may
    be missing on one side. Balances that both print must agree, and something else must speak for one row: a time, the
    wording, the other party, or on one page the whole printed line. Blocks of one row are done; the others are matched
    in printed order, a block at a time. Rows without a date or an amount repeat nothing.
    """
    key = ["case_id", "source_document_id", "transaction_date", "amount_cents"]
    wanted = ["id", "seq", "page", "row_index", "account_number", "direction", "balance_cents", "summary", "counterparty_name", "transaction_time", "raw_text"]
    fields = [*key, *(c if c in txn.columns else F.lit(None).cast("string").alias(c) for c in wanted)]
    sized = txn.where("transaction_date is not null and amount_cents is not null").select(*fields).withColumn("_n", F.count("*").over(Window.partitionBy(*key))).where("_n > 1").drop("_n")
    kind = dict(txn.dtypes)["case_id"]

    def match(block: list[dict]) -> list[tuple]:
        kept: list[dict] = []
        used: set[tuple] = set()
        out = []
        for row in block:
            hit = next((k for k in kept if (k["id"], row["page"]) not in used and _repeats(k, row)), None)
            if hit is None:
                kept.append(row)
            else:
                used.add((hit["id"], row["page"]))
                out.append((row["case_id"], row["id"], hit["id"]))
        return out

    return each_group(sized, key, ["page", "row_index", "seq"], match, f"case_id {kind}, id string, duplicate_of_id string")


def _words(row: dict, field: str) -> str:
    return "".join(str(row[field] or "").split())


def _overlap(a: dict, b: dict, field: str) -> bool:
    x, y = _words(a, field), _words(b, field)
    return bool(x and y) and (x in y or y in x)


def _clock(row: dict) -> str:
    found = re.search(r"\d{2}:\d{2}(?::\d{2})?", str(row["transaction_time"] or ""))
    return found[0] if found else ""


def _repeats(a: dict, b: dict) -> bool:
    """Whether two rows of one document, date and amount can be one row."""
    if a["account_number"] and b["account_number"] and a["account_number"] != b["account_number"]:
        return False
    if "UNKNOWN" not in (a["direction"], b["direction"]) and a["direction"] != b["direction"]:
        return False
    times, apart = (_clock(a), _clock(b)), abs(a["page"] - b["page"])
    shared = min(map(len, times))
    if times[0][:shared] != times[1][:shared]:
        return False
    known = [not pd.isna(r["balance_cents"]) for r in (a, b)]
    if all(known) and a["balance_cents"] != b["balance_cents"]:
        return False
    summaries = [_words(r, "summary") for r in (a, b)]
    if not apart:
        if all(known):
            return bool(shared) and times[0] == times[1] or summaries[0] == summaries[1]
        return bool(_words(a, "raw_text")) and a["raw_text"] == b["raw_text"]
    if all(known):
        if all(times):
            return times[0] == times[1]
        if all(summaries):
            return _overlap(a, b, "summary")
        return apart > 1 and (any(summaries) or _overlap(a, b, "counterparty_name"))
    return times[0] == times[1] and len(times[0]) == 8 or _overlap(a, b, "summary") or _overlap(a, b, "counterparty_name")


#: fixed values: what two readings of a row are compared by, the points for agreement, for disagreement, for a row without partner
ALIGNED = ("account", "date", "direction", "amount", "balance", "party_account")
WEIGHTS = (3, 2, 1, 3, 3, 2)
MISMATCH, GAP = -1, -4
LEAST_AGREEING, LEAST_SCORE = 3, 4
#: up to so many pairs are all looked at
SMALL = 2_500


def _points(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weighted agreement of coded rows, the last axis being their fields; forbidden below three agreements and four points."""
    shape = np.broadcast_shapes(x.shape, y.shape)[:-1]
    points, agree = np.zeros(shape), np.zeros(shape, dtype=np.int8)
    for k, w in enumerate(WEIGHTS):
        p, q = x[..., k], y[..., k]
        both = (p >= 0) & (q >= 0)
        same = both & (p == q)
        points += np.where(same, w, np.where(both, MISMATCH, 0))
        agree += same
    return np.where((agree >= LEAST_AGREEING) & (points >= LEAST_SCORE), points, -np.inf)


def _best_totals(score: np.ndarray) -> np.ndarray:
    """Points of the best ordered alignment of every two beginnings, an anti-diagonal at a time."""
    n, m = score.shape
    t = np.full((n + 1, m + 1), -np.inf)
    t[0, 0] = 0
    for d in range(1, n + m + 1):
        i = np.arange(max(0, d - m), min(n, d) + 1)
        j = d - i
        up, left, both = (np.full(len(i), -np.inf) for _ in range(3))
        up[i > 0] = t[i[i > 0] - 1, j[i > 0]] + GAP
        left[j > 0] = t[i[j > 0], j[j > 0] - 1] + GAP
        inner = (i > 0) & (j > 0)
        both[inner] = t[i[inner] - 1, j[inner] - 1] + score[i[inner] - 1, j[inner] - 1]
        t[i, j] = np.maximum(np.maximum(up, left), both)
    return t


def _coded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fields of both sides as numbers that are equal where the texts are; -1 for an empty text."""
    both = np.concatenate([a, b])
    codes = np.empty(both.shape, dtype=np.int64)
    for k in range(both.shape[1]):
        found, names = pd.factorize(both[:, k])
        codes[:, k] = np.where(np.append(names == "", False)[found], -1, found)
    return codes[: len(a)], codes[len(a) :]


def _meeting(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Places of all pairs that may be one row by `_points`; None if more than most pairs share three fields."""
    found, total, texts = [], 0, len(x) + len(y)
    for triple in combinations(range(x.shape[1]), LEAST_AGREEING):
        i, j = (np.flatnonzero((t[:, triple] >= 0).all(1)) for t in (x, y))
        if not len(i) or not len(j):
            continue
        left, right = ((t[:, triple[0]] * texts + t[:, triple[1]]) * texts + t[:, triple[2]] for t in (x[i], y[j]))
        order = np.argsort(right, kind="stable")
        start, stop = (np.searchsorted(right[order], left, side) for side in ("left", "right"))
        n = stop - start
        total += int(n.sum())
        if total > most:
            return None
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        found.append(np.repeat(i, n) * len(y) + j[order[at]])
    return np.divmod(np.unique(np.concatenate(found)), len(y)) if found else (np.empty(0, np.int64),) * 2


def _best_before(i: np.ndarray, j: np.ndarray, worth: np.ndarray, n_right: int) -> np.ndarray:
    """Of each pair, in order of i, the worth of the best chain of pairs that ends with it: one of smaller places before each."""
    tree, out, waiting = [0] * (n_right + 1), [0] * len(i), []
    rows, places, gains = i.tolist(), j.tolist(), worth.tolist()
    for k, row in enumerate(rows):
        if waiting and rows[waiting[0]] != row:
            for p in waiting:
                at, total = places[p] + 1, out[p]
                while at <= n_right:
                    if tree[at] < total:
                        tree[at] = total
                    at += at & -at
            waiting = []
        at, best = places[k], 0
        while at > 0:
            if tree[at] > best:
                best = tree[at]
            at -= at & -at
        out[k] = best + gains[k]
        waiting.append(k)
    return np.array(out)


def _sparse(i: np.ndarray, j: np.ndarray, score: np.ndarray, n_left: int, n_right: int) -> list[tuple[int, int]]:
    """`align` where few pairs are possible: a matched pair saves two gaps, so alignments are chains of pairs of the largest worth.

    The pairs of a best chain share out its worth without gaps or overlaps, so a pair is in every best chain just if no
    other pair of a best chain overlaps its share.
    """
    if not len(i):
        return []
    worth = score.astype(np.int64) - 2 * GAP
    before = _best_before(i, j, worth, n_right)
    after = _best_before(n_left - 1 - i[::-1], n_right - 1 - j[::-1], worth[::-1], n_right)[::-1]
    on = np.flatnonzero(before + after - worth == before.max())
    on = on[np.argsort((before - worth)[on], kind="stable")]
    start, stop = (before - worth)[on], before[on]
    reached = np.maximum.accumulate(stop)
    alone = np.append(True, reached[:-1] <= start[1:]) & np.append(stop[:-1] <= start[1:], True)
    return sorted(zip(i[on[alone]].tolist(), j[on[alone]].tolist(), strict=True))


def _score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Points of every row of a with every row of b."""
    x, y = _coded(a, b)
    return _points(x[:, None, :], y[None, :, :])


def align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of which neither row has another choice in any best ordered alignment.

    Where few pairs share three fields only these are looked at; else tables from both ends meet on every pair.
    """
    x, y = _coded(a, b)
    if len(a) * len(b) > SMALL and (met := _meeting(x, y, len(a) * len(b))) is not None:
        s = _points(x[met[0]], y[met[1]])
        fit = np.isfinite(s)
        if fit.sum() <= len(a) * len(b) // 16:
            return _sparse(met[0][fit], met[1][fit], s[fit], len(a), len(b))
    return _dense(_score(a, b))


def _dense(s: np.ndarray) -> list[tuple[int, int]]:
    f, r = _best_totals(s), _best_totals(s[::-1, ::-1])[::-1, ::-1]
    on = f[:-1, :-1] + s + r[1:, 1:] == f[-1, -1]
    left_alone = (f[:-1, :] + GAP + r[1:, :] == f[-1, -1]).any(1)
    right_alone = (f[:, :-1] + GAP + r[:, 1:] == f[-1, -1]).any(0)
    sure = on & ((on.sum(1) == 1) & ~left_alone)[:, None] & ((on.sum(0) == 1) & ~right_alone)
    return [(int(i), int(j)) for i, j in zip(*np.nonzero(sure), strict=True)]


def align_readings(left: DataFrame, right: DataFrame) -> DataFrame:
    """(case_id, document_id, page, left_row, right_row): rows of two readings of a page that surely are the same.

    The readings are grouped by page, which bounds what a task aligns at once; pages may hold thousands of rows.
    """
    keys = ["case_id", "document_id", "page"]
    kind = dict(left.dtypes)["case_id"]

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[*keys, "left_row", "right_row"])
        a, b = a.sort_values("row"), b.sort_values("row")
        values = [t[list(ALIGNED)].fillna("").astype(str).to_numpy() for t in (a, b)]
        pairs = align(*values)
        head = tuple(a.iloc[0][k] for k in keys)
        return pd.DataFrame([(*head, int(a.iloc[i]["row"]), int(b.iloc[j]["row"])) for i, j in pairs], columns=[*keys, "left_row", "right_row"])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(one, f"case_id {kind}, document_id string, page int, left_row int, right_row int")


def compare_readings(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Differences of two aligned readings: fields that disagree, rows without partner on either side."""
    keys = ["case_id", "document_id", "page"]
    a = left.select(*keys, F.col("row").alias("left_row"), *[F.col(f).alias(f"a_{f}") for f in ALIGNED])
    b = right.select(*keys, F.col("row").alias("right_row"), *[F.col(f).alias(f"b_{f}") for f in ALIGNED])
    both = pairs.join(a, [*keys, "left_row"]).join(b, [*keys, "right_row"])
    sides = F.explode(F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("one"), F.col(f"b_{f}").alias("other")) for f in ALIGNED]), lambda x: ~x["one"].eqNullSafe(x["other"]))).alias("x")
    conflicts = both.select(*keys, F.lit("VALUE_CONFLICT").alias("issue"), "left_row", "right_row", sides).select(*keys, "issue", "left_row", "right_row", "x.field")
    lost = a.join(pairs, [*keys, "left_row"], "left_anti").select(*keys, F.lit("UNMATCHED_ROW").alias("issue"), "left_row", F.lit(None).cast("int").alias("right_row"), F.lit(None).cast("string").alias("field"))
    extra = b.join(pairs, [*keys, "right_row"], "left_anti").select(*keys, F.lit("EXTRA_ROW").alias("issue"), F.lit(None).cast("int").alias("left_row"), "right_row", F.lit(None).cast("string").alias("field"))
    return conflicts.unionByName(lost).unionByName(extra)


def predecessor_check(txn: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Rows after an account's first day without an earlier row whose balance is what theirs implies.

    groups (case_id, account_number, balance_group): accounts that share one balance.
    """
    rows = txn.where("balance_cents is not null")
    rows = rows.withColumn("balance_group", F.col("account_number")) if groups is None else rows.join(groups, ["case_id", "account_number"])
    rows = rows.withColumn("implied", F.col("balance_cents") - signed())
    first = rows.groupBy("case_id", "balance_group").agg(F.min("transaction_date").alias("_first"))
    earliest = rows.groupBy("case_id", "balance_group", F.col("balance_cents").alias("implied")).agg(F.min("transaction_date").alias("_since"))
    asked = rows.where("implied is not null").join(first, ["case_id", "balance_group"]).where(F.col("transaction_date") > F.col("_first"))
    found = asked.join(earliest, ["case_id", "balance_group", "implied"], "left")
    return found.where(F.col("_since").isNull() | (F.col("_since") > F.col("transaction_date"))).select("case_id", "id", F.col("implied").alias("implied_cents"))


def merge_overlapping_views(txn: DataFrame) -> DataFrame:
    """One row per account, date, direction and balance; of several amounts the one whose implied balance before exists, of texts the longest."""
    key = ["case_id", "account_number", "transaction_date", "direction", "balance_cents"]
    rows = txn.where("balance_cents is not null").withColumn("implied", F.col("balance_cents") - signed())
    known = txn.where("balance_cents is not null").groupBy("case_id", "account_number", F.col("balance_cents").alias("implied")).agg(F.min("transaction_date").alias("_since"))
    marked = rows.join(known, ["case_id", "account_number", "implied"], "left").withColumn("_ok", F.coalesce(F.col("_since") <= F.col("transaction_date"), F.lit(False)))
    return marked.groupBy(*key).agg(
        F.min_by("amount_cents", F.struct(~F.col("_ok"), "seq")).alias("amount_cents"), F.max_by("summary", F.struct(F.length(text("summary")), -F.col("seq"))).alias("summary"), F.count("*").alias("n_views"),
    )


def row_contract_checks(txn: DataFrame, declared: DataFrame) -> DataFrame:
    """(case_id, document_id, page, row, code): places, dates, directions, amounts and page counts that break the contract."""
    place = ["case_id", "source_document_id", "page", "row_index"]
    head = lambda rows, code: rows.select("case_id", F.col("source_document_id").alias("document_id"), "page", F.col("row_index").cast("long").alias("row"), F.lit(code).alias("code"))
    twice = txn.groupBy(*place).agg(F.count("*").alias("_n")).where("_n > 1")
    pages = txn.groupBy("case_id", "source_document_id", "page").agg(F.count("*").alias("_got"))
    counts = declared.join(pages, ["case_id", "source_document_id", "page"], "left").where(F.coalesce("_got", F.lit(0)) != F.col("declared_rows")).withColumn("row_index", F.lit(None).cast("long"))
    parts = [
        head(txn.where("coalesce(page, 0) < 1 or coalesce(row_index, -1) < 0"), "BAD_LOCATION"), head(twice, "DUPLICATE_LOCATION"), head(txn.where("transaction_date is null"), "DATE"),
        head(txn.where("direction not in ('IN', 'OUT') or direction is null"), "DIRECTION"), head(txn.where("amount_cents is null or amount_cents <= 0"), "AMOUNT"),
        head(txn.where("coalesce(trim(account_number), '') = ''"), "REQUIRED"), head(txn.where("coalesce(trim(counterparty_name), '') = '' and coalesce(counterparty_account, '') = ''"), "COUNTERPARTY"), head(counts, "PAGE_COUNT"),
    ]
    return reduce(DataFrame.unionByName, parts)


def apply_edits(txn: DataFrame, edits: DataFrame, fields: tuple[str, ...] = ("amount_cents", "balance_cents", "direction", "summary")) -> DataFrame:
    """txn with edits (case_id, id, and a column for each field, null: as it was) laid over it.

    An id that two edits name is left alone. Changed money and directions keep the value before in original_*.
    """
    once = edits.withColumn("_k", F.count("*").over(Window.partitionBy("case_id", "id"))).where("_k = 1").select("case_id", "id", *[F.col(f).alias(f"_new_{f}") for f in fields])
    both = txn.join(once, ["case_id", "id"], "left")
    changed: dict[str, Column] = {}
    for f in fields:
        differs = F.col(f"_new_{f}").isNotNull() & ~F.col(f"_new_{f}").eqNullSafe(F.col(f))
        if f != "summary":
            changed[f"original_{f}"] = F.when(differs, F.col(f))
    out = both.withColumns(changed).withColumns({f: F.coalesce(f"_new_{f}", f) for f in fields})
    return out.drop(*[f"_new_{f}" for f in fields])


def edit_counts(txn: DataFrame, edits: DataFrame) -> DataFrame:
    """Per case: edits that were laid over, that named an id twice, and that named no row."""
    keyed = edits.groupBy("case_id", "id").agg(F.count("*").alias("k")).join(txn.select("case_id", "id").withColumn("known", F.lit(True)), ["case_id", "id"], "left")
    return keyed.groupBy("case_id").agg(F.count_if((F.col("k") == 1) & F.col("known").isNotNull()).alias("applied"), F.count_if(F.col("k") > 1).alias("ambiguous"), F.count_if(F.col("known").isNull()).alias("unknown"))


def candidate_page_compare(left: DataFrame, right: DataFrame, keys: list[list[str]], fields: list[str]) -> DataFrame:
    """Pairs of two readings by the first of several keys that is unique on both sides, and the fields that differ."""
    from .scoring import align_unique

    pairs = align_unique(left, right, keys, "left_id", "right_id")
    a, b = left.select("left_id", *[F.col(f).alias(f"a_{f}") for f in fields]), right.select("right_id", *[F.col(f).alias(f"b_{f}") for f in fields])
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), f) for f in fields]))
    return pairs.join(a, "left_id").join(b, "right_id").select("left_id", "right_id", "step", F.array_join(differ, ",").alias("differing"))
