"""Several printed views of the same transactions made one: matched streams, events, conflicts.

A stream is what a document shows of one account, with the owner either in each row or in the page's head. Two streams
of either kind are views of the same rows if enough rows occur once in both, equal in all that counts (anchors). Within
such a pair anchors cut both streams into segments, and only a segment's rows are aligned in a task; what is left over
is matched where it fits one row alone. Rows matched over any number of streams are one event, if it holds one row of
each stream at most.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns
from ..functions.identity import text
from ..plans.groups import each_group
from ..plans.storage import written
from .recognition import ALIGNED, align

DOC = "document_id"
FIELDS = patterns.STATEMENT_FIELDS
CORE = ("transaction_date", "direction", "amount", "balance")
#: names of what `align` compares, by the names of statement fields
AS_ALIGNED = dict(zip(("account_number", "transaction_date", "direction", "amount", "balance", "counterparty_account"), ALIGNED, strict=True))
EXACT, CORROBORATED, ORDERED, ASSISTED, UNIQUE = "EXACT", "TWO_READINGS", "ORDERED", "ASSISTED_ORDERED", "UNIQUE_CONFLICT"
BASES = (EXACT, CORROBORATED, ORDERED, ASSISTED, UNIQUE)
PAIR = [DOC, "left_stream", "right_stream"]


@dataclass(frozen=True)
class Views:
    """matches: (document_id, left_stream, right_stream, left_obs, right_obs, basis). events: (document_id, event,
    representative, observations, the twelve fields, conflicts), conflicts being an array of (field, values)."""

    matches: DataFrame
    events: DataFrame


def _filled(fields: tuple[str, ...], prefix: str = "") -> Column:
    return reduce(lambda a, b: a & b, [text(prefix + f) != "" for f in fields])


def streams(rows: DataFrame) -> DataFrame:
    """rows with their stream, its first observation and size, and their place in it."""
    stream = F.concat_ws("|", text("account_number"), F.when(F.col("direct_owner"), "ROW_OWNER").otherwise("HEADER_OWNER"), "account_kind")
    own = Window.partitionBy(DOC, "stream")
    return rows.withColumn("stream", stream).withColumns({"first_obs": F.min("obs").over(own), "size": F.count("*").over(own), "place": F.row_number().over(own.orderBy("obs"))})


def anchors(rows: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """(pair, left_obs, right_obs, left_place, right_place, basis) of the pairs of streams that are views of the same rows.

    Exact anchors are filled in date, direction, amount and balance and occur once in each stream. Where three exist and
    both streams name the same account, rows whose independent readings agree in all of that, and with the print but
    for the balance, and with no other row, are anchors too. A pair is established by three anchors of two dates that
    are four fifths of the shorter stream.
    """
    once = rows.where(_filled(CORE)).withColumn("_n", F.count("*").over(Window.partitionBy(DOC, "stream", *CORE))).where("_n = 1")
    met = _sides(once, [*CORE])
    exact = met.select(*PAIR, "left_obs", "right_obs", F.lit(EXACT).alias("basis"))
    enough = exact.groupBy(*PAIR).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    if "i_balance" in rows.columns:
        read = ("account_number", *CORE)
        sure = rows.where(_filled(read, "i_") & reduce(lambda a, b: a & b, [text(f) == text(f"i_{f}") for f in read[:-1]]))
        sure = sure.withColumn("_n", F.count("*").over(Window.partitionBy(DOC, "stream", *[f"i_{f}" for f in read]))).where("_n = 1")
        backed = _sides(sure, [f"i_{f}" for f in read], also=["account_number"]).join(enough, PAIR).select(*PAIR, "left_obs", "right_obs", F.lit(CORROBORATED).alias("basis"))
        backed = backed.join(exact.select(*PAIR, "left_obs"), [*PAIR, "left_obs"], "left_anti").join(exact.select(*PAIR, "right_obs"), [*PAIR, "right_obs"], "left_anti")
        exact = exact.unionByName(backed)
    side = lambda name: rows.select(DOC, F.col("stream").alias(f"{name}_stream"), F.col("obs").alias(f"{name}_obs"), F.col("place").alias(f"{name}_place"), F.col("size").alias(f"_{name}"), *([F.col("transaction_date").alias("_d")] if name == "left" else []))
    placed = exact.join(side("left"), [DOC, "left_stream", "left_obs"]).join(side("right"), [DOC, "right_stream", "right_obs"])
    per = placed.groupBy(*PAIR, "_left", "_right").agg(F.count("*").alias("n"), F.countDistinct("_d").alias("days"))
    good = per.where((F.col("n") >= least) & (F.col("days") >= 2) & (F.col("n") >= share * F.least("_left", "_right"))).select(*PAIR)
    return placed.drop("_left", "_right", "_d").join(good, PAIR)


def _sides(rows: DataFrame, keys: list[str], also: list[str] | None = None) -> DataFrame:
    """Rows with the owner in the row (left) beside rows of the same kind with the owner in the head (right) that agree in keys."""
    by = [DOC, "account_kind", *keys, *(also or [])]
    side = lambda name, direct: rows.where(F.col("direct_owner") == direct).select(*by, F.col("stream").alias(f"{name}_stream"), F.col("obs").alias(f"{name}_obs"))
    return side("left", True).join(side("right", False), by)


def _directions(found: DataFrame) -> DataFrame:
    """(pair, turned) of the pairs whose anchors stand in one order in both streams, or all against it (turned)."""
    step = F.col("right_place") - F.lag("right_place").over(Window.partitionBy(*PAIR).orderBy("left_place"))
    each = found.select(*PAIR, step.alias("_s")).groupBy(*PAIR).agg(F.count_if(F.col("_s") > 0).alias("_up"), F.count_if(F.col("_s") < 0).alias("_down"))
    return each.where("_up = 0 or _down = 0").select(*PAIR, (F.col("_down") > 0).alias("turned"))


def _aligned(rows: DataFrame, matched: DataFrame, turns: DataFrame, basis: str, independent: bool) -> DataFrame:
    """(pair, left_obs, right_obs, basis): rows between two matched ones that surely are the same, by the order of both streams."""
    value = lambda f: F.coalesce(F.when(text(f"i_{f}") != "", F.col(f"i_{f}")), text(f)) if independent else text(f)
    given = rows.select(DOC, "stream", "obs", "place", *[value(f).alias(a) for f, a in AS_ALIGNED.items()])

    def side(name: str) -> DataFrame:
        own = given.withColumnsRenamed({"stream": f"{name}_stream", "obs": f"{name}_obs"}).join(turns, [DOC, f"{name}_stream"])
        marked = own.join(matched.select(*PAIR, f"{name}_obs", F.lit(1).alias("_m")), [*PAIR, f"{name}_obs"], "left")
        order = F.when(F.col("turned"), -F.col("place")).otherwise(F.col("place")) if name == "right" else F.col("place")
        cut = F.sum(F.coalesce("_m", F.lit(0))).over(Window.partitionBy(*PAIR).orderBy(order))
        return marked.select(*PAIR, F.lit(name == "left").alias("left"), F.col(f"{name}_obs").alias("obs"), order.alias("row"), cut.alias("segment"), "_m", *AS_ALIGNED.values()).where("_m is null").drop("_m")

    def one(both: list[dict]) -> list[tuple]:
        sides = [[r for r in both if r["left"] == is_left] for is_left in (True, False)]
        pairs = align(*(np.array([[r[k] for k in ALIGNED] for r in side], dtype=object) for side in sides))
        head = tuple(both[0][k] for k in PAIR)
        return [(*head, sides[0][i]["obs"], sides[1][j]["obs"]) for i, j in pairs]

    kind = dict(rows.dtypes)[DOC]
    own = Window.partitionBy(*PAIR, "segment")
    met = side("left").unionByName(side("right")).withColumns({"_a": F.count_if("left").over(own), "_b": F.count_if(~F.col("left")).over(own)}).where("_a > 0 and _b > 0").drop("_a", "_b")
    found = each_group(met, [*PAIR, "segment"], ["row"], one, f"{DOC} {kind}, left_stream string, right_stream string, left_obs long, right_obs long")
    return found.withColumn("basis", F.lit(basis))


def matches(rows: DataFrame) -> DataFrame:
    """(pair, left_obs, right_obs, basis): a row of each stream at most once in a pair."""
    found = written(anchors(rows).select(*PAIR, "left_obs", "right_obs", "left_place", "right_place", "basis"), "view-anchors")
    turns = written(_directions(found), "view-turns")
    names = [*PAIR, "left_obs", "right_obs", "basis"]
    known = found.select(*names)
    known = written(known.unionByName(_aligned(rows, known, turns, ORDERED, False).select(*names)), "view-matches")
    if "i_balance" in rows.columns:
        facts = lambda name: rows.select(DOC, F.col("stream").alias(f"{name}_stream"), F.col("obs").alias(f"{name}_obs"), *[text(f"i_{f}").alias(f"_{name}_{f}") for f in CORE])
        more = _aligned(rows, known, turns, ASSISTED, True).join(facts("left"), [DOC, "left_stream", "left_obs"]).join(facts("right"), [DOC, "right_stream", "right_obs"])
        same = lambda f: (F.col(f"_left_{f}") != "") & (F.col(f"_left_{f}") == F.col(f"_right_{f}"))
        known = written(known.unionByName(more.where(same("transaction_date") & same("direction") & (same("amount") | same("balance"))).select(*names)), "view-matches")
    pairs = found.select(*PAIR).distinct()
    free = lambda name: rows.select(DOC, F.col("stream").alias(f"{name}_stream"), F.col("obs").alias(f"{name}_obs"), "transaction_date", "direction", text("amount").alias(f"_{name}_a"), text("balance").alias(f"_{name}_b")).where((text("transaction_date") != "") & (text("direction") != "")).join(pairs, [DOC, f"{name}_stream"]).join(known.select(*PAIR, f"{name}_obs"), [*PAIR, f"{name}_obs"], "left_anti")
    fits = free("left").join(free("right"), [*PAIR, "transaction_date", "direction"]).where("(_left_a <> '' and _left_a = _right_a) or (_left_b <> '' and _left_b = _right_b)")
    alone = lambda name: F.count("*").over(Window.partitionBy(*PAIR, f"{name}_obs"))
    last = fits.withColumns({"_l": alone("left"), "_r": alone("right")}).where("_l = 1 and _r = 1").select(*PAIR, "left_obs", "right_obs", F.lit(UNIQUE).alias("basis"))
    return written(known.unionByName(last), "view-matches")


def _groups(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(document_id, obs, event): observations joined by links, each group named by its first; smallest names spread until none changes."""
    both = written(links.select(DOC, F.col("left_obs").alias("obs"), F.col("right_obs").alias("other")).unionByName(links.select(DOC, F.col("right_obs").alias("obs"), F.col("left_obs").alias("other"))).distinct(), "view-links")
    named = rows.select(DOC, "obs", F.col("obs").alias("event"))
    while True:
        heard = both.join(named.select(DOC, F.col("obs").alias("other"), F.col("event").alias("_e")), [DOC, "other"]).groupBy(DOC, "obs").agg(F.min("_e").alias("_e"))
        new = written(named.join(heard, [DOC, "obs"], "left").select(DOC, "obs", F.least("event", "_e").alias("event"), F.coalesce(F.col("_e") < F.col("event"), F.lit(False)).alias("_moved")), "view-events")
        moved, named = new.where("_moved").limit(1).count(), new.drop("_moved")
        if not moved:
            return named


def _untangled(rows: DataFrame, named: DataFrame, links: DataFrame) -> DataFrame:
    """Groups with two rows of a stream joined anew, match by match, leaving out what would bring two of a stream together.

    A group is what one transaction, or a few alike, look like in the views of a document; only such groups go to a task each.
    """
    of = named.join(rows.select(DOC, "obs", "stream", "first_obs"), [DOC, "obs"])
    odd = of.groupBy(DOC, "event", "stream").agg(F.count("*").alias("n")).where("n > 1").select(DOC, "event").distinct()
    tangled = of.join(odd, [DOC, "event"])
    first = lambda name: rows.select(DOC, F.col("obs").alias(f"{name}_obs"), F.col("first_obs").alias(f"_{name}"))
    ordered = links.join(first("left"), [DOC, "left_obs"]).join(first("right"), [DOC, "right_obs"]).withColumn("rank", F.struct(F.least("_left", "_right"), F.greatest("_left", "_right"), F.array_position(F.array(*map(F.lit, BASES)), F.col("basis")), "left_obs"))
    edges = ordered.join(tangled.select(DOC, "event", F.col("obs").alias("left_obs")), [DOC, "left_obs"]).groupBy(DOC, "event").agg(F.array_sort(F.collect_list(F.struct("rank", "left_obs", "right_obs"))).alias("edges"))
    members = tangled.groupBy(DOC, "event").agg(F.array_sort(F.collect_list(F.struct("obs", "stream"))).alias("members")).join(edges, [DOC, "event"])

    def split(table: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in table.itertuples(index=False):
            group = {m["obs"]: {m["obs"]: m["stream"]} for m in r.members}
            for e in r.edges:
                a, b = group[e["left_obs"]], group[e["right_obs"]]
                if a is not b and not set(a.values()) & set(b.values()):
                    a |= b
                    group.update(dict.fromkeys(b, a))
            out += [(getattr(r, DOC), obs, min(g)) for obs, g in group.items()]
        return pd.DataFrame(out, columns=[DOC, "obs", "event"])

    fixed = members.groupBy(DOC, "event").applyInPandas(split, f"{DOC} {dict(rows.dtypes)[DOC]}, obs long, event long")
    return named.join(odd, [DOC, "event"], "left_anti").select(DOC, "obs", "event").unionByName(fixed)


def consolidated(observations: DataFrame) -> Views:
    """Matches between the views of each document, and the events that they make of its observations.

    observations: (document_id, obs, account_kind, direct_owner, the twelve fields as text, and perhaps independent
    readings i_account_number, i_transaction_date, i_direction, i_amount, i_balance, i_counterparty_account). obs numbers
    a document's rows in their order. An event's values are those of its representative: a row with its own owner before
    others, then the fullest, then the first. What it lacks is filled where all others agree; what they differ in is
    listed. Rows that match nothing are events of their own; null texts count as empty.
    """
    rows = written(streams(observations), "view-rows")
    links = matches(rows)
    named = written(_untangled(rows, _groups(rows, links), links), "view-groups")
    filled = reduce(lambda a, b: a + b, [(text(f) != "").cast("int") for f in FIELDS])
    one = F.struct((~F.col("direct_owner")).cast("int").alias("rank"), (-filled).alias("lack"), "obs", *[text(f).alias(f) for f in FIELDS])
    events = rows.join(named, [DOC, "obs"]).groupBy(DOC, "event").agg(F.array_sort(F.collect_list(one)).alias("views"))
    head = F.element_at("views", 1)
    options = {f: F.array_sort(F.array_distinct(F.filter(F.col("views")[f], lambda x: x != ""))) for f in FIELDS}
    value = {f: F.when(head[f] != "", head[f]).when(F.size(options[f]) == 1, F.element_at(options[f], 1)).otherwise("") for f in FIELDS}
    clocks = F.filter(options["transaction_time"], lambda x: x.rlike(r"[0-9]{2}:[0-9]{2}:[0-9]{2}$"))
    value["transaction_time"] = F.when((F.size(clocks) == 1) & F.startswith(F.element_at(clocks, 1), value["transaction_date"]), F.element_at(clocks, 1)).otherwise(value["transaction_time"])
    clash = [F.when((F.size(options[f]) > 1) & (F.lit(True) if f != "counterparty_name" else value["counterparty_account"] == ""), F.struct(F.lit(f).alias("field"), options[f].alias("values"))) for f in ("account_number", "transaction_date", "direction", "amount", "balance", "counterparty_account", "counterparty_name")]
    return Views(links, events.select(DOC, "event", head["obs"].alias("representative"), F.array_sort(F.col("views")["obs"]).alias("observations"), *[value[f].alias(f) for f in FIELDS], F.array_compact(F.array(*clash)).alias("conflicts")))
