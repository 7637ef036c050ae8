"""Scores of a reading against the true rows: alignment by unique keys, multiset overlap, acceptance figures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import written


def numbered_occurrences(rows: DataFrame, fields: Sequence[str], order: str) -> DataFrame:
    """rows with occurrence: equal rows are numbered, so that multisets can be joined."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*fields).orderBy(order)))


def multiset_overlap(gold: DataFrame, pred: DataFrame, keys: Sequence[str], grains: dict[str, Sequence[str]]) -> DataFrame:
    """Per key and grain: rows of either side and how many agree, counted as multisets. Counts are joined, not rows."""
    out = []
    for name, fields in grains.items():
        g, p = (t.groupBy(*keys, *fields).agg(F.count("*").alias(n)) for t, n in ((gold, "_g"), (pred, "_p")))
        other = p.select("_p", *[F.col(c).alias(f"_{c}") for c in (*keys, *fields)])
        both = g.join(other, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, *fields)]), "full")
        picked = both.select(*[F.coalesce(c, f"_{c}").alias(c) for c in keys], F.coalesce("_g", F.lit(0)).alias("_g"), F.coalesce("_p", F.lit(0)).alias("_p"))
        out.append(picked.groupBy(*keys).agg(F.sum("_g").alias("gold_rows"), F.sum("_p").alias("pred_rows"), F.sum(F.least("_g", "_p")).alias("common_rows")).withColumn("grain", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def align_unique(gold: DataFrame, pred: DataFrame, keys: Sequence[Sequence[str]], same: Sequence[str] = (), gold_id: str = "gold_id", pred_id: str = "pred_id") -> DataFrame:
    """(gold_id, pred_id, step): pairs by the first of several keys that is unique on both sides among what is left.

    Keys with a null don't count. At last rows equal in all fields of `same`, nulls included, are paired one by one.
    Both sides are one table, and each key is one window over it. What the first key pairs, most rows as a rule, is
    written by its ids alone, and only the others go on to the next keys.
    """
    fields = list(dict.fromkeys([c for key in keys for c in key] + list(same)))
    side = lambda t, i, own: t.select(F.lit(own).alias("_gold"), F.col(i).alias("_id"), *fields)
    rows = side(gold, gold_id, True).unionByName(side(pred, pred_id, False)).withColumns({"_step": F.lit(None).cast("int"), "_with": F.lit(None).cast(dict(pred.dtypes)[pred_id])})

    def pair(rows: DataFrame, key: Sequence[str], free: Column, step: int) -> DataFrame:
        # rows that can't be paired are dealt by their ids, so that no null or common key gathers them
        rows = rows.withColumn("_free", free).withColumn("_deal", F.when(F.col("_free"), 0).otherwise(F.xxhash64("_gold", "_id")))
        w = Window.partitionBy(*key, "_deal")
        mine, other = F.col("_free") & F.col("_gold"), F.col("_free") & ~F.col("_gold")
        rows = rows.withColumns({"_ng": F.count_if(mine).over(w), "_np": F.count_if(other).over(w), "_other": F.max(F.when(other, F.col("_id"))).over(w)})
        hit = F.col("_free") & (F.col("_ng") == 1) & (F.col("_np") == 1)
        return rows.withColumns({"_step": F.when(hit, step).otherwise(F.col("_step")), "_with": F.when(hit, F.col("_other")).otherwise(F.col("_with"))}).drop("_free", "_deal", "_ng", "_np", "_other")

    done = []
    for step, key in enumerate(keys, 1):
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
        rows = pair(rows, key, F.col("_step").isNull() & known, step)
        if step == 1:
            free = F.col("_step").isNull()
            lean = rows.where("_gold or _step is null").select("_gold", "_id", "_step", "_with", *[F.when(free, F.col(c)).alias(c) for c in fields])
            first = written(lean, "first-pairs")
            done.append(first.where("_step is not null"))
            rows = first.where("_step is null")
    if same:
        left = F.col("_step").isNull()
        order = Window.partitionBy(*same, "_gold", "_done").orderBy("_id")
        rows = rows.withColumn("_done", F.when(left, 0).otherwise(F.xxhash64("_gold", "_id"))).withColumn("_nth", F.row_number().over(order))
        rows = pair(rows, [*same, "_nth"], left, len(keys) + 1)
    found = [t.where("_gold and _step is not null").select(F.col("_id").alias(gold_id), F.col("_with").alias(pred_id), F.col("_step").alias("step")) for t in (*done, rows)]
    return reduce(DataFrame.unionByName, found)


def field_accuracy(gold: DataFrame, pred: DataFrame, pairs: DataFrame, keys: Sequence[str], fields: Sequence[str], gold_id: str = "gold_id", pred_id: str = "pred_id") -> DataFrame:
    """Per key and field: true values and how many the aligned rows read correctly. Rows without a partner count as wrong."""
    joined = gold.join(pairs, gold_id, "left").join(pred.select(pred_id, *[F.col(f).alias(f"_p_{f}") for f in fields]), pred_id, "left")
    sides = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("has"), F.coalesce(F.col(f) == F.col(f"_p_{f}"), F.lit(False)).alias("ok")) for f in fields])).alias("x")
    return joined.select(*keys, sides).groupBy(*keys, "x.field").agg(F.count_if("x.has").alias("true_values"), F.count_if(F.col("x.has") & F.col("x.ok")).alias("correct_values"))


def acceptance(gold: DataFrame, pred: DataFrame, pairs: DataFrame, alerts: DataFrame, keys: Sequence[str], critical: Sequence[str], gold_id: str = "gold_id", pred_id: str = "pred_id") -> DataFrame:
    """Per key: rows right in all critical fields over the larger side, rows under alert, wrong rows without one, and whether all three limits hold."""
    named = pred.select(pred_id, *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(f).alias(f"_p_{f}") for f in critical])
    right = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"_p_{f}")) for f in critical])
    paired = gold.join(pairs, gold_id, "left").join(named, pred_id, "left").withColumn("right", right & F.col(pred_id).isNotNull())
    warned = alerts.select(pred_id).distinct().withColumn("alerted", F.lit(True))
    g = paired.join(warned, pred_id, "left").groupBy(*keys).agg(F.count("*").alias("gold_rows"), F.count_if("right").alias("correct_rows"), F.count_if(~F.col("right") & F.col(pred_id).isNotNull() & F.col("alerted").isNull()).alias("silent_wrong"))
    extra = pred.join(pairs.select(pred_id).withColumn("_paired", F.lit(True)), pred_id, "left").join(warned, pred_id, "left")
    p = extra.groupBy(*keys).agg(F.count("*").alias("pred_rows"), F.count_if("alerted").alias("alerted_rows"), F.count_if(F.col("_paired").isNull() & F.col("alerted").isNull()).alias("silent_extra"))
    both = g.join(p, list(keys), "full").na.fill(0)
    accuracy = F.col("correct_rows") / F.greatest("gold_rows", "pred_rows")
    review = F.col("alerted_rows") / F.greatest("pred_rows", F.lit(1))
    return both.withColumns({"critical_accuracy": accuracy, "review_rate": review, "unalerted_errors": F.col("silent_wrong") + F.col("silent_extra")}).withColumn("accepted", (F.col("critical_accuracy") >= 0.995) & (F.col("review_rate") <= 0.05) & (F.col("unalerted_errors") == 0)).drop("silent_wrong", "silent_extra")


def alert_quality(errors: DataFrame, alerts: DataFrame, pred_id: str = "pred_id") -> DataFrame:
    """Per alert stage: alerts, rows under alert, how many of these were wrong, and the share of all wrong rows caught.

    errors: (pred_id, wrong) for every predicted row; alerts: (pred_id, stage).
    """
    wrong = errors.agg(F.count_if("wrong").alias("_all_wrong"))
    rows = alerts.groupBy("stage", pred_id).agg(F.count("*").alias("k")).join(errors, pred_id, "left")
    stages = rows.groupBy("stage").agg(F.sum("k").alias("alerts"), F.count("*").alias("rows_alerted"), F.count_if("wrong").alias("wrong_alerted"))
    return stages.join(F.broadcast(wrong)).select("stage", "alerts", "rows_alerted", "wrong_alerted", (F.col("wrong_alerted") / F.col("rows_alerted")).alias("precision"), (F.col("wrong_alerted") / F.greatest("_all_wrong", F.lit(1))).alias("recall"))


def suite_rollup(reports: DataFrame) -> DataFrame:
    """One row over all documents' reports (gold_rows, pred_rows, correct_rows, unalerted_errors); sums first, then ratios."""
    sums = reports.agg(*[F.sum(c).alias(c) for c in ("gold_rows", "pred_rows", "correct_rows", "unalerted_errors")], F.count("*").alias("documents"), F.bool_and("accepted").alias("all_accepted"))
    return sums.withColumn("critical_accuracy", F.col("correct_rows") / F.greatest("gold_rows", "pred_rows"))


def direction_code_votes(rows: DataFrame, keys: Sequence[str], marker: str = "marker", direction: str = "direction") -> DataFrame:
    """Direction of each marker by strict plurality of the rows that show both; ties decide nothing."""
    votes = rows.where(F.col(direction).isin("IN", "OUT")).groupBy(*keys, marker, direction).agg(F.count("*").alias("votes"))
    order = Window.partitionBy(*keys, marker).orderBy(F.desc("votes"), direction)
    ranked = votes.withColumns({"_r": F.row_number().over(order), "_next": F.lead("votes").over(order)})
    return ranked.where("_r = 1 and votes > coalesce(_next, 0)").select(*keys, marker, F.col(direction).alias("voted_direction"), "votes")


def gold_best_match(gold: DataFrame, pred: DataFrame, fields: Sequence[str], block: str, weights: dict[str, int], gold_id: str = "gold_id", pred_id: str = "pred_id") -> DataFrame:
    """Equal rows paired as a multiset; of the rest, rows of one block that are each other's best by weighted agreement."""
    keyed = lambda t, i: t.withColumn("_o", F.row_number().over(Window.partitionBy(*fields).orderBy(i)))
    g, p = keyed(gold, gold_id), keyed(pred, pred_id).select(pred_id, *[F.col(f).alias(f"_same_{f}") for f in (*fields, "_o")])
    same = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"_same_{f}")) for f in (*fields, "_o")])
    exact = g.join(p, same).select(gold_id, pred_id, F.lit(None).cast("long").alias("score"))
    gr, pr = gold.join(exact, gold_id, "left_anti"), pred.join(exact, pred_id, "left_anti")
    left, right = gr.select(gold_id, block, *[F.col(f).alias(f"_g_{f}") for f in weights]), pr.select(pred_id, block, *[F.col(f).alias(f"_p_{f}") for f in weights])
    score = reduce(lambda a, b: a + b, [F.when(F.col(f"_g_{f}").eqNullSafe(F.col(f"_p_{f}")), w).otherwise(0) for f, w in weights.items()])
    scored = left.join(right, block).withColumn("score", score.cast("long")).where("score > 0")
    by_gold, by_pred = (Window.partitionBy(a).orderBy(F.desc("score"), b) for a, b in ((gold_id, pred_id), (pred_id, gold_id)))
    mutual = scored.withColumns({"_a": F.row_number().over(by_gold), "_b": F.row_number().over(by_pred)}).where("_a = 1 and _b = 1").select(gold_id, pred_id, "score")
    return exact.unionByName(mutual)
