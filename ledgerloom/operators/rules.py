"""Rules: each turns a case's analysed rows into matches. Parameters are data, a rule is a function in a table."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.identity import text
from .aggregates import EXTERNAL, counterparty_lookup
from .netting import fast_in_out


@dataclass
class Context:
    """What rules look at: analysed rows (with phase_tag, is_internal), cases, counterparty summaries."""

    txn: DataFrame
    cases: DataFrame
    summary: DataFrame
    params: dict[str, float] = field(default_factory=dict)

    @property
    def external(self) -> DataFrame:
        return self.txn.where(EXTERNAL)

    def with_dates(self, *dates: str) -> DataFrame:
        return self.external.join(self.cases.select("case_id", *dates), "case_id", "left")

    def cents(self, name: str, default: int) -> int:
        """A parameter in cents; zero stands for the default, as an empty form field would."""
        return round((float(self.params.get(name, 0)) or default) * 100)


def match(rule: str, ident: Column | str, severity: Column | str, kind: str | Column, n: Column, total: Column, phase: Column | str, party: Column | str) -> list[Column]:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return [F.col("case_id"), F.concat(F.lit(f"{rule}_"), lit(ident)).alias("match_id"), F.lit(rule).alias("rule_id"), lit(severity).alias("severity"), lit(kind).alias("match_type"),
            n.cast("long").alias("n_rows"), total.cast("long").alias("total_cents"), lit(phase).alias("time_phase"), lit(party).alias("counterparty")]


def _single(rows: DataFrame, rule: str, severity: Column | str, phase: Column | None = None) -> DataFrame:
    return rows.select(*match(rule, F.col("id"), severity, "SINGLE", F.lit(1), F.col("amount_cents"), phase if phase is not None else F.col("phase_tag"), F.col("counterparty_name")))


def r01(c: Context) -> DataFrame:
    """Large outflow after filing or, worse, after the report order."""
    late = lambda t: F.coalesce(F.col("transaction_date") >= F.col(t), F.lit(False))
    rows = c.with_dates("t3", "t4").where((F.col("direction") == "OUT") & (F.col("amount_cents") >= c.cents("largeAmountThreshold", 50_000)) & (late("t3") | late("t4")))
    return _single(rows, "R01", F.when(late("t4"), "L0").otherwise("L1"), F.when(late("t4"), "《报告财产令》送达后").otherwise("执行立案后"))


def r02(c: Context) -> DataFrame:
    """Two or more cash withdrawals just below the reporting limit: one match per case."""
    cash = text("summary").rlike(P.R02_SUMMARY) | text("counterparty_name").rlike(P.R02_PARTY)
    rows = c.external.where((F.col("direction") == "OUT") & cash & F.col("amount_cents").between(c.cents("minThreshold", 45_000), c.cents("maxThreshold", 50_000)))
    groups = rows.groupBy("case_id").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("total"), F.min_by("phase_tag", "seq").alias("phase")).where("n >= 2")
    return groups.select(*match("R02", "GROUP_ALL", "L0", "GROUP", F.col("n"), F.col("total"), F.col("phase"), "【现金取现/ATM】"))


def r03(c: Context) -> DataFrame:
    """Several transfers to a suspected relative."""
    tagged = text("role_tag").rlike("亲属|配偶")
    rows = c.summary.where((F.col("suspected_relative") | tagged) & (F.col("n_rows") >= int(c.params.get("minCount", 0) or 3)) & (F.col("net_out_cents") >= c.cents("totalAmountThreshold", 30_000)))
    return rows.select(*match("R03", F.col("party_key"), F.when(F.col("net_out_cents") >= 10_000_000, "L0").otherwise("L1"), "GROUP", F.col("n_rows"), F.col("net_out_cents"), "多阶段累计", F.col("name")))


def r04(c: Context) -> DataFrame:
    """A large receipt paid out again within 48 hours."""
    pairs = fast_in_out(c.txn)
    rows = c.txn.select("case_id", F.col("id").alias("left_id"), "amount_cents", "phase_tag", F.col("counterparty_name").alias("source"))
    paid = c.txn.select("case_id", F.col("id").alias("right_id"), F.col("counterparty_name").alias("target"))
    found = pairs.join(rows, ["case_id", "left_id"]).join(paid, ["case_id", "right_id"])
    party = F.concat(F.coalesce("source", F.lit("未知来源")), F.lit(" -> "), F.coalesce("target", F.lit("未知去向")))
    return found.select(*match("R04", F.concat_ws("_", "left_id", "right_id"), "L1", "GROUP", F.lit(2), F.col("amount_cents"), F.col("phase_tag"), party))


def r05(c: Context) -> DataFrame:
    """Repayments by their remark; what came in from the party before tells how doubtful they are."""
    rows = c.external.where((F.col("direction") == "OUT") & (F.col("amount_cents") >= 100_000) & text("summary").rlike(P.R05_REPAYMENT))
    rows = counterparty_lookup(rows, c.summary, ["in_cents"])
    return _single(rows, "R05", F.when(F.coalesce("in_cents", F.lit(0)) * 10 < F.col("amount_cents") * 3, "L1").otherwise("L2"))


def r06(c: Context) -> DataFrame:
    """Trade-like payments to a party that was tagged as affiliated."""
    rows = c.external.where((F.col("direction") == "OUT") & (F.col("amount_cents") >= 2_000_000) & text("summary").rlike(P.R06_TRADE))
    return _single(counterparty_lookup(rows, c.summary, ["role_tag"]).where(text("role_tag").rlike("关联|独资")), "R06", "L1")


def r07(c: Context) -> DataFrame:
    """Account closures and card changes, in any direction."""
    return _single(c.txn.where(text("summary").rlike(P.R07_CLOSURE)), "R07", "L1")


def r08(c: Context) -> DataFrame:
    """Insurance, securities and wealth products, grouped by class and party, seen from the freezing date."""
    party, summary = text("counterparty_name"), text("summary")
    insurance = party.rlike(P.R08_INSURANCE_PARTY) | summary.rlike(P.R08_INSURANCE_SUMMARY)
    securities = party.rlike(P.R08_SECURITIES_PARTY) | summary.rlike(P.R08_SECURITIES_SUMMARY)
    wealth = party.rlike(P.R08_WEALTH) | summary.rlike(P.R08_WEALTH)
    kind = F.when(insurance, "保险保单").when(securities, "证券/基金/信托").when(wealth, "银行理财/大额存单")
    rows = c.with_dates("t5").where("direction = 'OUT'").withColumn("kind", kind).where(F.col("kind").isNotNull() & (F.col("amount_cents") >= F.when(insurance, 50_000).otherwise(500_000)))
    rows = rows.withColumn("key", F.concat(F.col("kind"), F.lit("::"), F.when(party != "", party).otherwise(summary)))
    first = F.struct("transaction_date", "seq")
    groups = rows.groupBy("case_id", "key").agg(
        F.count("*").alias("n"), F.sum("amount_cents").alias("total"), F.count_if(F.col("transaction_date") < F.col("t5")).alias("before"), F.max("t5").alias("t5"),
        F.min_by("phase_tag", first).alias("phase"), F.min_by("counterparty_name", first).alias("party"),
    )
    frozen = F.concat(F.lit("（冻结日 "), F.col("t5").cast("string"), F.lit("）"))
    phase = F.when(F.col("t5").isNotNull() & (F.col("before") == F.col("n")), F.concat(F.lit("冻结前购买/缴费"), frozen)).when(F.col("t5").isNotNull() & (F.col("before") > 0), F.concat(F.lit("冻结前后均有交易"), frozen)).otherwise(F.col("phase"))
    return groups.select(*match("R08", F.col("key"), "L1", F.when(F.col("n") > 1, "GROUP").otherwise("SINGLE"), F.col("n"), F.col("total"), phase, F.coalesce("party", F.lit("相关金融机构"))))


def r09(c: Context) -> DataFrame:
    """Income after filing from payers that paid in two months or more."""
    rows = c.with_dates("t3").where((F.col("direction") == "IN") & F.coalesce(F.col("transaction_date") >= F.col("t3"), F.lit(True)) & (text("summary").rlike(P.R09_INCOME) | (F.col("amount_cents") >= 500_000)) & (F.trim(text("counterparty_name")) != ""))
    payers = rows.groupBy("case_id", F.trim("counterparty_name").alias("payer")).agg(F.countDistinct(F.date_format("transaction_date", "yyyy-MM")).alias("months"), F.count("*").alias("n"), F.sum("amount_cents").alias("total")).where("months >= 2")
    groups = payers.groupBy("case_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n >= 2")
    return groups.select(*match("R09", "GROUP_ALL", "L2", "GROUP", F.col("n"), F.col("total"), "全执行周期", "【持续性收入来源方】"))


def r10(c: Context) -> DataFrame:
    """Money lent out, which is owed to the debtor."""
    lent = ~text("summary").rlike(P.R10_REPAYMENT) & text("summary").rlike(P.R10_LENDING)
    return _single(c.external.where((F.col("direction") == "OUT") & (F.col("amount_cents") >= 2_000_000) & lent), "R10", "L1")


def r11(c: Context) -> DataFrame:
    """No income declared, yet receipts after the report order (or the filing, without one)."""
    declared = c.cases.where((F.col("declared_income_cents") == 0) & text("declared_content").rlike(P.R11_NO_INCOME)).select("case_id", F.coalesce("t4", "t3").alias("since")).where("since is not null")
    rows = c.external.join(declared, "case_id").where((F.col("direction") == "IN") & (F.col("transaction_date") >= F.col("since")))
    groups = rows.groupBy("case_id").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("total")).where("total > 1000000")
    return groups.select(*match("R11", "INCOME_DISCREPANCY", "L0", "GROUP", F.col("n"), F.col("total"), "《报告财产令》送达后", "【多方收入来源】"))


Rule = Callable[[Context], DataFrame]
RULES: dict[str, Rule] = {f.__name__.upper(): f for f in (r01, r02, r03, r04, r05, r06, r07, r08, r09, r10, r11)}


def evaluate(context: Context, enabled: Iterable[str] | None = None, params: dict[str, dict[str, float]] | None = None, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Matches of all enabled rules. A rule whose plan can't be built doesn't stop the others: a warning names it and its error."""
    rules = RULES if rules is None else rules
    found, failed = [], []
    for name in rules if enabled is None else enabled:
        try:
            found.append(rules[name](Context(context.txn, context.cases, context.summary, (params or {}).get(name, {}))))
        except Exception as error:  # noqa: BLE001  a faulty rule of a user mustn't stop the others
            failed.append((name, error))
            warnings.warn(f"rule {name} was left out: {error!r}", RuntimeWarning, stacklevel=2)
    if not found:
        raise ValueError(f"no rule could be evaluated: {failed}")
    return reduce(DataFrame.unionByName, found)


def carry_annotations(matches: DataFrame, previous: DataFrame, fields: Iterable[str] = ("lawyer_adopted", "lawyer_notes", "verification_status", "verification_notes")) -> DataFrame:
    """matches with the human fields of earlier matches of the same id; matches that are gone take theirs along."""
    kept = [f for f in fields if f in previous.columns]
    return matches.drop(*kept).join(previous.select("case_id", "match_id", *kept), ["case_id", "match_id"], "left")


def first_clues(matches: DataFrame, k: int = 5) -> DataFrame:
    """The first k matches of each case: worst severity, then largest."""
    order = Window.partitionBy("case_id").orderBy("severity", F.desc("total_cents"), "match_id")
    return matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
