"""The whole evaluation of all cases: events, phases, netting, counterparties, rules, key figures."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, events, flow, netting, rules
from .storage import written


class Evaluation:
    """Stages of an evaluation, each computed when it is first asked for and kept for those that build on it.

    keep gets a stage's table and its name; by default it writes the table, so that eleven rules don't repeat the
    matching, and so that plans stay small.
    """

    def __init__(self, observations: DataFrame, accounts: DataFrame, cases: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = written):
        self._keep, self.cases, self.accounts = keep, cases, accounts
        self._given = observations

    @cached_property
    def _observed(self) -> DataFrame:
        """All rows with their events, written once: what follows reads them from there."""
        return events.observed_events(self._given, netting.owned_accounts(self.accounts))

    @property
    def observations(self) -> DataFrame:
        return self._observed.select(*self._given.columns)

    @property
    def events(self) -> DataFrame:
        return self._observed.select("case_id", "id", *events.EVENT)

    def _event_rows(self, owned: bool) -> DataFrame:
        rows = self._observed.where(F.col("_owned") == owned).drop("_owned")
        return flow.tag_phases(events.representatives(rows), self.cases)

    @property
    def event_rows(self) -> DataFrame:
        return self._event_rows(True).unionByName(self._event_rows(False))

    @cached_property
    def transfer_edges(self) -> DataFrame:
        return netting.internal_transfer_edges(self._event_rows(True))

    @cached_property
    def analysed(self) -> DataFrame:
        """Only rows of the party's own accounts can be netted; the others need no look for a partner."""
        own = self._keep(netting.net_internal(self._event_rows(True)), "analysed")
        return own.unionByName(self._event_rows(False).withColumns({"internal_pair_id": F.lit(None).cast("string"), "is_internal": F.lit(False)}))

    @cached_property
    def summary(self) -> DataFrame:
        return self._keep(aggregates.counterparty_summary(self.analysed, self.cases), "counterparties")

    @property
    def context(self) -> rules.Context:
        return rules.Context(self.analysed, self.cases, self.summary)

    def matches(self, **options) -> DataFrame:
        return rules.evaluate(self.context, **options)

    def kpis(self) -> DataFrame:
        return aggregates.case_kpis(self.analysed, self.cases, self.observations)

    def projected(self) -> DataFrame:
        return events.project_back(self.observations, self.events, self.analysed, ["phase_tag", "is_internal", "internal_pair_id"])


def evaluate_case(observations: DataFrame, accounts: DataFrame, cases: DataFrame, **options) -> Evaluation:
    return Evaluation(observations, accounts, cases, **options)
