"""Registered queries of the ledger operators and their SQL."""

from __future__ import annotations

from importlib import import_module

from .registry import QUERIES, SQL, Query

for _part in ("cases", "sequences", "scores", "paging", "readings", "texts", "evidence", "ownership", "mapping", "views", "recovery", "columns", "pending", "answers"):
    import_module(f"{__name__}.{_part}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
