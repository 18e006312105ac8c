"""The query catalogue: name, DataFrame plan and (where SQL can say it) the SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tradeframe.plans.view_sql import with_views
from tradeframe.sources.views import BusinessViews

TODAY = "1998-08-01"
START, END = "1996-01-01", "1998-06-30"


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[BusinessViews], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under a name together with its check."""
    def register(plan: Callable[[BusinessViews], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} exists already")
        QUERIES[name] = Query(name, plan, with_views(sql) if sql else None)
        return plan
    return register


def load_all() -> dict[str, Query]:
    from tradeframe.plans import (  # noqa: F401
        document_queries, listing_queries, report_queries, stock_queries, workflow_queries, write_queries)
    return QUERIES
