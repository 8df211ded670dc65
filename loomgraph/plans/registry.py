"""Named queries: a DataFrame plan and, where SQL can say the same, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class QuerySpec:
    name: str
    plan: Plan
    sql: str | None = None


SPECS: dict[str, QuerySpec] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register ``plan`` under ``name``; names are unique."""

    def add(plan: Plan) -> Plan:
        if name in SPECS:
            raise ValueError(f"query {name} is registered twice")
        SPECS[name] = QuerySpec(name, plan, sql)
        return plan

    return add
