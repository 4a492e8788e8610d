"""Named queries over the given tables, each with SQL that must give the same rows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from joblattice.plans.bindings import check_cte


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, uses: tuple[str, ...] = (), name: str | None = None):
    """Registers ``run(spark, sf_dir)``; ``uses`` are the logical tables its SQL reads."""

    def register(run):
        key = name or run.__name__
        if key in QUERIES:
            raise ValueError(f"query '{key}' is registered twice")
        QUERIES[key] = Query(key, run, with_tables(sql, uses) if sql else None)
        return run

    return register


def with_tables(sql: str, uses: tuple[str, ...]) -> str:
    """The statement with its logical tables defined; it may start with its own WITH."""
    if not uses:
        return sql
    ctes = ", ".join(check_cte(u) for u in uses)
    rest = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if rest.upper().startswith(start):
            return f"{start}{ctes}, {rest[len(start):]}"
    return f"WITH {ctes} {rest}"
