"""Queries of the library by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "agg01_stratified_report"
PLANS = ("scoring", "comparing", "labelling", "ranking", "sampling", "minting", "joining", "texts", "sequences", "corpora", "checks", "reports", "scans", "assembly", "further", "probes", "decisions")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; without SQL it is one that SQL can't express."""

    def add(make: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = make
        if sql is not None:
            ORACLES[name] = sql
        return make

    return add


def load() -> None:
    for plan in PLANS:
        import_module(f"gaugeworks.plans.{plan}")
