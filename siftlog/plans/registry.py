"""Collects the registered queries and their SQL twins from the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = [
    "q_detect", "q_parse", "q_mapping", "q_envelope", "q_search", "q_activity", "q_delivery",
    "q_governance", "q_dataset", "q_sources", "q_measure", "q_regress", "q_streams",
]


def query(name: str, oracle: str | None = None):
    """Register a query; `oracle` is SQL over the given tables and derived views."""

    def keep(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if oracle is not None:
            from siftlog.plans.oracle_views import with_views

            ORACLES[name] = with_views(oracle)
        return function

    return keep


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"siftlog.plans.{module}")


load()
