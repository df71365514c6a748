"""Registered queries, each with the DuckDB SQL of the same rows or the reason why there is none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import Relations, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Why a query has no SQL.
WITHOUT: dict[str, str] = {}


def query(oracle: str | None = None, why: str = "") -> Callable[[Callable[[Relations], DataFrame]], Callable[[Relations], DataFrame]]:
    """Register a function of the relations under its name."""

    def register(f: Callable[[Relations], DataFrame]) -> Callable[[Relations], DataFrame]:
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        if oracle:
            ORACLES[name] = with_views(oracle)
        else:
            WITHOUT[name] = why
        return f

    return register


def load() -> None:
    """Import the modules that register queries."""
    from tessera.plans import cluster_queries, editorial_queries, enrichment_queries, governance_queries, hydration_queries, more_queries, search_queries, story_queries, text_queries  # noqa: F401
