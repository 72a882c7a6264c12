"""Registered queries over the given tables, each with its SQL twin where SQL can say it.

No flow CSVs are at hand, so ``events`` stands in for labelled flows, ``documents`` and ``embeddings`` for
the analysis history and ``conversations`` for questions; see ``catalog.standins``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL twin."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def load_all() -> None:
    from catalog import features, files, flows, history, quality, questions, responses, streams  # noqa: F401
