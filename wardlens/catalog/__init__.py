"""Named queries: each is a Spark callable plus, where SQL can say it, a DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardlens.catalog.bindings import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name, with the SQL text that checks it."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is already registered")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return register


def load_all() -> None:
    from wardlens.catalog import (  # noqa: F401
        answers,
        basics,
        cohort,
        evaluation,
        explore,
        models,
        notes,
        stays,
    )
