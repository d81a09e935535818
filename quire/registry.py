"""Named queries over the driver tables, each with its DuckDB counterpart where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from quire.session import spread

    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # the text tables come as one file each; the work on them is bound by the processor
    return spread(rows) if name in ("documents", "pages", "conversations") else rows


def load_all() -> None:
    import importlib

    for part in PARTS:
        importlib.import_module(f"quire.queries.{part}")


PARTS = ("catalogue", "changes", "orderings", "segments", "texts", "repair", "extract", "export", "increments")
