"""Registry of driver queries: each operator run over the adapter views of one
driver folder, and its DuckDB oracle over the same views.

``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name] -> SQL``.
The oracle is independent SQL written from the operator's specification; only
the adapter views (the inputs) are shared text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapter import Adapter, duckdb_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: The oracle texts as registered, without the adapter views before them.
ORACLE_BODY: dict[str, str] = {}


def register(name: str, views: list[str] | None = None, oracle: str | None = None, recursive: bool = False):
    """Register ``fn(adapter) -> DataFrame`` under ``name``; ``oracle`` is the
    SQL body (CTEs allowed, written after the adapter CTEs as ``, x AS (...)``
    or a plain ``SELECT``), ``views`` the adapter views it reads, ``recursive`` says
    that one of its CTEs refers to itself."""

    def deco(fn: Callable[[Adapter], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Adapter(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            body = ORACLE_BODY[name] = oracle.strip()
            head = duckdb_ctes(views or [])
            sql = head + "\n" + body
            if recursive:
                sql = "WITH RECURSIVE " + sql[len("WITH "):]
            ORACLE[name] = sql
        return fn

    return deco


MODULES = ["q_reports", "q_cash", "q_ledgers", "q_stock", "q_tables"]


def load_all() -> None:
    import importlib

    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")
