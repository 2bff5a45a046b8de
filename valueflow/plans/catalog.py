"""Registry of named queries: Spark builder + DuckDB oracle text.

Each entry maps an inventory name (``<id>_<name>``) to a function
``(spark, sf_dir) -> DataFrame`` and, when the operator is expressible in
SQL, the equivalent DuckDB query over the star tables (ledger views are
added as CTEs by ``oracle.with_ledger``).  Every query reads the whole
derived ledger; parameters below are report inputs (an ``as_of`` instant, a
month), never row caps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.ledger import Ledger
from .oracle import with_ledger

# --- fixed values: report parameters of the registered queries ---
AS_OF = "2001-06-15 12:00:00"       # "now" for goods, stock and nutrition reports
MONTH = "199803"                   # month of the monthly reports
FUNDS_AS_OF = "2023-12-28 00:00:00"  # "now" for the money side (movements are in 2024-01)
FUNDS_DAYS = 7

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None, views: list[tuple[str, str]] | None = None):
    """Decorator: ``fn(led) -> DataFrame`` becomes ``(spark, sf_dir) -> DataFrame``; ``views`` are more CTEs for the oracle."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Ledger.from_star(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = (run, with_ledger(sql, views) if sql else None)
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}


def _load():
    # importing the query modules fills the registry
    from . import queries_goods, queries_money, queries_stock, queries_nutrition  # noqa: F401
    from . import queries_basic, queries_match, queries_quality, queries_sources  # noqa: F401
    from ..streaming import queries_stream  # noqa: F401
