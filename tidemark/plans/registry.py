"""Query registry: one Spark query and (where SQL can say it) one oracle.

``QUERIES[key] = (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
Keys are the survey's operator numbers plus a short name. Every query reads
the fixture tables (or data Spark derives from them) whole; no row caps.
Doubles are compared after rounding, so sort keys are rounded to 9 dp on
both sides and ties broken by ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[QueryFn, str | None]] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[key] = (fn, sql)
        return fn
    return deco


def _load_all() -> None:
    # importing the modules registers their queries
    from tidemark.plans import q_core, q_detect, q_votes, q_stats, q_clean, q_meta, q_stream  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in QUERIES.items() if v[1]}
