"""Registry of the named queries exposed through ``__spark_entry__``.

Each query is a function ``(spark, sf_dir) -> DataFrame`` over the driver
tables (through the fixture views); the optional oracle is DuckDB SQL over the
same tables.  Modules under ``charlens.plans`` register on import.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Double columns rounded, so that both engines' sums compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def load_all() -> None:
    # import for the side effect of registration
    from charlens.plans import (  # noqa: F401
        q_catalog,
        q_evaluation,
        q_files,
        q_graph,
        q_inference,
        q_mentions,
        q_metrics,
        q_repair,
        q_retrieval,
        q_streaming,
    )
