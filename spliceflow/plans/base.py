"""What the query families share: a registry, rounding, and the SQL of the common inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EV = """ev AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
  (epoch_us(ts) / 1e6 - 1704067200) / 30000.0::DOUBLE AS t, value AS x, event_type AS label FROM events)"""
BV = """bv AS (SELECT label::BIGINT AS track, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS beat,
  list_transform(embedding, lambda v: v::DOUBLE) AS feat FROM embeddings)"""
SG = """sg AS (SELECT l_suppkey AS track, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i,
  l_extendedprice::DOUBLE / 1e5 AS x FROM lineitem), nn AS (SELECT track, count(*) AS n FROM sg GROUP BY 1)"""


class Family:
    """Queries and SQL of one family: use as a decorator with the SQL, or None where SQL can't state the result."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; -0.0 becomes 0.0."""
    out = [(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(*out)


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)
