"""Named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.text import iso
from keepsake.plans.oracle_tables import with_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **tables: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(sql, **tables)
        return fn

    return add


def brief(rows: DataFrame) -> DataFrame:
    """The columns listings are compared on."""
    return rows.select(
        "id",
        "kind",
        "title",
        "status",
        F.col("rating").cast("bigint").alias("rating"),
        F.array_join("tags", " ").alias("tags"),
        iso(F.col("created_at")).alias("created_at"),
    )


BRIEF = """id, kind, title, status, cast(rating as bigint) as rating, array_to_string(tags, ' ') as tags,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') as created_at"""
