"""Joins and predicates over DataFrames where the dialect differs from Spark's own operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.columns import asc, desc


def join_using(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """JOIN USING: each column once, from the left, filled from the right in right and full joins; other columns keep their order."""
    return left.join(right, columns, how)


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """NOT IN over a query, aware of NULL: nothing is kept if the query has a NULL, everything if it has no rows, and a NULL never is in neither.

    An anti join and two look-ups of one row, so nothing is broadcast whatever the query's size."""
    keys = other.select(F.col(other_column).alias("__key"))
    if not keys.take(1):
        return df
    if keys.filter("__key is null").take(1):
        return df.limit(0)
    return df.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__key"), "left_anti")


def top(df: DataFrame, n: int, *keys: tuple[str, bool], offset: int = 0) -> DataFrame:
    """ORDER BY keys (name, descending) with NULL as the largest value, OFFSET and LIMIT: one TakeOrderedAndProject, no full sort."""
    return df.orderBy(*[desc(k) if d else asc(k) for k, d in keys]).offset(offset).limit(n)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that more than one row has: what a primary key forbids."""
    return df.groupBy(*keys).count().filter("count > 1")


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Child rows whose key has no NULL and no parent row: what a foreign key forbids."""
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    there = parent.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(parent_columns)])
    return child.filter(whole).join(there, reduce(Column.__and__, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(columns)]), "left_anti")
