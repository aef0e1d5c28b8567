"""Relational operators that need more than one DataFrame call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on all common columns; without any it is a cross join."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, how) if common else left.crossJoin(right)


def fetch(df: DataFrame, keys: list[Column], n: int, ties: bool = False, offset: int = 0) -> DataFrame:
    """OFFSET / FETCH FIRST n ROWS ONLY or WITH TIES.

    Only rows are sorted by Spark's top-k operator. With ties everything of rank offset + n or less is taken: Spark keeps
    only such ranks of each partition before one task brings them together, so that task sees the result and not the table.
    """
    if not ties:
        ordered = df.orderBy(*keys)
        return (ordered.offset(offset) if offset else ordered).limit(n)
    order = Window.orderBy(*keys)
    ranked = df.withColumn("_rank", F.rank().over(order)).where(F.col("_rank") <= offset + n)
    if offset:
        ranked = ranked.withColumn("_row", F.row_number().over(order)).where(F.col("_row") > offset).drop("_row")
    return ranked.orderBy(*keys).drop("_rank")


def top_n(df: DataFrame, partition: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each partition; Spark prunes by group limit before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def ordinal(df: DataFrame, positions: list[int]) -> list[Column]:
    """ORDER BY 1, -2: columns by position, negative ones descending, nulls last; out of range is an error."""
    for p in positions:
        if not 1 <= abs(p) <= len(df.columns):
            raise ValueError(f"ORDER BY position {abs(p)} is not in the select list")
    return [F.col(df.columns[abs(p) - 1]).asc_nulls_last() if p > 0 else F.col(df.columns[-p - 1]).desc_nulls_last() for p in positions]


def intersect(left: DataFrame, right: DataFrame, every: bool = False) -> DataFrame:
    return left.intersectAll(right) if every else left.intersect(right)


def difference(left: DataFrame, right: DataFrame, every: bool = False) -> DataFrame:
    return left.exceptAll(right) if every else left.subtract(right)


def union(left: DataFrame, right: DataFrame, every: bool = False) -> DataFrame:
    return left.unionAll(right) if every else left.unionAll(right).distinct()


def grouping_sets(df: DataFrame, sets: list[list[str]], keys: list[str], aggregates: list[Column]) -> DataFrame:
    """GROUPING SETS by one expand and one shuffle."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys]).agg(*aggregates)


def recursive(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = 1000) -> DataFrame:
    """WITH RECURSIVE by deltas: each round applies step to the rows that the last one made, and writes them before the next.

    Raises if it does not end within limit rounds.
    """
    from ..plans.storage import cut

    total = delta = cut(anchor)
    for _ in range(limit):
        delta = cut(step(delta).select(*anchor.columns))
        if delta.isEmpty():
            return total
        total = total.unionAll(delta)
    raise RuntimeError(f"recursion did not end within {limit} rounds")
