"""Rows that break a constraint, as DataFrames: what a declared constraint would refuse, found in a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """df's rows with a column ``violated`` of the names of the checks that are false for it; a null check is met. One scan."""
    failed = F.array_compact(F.array(*[F.when(~test, F.lit(name)) for name, test in checks.items()]))
    return df.withColumn("violated", F.array_join(failed, ",")).where("violated <> ''")


def not_null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    return check_violations(df, {c: F.col(c).isNotNull() for c in columns})


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that more than one row holds, and how many; a key with a null is never a repeat."""
    known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    return known.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def fk_orphans(child: DataFrame, columns: list[str], parent: DataFrame, to: list[str]) -> DataFrame:
    """child's rows whose key is whole and that no row of parent holds."""
    keys = parent.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(to)])
    known = child.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    return known.join(keys, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(columns)], "left_anti")
