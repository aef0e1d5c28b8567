"""Quantified and projected subqueries, in three-valued logic, as joins and one-row summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(values: DataFrame) -> DataFrame:
    """One row: count, nulls, least and greatest of a one-column frame. Built by partial aggregation."""
    v = F.col(values.columns[0])
    return values.agg(F.count("*").alias("_n"), F.count_if(v.isNull()).alias("_nulls"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))


def quantified(df: DataFrame, left: Column, op: str, quantifier: str, values: DataFrame, name: str = "result") -> DataFrame:
    """df with ``left op ANY|ALL (values)`` as a boolean column.

    Inequalities need only the extremes; ``= ANY`` and ``<> ALL`` are IN and NOT IN. The one-row summary is joined as a scalar, so its
    size is proven.
    """
    every = quantifier.upper() == "ALL"
    if (op, every) in (("=", False), ("<>", True)):
        out = is_in(df, left, values, name)
        return out.withColumn(name, ~F.col(name)) if every else out
    test = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    joined = df.crossJoin(F.broadcast(summary(values)))
    if op == "=":  # = ALL
        hit = (F.col("_lo") == left) & (F.col("_hi") == left)
    elif op == "<>":  # <> ANY
        hit = (F.col("_lo") != left) | (F.col("_hi") != left)
    else:
        low = (op in ("<", "<=")) == every
        hit = test[op](left, F.col("_lo") if low else F.col("_hi"))
    if every:
        value = F.when(F.col("_n") == 0, True).when(hit == False, False).when(F.col("_nulls") > 0, None).otherwise(hit)  # noqa: E712
    else:
        value = F.when(F.col("_n") == 0, False).when(hit, True).when(F.col("_nulls") > 0, None).otherwise(hit)
    return joined.withColumn(name, value).drop("_n", "_nulls", "_lo", "_hi")


def is_in(df: DataFrame, left: Column, values: DataFrame, name: str = "result") -> DataFrame:
    """df with ``left IN (values)`` as a three-valued column: a join to the distinct values beside the summary."""
    distinct = values.select(F.col(values.columns[0]).alias("_v")).where("_v is not null").distinct().withColumn("_hit", F.lit(True))
    joined = df.withColumn("_left", left).join(distinct, F.col("_left") == F.col("_v"), "left").crossJoin(F.broadcast(summary(values)))
    value = F.when(F.col("_n") == 0, False).when(F.col("_left").isNull(), None).when(F.col("_hit"), True).when(F.col("_nulls") > 0, None).otherwise(False)
    return joined.withColumn(name, value).drop("_left", "_v", "_hit", "_n", "_nulls", "_lo", "_hi")


def exists(df: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    return df.join(other, on, "left_semi")


def not_exists(df: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    return df.join(other, on, "left_anti")


def not_in(df: DataFrame, left: Column, values: DataFrame) -> DataFrame:
    """Rows for which ``left NOT IN (values)`` is true: none if the values hold a null."""
    return is_in(df, left, values, "_in").where(~F.col("_in")).drop("_in")


def scalar(df: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """df with a scalar subquery's value, null if it has no row; more than one row is an error at run time."""
    v = values.columns[0]
    one = values.agg(F.when(F.count("*") > 1, F.raise_error(F.lit("more than one row returned by a subquery"))).otherwise(F.max(v)).alias(name))
    return df.crossJoin(F.broadcast(one))
