"""Rows chosen within groups, and columns turned to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. The optimiser keeps k rows per group in each task before the shuffle."""
    return qualify(df, F.row_number().over(W.partitionBy(*by).orderBy(*order)), lambda n: n <= k)


def distinct_on(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return top_per_group(df, by, order, 1)


def qualify(df: DataFrame, value: Column, test) -> DataFrame:
    """Rows whose window value passes a test; the value itself isn't returned."""
    return df.withColumn("_value", value).where(test(F.col("_value"))).drop("_value")


def unpivot(df: DataFrame, keep: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """A row for each kept row and column."""
    return df.unpivot(keep, columns, name, value)
