"""Data-quality checks: each returns one row (check, violations); nothing is changed."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import fresh

#: Rows of a sample of violations, at most.
SAMPLE_ROWS = 5


def _result(df: DataFrame, name: str, count: Column) -> DataFrame:
    return df.agg(F.coalesce(count, F.lit(0)).cast("long").alias("violations")).select(F.lit(name).alias("check"), "violations")


def _any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which any of the columns is null."""
    return _result(df, "not_null", F.count_if(_any_null(columns)))


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Groups of equal values (null is one) that have several rows."""
    count, = fresh(df, "n_rows")
    return _result(df.groupBy(*columns).agg(F.count("*").alias(count)), "unique", F.count_if(F.col(count) > 1))


def row_count(df: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """1 if the number of rows is outside the bounds."""
    n = F.count("*")
    outside = (n < F.lit(least) if least is not None else F.lit(False)) | (n > F.lit(most) if most is not None else F.lit(False))
    return _result(df, "row_count", F.when(outside, 1).otherwise(0))


def freshness(df: DataFrame, column: str, max_age: timedelta, now: datetime) -> DataFrame:
    """1 if there is no value, or the latest is older than ``max_age`` at ``now``."""
    latest = F.max(column)
    return _result(df, "freshness", F.when(latest.isNull() | (latest < F.lit(now - max_age).cast(df.schema[column].dataType)), 1).otherwise(0))


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is none of ``values``; null passes."""
    return _result(df, "accepted_values", F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(values)))


def custom_sql(violating: DataFrame) -> DataFrame:
    """The rows that a query of violations returns."""
    return _result(violating, "custom_sql", F.count("*"))


def violating_rows(df: DataFrame, check: str, columns: list[str], values: list | None = None) -> DataFrame:
    """At most ``SAMPLE_ROWS`` examples of what a check counts."""
    if check == "not_null":
        return df.where(_any_null(columns)).limit(SAMPLE_ROWS)
    if check == "unique":
        count, = fresh(df, "n_rows")
        return df.groupBy(*columns).agg(F.count("*").alias(count)).where(F.col(count) > 1).limit(SAMPLE_ROWS)
    if check == "accepted_values":
        return df.where(F.col(columns[0]).isNotNull() & ~F.col(columns[0]).isin(values or [])).select(columns[0]).distinct().limit(SAMPLE_ROWS)
    raise ValueError(f"no sample for the check {check!r}")


def all_checks(results: list[DataFrame]) -> DataFrame:
    """The rows of several checks."""
    return reduce(DataFrame.unionByName, results)
