"""Partitioned reads of a table by equal ranges of a column."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

#: Ranges of a read, at most, unless the caller allows more (a fixed value).
MOST_RANGES = 16


def equal_width(low, high, parts: int, most: int = MOST_RANGES) -> list[tuple]:
    """(from, to, to is included) of ``parts`` ranges of equal width of numbers, dates or times; one
    range if there is nothing to divide."""
    if not 1 <= parts <= most:
        raise ValueError(f"there are 1 to {most} ranges")
    if low is None or high is None or low >= high or parts == 1:
        return [(low, high, True)]
    whole = isinstance(low, int) and isinstance(high, int)
    cuts = [low + ((high - low) * k // parts if whole else (high - low) * k / parts) for k in range(parts)] + [high]
    cuts = list(dict.fromkeys(cuts))
    return [(a, b, k == len(cuts) - 2) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def literal(value) -> str:
    """A number, date or time as every SQL writes it."""
    if isinstance(value, datetime):
        return f"timestamp '{value.isoformat(' ')}'"
    return f"date '{value.isoformat()}'" if isinstance(value, date) else f"{value:f}" if isinstance(value, Decimal) else repr(value)


def predicates(column: str, low, high, parts: int, most: int = MOST_RANGES) -> list[str]:
    """A condition for each range; rows without a value ride with the first."""
    out = []
    for k, (a, b, last) in enumerate(equal_width(low, high, parts, most)):
        if a is None:
            return ["1 = 1"]
        text = f"{column} >= {literal(a)} and {column} {'<=' if last else '<'} {literal(b)}"
        out.append(f"({text}) or {column} is null" if k == 0 else text)
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, parts: int = 1, properties: dict[str, str] | None = None, most: int = MOST_RANGES) -> DataFrame:
    """A table (or a query in brackets with an alias) over JDBC, in ranges of ``column``.

    The ends are asked for first, as one small query; each range is a task of its own.
    """
    if column is None or parts == 1:
        return spark.read.jdbc(url, table, properties=properties)
    ends = spark.read.jdbc(url, f"(select min({column}) as a, max({column}) as b from {table} t) ends", properties=properties).first()
    return spark.read.jdbc(url, table, predicates=predicates(column, ends[0], ends[1], parts, most), properties=properties)


def split(df: DataFrame, column: str, low, high, parts: int) -> list[DataFrame]:
    """The rows of each range of ``df``: together all of them, each once."""
    return [df.where(p) for p in predicates(column, low, high, parts)]
