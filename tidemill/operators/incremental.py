"""Incremental loads: bounds of a cursor, trimming, and the next watermark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Slice:
    """What a load may take: above ``low``, up to ``high``; None leaves a side open."""

    low: object = None
    high: object = None
    low_inclusive: bool = False
    high_inclusive: bool = True

    def holds(self, cursor: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (cursor >= F.lit(self.low) if self.low_inclusive else cursor > F.lit(self.low))
        if self.high is not None:
            out = out & (cursor <= F.lit(self.high) if self.high_inclusive else cursor < F.lit(self.high))
        return out


def read_slice(df: DataFrame, cursor: str, part: Slice, keep_null: bool = False) -> DataFrame:
    """The rows of a slice, as a source delivers them: rows without a cursor are left out as soon
    as the slice is bounded, unless they are to be kept. A plain filter, so it reaches the Parquet
    or JDBC scan."""
    if part == Slice():
        return df
    inside = part.holds(F.col(cursor))
    return df.where(inside | F.col(cursor).isNull() if keep_null else inside)


def trim(df: DataFrame, cursor: str, part: Slice) -> DataFrame:
    """What is staged, without rows outside the slice; rows without a cursor stay."""
    return df.where(F.coalesce(part.holds(F.col(cursor)), F.lit(True)))


def capture(df: DataFrame, cursor: str, part: Slice) -> DataFrame:
    """One row (watermark, n_rows, caught_up): the largest cursor inside the slice.

    An empty slice with an inclusive end advances to that end; with an exclusive one, or none, the
    watermark stays null and the load counts as caught up.
    """
    inside = df.where(part.holds(F.col(cursor))).agg(F.max(cursor).alias("seen"), F.count("*").alias("n_rows"))
    kind = df.schema[cursor].dataType
    end = F.lit(part.high).cast(kind) if part.high is not None and part.high_inclusive else F.lit(None).cast(kind)
    return inside.select(F.coalesce("seen", end).alias("watermark"), "n_rows", (F.col("seen").isNull() & end.isNull()).alias("caught_up"))


def fold(bounds: list[tuple[object, bool]], floor: bool) -> tuple[object, bool] | None:
    """Several bounds as one: floors to the loosest, ceilings to the tightest: the least of both.

    Of equal floors one that is inclusive wins, of equal ceilings one that is exclusive.
    """
    known = [b for b in bounds if b[0] is not None]
    if len(known) < len(bounds) and floor:
        return None
    if not known:
        return None
    least = min(b[0] for b in known)
    at = [inclusive for value, inclusive in known if value == least]
    return least, (any(at) if floor else all(at))
