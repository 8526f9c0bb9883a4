"""Schema drift, lints of inferred types, profiles and fingerprints of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import fresh
from .joins import numbered

#: Largest integer up to which doubles are exact, and the end of 128-bit integers (fixed values).
EXACT_DOUBLE, HUGE = 2.0**53, 2.0**127


@dataclass(frozen=True)
class Drift:
    added: dict[str, str]
    removed: dict[str, str]
    retyped: dict[str, tuple[str, str]]

    def __bool__(self) -> bool:
        return bool(self.added or self.removed or self.retyped)


def columns_of(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def diff(before: dict[str, str], after: dict[str, str]) -> Drift:
    """Columns that came, went or changed type; names are compared as they are written."""
    return Drift(
        {c: t for c, t in after.items() if c not in before},
        {c: t for c, t in before.items() if c not in after},
        {c: (before[c], t) for c, t in after.items() if c in before and before[c] != t},
    )


class SchemaDrift(RuntimeError):
    """A source's schema differs from the accepted one."""


def drift_gate(df: DataFrame, accepted: dict[str, str] | None, policy: str, has_contract: bool = False) -> Drift | None:
    """Compare what has landed with what was accepted: ``ignore``, ``warn`` (returns the drift) or
    ``fail`` (raises). With a contract, or nothing accepted yet, there is nothing to compare."""
    if has_contract or accepted is None or policy == "ignore":
        return None
    drift = diff(accepted, columns_of(df))
    if drift and policy == "fail":
        raise SchemaDrift(str(drift))
    return drift or None


def check_policy(target: dict[str, str], incoming: dict[str, str], policy: str = "fail_on_change") -> list[str]:
    """Columns to add to ``target``; raises where the policy forbids the change."""
    drift = diff(target, incoming)
    if policy == "additive" and not drift.retyped and not drift.removed:
        return [*drift.added]
    if drift:
        raise SchemaDrift(f"{policy}: {drift}")
    return []


def integer_lint(df: DataFrame) -> DataFrame:
    """column, largest: columns read as double that hold only integers, some too large for a
    double to be exact. One pass over the table for all columns."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    stats = []
    for c in doubles:
        x = F.col(c)
        # Not floor: of a double it gives a long, which ends at 2 ** 63.
        fine = x.isNull() | (~F.isnan(x) & (F.abs(x) < HUGE) & (F.rint(x) == x))
        stats.append(F.struct(F.lit(c).alias("column"), F.coalesce(F.bool_and(fine), F.lit(False)).alias("integral"), F.max(F.abs(x)).alias("largest")))
    if not stats:
        return df.sparkSession.createDataFrame([], "column string, largest double")
    found = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    return found.where(F.col("integral") & (F.col("largest") > EXACT_DOUBLE)).select("column", "largest")


def ambiguous_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, largest_day of date columns read day first whose days never pass 12."""
    stats = [F.struct(F.lit(c).alias("column"), F.max(F.dayofmonth(c)).alias("largest_day")) for c in columns]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s")).where("largest_day <= 12")


def text_lengths(df: DataFrame) -> DataFrame:
    """column, longest (code points; 0 if all null) of each string column, in one pass."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    stats = [F.struct(F.lit(c).alias("column"), F.coalesce(F.max(F.char_length(c)), F.lit(0)).alias("longest")) for c in texts]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def fingerprint(df: DataFrame) -> DataFrame:
    """n_rows and a sum of row hashes: equal for equal rows in any order or partitioning. Which values
    are null is hashed too, since a hash passes over nulls."""
    row = F.xxhash64(*df.columns, *[F.col(c).isNull() for c in df.columns])
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash_sum"))


def preview(df: DataFrame, rows: int = 20, hidden: list[str] = (), width: int = 200) -> DataFrame:
    """The first rows as text, cut to ``width`` characters; hidden columns show dots."""
    shown = [F.when(F.col(c).isNotNull(), F.lit("•••")).alias(c) if c in hidden else F.substring(F.col(c).cast("string"), 1, width).alias(c) for c in df.columns]
    return df.select(*shown).limit(rows)


def in_order(df: DataFrame, offset: int = 0) -> DataFrame:
    """All rows in the order of all columns, nulls last, from ``offset`` on: what a resumed sink drains.

    Rows are numbered by ranges and sorted by their number: no task holds more than a range.
    """
    number, = fresh(df, "row_number")
    placed = numbered(df, [F.col(c).asc_nulls_last() for c in df.columns], number)
    return placed.where(F.col(number) > offset).orderBy(number).drop(number)
