"""Change data: collapsing change rows, merging them into a table, deletes and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import fresh


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order`` (then by all columns, so ties settle).

    A partial aggregate, not a window: a key with very many rows is reduced before the shuffle.
    Null keys are a key. Column order stays.
    """
    rest = [c for c in df.columns if c not in order]
    row, = fresh(df, "row")
    greatest = F.max(F.struct(*order, *rest)).alias(row)
    return df.groupBy(*keys).agg(greatest).select(*[F.col(f"{row}.{c}").alias(c) for c in df.columns])


def collapse(changes: DataFrame, keys: list[str], lsn: str, op: str, envelope: list[str] = (), delete: str = "delete") -> tuple[DataFrame, DataFrame]:
    """The last change of each key by ``lsn``, as (upserts, deletes).

    ``lsn`` is text of fixed width, so its order is the log's. Upserts are all rows whose last
    operation isn't ``delete``, without the envelope columns; deletes are the keys of the others.
    """
    gone = [lsn, op, *envelope]
    last = last_by(changes, keys, [lsn])
    is_delete = F.coalesce(F.col(op) == delete, F.lit(False))
    return last.where(~is_delete).drop(*gone), last.where(is_delete).select(*keys)


def operation_counts(changes: DataFrame, op: str) -> DataFrame:
    return changes.groupBy(op).agg(F.count("*").alias("n"))


def merge(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``target`` with ``incoming`` merged in by key: matched rows replaced, others added.

    Of incoming rows of one key the last by ``order`` survives (all columns if none is named: a
    table has no arrival order). Columns go by name; a column that only one side has is null
    elsewhere. The anti join and the union need no table format, so it works on Parquet.
    """
    new = last_by(incoming, keys, order or [c for c in incoming.columns if c not in keys])
    old = target.join(new.select(*keys), keys, "left_anti").select(*target.columns)
    return old.unionByName(new, allowMissingColumns=True)


def insert_new(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Only keys that ``target`` lacks are added (a table of keys alone has nothing to update)."""
    return target.unionByName(last_by(incoming, keys, []).join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def delete_hard(target: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(deletes.select(*keys).distinct(), keys, "left_anti").select(*target.columns)


def delete_soft(target: DataFrame, deletes: DataFrame, keys: list[str], column: str, at: Column) -> DataFrame:
    """Rows of deleted keys get ``at`` in ``column``; a row that is deleted already keeps its time."""
    mark, = fresh(target, "deleted_now")
    marked = target.join(deletes.select(*keys).distinct().withColumn(mark, F.lit(True)), keys, "left")
    old = F.col(column) if column in target.columns else F.lit(None).cast("timestamp_ntz")
    value = F.when(F.col(mark) & old.isNull(), at).otherwise(old).alias(column)
    return marked.select(*[value if c == column else F.col(c) for c in target.columns], *([] if column in target.columns else [value]))


def apply_changes(target: DataFrame, upserts: DataFrame, deletes: DataFrame, keys: list[str], on_delete: str, column: str = "deleted_at", at: Column | None = None) -> DataFrame:
    """Upserts, then deletes (``hard`` or ``soft``). An upsert clears the mark of a soft delete."""
    if on_delete == "hard":
        return delete_hard(merge(target, upserts, keys), deletes, keys)
    if on_delete != "soft":
        raise ValueError(f"on_delete is hard or soft, not {on_delete!r}")
    if column not in target.columns:
        target = target.withColumn(column, F.lit(None).cast("timestamp_ntz"))
    merged = merge(target, upserts.withColumn(column, F.lit(None).cast(target.schema[column].dataType)), keys)
    return delete_soft(merged, deletes, keys, column, at if at is not None else F.current_timestamp().cast("timestamp_ntz"))


def merge_guard(incoming: DataFrame, keys: list[str]) -> DataFrame:
    """One row: null_key_rows, duplicate_groups, extra_rows of a batch that is to be merged."""
    some_null = F.lit(False)
    for key in keys:
        some_null = some_null | F.col(key).isNull()
    count, null = fresh(incoming, "n_rows", "has_null")
    groups = incoming.groupBy(*keys).agg(F.count("*").alias(count)).withColumn(null, some_null)
    several = ~F.col(null) & (F.col(count) > 1)
    return groups.agg(
        F.coalesce(F.sum(F.when(F.col(null), F.col(count))), F.lit(0)).cast("long").alias("null_key_rows"),
        F.count_if(several).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(several, F.col(count) - 1)), F.lit(0)).cast("long").alias("extra_rows"),
    )
