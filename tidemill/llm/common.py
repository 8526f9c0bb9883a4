"""Helpers that the corpus operators share: staged tables, Arrow tasks, a bounded cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import fresh, new_path, shared_dir, staged

__all__ = ["Recent", "column", "fresh", "held", "near_rows", "new_path", "partitions", "rows_beside", "rows_of", "settled", "shared_dir", "slices", "staged", "texts_of", "utf8_bytes"]


def texts_of(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The named columns and the text, with null read as the empty text."""
    return docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


#: Buckets of keys: a table of bucket numbers has as many rows at most, so it may be broadcast.
KEY_BUCKETS = 1 << 20


def _buckets(keys: DataFrame, key: str, bucket: str) -> DataFrame:
    found = keys.select(F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int").alias(bucket)).distinct()
    return F.broadcast(staged(found, "buckets"))


def near_rows(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` (long ``key``) whose key falls into a bucket of ``keys``: all rows of
    these keys and, while they are few, hardly any other. Nothing is shuffled."""
    bucket, = fresh(docs, "bucket")
    placed = docs.withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int"))
    return placed.join(_buckets(keys, key, bucket), bucket, "left_semi").select(*docs.columns)


def rows_of(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` (long ``key``) whose key is in ``keys``, for keys of few documents.

    Most rows of other keys fall to the buckets before their texts are shuffled; a semi join
    decides about the rest.
    """
    return near_rows(docs, keys, key).join(keys.select(key).distinct(), key, "left_semi").select(*docs.columns)


def rows_beside(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` (long ``key``) whose key isn't in ``keys``; null keys stay.

    The counterpart of ``rows_of``: rows of free buckets pass without a shuffle.
    """
    bucket, = fresh(docs, "bucket")
    placed = docs.withColumn(bucket, F.coalesce(F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int"), F.lit(0)))
    buckets = _buckets(keys, key, bucket)
    free = placed.join(buckets, bucket, "left_anti")
    near = placed.join(buckets, bucket, "left_semi").join(keys.select(key).distinct(), key, "left_anti")
    return free.select(*docs.columns).unionAll(near.select(*docs.columns))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def utf8_bytes(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def settled(docs: DataFrame) -> DataFrame:
    """``docs``, written first if its rows come out of a shuffle: a task that is run again after a lost
    executor must see its rows in the same order, since batches are told apart by their place."""
    return staged(docs, "settled") if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


#: Rows of one Arrow slice, and so the texts that are Python objects at one time.
SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


_held: dict = {}


def held(key, make: Callable):
    """What ``make()`` gave for ``key`` in this process, until another key is asked for.

    Python workers live on from stage to stage: the tables and caches of one operator go when a
    task of the next begins, so a worker never holds those of several.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


class Recent(dict):
    """A dict that computes missing values and keeps the recently used ones.

    Two generations of ``size`` entries bound the memory; a hit in the older one moves the
    entry to the newer one. Keys longer than ``longest`` are computed each time.
    """

    def __init__(self, compute: Callable, size: int = 200_000, longest: int = 64):
        super().__init__()
        self.compute, self.size, self.longest = compute, size, longest
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
