"""Incremental file loads and event-time aggregates as Structured Streaming queries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.changes import merge
from ..sources.files import write_files


def stream_files(spark: SparkSession, kind: str, path: str, schema: StructType, per_trigger: int = 1000) -> DataFrame:
    """New files under ``path`` as they come."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def load_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that has come since the last call, each row once, and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def merge_available(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str) -> None:
    """Merge all that has come since the last call into the Parquet table at ``path``."""

    def upsert(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            target = spark.read.parquet(path)
        except AnalysisException:
            target = batch.limit(0)
        write_files(merge(target, batch, keys, order), "parquet", path, "replace")

    stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, time: str, length: str, slide: str | None, late: str, by: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates per time window and key; rows later than ``late`` are left out in a stream."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return stamped.groupBy(window.alias("w"), *by).agg(*[a.alias(n) for n, a in aggregates.items()]).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *aggregates)


def sessions(events: DataFrame, time: str, gap: str, late: str, by: list[str]) -> DataFrame:
    """Sessions of each key: bounds and number of rows."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def first_of_each(events: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """Rows without repeats of ``keys`` within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
