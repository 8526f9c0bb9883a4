"""Files: csv, tsv, json, parquet, xml, text and zip archives, read and written."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.schema import SchemaDrift, check_policy, columns_of
from .contracts import ContractError, schema_of

#: Options that each format takes (fixed values).
OPTIONS = {
    "csv": {"delimiter"}, "tsv": set(), "json": {"layout"}, "parquet": set(), "xml": {"row"}, "text": set(), "avro": set(),
}
#: Date tokens and the partition columns that stand for them (fixed values).
CALENDAR = {"yyyy": "year", "yy": "year", "MM": "month", "dd": "day", "HH": "hour", "mm": "minute"}
#: Bytes that one archive may unpack to.
ARCHIVE_BYTES = 1 << 30


class FormatError(ValueError):
    """A format is unknown or takes no such option."""


def _checked(kind: str, options: dict) -> None:
    if kind not in OPTIONS:
        raise FormatError(f"unknown format {kind!r}; known are {', '.join(OPTIONS)}")
    wrong = set(options) - OPTIONS[kind]
    if wrong:
        raise FormatError(f"{kind} takes no option {', '.join(sorted(wrong))}")
    mark = options.get("delimiter")
    if mark is not None and (len(mark) != 1 or not mark.isascii() or mark in '"\r\n'):
        raise FormatError("a delimiter is one ASCII character, not a quote or a line end")


def read_files(spark: SparkSession, kind: str, paths: str | list[str], columns: dict[str, str] | None = None, **options: str) -> DataFrame:
    """Files of a format. With a contract (``columns``) nothing is inferred; for csv and tsv the
    headers must then agree with it, and a cell that doesn't fit its type fails the read."""
    _checked(kind, options)
    paths = [paths] if isinstance(paths, str) else paths
    reader = spark.read
    if columns:
        reader = reader.schema(schema_of(columns))
    if kind in ("csv", "tsv"):
        reader = reader.option("header", True).option("sep", "\t" if kind == "tsv" else options.get("delimiter", ","))
        reader = reader.option("mode", "FAILFAST").option("enforceSchema", False) if columns else reader.option("inferSchema", True)
        return reader.csv(paths)
    if kind == "json":
        layout = options.get("layout", "ndjson")
        if layout not in ("ndjson", "array"):
            raise FormatError("a json layout is ndjson or array")
        return reader.option("multiLine", layout == "array").option("mode", "FAILFAST").json(paths)
    if kind == "xml":
        return reader.format("xml").option("rowTag", options.get("row", "row")).load(paths)
    if kind == "avro":
        return reader.format("avro").load(paths)
    if kind == "text":
        return spark.read.text(paths)
    read = spark.read.parquet(*paths)
    if not columns:
        return read
    missing = [c for c in columns if c not in read.columns]
    if missing:
        raise ContractError(f"columns {missing} are missing; there are {read.columns}")
    return read.select(*[F.col(f.name).cast(f.dataType) for f in schema_of(columns).fields])


def read_back(spark: SparkSession, kind: str, path: str, like: DataFrame, **options: str) -> DataFrame | None:
    """What stands in an output, its columns of the types that ``like`` has for them (others as text);
    None if nothing is there. Text formats hold no types, so those of new rows count."""
    known = {f.name: f.dataType for f in like.schema.fields}
    sep = "\t" if kind == "tsv" else options.get("delimiter", ",")
    try:
        if kind in ("csv", "tsv"):
            reader = spark.read.option("header", True).option("sep", sep)
            names = reader.csv(path).columns
            typed = T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in names])
            return reader.schema(typed).option("mode", "FAILFAST").option("enforceSchema", False).csv(path) if names else None
        found = read_files(spark, kind, path, **options)
        if kind not in ("json", "xml"):
            return found
        typed = T.StructType([T.StructField(f.name, known.get(f.name, f.dataType)) for f in found.schema.fields])
        reader = spark.read.schema(typed).option("mode", "FAILFAST")
        if not found.columns:
            return None
        return reader.json(path) if kind == "json" else reader.format("xml").option("rowTag", options.get("row", "row")).load(path)
    except AnalysisException:
        return None


def read_archives(spark: SparkSession, paths: str | list[str], member: str = "*") -> DataFrame:
    """path, member, line of the text files in zip archives whose names match ``member``.

    An archive is read in one task, member by member and line by line; one that unpacks to more
    than ``ARCHIVE_BYTES`` fails. Gzip and plain files need no such reader.
    """

    def lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    if sum(i.file_size for i in archive.infolist()) > ARCHIVE_BYTES:
                        raise ValueError(f"{path} unpacks to more than {ARCHIVE_BYTES} bytes")
                    for info in archive.infolist():
                        if info.is_dir() or not fnmatchcase(info.filename, member):
                            continue
                        with archive.open(info) as file:
                            held = []
                            for line in io.TextIOWrapper(file, "utf-8"):
                                held.append(line.rstrip("\r\n"))
                                if len(held) == 10_000:
                                    yield pd.DataFrame({"path": path, "member": info.filename, "line": held})
                                    held = []
                            if held:
                                yield pd.DataFrame({"path": path, "member": info.filename, "line": held})

    found = spark.read.format("binaryFile").load(paths).select("path", "content")
    return found.mapInPandas(lines, "path string, member string, line string")


def write_files(df: DataFrame, kind: str, path: str, mode: str = "append", by: list[str] | None = None, **options: str) -> None:
    """Write ``df`` as files below ``path``: ``append`` adds, ``replace`` leaves only the new ones.

    A replaced folder is written beside the old one and then renamed, so readers see one or the
    other, and ``df`` may itself read from ``path``. ``by`` partitions by columns.
    """
    _checked(kind, options)
    if kind == "avro":
        raise FormatError("avro is read only")
    if mode not in ("append", "replace"):
        raise FormatError(f"files are written by append or replace, not {mode!r}")
    to = path if mode == "append" else f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    writer = df.write.mode("append")
    if by:
        writer = writer.partitionBy(*by)
    if kind in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if kind == "tsv" else options.get("delimiter", ",")).csv(to)
    elif kind == "json":
        if options.get("layout", "ndjson") == "array":
            raise FormatError("an array in one file would bring all rows together; write ndjson")
        writer.json(to)
    elif kind == "xml":
        writer.format("xml").option("rowTag", options.get("row", "row")).save(to)
    elif kind == "text":
        writer.text(to)
    else:
        writer.parquet(to)
    if mode == "replace":
        _swap(df.sparkSession, to, path)


def _swap(spark: SparkSession, new: str, path: str) -> None:
    jvm = spark.sparkContext._jvm
    of = jvm.org.apache.hadoop.fs.Path
    files = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    had = files.exists(of(path))
    if had and not files.rename(of(path), of(old)):
        raise OSError(f"{path} can't be moved away")
    if not files.rename(of(new), of(path)):
        if had:
            files.rename(of(old), of(path))
        raise OSError(f"{new} can't be moved to {path}")
    if had:
        files.delete(of(old), True)


def write_by_calendar(df: DataFrame, path: str, column: str, template: str, kind: str = "parquet") -> None:
    """Write each row to the folder that ``template`` gives for its time, such as {yyyy}/{MM}."""
    parts = hive_parts(column, template)
    write_files(df.withColumns(parts), kind, path, by=[*parts])


def with_policy(target: dict[str, str], df: DataFrame, policy: str) -> DataFrame:
    """``df`` as ``target`` takes it: columns in its order, new ones last if ``additive``."""
    new = check_policy(target, columns_of(df), policy)
    missing = [c for c in target if c not in df.columns]
    if missing:
        raise SchemaDrift(f"columns {missing} are missing")
    return df.select(*target, *new)


def hive_parts(column: str, template: str) -> dict[str, Column]:
    """The partition columns of ``write_by_calendar``."""
    return {CALENDAR[n]: F.date_format(column, n) for n in re.findall(r"\{(\w+)\}", template)}
