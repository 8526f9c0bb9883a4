"""Column contracts: eight flat types by name, JSON pointers, and tolerant conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types that a contract may name (fixed values).
TYPES: dict[str, T.DataType] = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "decimal": T.DecimalType(38, 9),
    "varchar": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
}

#: Types that a cursor may have (fixed values).
CURSORS = ("int", "bigint", "decimal", "date", "timestamp")


class ContractError(ValueError):
    """A contract names something that can't be read."""


def schema_of(columns: dict[str, str]) -> T.StructType:
    unknown = {c: t for c, t in columns.items() if t not in TYPES}
    if unknown:
        raise ContractError(f"unknown types {unknown}; known are {', '.join(TYPES)}")
    return T.StructType([T.StructField(c, TYPES[t]) for c, t in columns.items()])


def pointer_path(pointer: str) -> str:
    """The JSON path of an RFC 6901 pointer, for ``get_json_object``."""
    if pointer and not pointer.startswith("/"):
        raise ContractError(f"a pointer is empty or starts with a slash: {pointer!r}")
    path = "$"
    for step in pointer.split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        if "'" in step:
            raise ContractError(f"a quote in the pointer {pointer!r} has no path form")
        path += f"[{step}]" if step.isdigit() else f"['{step}']"
    return path


def convert(value: Column, kind: str, unit: str | None = None) -> Column:
    """Text as a contract's type; null where it doesn't fit. ``unit`` is s, ms or us for times
    that are counted from 1970."""
    if kind == "timestamp" and unit:
        per = {"s": 1, "ms": 1_000, "us": 1_000_000}[unit]
        return F.timestamp_micros((value.try_cast("decimal(38,6)") * (1_000_000 // per)).cast("long")).cast("timestamp_ntz")
    if kind not in TYPES:
        raise ContractError(f"unknown type {kind!r}")
    return value if kind == "varchar" else value.try_cast(TYPES[kind])


def project_json(df: DataFrame, payload: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """The columns {name: (pointer, type)} out of a column of JSON text; a missing step is null."""
    return df.select(*[convert(F.get_json_object(payload, pointer_path(p)), t).alias(c) for c, (p, t) in columns.items()])


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The contract's columns by name, cast to its types; a column that is missing is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"columns {missing} are missing; there are {df.columns}")
    return df.select(*[F.col(c).cast(f.dataType).alias(c) for c, f in zip(columns, schema_of(columns).fields, strict=True)])
