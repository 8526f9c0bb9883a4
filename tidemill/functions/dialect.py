"""Functions of other SQL dialects in terms of Spark's, and a guard for SQL that Spark misreads."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strftime codes and Spark's patterns (fixed values).
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%f": "SSSSSS", "%p": "a", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE",
}


def strftime(at: Column, pattern: str) -> Column:
    out = ""
    for code in re.findall(r"%.|[^%]+", pattern):
        if code == "%%":
            out += "%"
        elif code in STRFTIME:
            out += STRFTIME[code]
        elif code.startswith("%"):
            raise ValueError(f"no pattern for {code}")
        else:
            out += "'" + code.replace("'", "''") + "'" if re.search("[A-Za-z]", code) else code
    return F.date_format(at, out)


def isfinite(x: Column) -> Column:
    """False for NaN and the infinities, null for null."""
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def string_agg(x: Column, separator: str, order: Column | None = None) -> Column:
    """The non-null texts joined in order (of themselves, if none is given)."""
    pairs = F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct((x if order is None else order).alias("o"), x.alias("x")))))
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(pairs, lambda p: p["x"]), separator))


def regexp_matches(x: Column, pattern: str) -> Column:
    return x.rlike(pattern)


def trunc(x: Column) -> Column:
    """Toward zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def int_cast(x: Column) -> Column:
    """Text or number to a whole number, rounding halves away from zero; null if it is none."""
    return F.round(x.try_cast("double")).try_cast("int")


def median(x: Column) -> Column:
    return F.percentile(x, 0.5)


class MisreadSql(ValueError):
    """SQL that Spark would run as something else than it says."""


#: Words after which Spark reads something else, or fails late (fixed values).
_MISREAD = {
    r"\basof\s+(left\s+|inner\s+)?join\b": "use operators.joins.asof_join",
    r"\bpositional\s+join\b": "use operators.joins.positional_join",
    r"\bqualify\b": "use operators.joins.distinct_on",
    r"\bdistinct\s+on\b": "use operators.joins.distinct_on",
    r"\bunion\s+(all\s+)?by\s+name\b": "use unionByName",
    r"\*\s*exclude\b": "write * except (...)",
}


def check_sql(sql: str) -> str:
    """``sql`` itself; raises where Spark would silently do something else (an as-of join, say,
    becomes an inner join). Quoted text and comments don't count."""
    bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    for pattern, instead in _MISREAD.items():
        found = re.search(pattern, bare, re.I)
        if found:
            raise MisreadSql(f"Spark has no {found[0]!r}: {instead}")
    return sql
