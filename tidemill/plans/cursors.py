"""Arithmetic of cursors and bounded windows: plain values, no Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from decimal import Decimal

from ..sources.contracts import CURSORS

_STEP = re.compile(r"^\s*(\d+)\s*([a-z]*)\s*$", re.I)
#: Units of a window over times, in seconds (fixed values).
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}


class CursorError(ValueError):
    """A value isn't one of the cursor's type."""


def parse(value: str, kind: str):
    """The value of a cursor's text. Times are UTC without a zone; a Z is accepted, offsets aren't."""
    if kind not in CURSORS:
        raise CursorError(f"a cursor is one of {', '.join(CURSORS)}, not {kind!r}")
    try:
        if kind in ("int", "bigint"):
            return int(value)
        if kind == "decimal":
            return Decimal(value)
        if kind == "date":
            return date.fromisoformat(value)
        text = value[:-1] if value.endswith(("Z", "z")) else value
        at = datetime.fromisoformat(text)
    except (ValueError, ArithmeticError) as e:
        raise CursorError(f"{value!r} is no {kind}") from e
    if at.tzinfo is not None:
        raise CursorError(f"{value!r} has an offset; times are UTC")
    return at


def canonical(value, kind: str) -> str:
    """The text under which a value is stored; decimals keep their scale."""
    if kind == "timestamp":
        return value.isoformat(timespec="microseconds")
    return value.isoformat() if kind == "date" else str(value)


def add(value, step: str, kind: str):
    """``value`` moved on by a step: a count for numbers, such as 90m, 6h, 7d for times."""
    found = _STEP.match(step)
    if not found:
        raise CursorError(f"{step!r} is no step")
    count, unit = int(found[1]), found[2].lower()
    if kind in ("int", "bigint", "decimal"):
        if unit:
            raise CursorError(f"a step of a {kind} has no unit")
        return value + count
    if unit not in UNITS:
        raise CursorError(f"a unit is one of {', '.join(UNITS)}")
    seconds = count * UNITS[unit]
    if kind == "date":
        if seconds % 86_400:
            raise CursorError("dates move by whole days")
        return value + timedelta(days=seconds // 86_400)
    return value + timedelta(seconds=seconds)


@dataclass(frozen=True)
class Window:
    """What one bounded load takes: above ``low``, to ``high``."""

    low: object
    high: object
    inclusive: bool
    empty: bool


def bounded(low, step: str, until, kind: str, until_is_now: bool = False) -> Window:
    """The next window after ``low``: a step further, never past ``until``.

    A stop that is the present moment is left out, since rows of that moment may still come; any
    other is included. A window is empty when its end isn't after its start.
    """
    high = add(low, step, kind)
    inclusive = True
    if until is not None and high >= until:
        high, inclusive = until, not until_is_now
    return Window(low, high, inclusive, high <= low)


def same_kind(stored: str, landed: str) -> bool:
    """Whether a stored cursor may be compared with what lands; int and bigint may."""
    whole = {"int", "bigint"}
    return stored == landed or {stored, landed} <= whole
