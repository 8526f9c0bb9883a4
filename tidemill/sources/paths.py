"""Paths with date tokens: the globs that cover a time window, and nothing beside it."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

#: Date tokens of a path, from coarse to fine (fixed values).
TOKENS = {"yyyy": "%Y", "yy": "%y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M"}
_LEVEL = {"yyyy": 0, "yy": 0, "MM": 1, "dd": 2, "HH": 3, "mm": 4}
_TOKEN = re.compile(r"\{(yyyy|yy|MM|dd|HH|mm)\}")


def _floor(at: datetime, level: int) -> datetime:
    parts = [at.year, at.month, at.day, at.hour, at.minute][: level + 1]
    return datetime(*(parts + [1, 1][len(parts) - 1 :] if len(parts) < 3 else parts))


def _next(at: datetime, level: int) -> datetime:
    if level == 0:
        return datetime(at.year + 1, 1, 1)
    if level == 1:
        return datetime(at.year + at.month // 12, at.month % 12 + 1, 1)
    return at + [timedelta(days=1), timedelta(hours=1), timedelta(minutes=1)][level - 2]


def render(template: str, at: datetime) -> str:
    return _TOKEN.sub(lambda m: at.strftime(TOKENS[m[1]]), template)


def cover(template: str, low: datetime, high: datetime) -> list[str]:
    """The fewest globs whose folders hold all times from ``low`` to ``high`` (both included).

    Whole years, months or days are covered by one glob with ``*`` for the finer tokens.
    """
    levels = sorted({_LEVEL[t] for t in _TOKEN.findall(template)})
    if not levels or levels != list(range(len(levels))):
        # without the coarser tokens a value would come again and again
        return [_TOKEN.sub("*", template)]
    finest, out = levels[-1], []
    at, stop = _floor(low, finest), _next(_floor(high, finest), finest)
    while at < stop:
        level = next((k for k in levels if _floor(at, k) == at and _next(at, k) <= stop), finest)
        out.append(_TOKEN.sub(lambda m, level=level, at=at: at.strftime(TOKENS[m[1]]) if _LEVEL[m[1]] <= level else "*", template))
        at = _next(at, level)
    return list(dict.fromkeys(out))
