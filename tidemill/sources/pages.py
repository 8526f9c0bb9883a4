"""A paged web service as a Spark data source.

``spark.dataSource.register(PagedSource)`` and ``spark.read.format("pages")`` with the options
url, paging and columns (a contract as JSON: {name: [pointer, type]}). The rows of a page are the
array at ``items``. Paging is one of: ``page`` (?page=1, 2 ... until a page is empty), ``offset``
(?offset=0, n ...), ``cursor`` (the token at ``next`` comes back as ?cursor=), ``next_url`` (the
address at ``next``), ``link`` (the Link header's rel="next"). With ``pages`` given, so many
pages are read in parallel, each in a task of its own, and the last task follows the chain as far
as it goes; otherwise one task follows all of it. ``headers``
(JSON) go with each request. For services that list the newest first, ``stop_pointer`` and
``stop_at`` end the chain at the first row that isn't above the stored watermark; a row that is
newer than the one before it fails the read.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import datetime
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .contracts import schema_of

PAGING = ("page", "offset", "cursor", "next_url", "link")


def at_pointer(value, pointer: str):
    """The value that an RFC 6901 pointer names; None if a step is missing."""
    for step in pointer.split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        if isinstance(value, dict):
            value = value.get(step)
        elif isinstance(value, list) and step.isdigit() and int(step) < len(value):
            value = value[int(step)]
        else:
            return None
    return value


def _typed(value, kind: str):
    try:
        if value is None:
            return None
        if kind in ("int", "bigint"):
            return int(value)
        if kind == "double":
            return float(value)
        if kind == "decimal":
            return Decimal(str(value))
        if kind == "boolean":
            return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).lower())
        if kind == "date":
            return datetime.fromisoformat(value).date()
        if kind == "timestamp":
            return datetime.fromisoformat(value.replace("Z", "+00:00")).replace(tzinfo=None)
        return value if isinstance(value, str) else json.dumps(value)
    except (ValueError, TypeError, ArithmeticError):
        return None


def fetch(url: str, headers: dict[str, str] | None = None, body: bytes | None = None, method: str | None = None, attempts: int = 3, base: float = 1.0, cap: float = 30.0):
    """The page at ``url`` and its headers. Busy and failing servers are asked again after a pause
    that doubles, or as long as Retry-After says."""
    for attempt in range(attempts):
        try:
            request = urllib.request.Request(url, body, headers or {}, method=method)
            with urllib.request.urlopen(request, timeout=60) as answer:
                return json.loads(answer.read() or b"null"), answer.headers
        except urllib.error.HTTPError as e:
            if attempt + 1 == attempts or (e.code != 429 and e.code < 500):
                raise
            after = e.headers.get("Retry-After", "")
            time.sleep(min(cap, float(after) if after.isdigit() else base * 2**attempt))
        except urllib.error.URLError:
            if attempt + 1 == attempts:
                raise
            time.sleep(min(cap, base * 2**attempt))


def _with(url: str, **query) -> str:
    parts = urllib.parse.urlsplit(url)
    both = dict(urllib.parse.parse_qsl(parts.query)) | {k: str(v) for k, v in query.items()}
    return urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode(both)))


class Page(InputPartition):
    def __init__(self, url: str, follow: bool, number: int = 0):
        self.url, self.follow, self.number = url, follow, number


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options = {k.lower(): v for k, v in options.items()}
        self.columns = json.loads(self.options["columns"])
        self.paging = self.options.get("paging", "page")
        if self.paging not in PAGING:
            raise ValueError(f"paging is one of {', '.join(PAGING)}")

    def partitions(self) -> list[Page]:
        url, pages = self.options["url"], int(self.options.get("pages", 0))
        size = int(self.options.get("size", 100))
        if pages and self.paging == "page":
            return [Page(_with(url, page=k + 1), k + 1 == pages, k) for k in range(pages)]
        if pages and self.paging == "offset":
            return [Page(_with(url, offset=k * size, limit=size), k + 1 == pages, k) for k in range(pages)]
        return [Page(url, True)]

    def _next(self, url: str, number: int, rows: int, page, headers) -> str | None:
        if self.paging == "page":
            return _with(url, page=number + 2) if rows else None
        if self.paging == "offset":
            at = int(dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query)).get("offset", 0))
            return _with(url, offset=at + rows) if rows else None
        if self.paging == "link":
            found = re.search(r'<([^>]*)>\s*;[^,]*\brel="?next"?', headers.get("Link") or "")
            return urllib.parse.urljoin(url, found[1]) if found else None
        token = at_pointer(page, self.options.get("next", "/next"))
        if not token:
            return None
        return urllib.parse.urljoin(url, token) if self.paging == "next_url" else _with(url, cursor=token)

    def read(self, partition: Page) -> Iterator[tuple]:
        url, number, seen = partition.url, partition.number, set()
        headers_out = json.loads(self.options.get("headers", "{}"))
        stop, pointer, newest = self.options.get("stop_at"), self.options.get("stop_pointer", ""), None
        if partition.follow and self.paging == "page":
            url = _with(url, page=number + 1)
        while url:
            if url in seen:
                raise ValueError(f"the service leads back to {url}")
            seen.add(url)
            page, headers = fetch(url, headers_out)
            rows = at_pointer(page, self.options.get("items", "")) or []
            for row in rows:
                if stop is not None:
                    at = at_pointer(row, pointer)
                    at, least = (at, float(stop)) if isinstance(at, (int, float)) else (str(at), stop)
                    if newest is not None and at > newest:
                        raise ValueError("the service doesn't list the newest first")
                    newest = at
                    if at <= least:
                        return
                yield tuple(_typed(at_pointer(row, p), t) for p, t in self.columns.values())
            url = self._next(url, number, len(rows), page, headers) if partition.follow else None
            number += 1


def fetch_each(keys: DataFrame, template: str, columns: dict[str, tuple[str, str]], items: str = "", headers: dict[str, str] | None = None) -> DataFrame:
    """The rows of a request for each row of ``keys``: ``{name}`` in the address is that column.

    Requests run where the rows are, so ``keys.repartition(n)`` sets how many run at once.
    """

    def get(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                url = re.sub(r"\{(\w+)\}", lambda m, row=row: urllib.parse.quote(str(row[m[1]]), safe=""), template)
                page, _ = fetch(url, headers)
                found = at_pointer(page, items)
                found = found if isinstance(found, list) else [] if found is None else [found]
                if found:
                    yield pd.DataFrame([[*row.values(), *(_typed(at_pointer(x, p), t) for p, t in columns.values())] for x in found], columns=[*row, *columns], dtype=object)

    schema = StructType([*keys.schema.fields, *schema_of({c: t for c, (_, t) in columns.items()}).fields])
    return keys.mapInPandas(get, schema)


class Sent(WriterCommitMessage):
    def __init__(self, requests: int):
        self.requests = requests


class PagedWriter(DataSourceWriter):
    """Sends rows as JSON: ``method`` POST in lists of ``size``; PUT or PATCH one by one to the
    address with ``{name}`` replaced by the row's column. A task that is run again sends again."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = {k.lower(): v for k, v in options.items()}, schema.names

    def write(self, rows: Iterator) -> Sent:
        url, method, size = self.options["url"], self.options.get("method", "POST"), int(self.options.get("size", 100))
        headers = {"Content-Type": "application/json"} | json.loads(self.options.get("headers", "{}"))
        held, sent = [], 0

        def send(where: str, what) -> None:
            fetch(where, headers, json.dumps(what, default=str).encode(), method)

        for row in rows:
            record = dict(zip(self.names, row, strict=True))
            if method == "POST":
                held.append(record)
                if len(held) == size:
                    send(url, held)
                    held, sent = [], sent + 1
            else:
                send(re.sub(r"\{(\w+)\}", lambda m, record=record: urllib.parse.quote(str(record[m[1]]), safe=""), url), record)
                sent += 1
        if held:
            send(url, held)
            sent += 1
        return Sent(sent)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> StructType:
        columns = json.loads({k.lower(): v for k, v in self.options.items()}["columns"])
        return schema_of({c: t for c, (_, t) in columns.items()})

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> PagedWriter:
        return PagedWriter(dict(self.options), schema)
