"""A paged JSON service as a Spark data source, as a stream of updated rows, and as a target.

Each partition reads one range of offsets; the last ranges of a source that is shorter than
stated are empty. Failed requests of status 500, 502 and 504 are tried again.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)

RETRIED = (500, 502, 504)


def pull_parameters(columns: list[str] | None, where: str | None, order: str, mode: str, cursor: str | None) -> dict[str, str]:
    """What a request asks for: system columns and those named, the filter and the cursor's, and the order.

    An incremental pull asks for rows from the cursor on; without one it is a full pull. A
    preview begins with the newest rows, any other pull with the oldest.
    """
    clauses = [f"({where})"] if where else []
    if mode == "incremental" and cursor:
        clauses.append(f":updated_at >= '{cursor}'")
    out = {"$select": ",".join([":id", ":created_at", ":updated_at", *columns]) if columns else ":*, *", "$order": f"{order} {'DESC' if mode == 'preview' else 'ASC'}"}
    return out | ({"$where": " AND ".join(clauses)} if clauses else {})


def fetched(url: str, attempts: int = 3, pause: float = 0.5) -> list[dict]:
    """The rows of one page; a wait that grows by `pause` comes before each new attempt."""
    for attempt in range(1, attempts + 1):
        try:
            with urllib.request.urlopen(url, timeout=30) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as error:
            if error.code not in RETRIED or attempt == attempts:
                raise
            time.sleep(pause * attempt)
    return []


def literal(value) -> str:
    """A value in a request's filter."""
    return str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else "'" + str(value).replace("'", "''") + "'"


def clause(f: Filter, ordered: tuple[str, ...]) -> str | None:
    """What the service is asked for a filter of Spark's; None where it might understand it otherwise.

    All columns are read as text, so order is only asked for of columns whose text sorts as
    their values do, such as ISO times: `ordered`.
    """
    name = ".".join(getattr(f, "attribute", ()))
    signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
    if type(f) in signs and name in ordered:
        return f"{name} {signs[type(f)]} {literal(f.value)}"
    if isinstance(f, EqualTo):
        return f"{name} = {literal(f.value)}"
    if isinstance(f, In):
        return f"{name} in ({', '.join(literal(v) for v in f.value)})"
    if isinstance(f, StringStartsWith):
        return f"starts_with({name}, {literal(f.value)})"
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{name} is {'not ' if isinstance(f, IsNotNull) else ''}null"
    return None


class Range(InputPartition):
    def __init__(self, first: int, last: int, where: str | None = None):
        self.first, self.last, self.where = first, last, where


class Pages:
    """Requests for the pages of a range, and for single values."""

    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = dict(options), names
        self.ordered = tuple(c for c in self.options.get("ordered", "").split(",") if c)

    def asked(self, where: str | None, **more) -> list[dict]:
        fixed = dict(json.loads(self.options.get("parameters", "{}")))
        both = [w for w in (fixed.get("$where"), where) if w]
        if both:
            fixed["$where"] = " AND ".join(both)
        return fetched(f"{self.options['url']}?{urllib.parse.urlencode(fixed | more)}", pause=float(self.options.get("pause", 0.5)))

    def rows(self, part: Range) -> Iterator[tuple]:
        size, at = int(self.options.get("pagesize", 1000)), part.first
        while at < part.last:
            n = min(size, part.last - at)
            found = self.asked(part.where, **{"$limit": n, "$offset": at})
            for row in found:
                yield tuple(None if row.get(name) is None else str(row[name]) for name in self.names)
            if len(found) < n:
                return
            at += n

    def ranges(self, most: int, where: str | None) -> list[Range]:
        share = int(self.options.get("rangerecords", 50_000))
        return [Range(low, min(low + share, most), where) for low in range(0, most, share)]


class PagedReader(DataSourceReader):
    """Filters go to the service, and Spark applies them again to what comes back."""

    def __init__(self, options: dict, names: list[str]):
        self.pages, self.where = Pages(options, names), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.where = " AND ".join(c for f in filters if (c := clause(f, self.pages.ordered))) or None
        yield from filters

    def partitions(self) -> list[Range]:
        return self.pages.ranges(int(self.pages.options["maxrecords"]), self.where)

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.pages.rows(partition)


class PagedStream(DataSourceStreamReader):
    """Rows by the time of their last update: a micro-batch has those after its offset, up to the newest time there is.

    Option `cursor` names the column of that time, `since` where a new stream begins. The service
    must give times in the order in which rows become visible; else let the stream end behind now.
    """

    def __init__(self, options: dict, names: list[str]):
        self.pages = Pages(options, names)
        self.cursor = self.pages.options["cursor"]

    def initialOffset(self) -> dict:
        return {"upto": self.pages.options.get("since", "")}

    def latestOffset(self) -> dict:
        newest = self.pages.asked(None, **{"$select": f"max({self.cursor}) as newest"})
        return {"upto": (newest and newest[0].get("newest")) or self.initialOffset()["upto"]}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        where = f"{self.cursor} > {literal(start['upto'])} AND {self.cursor} <= {literal(end['upto'])}"
        counted = self.pages.asked(where, **{"$select": "count(*) as n"})
        return self.pages.ranges(int(counted[0]["n"]), where) or [Range(0, 0, where)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.pages.rows(partition)


@dataclass
class Staged(WriterCommitMessage):
    part: str
    rows: int


class PagedWriter(DataSourceWriter):
    """Tasks post pages to a staging area of the service; the driver makes them visible together, or drops them."""

    def __init__(self, options: dict, names: list[str]):
        self.options, self.names, self.run = dict(options), names, uuid.uuid4().hex

    def _post(self, action: str, body, **more) -> None:
        url = f"{self.options['url']}?{urllib.parse.urlencode({'action': action, 'run': self.run} | more)}"
        sent(urllib.request.Request(url, json.dumps(body, default=str).encode(), {"Content-Type": "application/json"}), pause=float(self.options.get("pause", 0.5)))

    def write(self, iterator: Iterator) -> Staged:
        # each attempt of a task has a part of its own, so that a lost one's pages are never committed
        part, size, held, n = uuid.uuid4().hex, int(self.options.get("pagesize", 1000)), [], 0
        for row in iterator:
            held.append({name: row[name] for name in self.names})
            if len(held) == size:
                self._post("stage", held, part=part)
                held, n = [], n + size
        if held:
            self._post("stage", held, part=part)
        return Staged(part, n + len(held))

    def commit(self, messages: list) -> None:
        self._post("commit", [m.part for m in messages if m is not None])

    def abort(self, messages: list) -> None:
        self._post("abort", [])


def sent(request: urllib.request.Request, attempts: int = 3, pause: float = 0.5) -> None:
    """Send a request; a wait that grows by `pause` comes before each new attempt."""
    for attempt in range(1, attempts + 1):
        try:
            with urllib.request.urlopen(request, timeout=30):
                return
        except urllib.error.HTTPError as error:
            if error.code not in RETRIED or attempt == attempts:
                raise
            time.sleep(pause * attempt)


class PagedSource(DataSource):
    """format("paged_json"): options url, maxRecords, pageSize, rangeRecords, parameters (JSON), ordered; all columns are read as strings.

    As a stream: cursor and since instead of maxRecords. As a target: pages of pageSize rows.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        raise ValueError("give the columns to read as the schema")

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options, schema.fieldNames())

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(self.options, schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> PagedWriter:
        return PagedWriter(self.options, schema.fieldNames())


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
