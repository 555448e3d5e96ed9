"""The structured query: one table, decoded strictly from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from sluice.errors import Invalid


@dataclass(frozen=True)
class Aggregation:
    function: str
    column: str = "*"
    alias: str = ""
    by: str = ""  # extension: argMin and argMax
    level: float | None = None  # extension: quantile


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any


@dataclass(frozen=True)
class Order:
    column: str
    dir: str = ""

    @property
    def descending(self) -> bool:
        return self.dir.lower() == "desc"


@dataclass(frozen=True)
class TimeRange:
    column: str = ""
    since: str = ""
    until: str = ""


@dataclass(frozen=True)
class StructuredQuery:
    columns: tuple[str, ...] = ()
    select_all: bool = False
    aggregations: tuple[Aggregation, ...] = ()
    filters: tuple[Filter, ...] = ()
    group_by: tuple[str, ...] = ()
    order_by: tuple[Order, ...] = ()
    time_range: TimeRange = field(default_factory=TimeRange)
    limit: int = 0


def names(value, what: str) -> tuple[str, ...]:
    """A list of names, or one; "", null and [] are none."""
    if value in (None, "", []):
        return ()
    items = [value] if isinstance(value, str) else value
    if not isinstance(items, list) or not all(isinstance(x, str) and x for x in items):
        raise Invalid(f"{what} must be names")
    return tuple(items)


def objects(value, kind, what: str, rename: dict | None = None) -> tuple:
    try:
        return tuple(kind(**{(rename or {}).get(k, k): v for k, v in x.items()}) for x in value or ())
    except (TypeError, AttributeError) as e:
        raise Invalid(f"bad {what}: {e}") from None


def decode(text: str | dict) -> StructuredQuery:
    try:
        raw = json.loads(text) if isinstance(text, str) else dict(text)
    except ValueError as e:
        raise Invalid(f"invalid json: {e}") from None
    if not isinstance(raw, dict):
        raise Invalid("a query is an object")
    known = {"columns", "select_all", "aggregations", "filters", "group_by", "order_by", "time_range", "limit"}
    if extra := raw.keys() - known:
        raise Invalid(f"unknown fields {sorted(extra)}")
    limit = raw.get("limit") or 0
    if not isinstance(limit, int):
        raise Invalid("limit must be an integer")
    return StructuredQuery(
        names(raw.get("columns"), "columns"), bool(raw.get("select_all")),
        objects(raw.get("aggregations"), Aggregation, "aggregations", {"fn": "function"}), objects(raw.get("filters"), Filter, "filters", {"operator": "op"}),
        names(raw.get("group_by"), "group_by"), objects(raw.get("order_by"), Order, "order_by", {"direction": "dir"}),
        (objects([raw["time_range"]], TimeRange, "time_range") if raw.get("time_range") else (TimeRange(),))[0], limit,
    )


def has_more(q: StructuredQuery, rows: int) -> bool:
    return q.limit > 0 and rows >= q.limit


def next_page(q: StructuredQuery, last_row: dict) -> StructuredQuery | None:
    """The query for the page after last_row by the first order column; None without an order.  Ties are skipped."""
    if not q.order_by:
        return None
    key = q.order_by[0]
    return replace(q, filters=(*q.filters, Filter(key.column, "lt" if key.descending else "gt", last_row[key.column])))
