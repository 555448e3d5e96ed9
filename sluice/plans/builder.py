"""A structured query, a table and a grant -> a lazy DataFrame."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.catalog import Table
from sluice.errors import EmptyProjection, Forbidden, Invalid, Rejected
from sluice.functions import timestamps
from sluice.operators import aggregates, filters
from sluice.operators.aggregates import col
from sluice.plans.ast import StructuredQuery
from sluice.policy import ReadGrant

DEFAULT_MAX_ROWS = 10_000


def authorize(q: StructuredQuery, table: Table, grant: ReadGrant) -> None:
    """Every name in every clause must exist and be readable."""
    def check(name: str) -> None:
        if "?" in name:
            raise Invalid(f"name with ?: {name!r}")
        if table[name] is None:
            raise Invalid(f"unknown column {name!r}")
        if not grant.column(name):
            raise Forbidden(f"column {name!r}")

    for name in (*q.columns, *q.group_by, *(f.column for f in q.filters)):
        check(name)
    for a in q.aggregations:
        if not aggregates.known(a.function):
            raise Invalid(f"unknown aggregation {a.function!r}")
        if not grant.aggregation(a.function):
            raise Forbidden(f"aggregation {a.function!r}")
        for name in (a.column, a.by):
            if name not in ("", "*"):
                check(name)
        if "?" in a.alias:
            raise Invalid("alias with ?")
    for o in q.order_by:
        if "?" in o.column:
            raise Invalid("order by a name with ?")
        if table[o.column] is not None:  # an alias of that name changes nothing
            check(o.column)
    if q.time_range.column:
        check(q.time_range.column)


def row_limit(q: StructuredQuery, grant: ReadGrant, default_max_rows: int = DEFAULT_MAX_ROWS) -> int:
    cap = default_max_rows if default_max_rows > 0 else DEFAULT_MAX_ROWS
    if grant.cap("max_rows"):
        cap = min(cap, grant.cap("max_rows"))
    return q.limit if 0 < q.limit <= cap else cap


def build(q: StructuredQuery, table: Table, grant: ReadGrant | None = None, now: datetime | None = None, default_max_rows: int = DEFAULT_MAX_ROWS, bucket_seconds: int = 0) -> DataFrame:
    grant = grant or ReadGrant(None)
    if q.select_all and q.columns:
        raise Invalid("columns and select_all exclude each other")
    if q.select_all and q.aggregations:
        raise Invalid("select_all and aggregations exclude each other")
    authorize(q, table, grant)
    if not (q.columns or q.select_all or q.aggregations):
        raise EmptyProjection()
    df = table.load()
    schema = df.schema
    for p in grant.predicates:  # the role's rows first
        df = df.filter(p.query(table, schema))
    for f in q.filters:
        df = df.filter(filters.build(f.column, f.op, f.value, schema[f.column].dataType))
    r = q.time_range
    if r.column and r.since:
        now = now or datetime.now(UTC)
        kind = schema[r.column].dataType
        df = df.filter(col(r.column) >= filters.time_literal(timestamps.bound(r.since, now, bucket_seconds), kind))
        if r.until:
            df = df.filter(col(r.column) <= filters.time_literal(timestamps.bound(r.until, now, bucket_seconds), kind))
    order = [F.desc_nulls_last(aggregates.quoted(o.column)) if o.descending else F.asc_nulls_last(aggregates.quoted(o.column)) for o in q.order_by]
    limit = row_limit(q, grant, default_max_rows)
    if q.select_all:
        shown = [c for c in table.names if grant.column(c) and c in schema.names]
        if not shown:
            raise Forbidden("no readable columns")
        return (df.orderBy(*order) if order else df).limit(limit).select(*map(col, shown))
    aggs = [aggregates.build(a) for a in q.aggregations]
    if q.group_by or aggs:
        keys = [col(c) for c in q.group_by]
        if set(q.columns) - set(q.group_by):
            raise Rejected(f"columns neither grouped nor aggregated: {sorted(set(q.columns) - set(q.group_by))}")
        if aggs:
            df = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
        else:
            df = df.select(*keys).distinct()
        shown = [col(c) for c in q.columns] + [col(a.alias or f"{a.function}({'*' if a.column in ('*', '') else aggregates.quoted(a.column)})") for a in q.aggregations]
        return (df.orderBy(*order) if order else df).limit(limit).select(*shown)
    df = df.orderBy(*order) if order else df
    return df.limit(limit).select(*map(col, q.columns))
