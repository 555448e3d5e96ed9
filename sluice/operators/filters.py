"""Filter operators of structured queries as Columns."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import Invalid, Rejected
from sluice.functions import timestamps
from sluice.operators.aggregates import col

COMPARE = {"eq": "__eq__", "neq": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def time_literal(at: datetime, of: T.DataType) -> Column:
    """For a zone-less column the UTC wall clock: Spark would drop the zone, not convert."""
    if isinstance(of, T.TimestampNTZType):
        return F.lit(at.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(at.isoformat()).cast("timestamp")


def constant(value, of: T.DataType, times: bool = True) -> Column:
    """A literal as the column reads it; what can't be read is rejected before the query runs."""
    if times and (at := timestamps.rfc3339(value)) and not isinstance(of, T.StringType):
        return time_literal(at, of)
    if isinstance(value, bool) and isinstance(of, T.NumericType):
        value = int(value)
    if isinstance(value, (list, dict)):
        raise Invalid("a filter value must be a scalar")
    if isinstance(value, str) and isinstance(of, T.NumericType):
        try:
            float(value)
        except ValueError:
            raise Rejected(f"{value!r} is no {of.simpleString()}") from None
        if isinstance(of, T.IntegralType):
            return F.lit(value).cast("decimal(38,6)")
    if isinstance(value, (int, float)) and isinstance(of, T.StringType):
        value = str(value)
    if isinstance(value, str) and isinstance(of, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(value).cast(of)
    return F.lit(value)


def like_pattern(text: str) -> str:
    """A lone backslash stands for itself; Spark wants it doubled."""
    return re.sub(r"\\(?![%_\\])", r"\\\\", text)


def build(column: str, op: str, value, of: T.DataType) -> Column:
    op, c = op.lower(), col(column)
    if op in COMPARE:
        return getattr(c, COMPARE[op])(constant(value, of))
    if op == "like":
        return c.like(like_pattern(str(value)))
    if op == "in":
        if not isinstance(value, list) or not value:
            raise Invalid("in needs a list that isn't empty")
        return c.isin(*(constant(v, of, times=False) for v in value))
    raise Invalid(f"unknown operator {op!r}")


def client_filter(column: str, op: str, value) -> Column:
    """What stream clients apply to rows they get: like ignores case, order only within one kind."""
    if op.lower() == "like":
        return F.coalesce(col(column).ilike(like_pattern(str(value))), F.lit(False))
    return F.coalesce(build(column, op, value, T.NullType()), F.lit(False))
