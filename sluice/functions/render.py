"""Results as clients get them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.timestamps import show
from sluice.operators.aggregates import col, quoted


def rendered(df: DataFrame) -> DataFrame:
    """Timestamps as RFC 3339 in UTC; other columns as they are."""
    return df.select(*(show(col(f.name)).alias(f.name) if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else col(f.name) for f in df.schema))


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object for each row, nulls included."""
    return rendered(df).select(F.to_json(F.struct(*(F.expr(quoted(c)) for c in df.columns)), {"ignoreNullFields": "false"}).alias("json"))
