"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.aggregates import col


def once(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in ``keep``) and the new columns, behind a generator of one row.

    Catalyst puts an expression wherever it's used, filters included; a parsed record
    used by each of its fields would be parsed for each.  It doesn't see through a
    generator, so what comes out of one is a value.
    """
    made = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select(*(col(c) for c in (df.columns if keep is None else keep)), made)
