"""The aggregate functions a structured query may use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.errors import Invalid, Rejected
from sluice.plans.ast import Aggregation


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name: dots, blanks, backticks and * are part of it."""
    return F.col(quoted(name))


def by(pick: Callable) -> Callable:
    def made(c: Column, a: Aggregation) -> Column:
        if not a.by:
            raise Rejected(f"{a.function} needs a second column")
        return pick(c, col(a.by))

    return made


TABLE: dict[str, Callable[[Column, Aggregation], Column]] = {
    "count": lambda c, a: F.count(c),
    "sum": lambda c, a: F.sum(c),
    "avg": lambda c, a: F.avg(c),
    "min": lambda c, a: F.min(c),
    "max": lambda c, a: F.max(c),
    "countdistinct": lambda c, a: F.count_distinct(c),
    "uniq": lambda c, a: F.approx_count_distinct(c),
    "uniqexact": lambda c, a: F.count_distinct(c),
    "any": lambda c, a: F.any_value(c, ignoreNulls=True),
    "anylast": lambda c, a: F.last(c, ignorenulls=True),
    "argmin": by(F.min_by),
    "argmax": by(F.max_by),
    "grouparray": lambda c, a: F.collect_list(c),
    "median": lambda c, a: F.percentile(c, F.lit(0.5)),
    "quantile": lambda c, a: F.percentile(c, F.lit(0.5 if a.level is None else a.level)),
    "stddevpop": lambda c, a: F.stddev_pop(c),
    "stddevsamp": lambda c, a: F.stddev_samp(c),
    "varpop": lambda c, a: F.var_pop(c),
    "varsamp": lambda c, a: F.var_samp(c),
}


def known(name: str) -> bool:
    return name.isascii() and name.lower() in TABLE


def build(a: Aggregation) -> Column:
    if not known(a.function):
        raise Invalid(f"unknown aggregation {a.function!r}")
    star = a.column in ("*", "")
    if star and a.function.lower() != "count":
        raise Rejected(f"{a.function}(*)")
    made = TABLE[a.function.lower()](F.lit(1) if star else col(a.column), a)
    return made.alias(a.alias or f"{a.function}({'*' if star else quoted(a.column)})")


def with_default_alias(function: str, column: str = "*", **more) -> Aggregation:
    """count, sum_x, count_distinct_x: the names that query builders give."""
    short = {"countdistinct": "count_distinct"}.get(function.lower(), function)
    return Aggregation(function, column, short if column == "*" else f"{short}_{column}", **more)
