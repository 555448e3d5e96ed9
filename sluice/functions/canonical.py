"""One spelling for a scalar: on the driver for claims and constants, as Columns for payloads."""

from __future__ import annotations

import re
from decimal import Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
DIGITS = 100


def decimal_text(text: str) -> str | None:
    """1.0 -> 1, 2.50 -> 2.5, 1e3 -> 1000, -0 -> 0; None beyond DIGITS digits."""
    with localcontext() as c:
        c.prec = 4 * DIGITS
        d = Decimal(text)
        if d.is_zero():
            return "0"
        if not -DIGITS <= d.adjusted() < DIGITS or len(d.as_tuple().digits) > DIGITS:
            return None
        out = format(d.normalize(), "f")
    return out if len(out.lstrip("-").replace(".", "")) <= DIGITS else None


def numeric(text: str) -> str | None:
    """The canonical spelling of a JSON number's text; +5, 007 and NaN are none."""
    return decimal_text(text) if len(text) <= DIGITS + 4 and re.fullmatch(NUMBER, text) else None


def scalar(value) -> str | None:
    """None: nothing that can be bound (null, arrays, objects, numbers too long or past exact floats)."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value
    if isinstance(value, int):
        return decimal_text(str(value))
    if isinstance(value, float):
        return decimal_text(repr(value)) if abs(value) < 2**53 else None
    if isinstance(value, Decimal):
        return numeric(str(value))
    return None


def number_column(text: Column) -> Column:
    """A JSON number's value with up to 20 digits before and 18 after the point, else null."""
    return F.when(text.rlike(f"^(?:{NUMBER})$") & (F.length(text) <= DIGITS + 4), text.try_cast("decimal(38,18)"))


def numeric_column(text: Column) -> Column:
    """numeric() for a column of texts: the same spelling, exact for up to 38 digits with up to 18 of fraction, else null."""
    value = number_column(text)
    shown = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(value == 0, F.lit("0")).otherwise(shown)


def truncate(value: Column, precision: int, scale: int) -> Column:
    """To a decimal's scale toward zero; a plain cast would round half up."""
    power = F.lit(10 ** min(scale, 18)).cast("decimal(19,0)")
    cut = F.signum(value).cast("decimal(2,0)") * F.floor(F.abs(value) * power)
    return (cut / power).cast(f"decimal({precision},{scale})")
