"""Time text: durations and RFC 3339 on the driver, canonical timestamps as Columns."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.errors import Invalid
from sluice.types import ColumnType

#: Nanoseconds of each unit.
UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9}
PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h|d|w)")
RFC3339 = re.compile(r"(\d{4}-\d{2}-\d{2})[Tt](\d{2}:\d{2}:\d{2})(\.\d+)?([Zz]|[+-]\d{2}:\d{2})")
#: Seconds from the year 1 to 1970.
YEAR_ONE = 62_135_596_800


def duration(text: str) -> timedelta | None:
    """1h30m, 1.5d, 1d12h, 2w; None if it's no duration."""
    sign, body = (-1, text[1:]) if text[:1] == "-" else (1, text.removeprefix("+"))
    parts = PART.findall(body)
    if not parts or "".join(a + b for a, b in parts) != body:
        return timedelta(0) if body == "0" else None
    return timedelta(microseconds=sign * sum(float(a) * UNITS[b] for a, b in parts) / 1000)


def rfc3339(text: str) -> datetime | None:
    """In UTC, to microseconds."""
    if not isinstance(text, str) or not (m := RFC3339.fullmatch(text)):
        return None
    try:
        zone = "+00:00" if m[4] in "Zz" else m[4]
        return datetime.fromisoformat(f"{m[1]}T{m[2]}{(m[3] or '.0')[:7]}{zone}").astimezone(UTC)
    except (ValueError, OverflowError):
        return None


def bound(text: str, now: datetime, bucket_seconds: int = 0) -> datetime:
    """A time range's end: a duration before now, or RFC 3339; down to the bucket, counted from the year 1."""
    back = duration(text)
    at = now - back if back is not None else rfc3339(text)
    if at is None:
        raise Invalid(f"bad time {text!r}")
    if bucket_seconds > 0:
        micros = int((at - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)) + YEAR_ONE * 10**6
        at -= timedelta(microseconds=micros % (bucket_seconds * 10**6))
    return at


def show(ts: Column, precision: int = 6) -> Column:
    """RFC 3339 in UTC without trailing zeros of the fraction (session time zone UTC)."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss" + (".SSSSSS" if precision else ""))
    return F.concat(F.regexp_replace(text, r"\.?0+$", "") if precision else text, F.lit("Z"))


def from_number(text: Column, of: ColumnType) -> Column:
    """An integer JSON number: seconds, or for a type with a scale ticks of that scale; null for any other number."""
    n = F.when(text.rlike(r"^[0-9]{1,19}$"), text.try_cast("decimal(38,0)"))
    p = of.precision or 0
    micros = n * 1_000_000 if "64" not in of.name else n * 10 ** (6 - p) if p <= 6 else F.floor(n / 10 ** (p - 6))
    return F.when(micros < 10**18, F.timestamp_micros(micros.cast("long")))


def parse_column(text: Column, of: ColumnType, number: Column | None = None) -> Column:
    """A payload's time as a timestamp, null if it isn't one: RFC 3339, zone-less text in the column's zone, unix digits.

    number: whether the payload was a JSON number, which is read otherwise than a text of the same digits.
    """
    p = of.precision or 0
    zone = of.zone or "UTC"
    with_zone = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+", "$1")))
    plain = F.regexp_replace(F.regexp_replace(text, "T", " "), r"(\.\d{6})\d+", "$1")
    local = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d+)?)?$"), F.to_utc_timestamp(F.try_to_timestamp(plain), zone))
    fraction = r"(\.\d+)?" if "64" in of.name else ""
    seconds = F.when(text.rlike(rf"^\d{{9,10}}{fraction}$"), F.timestamp_micros((text.try_cast("decimal(20,6)") * 1_000_000).cast("long")))
    at = F.coalesce(with_zone, local, seconds)
    if number is not None:
        at = F.when(number, from_number(text, of)).otherwise(at)
    #: The ranges of the types.
    low, high = ("1970-01-01", "2106-02-06") if p == 0 and not of.name.count("64") else ("1900-01-02", "2262-04-10" if p >= 7 else "2299-12-30")
    return F.when((at >= F.lit(low).cast("timestamp")) & (at <= F.lit(high).cast("timestamp")), at)


def canonical_column(text: Column, of: ColumnType, number: Column | None = None) -> Column:
    """Canonical spelling truncated to the column's precision, or the text as it came."""
    p = min(of.precision or 0, 6)
    at = parse_column(text, of, number)
    step = 10 ** (6 - p)
    cut = F.timestamp_micros(F.floor(F.unix_micros(at) / step).cast("long") * step) if p < 6 else at
    return F.coalesce(show(cut, p), text)
