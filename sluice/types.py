"""Backend type names -> Spark types, and how a column compares on the stream."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnType:
    name: str
    spark: T.DataType
    kind: str  # integer, float, decimal, text, time, opaque
    json: frozenset[str]  # JSON kinds accepted on ingest; empty: any
    nullable: bool = False
    low: int | None = None  # integers
    high: int | None = None
    precision: int | None = None  # decimals: digits; times: fraction digits
    scale: int | None = None
    zone: str | None = None


NUMBER = frozenset({"number", "string"})
TEXT = frozenset({"string", "number", "bool"})
SIGNED = {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}
UNSIGNED = {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0)}


def strip(name: str) -> tuple[str, bool]:
    """Without Nullable(..) and LowCardinality(..), in any nesting."""
    nullable = False
    while m := re.fullmatch(r"\s*(Nullable|LowCardinality)\((.*)\)\s*", name, re.S):
        nullable |= m[1] == "Nullable"
        name = m[2]
    return name.strip(), nullable


def parse(name: str) -> ColumnType:
    base, nullable = strip(name)

    def of(spark, kind, json, **more):
        return ColumnType(name, spark, kind, json, nullable, **more)

    if m := re.fullmatch(r"(U?)Int(8|16|32|64|128|256)", base):
        bits, unsigned = int(m[2]), bool(m[1])
        low, high = (0, 2**bits - 1) if unsigned else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
        spark = (UNSIGNED if unsigned else SIGNED).get(bits, T.DecimalType(38, 0) if bits == 128 else T.StringType())
        return of(spark, "integer", NUMBER, low=low, high=high)
    if base in ("Float32", "Float64"):
        return of(T.FloatType() if base == "Float32" else T.DoubleType(), "float", NUMBER)
    if m := re.fullmatch(r"Decimal(?:(32|64|128|256)\(\s*(\d+)\s*\)|\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))", base):
        p, s = (int({"32": 9, "64": 18, "128": 38, "256": 76}[m[1]]), int(m[2])) if m[1] else (int(m[3]), int(m[4] or 0))
        if 1 <= p <= 76 and 0 <= s <= p:
            return of(T.DecimalType(p, s) if p <= 38 else T.StringType(), "decimal", NUMBER, precision=p, scale=s)
    if base == "String":
        return of(T.StringType(), "text", TEXT)
    if base == "UUID" or re.fullmatch(r"FixedString\(\d+\)", base):
        return of(T.StringType(), "opaque", TEXT)
    if base == "Bool":
        return of(T.BooleanType(), "opaque", TEXT)
    if base in ("Date", "Date32"):
        return of(T.DateType(), "opaque", NUMBER)
    if m := re.fullmatch(r"DateTime(?:\('([^']+)'\))?", base):
        return of(T.TimestampType(), "time", NUMBER, precision=0, zone=m[1])
    if m := re.fullmatch(r"DateTime64\(\s*(\d)\s*(?:,\s*'([^']+)'\s*)?\)", base):
        return of(T.TimestampType(), "time", NUMBER, precision=int(m[1]), zone=m[2])
    if base.startswith("Enum") or base in ("IPv4", "IPv6"):
        return of(T.StringType(), "opaque", NUMBER)
    for head, spark, json in (("Array(", T.ArrayType(T.StringType()), {"array"}), ("Map(", T.MapType(T.StringType(), T.StringType()), {"object"}), ("Tuple(", T.StringType(), {"array", "object"})):
        if base.startswith(head):
            return of(spark, "opaque", frozenset(json))
    return of(T.StringType(), "opaque", frozenset())


def from_spark(dt: T.DataType, nullable: bool = True) -> ColumnType:
    """The backend name that a discovered Spark column answers to."""
    names = {"tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "string": "String", "boolean": "Bool", "date": "Date", "timestamp": "DateTime64(6)", "timestamp_ntz": "DateTime64(6)"}
    simple = dt.simpleString()
    if isinstance(dt, T.DecimalType):
        name = f"Decimal({dt.precision},{dt.scale})"
    elif isinstance(dt, T.ArrayType):
        name = "Array(String)"
    elif isinstance(dt, T.MapType):
        name = "Map(String, String)"
    else:
        name = names.get(simple, "Tuple()" if simple.startswith("struct") else "JSON")
    return parse(f"Nullable({name})" if nullable else name)
