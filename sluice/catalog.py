"""Discovered tables: ordered columns with defaults, refresh and differences, by tenant."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sluice import types
from sluice.errors import Invalid, NotFound, Unavailable

TENANT = re.compile(r"[A-Za-z0-9_-]{1,64}")
DEFAULT_TENANT = "0"


def tenant_id(text: str = "") -> str:
    text = text or DEFAULT_TENANT
    if not TENANT.fullmatch(text):
        raise Invalid(f"bad tenant id {text!r}")
    return text


@dataclass(frozen=True)
class Column:
    name: str
    type: types.ColumnType
    default_kind: str = ""  # "", DEFAULT, MATERIALIZED, ALIAS, EPHEMERAL
    default: str | None = None  # a Spark SQL expression
    position: int = 0

    @property
    def insertable(self) -> bool:
        return self.default_kind not in ("MATERIALIZED", "ALIAS")

    @property
    def required(self) -> bool:
        return self.insertable and not self.type.nullable and self.default_kind == ""


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    load: Callable[[], DataFrame] = field(compare=False)
    schema: T.StructType | None = field(default=None, compare=False)

    def __getitem__(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def insertable(self) -> list[Column]:
        return [c for c in self.columns if c.insertable]


def declared(name: str, columns: list[tuple], load: Callable[[], DataFrame]) -> Table:
    """columns: (name, backend type[, default kind[, expression]])."""
    return Table(name, tuple(Column(c[0], types.parse(c[1]), *c[2:4], position=i + 1) if len(c) > 2 else Column(c[0], types.parse(c[1]), position=i + 1) for i, c in enumerate(columns)), load)


def discovered(name: str, load: Callable[[], DataFrame]) -> Table:
    schema = load().schema
    cols = [Column(f.name, types.from_spark(f.dataType, f.nullable), f.metadata.get("default_kind", ""), f.metadata.get("default_expr"), i + 1) for i, f in enumerate(schema)]
    return Table(name, tuple(cols), load, schema)


class Catalog:
    """Tables of one tenant.  ``source`` lists them; a failed refresh keeps the last good snapshot."""

    def __init__(self, source: Callable[[], list[Table]]):
        self.source, self.tables = source, None

    def refresh(self) -> dict[str, list[str]]:
        """Added, removed and changed names.  Names that start with a dot are hidden."""
        found = {t.name: t for t in self.source() if not t.name.startswith(".")}
        old, self.tables = self.tables or {}, found
        return {
            "added": sorted(found.keys() - old.keys()),
            "removed": sorted(old.keys() - found.keys()),
            "changed": sorted(n for n in found.keys() & old.keys() if replace(found[n], load=old[n].load, schema=None) != replace(old[n], schema=None)),
        }

    def lookup(self, name: str) -> Table:
        if self.tables is None:
            raise Unavailable("schemas are not loaded")
        if name not in self.tables:
            raise NotFound(f"unknown table {name!r}")
        return self.tables[name]


def parquet_catalog(spark, folder: str, names: list[str]) -> Catalog:
    """A table for each name.parquet in the folder."""

    def listed():
        return [discovered(n, lambda n=n: spark.read.parquet(f"{folder}/{n}.parquet")) for n in names]

    return Catalog(listed)
