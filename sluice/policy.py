"""Roles, columns, rows, aggregates and limits.

A policy decides on the driver; rows are decided by Columns, in two readings of one
predicate: SQL's for queries, and for streams one that hides what it can't decide.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.catalog import Table
from sluice.errors import Forbidden, Invalid
from sluice.functions import canonical, timestamps
from sluice.operators import aggregates, filters
from sluice.operators.aggregates import col

#: The grammar of claims, the filters and the caps of a policy.
CLAIM = re.compile(r"\{\{\s*jwt\.([A-Za-z0-9_.]+)\s*\}\}", re.ASCII)
OPS = {"_eq": "eq", "_neq": "neq", "_gt": "gt", "_lt": "lt", "_in": "in"}
CAPS = ("max_rows", "max_rows_to_read", "max_memory_usage", "max_execution_time")


@dataclass(frozen=True)
class Select:
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    filter: dict = field(default_factory=dict)
    allow_aggregations: tuple[str, ...] = ()
    deny_aggregations: tuple[str, ...] = ()
    caps: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Insert:
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    check: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Policy:
    tables: dict[str, dict[str, dict]]  # table -> role -> {"select": Select, "insert": Insert}
    default_role: str = "anonymous"
    admin_role: str = "admin"

    def role(self, name: str | None) -> str:
        return name or self.default_role

    def is_admin(self, role: str | None) -> bool:
        return bool(self.admin_role) and self.role(role) == self.admin_role


def passes(name: str, allow, deny, fold: bool = False) -> bool:
    """Deny wins; no list, or * in it, allows all.  In a deny list * is a name like any other."""
    f = str.lower if fold else str
    allow, deny = {f(x) for x in allow}, {f(x) for x in deny}
    return f(name) not in deny and (not allow or "*" in allow or f(name) in allow)


def claim(claims: dict, path: str):
    """(texts, is a set), or None if nothing there can be bound; one bad element spoils a set."""
    at = claims
    for part in path.split("."):
        if not isinstance(at, dict) or part not in at:
            return None
        at = at[part]
    if isinstance(at, list):
        texts = [canonical.scalar(x) for x in at]
        return None if not texts or None in texts else (texts, True)
    text = canonical.scalar(at)
    return None if text is None else ([text], False)


def fill(template, claims: dict) -> list[str] | None:
    """A policy value with claims in it; the whole template may be one array claim."""
    if not isinstance(template, str):
        text = canonical.scalar(template)
        return None if text is None else [text]
    if (m := CLAIM.fullmatch(template.strip())) and (got := claim(claims, m[1])):
        return got[0]
    found = [claim(claims, p) for p in CLAIM.findall(template)]
    if any(x is None or x[1] for x in found):
        return None
    values = iter(found)
    return [CLAIM.sub(lambda _: next(values)[0][0], template)]


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    values: tuple[str, ...] | None  # None: can't be resolved, nothing passes

    def query(self, table: Table, schema: T.StructType) -> Column:
        """SQL's reading.  Constants are texts that the column's type reads."""
        if self.values is None:
            return F.lit(False)
        of = schema[self.column].dataType
        if self.op == "in":
            return filters.build(self.column, "in", list(self.values), of)
        return filters.build(self.column, self.op, self.values[0], of)

    def stream(self, table: Table, payload: Column | None = None) -> Column:
        """Over the ingested text of the column: true only if it is surely so."""
        spec = table[self.column]
        if self.values is None or spec is None:
            return F.lit(False)
        c = col(self.column).cast("string") if payload is None else payload
        if self.op == "in" and spec.type.kind == "integer":  # one reading of the payload for all values
            n, good = canonical.number_column(c), [v for v in self.values if self.one(c, v, spec.type) is not None]
            return F.coalesce(n.isin(*(F.lit(v).try_cast("decimal(38,18)") for v in good)) & (n == F.floor(n)), F.lit(False)) if good else F.lit(False)
        hits = [self.one(c, v, spec.type) for v in self.values]
        hits = [h for h in hits if h is not None]
        if not hits:
            return F.lit(False)
        any_of = hits[0]
        for h in hits[1:]:
            any_of = any_of | h
        return F.coalesce(any_of, F.lit(False))

    def one(self, c: Column, value: str, of) -> Column | None:
        op = "eq" if self.op == "in" else self.op
        compare = {"eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "gt": lambda a, b: a > b, "lt": lambda a, b: a < b}[op]
        if of.kind == "text":
            return compare(c, F.lit(value))
        if of.kind == "integer":
            if canonical.numeric(value) != value or "." in value or not of.low <= int(value) <= of.high:
                return None  # only the one spelling of an integer in range matches anything
            n = canonical.number_column(c)
            low, high = (F.lit(str(min(max(x, -(10**20 - 1)), 10**20 - 1))).cast("decimal(38,18)") for x in (of.low, of.high))
            return F.when((n == F.floor(n)) & n.between(low, high), compare(n, F.lit(value).try_cast("decimal(38,18)")))
        if of.kind == "float":
            if canonical.numeric(value) is None:
                return None
            return F.when(canonical.number_column(c).isNotNull(), compare(c.try_cast(of.spark), F.lit(value).cast(of.spark)))
        if of.kind == "decimal":
            if canonical.numeric(value) is None or of.precision > 38:
                return None
            cut = lambda x: canonical.truncate(x.try_cast("decimal(38,18)"), of.precision, of.scale)
            return F.when(canonical.number_column(c).isNotNull(), compare(cut(c), cut(F.lit(value))))
        if of.kind == "time":
            at = timestamps.parse_column(F.lit(value), of)
            return compare(timestamps.parse_column(c, of), at)
        return c == F.lit(value) if op == "eq" else None  # opaque: equal bytes, nothing else is sure


def predicates(rules: dict, claims: dict) -> list[Predicate]:
    out = []
    for column, ops in rules.items():
        for name, template in ops.items():
            if name not in OPS:
                raise Invalid(f"unknown policy operator {name!r}")
            if name == "_in" and isinstance(template, list):
                parts = [fill(t, claims) for t in template]
                values = None if not parts or None in parts else [v for p in parts for v in p]
            else:
                values = fill(template, claims)
                if values is not None and name != "_in" and len(values) != 1:
                    values = None
            out.append(Predicate(column, OPS[name], None if values is None else tuple(values)))
    return out


@dataclass(frozen=True)
class ReadGrant:
    """What a role may read of a table; all of it for admins."""

    select: Select | None
    predicates: tuple[Predicate, ...] = ()

    def column(self, name: str) -> bool:
        return self.select is None or passes(name, self.select.allow, self.select.deny)

    def aggregation(self, name: str) -> bool:
        return self.select is None or passes(name, self.select.allow_aggregations, self.select.deny_aggregations, fold=True)

    @property
    def restricted(self) -> bool:
        return self.select is not None and bool(self.select.deny or (self.select.allow and "*" not in self.select.allow))

    def cap(self, name: str) -> int:
        return 0 if self.select is None else int(self.select.caps.get(name) or 0)

    def visible(self, table: Table) -> Column:
        out = F.lit(True)
        for p in self.predicates:
            out = out & p.stream(table)
        return out


@dataclass(frozen=True)
class WriteGrant:
    insert: Insert | None
    claims: dict = field(default_factory=dict)

    def column(self, name: str) -> bool:
        return self.insert is None or passes(name, self.insert.allow, self.insert.deny)

    def checks(self, table: Table) -> dict[str, tuple[str, list[str]]]:
        """column -> (eq or in, texts).  An _eq claim that can't be resolved is the empty text."""
        out = {}
        for column, rule in (self.insert.check if self.insert else {}).items():
            spec = table[column]
            if spec is None or not spec.insertable or spec.default_kind == "EPHEMERAL":
                raise Forbidden(f"policy checks column {column!r}, which can't be inserted")
            (name, template), = rule.items()
            values = [v for t in (template if isinstance(template, list) else [template]) for v in (fill(t, self.claims) or [])]
            out[column] = ("in", values) if name == "_in" else ("eq", values[:1] or [""])
        return out


def grant(policy: Policy | None, table: str, role: str | None, operation: str, claims: dict):
    """A ReadGrant or WriteGrant; everything that isn't allowed raises Forbidden."""
    if policy is None:
        raise Forbidden("no policy")
    if policy.is_admin(role):
        return ReadGrant(None) if operation == "select" else WriteGrant(None)
    role = policy.role(role)
    rules = policy.tables.get(table, {})
    entry = rules.get(role) if role and role != "*" else None
    op = (entry or {}).get(operation)
    if op is None:
        raise Forbidden(f"role {role!r} may not {operation} {table!r}")
    return ReadGrant(op, tuple(predicates(op.filter, claims))) if operation == "select" else WriteGrant(op, claims)


def validate(policy: Policy, roles: set[str] | None = None) -> list[str]:
    """What is wrong with a policy, as texts."""
    bad = []
    for table, by_role in policy.tables.items():
        for role, ops in by_role.items():
            at = f"{table}/{role}"
            if not role or role == "*" or (roles is not None and role not in roles):
                bad.append(f"{at}: unknown role")
            if not ops:
                bad.append(f"{at}: neither select nor insert")
            for kind, op in ops.items():
                rules = op.filter if kind == "select" else op.check
                for column, rule in rules.items():
                    if not rule:
                        bad.append(f"{at}: no operator for {column}")
                    if "?" in column:
                        bad.append(f"{at}: ? in a name")
                    for name, template in rule.items():
                        if name not in OPS or (kind == "insert" and name not in ("_eq", "_in")):
                            bad.append(f"{at}: {name} not possible for {column}")
                        for text in template if isinstance(template, list) else [template]:
                            if isinstance(text, str) and "{{" in CLAIM.sub("", text):
                                bad.append(f"{at}: malformed template {text!r}")
                    if kind == "insert" and len(rule) > 1:
                        bad.append(f"{at}: more than one check for {column}")
                if kind == "select":
                    bad += [f"{at}: {k} must not be negative" for k in CAPS if (op.caps.get(k) or 0) < 0]
                    bad += [f"{at}: unknown aggregation {a}" for a in (*op.allow_aggregations, *op.deny_aggregations) if a != "*" and not aggregates.known(a)]
    return bad


def role_allowed(policy: Policy | None, role: str | None, allowed: list[str]) -> bool:
    """Pipes: exact membership; the admin always."""
    return policy is not None and (policy.is_admin(role) or policy.role(role) in allowed)
