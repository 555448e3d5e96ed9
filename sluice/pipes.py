"""Named SQL templates: parameters and claims bound as literals in one pass."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from sluice import policy, sqlscan
from sluice.errors import Invalid

#: The grammar of placeholders and of numeric texts.
PARAM = r"\{\{(?P<name>\w+)(?::(?P<default>[^}]*))?\}\}"
PLACE = re.compile(rf"{policy.CLAIM.pattern}|{PARAM}", re.ASCII)
ATTEMPT = re.compile(r"\{\{\s*[\w.]", re.ASCII)
NUMERIC = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", re.ASCII)
RESERVED = "jwt"


class UnresolvedClaim(Exception):
    def __init__(self, path: str):
        super().__init__(f"claim {path!r} can't be bound")
        self.path = path


@dataclass(frozen=True)
class Parameter:
    name: str
    type: str = "string"
    required: bool = False
    default: object = None


@dataclass(frozen=True)
class Pipe:
    name: str
    sql: str
    parameters: tuple[Parameter, ...] = ()
    description: str = ""
    allowed_roles: tuple[str, ...] = ()


def quote(text: str) -> str:
    """Spark's escapes: backslash, quote and line ends.  Stars and dollars go out as octal so that no comment or heredoc in the template can end in a value."""
    table = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "*": "\\052", "$": "\\044"}
    return "'" + "".join(table.get(c, c) for c in text) + "'"


def bare(text: str) -> str:
    return f" {text}" if text.startswith("-") else text  # -- would begin a comment


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, str):
        return bare(value.removeprefix("+")) if NUMERIC.fullmatch(value) else quote(value)
    if isinstance(value, (int, float)):
        if isinstance(value, float) and not math.isfinite(value):
            raise Invalid("a number parameter must be finite")
        return bare(str(value) if isinstance(value, int) else str(int(value)) if value.is_integer() else repr(value))
    if isinstance(value, list) and value:
        return "(" + ", ".join(map(literal, value)) + ")"
    raise Invalid("an array parameter must not be empty" if value == [] else f"unsupported parameter {type(value).__name__}")


def parameters(query_string: dict, body: dict | None) -> dict:
    """What a call supplies: the body's over the query string's."""
    return {**query_string, **(body or {})}


def claims_used(pipe: Pipe) -> list[str]:
    return list(dict.fromkeys(m[1] for m in PLACE.finditer(pipe.sql) if m[1]))


def bind(pipe: Pipe, supplied: dict, claims: dict) -> str:
    """Claims first, then required parameters, then each placeholder: supplied, declared default, inline default."""
    found = {}
    for path in claims_used(pipe):
        if (got := policy.claim(claims, path)) is None:
            raise UnresolvedClaim(path)
        texts, many = got
        found[path] = "(" + ", ".join(map(quote, texts)) + ")" if many else quote(texts[0])
    declared = {p.name: p for p in pipe.parameters}
    for p in pipe.parameters:
        if p.required and p.name not in supplied:
            raise Invalid(f"missing required parameter {p.name!r}")

    def put(m: re.Match) -> str:
        if m[1]:
            return found[m[1]]
        name, inline = m["name"], m["default"]
        if name in supplied:
            return literal(supplied[name])
        if name in declared and declared[name].default is not None:
            return literal(declared[name].default)
        if inline is not None:
            return literal(inline)
        raise Invalid(f"missing required parameter {name!r}")

    return PLACE.sub(put, pipe.sql)


def skeleton(pipe: Pipe) -> str:
    """The statement with '' in every place, for classification and checks."""
    return PLACE.sub("''", pipe.sql)


def check(pipe: Pipe) -> list[str]:
    """Faults of a template."""
    bad = []
    hidden = sqlscan.opaque(PLACE.sub(lambda m: "x" * len(m[0]), pipe.sql))
    for m in PLACE.finditer(pipe.sql):
        if any(a <= m.start() and m.end() <= z for a, z in hidden):
            bad.append(f"placeholder {m[0]} in a comment or quotes")
        if m["name"] == RESERVED:
            bad.append(f"{RESERVED} is reserved for claims")
    if any(p.name == RESERVED for p in pipe.parameters):
        bad.append(f"{RESERVED} is reserved for claims")
    if m := ATTEMPT.search(PLACE.sub("", pipe.sql)):
        bad.append(f"unrecognized placeholder at {m[0]!r}")
    return bad
