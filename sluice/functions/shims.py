"""Functions of the other dialect that pipes use, as Spark's own."""

from __future__ import annotations

import re

from sluice.sqlscan import opaque

#: A call in the other dialect (patterns on code, quotes and comments left out) and Spark's.
CALLS = (
    (r"(?i:\bcount)\(\s*\)", "count(*)"),
    (r"\buniqExact\(", "count(DISTINCT "),
    (r"\btoDate\(", "to_date("),
    (r"\bnow64\(\s*[0-9]*\s*\)", "current_timestamp()"),
    (r"\bhas\(", "array_contains("),
    (r"\btimezone\(\s*\)", "current_timezone()"),
)


def rewrite(sql: str) -> str:
    out, at = [], 0
    for a, z in [*opaque(sql), (len(sql), len(sql))]:
        code = sql[at:a]
        for pattern, own in CALLS:
            code = re.sub(pattern, own, code)
        out += [code, sql[a:z]]
        at = z
    return "".join(out)
