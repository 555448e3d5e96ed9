"""A lexer for SQL text: which words are code, and whether a statement writes.

Comments (``--``, ``#``, ``//``, nesting ``/* */``), quotes with backslash escapes,
curly quotes and ``$tag$`` heredocs are opaque.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: First words of statements that write.
WRITES = frozenset("insert update delete truncate drop alter create rename exchange optimize replace grant revoke system attach detach kill set use".split())
#: What counts as blank.
SPACE = "\t\n\v\f\r \x85\xa0 ᠎           ​‌‍    ⁠　﻿"
TOKEN = re.compile(
    rf"""(?P<space>[{SPACE}]+)
    |(?P<line>(?:--|//|\#)[^\n]*)
    |(?P<open>/\*)
    |(?P<quote>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`\\]|\\.|``)*`|‘[^’]*’|“[^”]*”)
    |(?P<doc>\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)
    |(?P<number>\.[0-9][0-9_]*(?:[eE][+-]?[0-9]+)?)
    |(?P<word>[\w$]+)
    |(?P<sign>.)""",
    re.X | re.S,
)


def tokens(sql: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, begin, end); kinds: space, comment, quote, number, word, sign, broken."""
    at = 0
    while at < len(sql):
        m = TOKEN.match(sql, at)
        kind, end = m.lastgroup if m.lastgroup != "tag" else "doc", m.end()
        if kind == "open":
            depth, end = 1, m.end()
            while depth and end < len(sql):
                nxt = re.compile(r"/\*|\*/").search(sql, end)
                if not nxt:
                    break
                depth, end = depth + (1 if nxt[0] == "/*" else -1), nxt.end()
            kind, end = ("broken", len(sql)) if depth else ("comment", end)
        elif kind == "sign" and m[0] in "'\"`‘“":
            kind, end = "broken", len(sql)
        kind = {"line": "comment", "doc": "quote"}.get(kind, kind)
        yield kind, sql[at:end], at, end
        at = end


def opaque(sql: str) -> list[tuple[int, int]]:
    """Spans of comments, quotes and heredocs."""
    return [(a, z) for kind, _, a, z in tokens(sql) if kind in ("comment", "quote", "broken")]


def is_write(sql: str) -> bool:
    """What can't be parsed counts as a read: nothing of it runs."""
    code = [(k, t) for k, t, _, _ in tokens(sql) if k not in ("space", "comment")]
    if not code or code[0][0] != "word":
        return False
    first = code[0][1].lower()
    if first == "execute":
        if len(code) < 3 or code[1][1].lower() != "as":
            return False
        rest = code[3:]  # after the user, and a host if there is one
        if len(rest) >= 2 and rest[0][1] == "@":
            rest = rest[2:]
        while rest and rest[-1][1] == ";":
            rest = rest[:-1]
        if not rest:
            return True  # switches the session's user
        if rest[0][0] != "word" or rest[0][1].lower() == "execute":
            return False
        return rest[0][1].lower() in WRITES or (rest[0][1].lower() == "with" and with_writes(rest))
    return first in WRITES or (first == "with" and with_writes(code))


def with_writes(code: list[tuple[str, str]]) -> bool:
    """Whether the statement after a WITH list is INSERT INTO, looking at words outside brackets only."""
    depth, flat = 0, []
    for kind, text in code[1:]:
        if kind == "sign" and text in "([{":
            depth += 1
            flat.append(("group", text))
        elif kind == "sign" and text in ")]}":
            depth -= 1
        elif depth == 0:
            flat.append((kind, text.lower() if kind == "word" else text))
    if depth:
        return False
    for i, (kind, text) in enumerate(flat):
        after = flat[i + 1] if i + 1 < len(flat) else ("", "")
        before = flat[i - 1] if i else ("", "")
        if kind == "word" and text == "insert" and after == ("word", "into"):
            return True
        # a name after AS, before AS, in an expression or called isn't the statement's verb
        if kind == "word" and text == "select" and i and before[1] not in ("as", ".", "+", "-", "*", "/", ",", "=", "<", ">") and after[1] not in ("as", ".", "+", "->", ",") and after != ("word", "insert"):
            return False
    return False
