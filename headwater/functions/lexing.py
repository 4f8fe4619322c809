"""SQL text as tokens with their nesting and their clauses. One pass over a statement, in time proportional to it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

_NAME = r"""(?:[A-Za-z_][A-Za-z0-9_$]*|"[^"]*"|`[^`]*`)"""
#: White space, comments, strings, dotted names (or name.*), numbers, operators, any other character.
TOKEN_RE = (
    r"\s+|--[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|'(?:[^']|'')*'|"
    + _NAME
    + r"(?:\s*\.\s*(?:"
    + _NAME
    + r"|\*))*|[0-9]+(?:\.[0-9]+)?|<>|<=|>=|!=|\|\||::|."
)
_TOKENS = re.compile(TOKEN_RE, re.S | re.A)
_LAST = re.compile(f"({_NAME})\\s*$", re.A)
_ENDS = re.compile(r"^[\s;]+|[\s;]+$", re.A)

CLAUSES = frozenset("SELECT FROM WHERE GROUP HAVING ORDER UNION INTERSECT EXCEPT LIMIT WINDOW QUALIFY ON USING SET VALUES".split())
SET_OPERATIONS = frozenset("UNION INTERSECT EXCEPT".split())
#: Words that are never an alias or a table.
RESERVED = CLAUSES | frozenset(
    "JOIN INNER LEFT RIGHT FULL CROSS OUTER NATURAL LATERAL AS BY AND OR NOT IN IS LIKE BETWEEN CASE WHEN THEN ELSE DISTINCT ALL OVER PARTITION INTO INSERT CREATE TABLE WITH RECURSIVE EXISTS ONLY".split()
)


def last_segment(name: str) -> str:
    """The last part of a dotted name, without quotes; empty if it isn't a name."""
    m = _LAST.search(name)
    return m[1].translate(_QUOTES) if m else ""


def whole_name(name: str) -> str:
    """A dotted name without quotes and spaces."""
    return re.sub(r"\s*\.\s*", ".", name.translate(_QUOTES), flags=re.A)


_QUOTES = {ord('"'): None, ord("`"): None}


@dataclass(slots=True)
class Token:
    """A token that is neither white space nor a comment. ``group`` tells apart parentheses of one depth; ``clause`` and
    ``select_seen`` are those of the group up to the token itself."""

    at: int  # number among all tokens of the statement
    text: str
    up: str
    name: bool
    depth: int
    group: int
    clause: str | None
    select_seen: bool


def split_statements(sql: str) -> Iterator[tuple[int, str]]:
    """(number, text) of the statements, cut at semicolons and trimmed; such of comments only are left out. A text without
    a semicolon but at its ends is statement 0."""
    whole = _ENDS.sub("", sql)
    if ";" not in whole:
        if any(not _silent(t) for t in _TOKENS.findall(whole)):
            yield 0, whole
        return
    number, part = 0, []
    for tok in [*_TOKENS.findall(sql), None]:
        if tok == ";" or tok is None:
            if any(not _silent(t) for t in part):
                yield number, _ENDS.sub("", "".join(part))
            number, part = number + 1, []
        else:
            part.append(tok)


def _silent(tok: str) -> bool:
    return tok.isspace() or tok.startswith("--") or tok.startswith("/*") and len(tok) > 2


def lex(sql: str) -> tuple[list[str], list[Token]]:
    """All tokens of a statement, which put together are its text, and those that count."""
    raw = _TOKENS.findall(sql)
    out: list[Token] = []
    opened = closed = 0
    groups: dict[int, int] = {}  # of each depth, the group that is open
    state: dict[tuple[int, int], tuple[str | None, bool]] = {}
    before = before2 = ""
    for at, text in enumerate(raw):
        if _silent(text):
            continue
        up = text.upper()
        closed += text == ")"
        depth = opened - closed
        if before == "(" and text != ")":
            groups[depth] = at
        group = groups.get(depth, -1)
        clause, seen = state.get((depth, group), (None, False))
        if up in CLAUSES and not (up == "FROM" and before == "DISTINCT" and before2 in ("IS", "NOT")):
            clause = up
            seen = seen or up == "SELECT"
            state[depth, group] = clause, seen
        out.append(Token(at, text, up, text[0].isalpha() and text[0].isascii() or text[0] in '_"`', depth, group, clause, seen))
        opened += text == "("
        before2, before = before, up
    return raw, out
