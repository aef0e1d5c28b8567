"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SqlError(Exception):
    """An error of a statement: its kind (syntax, name, semantic, constraint, runtime), and its line and column where they are known."""

    def __init__(self, message: str, kind: str = "semantic", line: int | None = None, column: int | None = None) -> None:
        super().__init__(message)
        self.kind, self.line, self.column = kind, line, column


@dataclass
class Token:
    kind: str  # word, name (quoted), text, number, op, end
    value: str
    at: int
    line: int = 0
    column: int = 0

    @property
    def upper(self) -> str:
        return self.value.upper() if self.kind == "word" else ""


_TOKEN = re.compile(r"""
 (?P<skip>\s+|--[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z))
|(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
|(?P<text>'(?:[^'\\]|''|\\.)*')
|(?P<name>`[^`]*`|"[^"]*")
|(?P<word>[^\W\d][\w$]*|@\w+)
|(?P<op><=>|\|\||<>|!=|<=|>=|::|[-+*/%(),.;=<>\[\]:?])
""", re.X | re.S)
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def unquote(raw: str) -> str:
    """The value of a quoted text; ``\\%`` and ``\\_`` stay for LIKE."""
    return re.sub(r"''|\\(.)", lambda m: "'" if m[0] == "''" else m[0] if m[1] in "%_" else _ESCAPE.get(m[1], m[1]), raw[1:-1], flags=re.S)


def tokenize(sql: str) -> list[Token]:
    out, at, line, begin = [], 0, 1, 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        place = line, at - begin + 1
        if m is None:
            raise SqlError(f"syntax error at line {line}, column {place[1]}: unexpected {sql[at]!r}", "syntax", *place)
        kind = m.lastgroup
        if kind != "skip":
            out.append(Token(kind, unquote(m[0]) if kind == "text" else m[0][1:-1] if kind == "name" else m[0], at, *place))
        if breaks := m[0].count("\n"):
            line, begin = line + breaks, at + m[0].rindex("\n") + 1
        at = m.end()
    return [*out, Token("end", "", len(sql), line, len(sql) - begin + 1)]
