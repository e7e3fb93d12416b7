"""Tokens of a statement."""

from __future__ import annotations

import re
from dataclasses import dataclass

from larkspur.errors import SqlError

# The words that can be names only in double quotes.
RESERVED = frozenset(
    "ALL ALTER AND ANY AS ASC BETWEEN BY CASE CAST CHECK CONSTRAINT CREATE CROSS CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP CURRENT_USER DEFAULT DELETE DESC DISTINCT DROP "
    "ELSE END ESCAPE EXCEPT EXISTS FALSE FETCH FOR FOREIGN FROM FULL GRANT GROUP HAVING IN INNER INSERT INTERSECT INTO IS JOIN LEFT LIKE LIMIT LOCALTIME LOCALTIMESTAMP "
    "NATURAL NOT NULL OFFSET ON OR ORDER OUTER PRIMARY REFERENCES REVOKE RIGHT SELECT SET SOME TABLE THEN TO TRUE UNION UNIQUE UPDATE USING VALUES WHEN WHERE WITH".split()
)

_TOKEN = re.compile(
    r"""(?P<blank>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<bad_comment>/\*)
    |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<string>[nN]?'(?:[^']|'')*')
    |(?P<hex>[xX]'[^']*')
    |(?P<quoted>"(?:[^"]|"")*")
    |(?P<word>[^\W\d][\w$]*)
    |(?P<symbol><>|!=|<=|>=|\|\||[(),.;*+\-/=<>?])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str  # word, quoted, string, hex, number, symbol, end
    text: str
    offset: int
    end: int


def position(sql: str, offset: int) -> tuple[int, int, int]:
    """Offset in UTF-16 units, line and column from 1; a CR LF is one line end."""
    units = lambda s: len(s.encode("utf-16-le")) // 2
    before = sql[:offset].replace("\r\n", "\n").replace("\r", "\n")
    line = before.rsplit("\n", 1)[-1]
    return units(sql[:offset]), before.count("\n") + 1, units(line) + 1


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if m is None or m.lastgroup == "bad_comment":
            what = "Unterminated comment" if m else "Unterminated literal" if sql[at] in "'\"" else f'Unexpected "{sql[at]}"'
            raise SqlError("42601", what, position(sql, at))
        kind, text = m.lastgroup, m.group()
        if kind == "number" and m.end() < len(sql) and re.match(r"[\w$]", sql[m.end()]):
            raise SqlError("42601", f'Unexpected "{sql[m.end()]}" after a number', position(sql, m.end()))
        if kind == "word":
            text = text.upper()
        elif kind == "string":
            text = text[text.index("'") + 1 : -1].replace("''", "'")
        elif kind == "hex":
            text = text[2:-1].upper()
            if len(text) % 2 or re.search("[^0-9A-F]", text):
                raise SqlError("42601", "A binary literal takes an even number of hexadecimal digits", position(sql, at))
        elif kind == "quoted":
            text = text[1:-1].replace('""', '"')
            if not text:
                raise SqlError("42601", "An empty name", position(sql, at))
        if kind in ("word", "quoted") and len(text) > 128:
            raise SqlError("42622", "Identifier is longer than 128 characters", position(sql, at))
        if kind == "symbol" and text == "!=":
            text = "<>"
        if kind != "blank":
            out.append(Token(kind, text, at, m.end()))
        at = m.end()
    out.append(Token("end", "end of statement", len(sql), len(sql)))
    return out
