"""A shell: python -m larkspur.cli FOLDER [-e STATEMENTS | -f FILE]; without either, statements from standard input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from larkspur.dialect.lexer import tokens
from larkspur.errors import SqlError
from larkspur.session import Database, Result


def split(script: str) -> list[str]:
    """Statements of a script; a semicolon in a literal, a name or a comment ends none."""
    out, start = [], 0
    for t in tokens(script):
        if t.kind == "symbol" and t.text == ";" or t.kind == "end":
            part = script[start : t.offset].strip()
            if len(tokens(part)) > 1:
                out.append(part)
            start = t.end
    return out


def shown(r: Result, most: int = 1000) -> str:
    """A table of up to `most` rows, or the message of a statement without rows."""
    if r.frame is None:
        return r.message
    rows = next(iter(r.fetch(most)), [])
    cell = lambda v: "NULL" if v is None else v.hex().upper() if isinstance(v, (bytes, bytearray)) else str(v).upper() if isinstance(v, bool) else str(v)
    table = [[c for c, _ in r.columns], *[[cell(v) for v in row] for row in rows]]
    widths = [max(map(len, col)) for col in zip(*table, strict=True)]
    lines = [" | ".join(v.ljust(w) for v, w in zip(row, widths, strict=True)).rstrip() for row in table]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:], f"({len(rows)} row{'s' * (len(rows) != 1)})"])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="larkspur")
    p.add_argument("folder")
    p.add_argument("-e", dest="text")
    p.add_argument("-f", dest="file")
    p.add_argument("-u", dest="user", default="SYSTEM")
    p.add_argument("-p", dest="password", default="")
    a = p.parse_args(argv)
    if a.file:
        with open(a.file, encoding="utf-8") as f:
            a.text = f.read()
    session = Database(SparkSession.builder.getOrCreate(), a.folder).connect(a.user, a.password)
    for statement in split(a.text if a.text is not None else sys.stdin.read()):
        try:
            print(shown(session.execute(statement)))
        except SqlError as e:
            print(f"{e.sqlstate}: {e}", file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
