"""Declared types, families, and the types of results.

In Spark, values are held as: characters string, BINARY and VARBINARY binary, TIME micros since
midnight (bigint), TIME WITH TIME ZONE struct<t bigint of UTC micros, off int>, TIMESTAMP
timestamp_ntz, TIMESTAMP WITH TIME ZONE struct<ts timestamp_ntz in UTC, off int>, year-month
intervals months (int), day-time intervals micros (bigint). Structs compare by their first field,
which is the instant. Day-time intervals are thus limited to what a bigint of micros holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from larkspur.errors import SqlError

CHARS, BINS = ("CHAR", "VARCHAR"), ("BINARY", "VARBINARY")
EXACT, FLOATS = ("SMALLINT", "INTEGER", "BIGINT", "DECIMAL"), ("REAL", "DOUBLE")
INTS = EXACT[:3]
YM_FIELDS, DT_FIELDS = ("YEAR", "MONTH"), ("DAY", "HOUR", "MINUTE", "SECOND")
MAX_VARCHAR, MAX_CHAR = 65_535, 2_000
#: Digits of an integer kind when it meets a DECIMAL.
INT_DIGITS = {"SMALLINT": 5, "INTEGER": 10, "BIGINT": 19}


@dataclass(frozen=True)
class Type:
    kind: str
    a: int = 0  # length, precision, or leading precision of an interval
    b: int = 0  # scale, or fraction digits of an interval
    start: str = ""
    end: str = ""

    @property
    def family(self) -> str:
        k = self.kind
        if k in CHARS:
            return "CHARACTER"
        if k in BINS:
            return "BINARY"
        if k in EXACT or k in FLOATS:
            return "NUMERIC"
        if k in ("DATE", "TIMESTAMP", "TIMESTAMPTZ"):
            return "DATETIME"
        if k in ("TIME", "TIMETZ"):
            return "TIME"
        if k == "INTERVAL":
            return "INTERVAL_YM" if self.start in YM_FIELDS else "INTERVAL_DT"
        return k

    @property
    def spark(self) -> str:
        k = self.kind
        fixed = {"SMALLINT": "smallint", "INTEGER": "int", "BIGINT": "bigint", "REAL": "float", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date", "TIME": "bigint", "TIMETZ": "struct<t:bigint,off:int>", "TIMESTAMP": "timestamp_ntz", "TIMESTAMPTZ": "struct<ts:timestamp_ntz,off:int>", "NULL": "string"}
        if k in CHARS or k == "TEXT":
            return "string"
        if k in BINS:
            return "binary"
        if k == "DECIMAL":
            return f"decimal({self.a},{self.b})"
        if k == "INTERVAL":
            return "int" if self.family == "INTERVAL_YM" else "bigint"
        return fixed[k]

    def __str__(self) -> str:
        k = self.kind
        if k in CHARS or k in BINS:
            return f"{k}({self.a})"
        if k == "DECIMAL":
            return f"DECIMAL({self.a},{self.b})"
        if k in ("TIME", "TIMESTAMP"):
            return f"{k}({self.a})"
        if k in ("TIMETZ", "TIMESTAMPTZ"):
            return f"{k[:-2]}({self.a}) WITH TIME ZONE"
        if k == "INTERVAL":
            to = f" TO {self.end}" if self.end != self.start else ""
            frac = f"({self.b})" if self.end == "SECOND" else ""
            return f"INTERVAL {self.start}({self.a}){to}{frac if to else ''}"
        if k == "DOUBLE":
            return "DOUBLE PRECISION"
        return k


NULL = Type("NULL")
BOOLEAN, DATE = Type("BOOLEAN"), Type("DATE")
SMALLINT, INTEGER, BIGINT, REAL, DOUBLE = map(Type, ("SMALLINT", "INTEGER", "BIGINT", "REAL", "DOUBLE"))


def varchar(n: int) -> Type:
    return Type("VARCHAR", max(1, min(MAX_VARCHAR, n)))


def decimal(p: int, s: int) -> Type:
    """A decimal of at most 38 digits; whole digits go first, but 6 of the scale stay if it has them."""
    if p > 38:
        whole = p - s
        s = max(38 - whole, min(s, 6))
        p = 38
    return Type("DECIMAL", p, s)


def as_decimal(t: Type) -> Type:
    return t if t.kind == "DECIMAL" else Type("DECIMAL", INT_DIGITS[t.kind], 0)


def mismatch(x: Type, y: Type, what: str = "compared or combined") -> SqlError:
    return SqlError("42804", f"Types {x} and {y} cannot be {what}")


def merge_intervals(x: Type, y: Type) -> Type:
    fields = YM_FIELDS if x.family == "INTERVAL_YM" else DT_FIELDS
    start = min(x.start, y.start, key=fields.index)
    end = max(x.end, y.end, key=fields.index)
    return Type("INTERVAL", max(x.a, y.a), max(x.b, y.b), start, end)


def common(x: Type, y: Type) -> Type:
    """The type both are taken as when they are compared or become one column."""
    if x.kind == "NULL":
        return y
    if y.kind == "NULL":
        return x
    if x.family != y.family:
        raise mismatch(x, y)
    f = x.family
    if f == "CHARACTER":
        return Type("CHAR" if x.kind == y.kind == "CHAR" else "VARCHAR", max(x.a, y.a))
    if f == "BINARY":
        return Type("BINARY" if x.kind == y.kind == "BINARY" and x.a == y.a else "VARBINARY", max(x.a, y.a))
    if f == "NUMERIC":
        if x.kind in FLOATS or y.kind in FLOATS:
            return REAL if x.kind == y.kind == "REAL" else DOUBLE
        if "DECIMAL" in (x.kind, y.kind):
            p, q = as_decimal(x), as_decimal(y)
            s = max(p.b, q.b)
            return decimal(max(p.a - p.b, q.a - q.b) + s, s)
        return max(x, y, key=lambda t: INTS.index(t.kind))
    if f == "DATETIME":
        if "TIMESTAMPTZ" in (x.kind, y.kind):
            return Type("TIMESTAMPTZ", max(x.a, y.a))
        return DATE if x.kind == y.kind == "DATE" else Type("TIMESTAMP", max(x.a, y.a))
    if f == "TIME":
        return Type("TIMETZ" if "TIMETZ" in (x.kind, y.kind) else "TIME", max(x.a, y.a))
    if f.startswith("INTERVAL"):
        return merge_intervals(x, y)
    return x


def arithmetic(op: str, x: Type, y: Type) -> Type:
    """Result of a numeric operator; the DECIMAL formulas are the usual ones of SQL engines."""
    if x.kind in FLOATS or y.kind in FLOATS:
        return REAL if x.kind == y.kind == "REAL" else DOUBLE
    if "DECIMAL" not in (x.kind, y.kind):
        return max(x, y, INTEGER, key=lambda t: INTS.index(t.kind))
    p, q = as_decimal(x), as_decimal(y)
    if op in "+-":
        s = max(p.b, q.b)
        return decimal(max(p.a - p.b, q.a - q.b) + s + 1, s)
    if op == "*":
        return decimal(p.a + q.a + 1, p.b + q.b)
    s = max(6, p.b + q.a + 1)
    return decimal(p.a - p.b + q.b + s, s)


def can_cast(x: Type, y: Type) -> bool:
    f, g = x.family, y.family
    if "NULL" in (x.kind, y.kind) or f == g:
        return True
    if "CHARACTER" in (f, g):
        return "BINARY" not in (f, g)
    if {f, g} == {"DATETIME", "TIME"}:
        return "DATE" not in (x.kind, y.kind)
    interval, number = (x, y) if f.startswith("INTERVAL") else (y, x)
    return interval.kind == "INTERVAL" and number.kind in EXACT and interval.start == interval.end


_SIMPLE = {
    "SMALLINT": SMALLINT, "INT": INTEGER, "INTEGER": INTEGER, "BIGINT": BIGINT, "REAL": REAL, "BOOLEAN": BOOLEAN, "DATE": DATE,
}


def resolve(words: str, args: list[int], qualifier: Type | None = None, zone: bool = False) -> Type:
    """A declared type by its name (words joined by a space) and arguments, with the dialect's defaults and limits."""

    def one(default, least, most):
        n = args[0] if args else default
        if len(args) > 1 or not least <= n <= most:
            raise SqlError("22023", f"Argument of {words} must be from {least} to {most}")
        return n

    if words in _SIMPLE:
        if args:
            raise SqlError("22023", f"{words} takes no argument")
        return _SIMPLE[words]
    if words in ("CHAR", "CHARACTER", "NCHAR", "NATIONAL CHAR", "NATIONAL CHARACTER"):
        return Type("CHAR", one(1, 1, MAX_CHAR))
    if re.fullmatch(r"(N?VARCHAR2?|N?CHAR VARYING|CHARACTER VARYING|NATIONAL (CHAR|CHARACTER) VARYING)", words):
        return Type("VARCHAR", one(MAX_VARCHAR, 1, MAX_VARCHAR))
    if words == "BINARY":
        return Type("BINARY", one(1, 1, MAX_CHAR))
    if words in ("VARBINARY", "BINARY VARYING"):
        return Type("VARBINARY", one(MAX_VARCHAR, 1, MAX_VARCHAR))
    if words in ("DECIMAL", "DEC", "NUMERIC"):
        p, s = (10, 3) if not args else (args[0], args[1] if len(args) > 1 else 0)
        if len(args) > 2 or not 1 <= p <= 38 or not 0 <= s <= p:
            raise SqlError("22023", "DECIMAL takes a precision from 1 to 38 and a scale from 0 to the precision")
        return Type("DECIMAL", p, s)
    if words in ("DOUBLE PRECISION", "DOUBLE"):
        return DOUBLE
    if words == "FLOAT":
        return REAL if one(53, 1, 53) <= 24 else DOUBLE
    if words in ("TIME", "TIMESTAMP"):
        return Type(words + ("TZ" if zone else ""), one(0 if words == "TIME" else 6, 0, 6))
    if words == "INTERVAL":
        return replace(qualifier, a=qualifier.a if qualifier.a >= 0 else 2, b=qualifier.b if qualifier.b >= 0 else 6)
    raise SqlError("0A000", f"Not supported: data type {words}")
