"""From a tree to Spark SQL text with explicit casts.

The binder resolves names, gives every expression a declared type, takes untyped literals and
parameters as their peer's type, and writes SQL whose meaning in Spark is the dialect's meaning.
Joins, pushdown, pruning and decorrelation are left to Catalyst: predicates are written where Spark
can use them (native IN, EXISTS and NOT IN in filters), and only values that Spark computes
differently are rewritten.

Sources are named s1, s2, ... and output columns c0, c1, ..., so names of the statement never meet
Spark's resolution rules.
"""

from __future__ import annotations

import datetime as dt
import decimal as dec
import itertools
import re
from dataclasses import dataclass, field

from larkspur.dialect import types as T
from larkspur.dialect.parser import Node, parse
from larkspur.dialect.types import BIGINT, BOOLEAN, DATE, DOUBLE, INTEGER, NULL, Type, decimal, varchar
from larkspur.errors import SqlError, unsupported
from larkspur.functions import rules as R

TEXT = "TEXT"
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


@dataclass
class Expr:
    sql: str
    type: Type
    raw: str | None = None  # text of an untyped literal
    agg: bool = False

    @property
    def open(self) -> bool:
        return self.type.kind in (TEXT, "NULL")


@dataclass
class Field:
    name: str
    type: Type
    sql: str
    hidden: bool = False


@dataclass
class Source:
    qualifiers: list[tuple[str, ...]]
    fields: list[Field]
    table: tuple[str, str] | None = None


@dataclass
class Scope:
    sources: list[Source]
    parent: Scope | None = None
    outputs: list[Field] = field(default_factory=list)
    grouped: bool = False
    used: bool = False  # by a subquery


@dataclass
class Relation:
    """What the catalog knows of a name: SQL that selects the columns in order, or a view's text."""

    columns: list[tuple[str, Type]]
    sql: str | None = None
    view: str | None = None
    view_columns: list[str] | None = None
    key: tuple[str, str] | None = None


@dataclass
class Bound:
    sql: str
    columns: list[tuple[str, Type]]


def tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Binder:
    """catalog(space, name) -> Relation; now: the statement's clock; params: values for `?`."""

    def __init__(self, catalog, now, params=(), zone="UTC", user="SYSTEM", space=None):
        self.catalog, self.now, self.params, self.zone, self.user, self.space = catalog, now, list(params), zone, user, space
        self.ids, self.describing = itertools.count(1), False
        self.viewing: list[tuple[str, str]] = []

    # expressions: helpers

    def error(self, state, message, node=None) -> SqlError:
        return SqlError(state, message, getattr(node, "at", None))

    def settle(self, e: Expr) -> Expr:
        """An untyped literal that nothing has given a type."""
        if e.type.kind == TEXT:
            return Expr(e.sql, varchar(len(e.raw)), None, e.agg)
        return e

    def fit(self, e: Expr, t: Type) -> Expr:
        """e as type t, within t's family; untyped literals are cast to it."""
        if e.type.kind == "NULL":
            return Expr(f"CAST(NULL AS {t.spark})", t)
        if e.type.kind == TEXT:
            if t.kind in T.CHARS:
                return Expr(e.sql, varchar(len(e.raw)))
            return Expr(self.literal(e.raw, t), t)
        if e.type.family != t.family:
            raise T.mismatch(e.type, t)
        if e.type == t or t.kind in T.CHARS:
            return e
        return Expr(R.cast(e.sql, e.type, t, self.zone, self.today), t, None, e.agg)

    @property
    def today(self) -> str:
        return f"DATE '{self.now.date().isoformat()}'"

    def literal(self, text: str, t: Type) -> str:
        if t.kind in T.BINS:
            if len(text) % 2 or not all(c in "0123456789abcdefABCDEF" for c in text):
                raise SqlError("22018", f"'{text}' is not hexadecimal")
            return f"X'{text}'"
        if t.kind == "INTERVAL":
            return f"CAST({R.interval_value(text, Type('INTERVAL', 9, 6, t.start, t.end))} AS {t.spark})"
        return R.cast(R.quoted(text), varchar(max(1, len(text))), t, self.zone, self.today)

    def together(self, *exprs: Expr) -> tuple[Type, list[Expr]]:
        """The common type of expressions, and each cast to it."""
        t = NULL
        for e in exprs:
            if not e.open:
                t = T.common(t, e.type)
        if t.kind == "NULL":
            texts = [e for e in exprs if e.type.kind == TEXT]
            t = varchar(max((len(e.raw) for e in texts), default=1)) if texts else NULL
            return t, [e if e.type.kind == TEXT else Expr("CAST(NULL AS string)", t) for e in exprs]
        if t.kind in T.CHARS:
            t = Type(t.kind, max([t.a, *(len(e.raw) for e in exprs if e.type.kind == TEXT)])) if any(e.type.kind == TEXT for e in exprs) else t
        return t, [self.fit(e, t) for e in exprs]

    def key(self, e: Expr) -> str:
        """What comparison looks at: the instant of types with a zone."""
        return f"{e.sql}.ts" if e.type.kind == "TIMESTAMPTZ" else f"{e.sql}.t" if e.type.kind == "TIMETZ" else e.sql

    def compared(self, *exprs: Expr) -> list[str]:
        padded = [e.type.kind == "CHAR" for e in exprs]
        if any(e.type.kind == "CHAR" for e in exprs) and all(p or e.open for p, e in zip(padded, exprs, strict=True)):
            _, fitted = self.together(*exprs)
            return [f"rtrim({e.sql})" for e in fitted]
        _, fitted = self.together(*exprs)
        return [self.key(e) for e in fitted]

    def boolean(self, e: Expr, node=None) -> str:
        if e.type.kind in ("BOOLEAN", "NULL"):
            return e.sql if e.type.kind == "BOOLEAN" else "CAST(NULL AS BOOLEAN)"
        if e.type.kind == TEXT:
            return self.literal(e.raw, BOOLEAN)
        raise self.error("42804", f"A condition must be BOOLEAN, not {e.type}", node)

    def number(self, e: Expr, node=None, peer: Type = DOUBLE) -> Expr:
        if e.open:
            return self.fit(e, peer)
        if not R.numeric(e.type):
            raise self.error("42804", f"A number is needed, not {e.type}", node)
        return e

    def chars(self, e: Expr, node=None) -> Expr:
        e = self.settle(e)
        if e.type.kind == "NULL":
            return Expr("CAST(NULL AS string)", varchar(1))
        if e.type.kind not in T.CHARS:
            raise self.error("42804", f"Text is needed, not {e.type}", node)
        return e

    # expressions

    def expr(self, n: Node, scope: Scope, where: str = "value") -> Expr:
        """where: value, filter (a condition whose UNKNOWN counts as FALSE) or conjunct (a filter joined by AND only)."""
        method = getattr(self, f"x_{n.kind.lower()}", None)
        if method is None:
            raise unsupported(n.kind)
        if n.kind in ("And", "Or", "Not", "InQuery", "Quantified"):
            return method(n, scope, where)
        return method(n, scope)

    def x_number(self, n, scope) -> Expr:
        s = n.text
        if "e" in s.lower():
            v = float(s)
            if v in (float("inf"), float("-inf")):
                raise self.error("22003", "Number is out of range", n)
            return Expr(f"{s}D" if "." in s else f"{s.lower().replace('e', '.0e')}D", DOUBLE)
        digits = s.lstrip("-").lstrip("0")
        if "." not in s:
            v = int(s)
            if -(2**31) <= v < 2**31:
                return Expr(f"({v})" if v < 0 else s, INTEGER)
            if -(2**63) <= v < 2**63:
                return Expr(f"({v}L)" if v != -(2**63) else f"CAST('{v}' AS BIGINT)", BIGINT)
            if len(digits) > 38:
                raise self.error("22003", "Number has more than 38 digits", n)
            return Expr(f"CAST('{v}' AS DECIMAL({len(digits)},0))", Type("DECIMAL", len(digits), 0))
        whole, frac = digits.split(".")
        p = max(1, len(whole) + len(frac))
        if p > 38:
            raise self.error("22003", "Number has more than 38 digits", n)
        return Expr(f"CAST('{s}' AS DECIMAL({p},{len(frac)}))", Type("DECIMAL", p, len(frac)))

    def x_string(self, n, scope) -> Expr:
        return Expr(R.quoted(n.text), Type(TEXT, len(n.text)), n.text)

    def x_hex(self, n, scope) -> Expr:
        return Expr(f"X'{n.text}'", Type("VARBINARY", max(1, len(n.text) // 2)))

    def x_constant(self, n, scope) -> Expr:
        return Expr("NULL", NULL) if n.value == "NULL" else Expr(n.value, BOOLEAN)

    def x_param(self, n, scope) -> Expr:
        v = self.params[n.index - 1]
        if v is None:
            return Expr("NULL", NULL)
        if isinstance(v, bool):
            return Expr(str(v).upper(), BOOLEAN)
        if isinstance(v, int):
            return self.x_number(Node("Number", text=str(v)), scope)
        if isinstance(v, float):
            return Expr(f"CAST('{v!r}' AS DOUBLE)", DOUBLE)
        if isinstance(v, dec.Decimal):
            return self.x_number(Node("Number", text=s if "." in (s := format(v, "f")) else f"{s}."), scope)
        if isinstance(v, dt.datetime):
            if v.tzinfo is not None:
                utc = v.astimezone(dt.UTC).replace(tzinfo=None)
                return Expr(f"named_struct('ts', TIMESTAMP_NTZ '{utc.isoformat(' ')}', 'off', {int(v.utcoffset().total_seconds() // 60)})", Type("TIMESTAMPTZ", 6))
            return Expr(f"TIMESTAMP_NTZ '{v.isoformat(' ')}'", Type("TIMESTAMP", 6))
        if isinstance(v, dt.date):
            return Expr(f"DATE '{v.isoformat()}'", DATE)
        if isinstance(v, dt.time):
            return Expr(f"{((v.hour * 60 + v.minute) * 60 + v.second) * 10**6 + v.microsecond}L", Type("TIME", 6))
        if isinstance(v, dt.timedelta):
            return Expr(f"{v // dt.timedelta(microseconds=1)}L", Type("INTERVAL", 9, 6, "DAY", "SECOND"))
        if isinstance(v, (bytes, bytearray)):
            return Expr(f"X'{bytes(v).hex()}'", Type("VARBINARY", max(1, len(v))))
        return self.x_string(Node("String", text=str(v)), scope)

    def x_temporal(self, n, scope) -> Expr:
        zoned = n.zone if n.zone is not None else bool(n.what != "DATE" and _has_zone(n.text))
        fraction = re.search(r"[.](\d+)", n.text)
        digits = min(6, len(fraction[1])) if fraction else 0
        t = DATE if n.what == "DATE" else Type(n.what + ("TZ" if zoned else ""), digits if n.what == "TIME" else 6)
        return Expr(self.literal(n.text, t), t)

    def x_interval(self, n, scope) -> Expr:
        q = n.qualifier
        t = Type("INTERVAL", q.a if q.a > 0 else 9, q.b if q.b >= 0 else 6, q.start, q.end)
        value = R.interval_value(n.text, t)
        return Expr(f"CAST({value} AS {t.spark})", t)

    def x_column(self, n, scope) -> Expr:
        *qualifier, name = n.parts
        here = scope
        while here is not None:
            if not qualifier and here.outputs:
                found = [f for f in here.outputs if f.name == name]
                if found:
                    return Expr(found[0].sql, found[0].type)
            found = [f for s in here.sources for f in s.fields if f.name == name and (tuple(qualifier) in s.qualifiers if qualifier else not f.hidden)]
            if len(found) > 1:
                raise self.error("42702", f"Column {'.'.join(n.parts)} is ambiguous", n)
            if found:
                here.used |= here is not scope
                return Expr(found[0].sql, found[0].type)
            here = here.parent
        raise self.error("42703", f"Column {'.'.join(n.parts)} does not exist", n)

    def x_and(self, n, scope, where) -> Expr:
        parts = [self.expr(p, scope, where) for p in n.parts]
        return Expr("(" + " AND ".join(self.boolean(p) for p in parts) + ")", BOOLEAN, None, any(p.agg for p in parts))

    def x_or(self, n, scope, where) -> Expr:
        parts = [self.expr(p, scope, "filter" if where == "conjunct" else where) for p in n.parts]
        return Expr("(" + " OR ".join(self.boolean(p) for p in parts) + ")", BOOLEAN, None, any(p.agg for p in parts))

    def x_not(self, n, scope, where) -> Expr:
        if n.arg.kind == "InQuery" and where == "conjunct":
            flipped = Node("InQuery", left=n.arg.left, query=n.arg.query, negated=not n.arg.negated, at=n.arg.at)
            return self.expr(flipped, scope, where)
        e = self.expr(n.arg, scope)
        return Expr(f"(NOT {self.boolean(e)})", BOOLEAN, None, e.agg)

    def x_compare(self, n, scope) -> Expr:
        a, b = self.expr(n.left, scope), self.expr(n.right, scope)
        x, y = self.compared(a, b)
        return Expr(f"({x} {n.op} {y})", BOOLEAN, None, a.agg or b.agg)

    def x_is(self, n, scope) -> Expr:
        e = self.expr(n.arg, scope)
        if n.what == "NULL":
            return Expr(f"({e.sql} IS {'NOT ' if n.negated else ''}NULL)", BOOLEAN, None, e.agg)
        return Expr(f"({self.boolean(e, n)} IS {'NOT ' if n.negated else ''}{n.what})", BOOLEAN, None, e.agg)

    def x_between(self, n, scope) -> Expr:
        es = [self.expr(p, scope) for p in (n.arg, n.low, n.high)]
        x, a, b = self.compared(*es)
        inside = f"{x} >= {a} AND {x} <= {b}"
        some_null = " OR ".join(f"{v} IS NULL" for v, e in zip((x, a, b), (n.arg, n.low, n.high), strict=True) if e.kind not in ("Number", "String", "Temporal"))
        agg = any(e.agg for e in es)
        if n.low.kind in ("Number", "Temporal", "String") and n.high.kind in ("Number", "Temporal", "String"):
            # with constant bounds plain BETWEEN has the same meaning, and reaches the scan
            return Expr(f"({x} {'NOT ' if n.negated else ''}BETWEEN {a} AND {b})", BOOLEAN, None, agg)
        test = f"NOT ({inside})" if n.negated else inside
        return Expr(f"(CASE WHEN {some_null} THEN NULL ELSE {test} END)", BOOLEAN, None, agg)

    def x_in(self, n, scope) -> Expr:
        es = [self.expr(p, scope) for p in (n.arg, *n.items)]
        x, *items = self.compared(*es)
        return Expr(f"({x} {'NOT ' if n.negated else ''}IN ({', '.join(items)}))", BOOLEAN, None, any(e.agg for e in es))

    def x_like(self, n, scope) -> Expr:
        x, p = self.chars(self.expr(n.arg, scope), n), self.chars(self.expr(n.pattern, scope), n)
        if n.escape is None:
            # no character escapes: Spark's own default, the backslash, is doubled
            pattern, escape = f"replace({p.sql}, '\\\\', '\\\\\\\\')", ""
            if n.pattern.kind == "String":
                pattern = R.quoted(n.pattern.text.replace("\\", "\\\\"))
        else:
            if n.escape.kind != "String" or len(n.escape.text) != 1:
                raise self.error("22019", "ESCAPE takes one character", n)
            e = n.escape.text
            if n.pattern.kind == "String":
                out, at = [], 0
                while at < len(s := n.pattern.text):
                    if s[at] == e:
                        if at + 1 == len(s):
                            raise self.error("22025", "A pattern cannot end with its escape character", n)
                        at += 1
                        out.append(("\\" if s[at] in "%_\\" else "") + s[at])
                    else:
                        out.append("\\\\" if s[at] == "\\" else s[at])
                    at += 1
                pattern, escape = R.quoted("".join(out)), ""
            else:
                pattern, escape = p.sql, f" ESCAPE {R.quoted(e)}"
        return Expr(f"({x.sql} {'NOT ' if n.negated else ''}LIKE {pattern}{escape})", BOOLEAN, None, x.agg or p.agg)

    def x_sign(self, n, scope) -> Expr:
        e = self.expr(n.arg, scope)
        if e.open:
            e = self.fit(e, DOUBLE)
        if not R.numeric(e.type) and e.type.kind != "INTERVAL":
            raise self.error("42804", f"A sign needs a number or an interval, not {e.type}", n)
        t = INTEGER if e.type.kind == "SMALLINT" and n.op == "-" else e.type
        return e if n.op == "+" else Expr(f"(- {e.sql if t == e.type else f'CAST({e.sql} AS INT)'})", t, None, e.agg)

    def x_binary(self, n, scope) -> Expr:
        a, b = self.expr(n.left, scope), self.expr(n.right, scope)
        agg = a.agg or b.agg
        if n.op == "||":
            return self.concat([a, b], n)
        if a.open and b.open:
            a, b = self.fit(a, DOUBLE), self.fit(b, DOUBLE)
        elif a.open or b.open:
            peer = b.type if a.open else a.type
            # beside a date or an interval an untyped literal is taken as one of the same kind
            a, b = (self.fit(a, peer), b) if a.open else (a, self.fit(b, peer))
        x, y = a.type, b.type
        if R.numeric(x) and R.numeric(y):
            return Expr(self.arithmetic(n.op, a, b), T.arithmetic(n.op, x, y), None, agg)
        out = self.datetime_arithmetic(n.op, a, b)
        if out is None:
            raise self.error("42804", f"Operator {n.op} is not defined for {x} and {y}", n)
        out.agg = agg
        return out

    def arithmetic(self, op: str, a: Expr, b: Expr) -> str:
        t = T.arithmetic(op, a.type, b.type)
        if t.kind in T.FLOATS:
            x, y = (e.sql if e.type == t else f"CAST({e.sql} AS {t.spark})" for e in (a, b))
            if op == "/":
                return R.finite(f"CAST(({x} / {y}) AS {t.spark})", t.spark)
            return R.finite(f"({x} {op} {y})", t.spark)
        if t.kind in T.INTS:
            x, y = (e.sql if e.type == t else f"CAST({e.sql} AS {t.spark})" for e in (a, b))
            return f"CAST(({x} DIV {y}) AS {t.spark})" if op == "/" else f"({x} {op} {y})"
        x, y = (e.sql if e.type.kind == "DECIMAL" else f"CAST({e.sql} AS {T.as_decimal(e.type).spark})" for e in (a, b))
        return f"CAST(({x} {op} {y}) AS {t.spark})"

    def datetime_arithmetic(self, op: str, a: Expr, b: Expr) -> Expr | None:
        x, y = a.type, b.type
        f, g = x.family, y.family
        if f == "NUMERIC" or f.startswith("INTERVAL") and g in ("DATETIME", "TIME"):
            if op in ("+", "*"):
                return self.datetime_arithmetic(op, b, a) if g != "NUMERIC" else None
            return None
        sign = "-" if op == "-" else ""
        if f == g and f.startswith("INTERVAL") and op in "+-":
            t = T.merge_intervals(x, y)
            return Expr(f"({a.sql} {op} {b.sql})", Type("INTERVAL", 9, t.b, t.start, t.end))
        if f.startswith("INTERVAL") and g == "NUMERIC" and op in "*/":
            num = b.sql if y.kind in T.FLOATS else f"CAST({b.sql} AS DECIMAL(38,10))" if y.kind != "DECIMAL" else b.sql
            value = f"floor(CAST({a.sql} AS DECIMAL(20,0)) {op} {num} + 0.5)"
            return Expr(R.fit_interval(f"CAST({value} AS {x.spark})", x), x)
        if f == "DATETIME" and op in "+-":
            if x.kind == "DATE" and y.kind in T.INTS:
                return Expr(f"date_{'add' if op == '+' else 'sub'}({a.sql}, CAST({b.sql} AS INT))", DATE)
            if g == "INTERVAL_YM":
                if x.kind == "TIMESTAMPTZ":
                    return Expr(f"named_struct('ts', timestampadd(MONTH, {sign}({b.sql}), {a.sql}.ts), 'off', {a.sql}.off)", x)
                return Expr(f"add_months({a.sql}, {sign}({b.sql}))" if x.kind == "DATE" else f"timestampadd(MONTH, {sign}({b.sql}), {a.sql})", x)
            if g == "INTERVAL_DT":
                if x.kind == "DATE" and y.start == y.end == "DAY":
                    return Expr(f"date_add({a.sql}, CAST({sign}({b.sql}) DIV {R.DAY} AS INT))", DATE)
                base = f"{a.sql}.ts" if x.kind == "TIMESTAMPTZ" else f"CAST({a.sql} AS TIMESTAMP_NTZ)" if x.kind == "DATE" else a.sql
                moved = f"timestampadd(MICROSECOND, {sign}({b.sql}), {base})"
                if x.kind == "TIMESTAMPTZ":
                    return Expr(f"named_struct('ts', {moved}, 'off', {a.sql}.off)", x)
                return Expr(moved, Type("TIMESTAMP", max(x.a, y.b if y.end == "SECOND" else 0) if x.kind == "TIMESTAMP" else (y.b if y.end == "SECOND" else 0)))
            if g == "DATETIME" and op == "-":
                if x.kind == y.kind == "DATE":
                    return Expr(f"datediff({a.sql}, {b.sql})", INTEGER)
                t, (p, q) = self.together(a, b)
                return Expr(f"timestampdiff(MICROSECOND, {self.key(q)}, {self.key(p)})", Type("INTERVAL", 9, 6, "DAY", "SECOND"))
        if f == "TIME" and op in "+-":
            if g == "INTERVAL_DT":
                t = Type(x.kind, max(x.a, y.b if y.end == "SECOND" else 0))
                if x.kind == "TIMETZ":
                    return Expr(f"named_struct('t', pmod({a.sql}.t {op} {b.sql}, {R.DAY}), 'off', {a.sql}.off)", t)
                return Expr(f"pmod({a.sql} {op} {b.sql}, {R.DAY})", t)
            if g == "TIME" and op == "-":
                t, (p, q) = self.together(a, b)
                return Expr(f"({self.key(p)} - {self.key(q)})", Type("INTERVAL", 9, 6, "HOUR", "SECOND"))
        return None

    def concat(self, es: list[Expr], n) -> Expr:
        agg = any(e.agg for e in es)
        if any(e.type.kind in T.BINS for e in es):
            es = [self.fit(e, Type("VARBINARY", T.MAX_VARCHAR)) if e.open else e for e in es]
            if not all(e.type.kind in T.BINS for e in es):
                raise self.error("42804", "Binary values and text cannot be joined", n)
            return Expr(f"concat({', '.join(e.sql for e in es)})", Type("VARBINARY", min(T.MAX_VARCHAR, sum(e.type.a for e in es))), None, agg)
        es = [self.chars(e, n) for e in es]
        return Expr(f"concat({', '.join(e.sql for e in es)})", varchar(sum(e.type.a for e in es)), None, agg)

    def x_case(self, n, scope) -> Expr:
        agg = False
        if n.subject is not None:
            subject = self.expr(n.subject, scope)
            tests = []
            for w in n.whens:
                e = self.expr(w, scope)
                agg |= e.agg
                x, y = self.compared(subject, e)
                tests.append(f"{x} = {y}")
            agg |= subject.agg
        else:
            es = [self.expr(w, scope) for w in n.whens]
            agg = any(e.agg for e in es)
            tests = [self.boolean(e, n) for e in es]
        values = [self.expr(v, scope) for v in n.values] + ([self.expr(n.otherwise, scope)] if n.otherwise else [])
        t, fitted = self.together(*values)
        out = " ".join(f"WHEN {w} THEN {v.sql}" for w, v in zip(tests, fitted, strict=False))
        end = f" ELSE {fitted[-1].sql}" if n.otherwise else ""
        return Expr(f"(CASE {out}{end} END)", t, None, agg or any(v.agg for v in values))

    def x_cast(self, n, scope) -> Expr:
        e = self.expr(n.arg, scope)
        if e.type.kind == TEXT and n.to.kind not in T.CHARS:
            return Expr(self.literal(e.raw, n.to) if n.to.kind in (*T.BINS, "INTERVAL") else R.cast(e.sql, varchar(max(1, len(e.raw))), n.to, self.zone, self.today), n.to)
        e = self.settle(e)
        if not T.can_cast(e.type, n.to):
            raise self.error("42846", f"{e.type} cannot be cast to {n.to}", n)
        return Expr(R.cast(e.sql, e.type, n.to, self.zone, self.today), n.to, None, e.agg)

    def x_default(self, n, scope) -> Expr:
        raise self.error("42601", "DEFAULT stands only for a whole value", n)

    # subqueries

    def subquery(self, query: Node, scope: Scope, columns: int | None = 1) -> Bound:
        out = self.query(query, scope)
        if columns and len(out.columns) != columns:
            raise self.error("21000", "A subquery here must have one column")
        return out

    def x_scalar(self, n, scope) -> Expr:
        before, scope.used = scope.used, False
        q = self.subquery(n.query, scope)
        correlated, scope.used = scope.used, before or scope.used
        # of a group, the subquery sees one row; its columns are the same in all of them
        return Expr(f"first(({q.sql}))" if correlated and scope.grouped else f"({q.sql})", q.columns[0][1])

    def x_exists(self, n, scope) -> Expr:
        return Expr(f"EXISTS ({self.subquery(n.query, scope, None).sql})", BOOLEAN)

    def matched(self, n, scope, op: str):
        """The query as a source q, the operand, and the comparison of both."""
        left = self.expr(n.left, scope)
        before, scope.used = scope.used, False
        q = self.subquery(n.query, scope)
        self.correlated, scope.used = scope.used, before or scope.used
        name = f"q{next(self.ids)}"
        x, y = self.compared(left, Expr(f"{name}.c0", q.columns[0][1]))
        rows = lambda cond: f"EXISTS (SELECT 1 FROM ({q.sql}) {name} WHERE {cond})"
        return left, q, x, y, f"({x} {op} {y})", rows, name

    def x_inquery(self, n, scope, where) -> Expr:
        left, q, x, y, same, rows, name = self.matched(n, scope, "=")
        if where in ("conjunct", "filter") and not n.negated:
            inner = q.sql if y == f"{name}.c0" else f"SELECT {y} FROM ({q.sql}) {name}"
            return Expr(f"({x} IN ({inner}))", BOOLEAN, None, left.agg)
        if where == "conjunct":
            # Spark plans NOT IN as a broadcast of the whole query, whatever its size; these parts become an ordinary anti join and two yes-or-no subqueries
            if self.correlated:
                return Expr(f"(NOT {rows(f'{same} IS NOT FALSE')})", BOOLEAN, None, left.agg)
            return Expr(f"(NOT {rows(same)} AND NOT {rows(f'{y} IS NULL')} AND ({x} IS NOT NULL OR NOT EXISTS ({q.sql})))", BOOLEAN, None, left.agg)
        test = f"CASE WHEN {rows(same)} THEN TRUE WHEN NOT EXISTS ({q.sql}) THEN FALSE WHEN {x} IS NULL OR {rows(f'{y} IS NULL')} THEN NULL ELSE FALSE END"
        return Expr(f"(NOT ({test}))" if n.negated else f"({test})", BOOLEAN, None, left.agg)

    def x_quantified(self, n, scope, where) -> Expr:
        left, q, x, y, test, rows, name = self.matched(n, scope, n.op)
        if not self.correlated:
            return Expr(self.quantified_by_ends(n, q, x, y, name, where), BOOLEAN, None, left.agg)
        if where in ("filter", "conjunct"):
            return Expr(f"NOT {rows(f'{test} IS NOT TRUE')}" if n.every else rows(test), BOOLEAN, None, left.agg)
        decided, value = (f"{test} IS FALSE", "FALSE") if n.every else (test, "TRUE")
        other = "TRUE" if n.every else "FALSE"
        return Expr(f"(CASE WHEN {rows(decided)} THEN {value} WHEN {rows(f'{test} IS NULL')} THEN NULL ELSE {other} END)", BOOLEAN, None, left.agg)

    def quantified_by_ends(self, n, q, x, y, name, where) -> str:
        """A comparison with all rows of a query that doesn't depend on the outer row is one with its least or greatest value: two aggregates, no join."""
        ask = lambda what: f"(SELECT {what} FROM ({q.sql}) {name})"
        low, high = ask(f"min({y})"), ask(f"max({y})")
        none, nulls = f"{ask('count(1)')} = 0", f"{ask(f'count(1) - count({y})')} > 0"
        if n.op == "=":
            some = f"EXISTS (SELECT 1 FROM ({q.sql}) {name} WHERE {x} = {y})"
            every = f"({x} = {low} AND {x} = {high})"
        elif n.op == "<>":
            some = f"({x} <> {low} OR {x} <> {high})"
            every = f"NOT EXISTS (SELECT 1 FROM ({q.sql}) {name} WHERE {x} = {y})"
        else:
            near, far = (low, high) if n.op[0] == ">" else (high, low)
            some, every = f"({x} {n.op} {near})", f"({x} {n.op} {far})"
        unsure = f"({x} IS NULL OR {nulls})"
        if n.every:
            if where in ("filter", "conjunct"):
                return f"({none} OR (NOT {unsure} AND {every}))"
            return f"(CASE WHEN {none} THEN TRUE WHEN NOT {every} THEN FALSE WHEN {unsure} THEN NULL ELSE TRUE END)"
        if where in ("filter", "conjunct"):
            return some
        return f"(CASE WHEN {some} THEN TRUE WHEN {none} THEN FALSE WHEN {unsure} THEN NULL ELSE FALSE END)"

    # functions

    def x_call(self, n, scope) -> Expr:
        if n.name in AGGREGATES:
            return self.aggregate(n, scope)
        if n.distinct:
            raise self.error("42601", f"DISTINCT is not for {n.name}", n)
        method = getattr(self, f"f_{n.name.lower()}", None)
        if method is None:
            raise self.error("42883", f"Function {n.name} does not exist", n)
        args = [self.expr(a, scope) for a in n.args]
        out = method(n, *args) if self.arity(n, method, len(args)) else None
        out.agg = out.agg or any(a.agg for a in args)
        return out

    def arity(self, n, method, given: int) -> bool:
        code = method.__func__.__code__
        most = code.co_argcount - 2
        least = most - len(method.__func__.__defaults__ or ())
        if not (code.co_flags & 4) and not least <= given <= most:
            raise self.error("42883", f"Function {n.name} does not take {given} arguments", n)
        return True

    def aggregate(self, n, scope) -> Expr:
        if n.star:
            return Expr("count(1)", BIGINT, None, True)
        if len(n.args) != 1:
            raise self.error("42883", f"{n.name} takes one argument", n)
        grouped, scope.grouped = scope.grouped, False
        e = self.expr(n.args[0], scope)
        scope.grouped = grouped
        if e.agg:
            raise self.error("42803", "An aggregate cannot be inside another", n)
        d = "DISTINCT " if n.distinct else ""
        if n.name == "COUNT":
            return Expr(f"count({d}{self.key(self.settle(e))})", BIGINT, None, True)
        if n.name in ("MIN", "MAX"):
            e = self.settle(e)
            x = e.sql if e.type.kind != "NULL" else "CAST(NULL AS string)"
            return Expr(f"{n.name.lower()}({x})", e.type if e.type.kind != "NULL" else varchar(1), None, True)
        if e.type.kind == "NULL":
            e = Expr("CAST(NULL AS BIGINT)", BIGINT)
        e = self.number(e, n)
        if e.type.kind in T.FLOATS:
            return Expr(R.finite(f"{n.name.lower()}({d}CAST({e.sql} AS DOUBLE))"), DOUBLE, None, True)
        if n.name == "SUM":
            t = e.type if e.type.kind == "DECIMAL" else BIGINT
            x = e.sql if t == e.type else f"CAST({e.sql} AS BIGINT)"
            return Expr(f"CAST(sum({d}{x}) AS {t.spark})", t, None, True)
        x = e.sql if e.type.kind == "DECIMAL" else f"CAST({e.sql} AS DECIMAL(19,0))"
        total = f"CAST(sum({d}{x}) AS DECIMAL(38,{min(e.type.b, 12) if e.type.kind == 'DECIMAL' else 0}))"
        return Expr(f"CAST({total} / nullif(count({d}{x}), 0) AS DECIMAL(38,6))", decimal(38, 6), None, True)

    def f_upper(self, n, x) -> Expr:
        x = self.chars(x, n)
        return Expr(f"{n.name.lower()}({x.sql})", varchar(x.type.a))

    f_lower = f_upper

    def f_length(self, n, x) -> Expr:
        return Expr(f"CAST({'octet_length' if n.name == 'OCTET_LENGTH' else 'length'}({self.chars(x, n).sql}) AS BIGINT)", BIGINT)

    f_char_length = f_character_length = f_octet_length = f_length

    def whole(self, e: Expr, n) -> str:
        e = self.fit(e, INTEGER) if e.open else e
        if e.type.kind not in T.EXACT:
            raise self.error("42804", f"A whole number is needed, not {e.type}", n)
        return R.cast(e.sql, e.type, INTEGER)

    def f_substring(self, n, x, start, length=None) -> Expr:
        x, s = self.chars(x, n), self.whole(start, n)
        first = f"CASE WHEN {s} > 0 THEN {s} WHEN {s} = 0 THEN 1 ELSE greatest(length({x.sql}) + {s} + 1, 1) END"
        if n.args[1].kind == "Number":
            v = int(float(n.args[1].text))
            first = str(max(1, v)) if v >= 0 else first
        if length is None:
            return Expr(f"substring({x.sql}, {first})", varchar(x.type.a))
        k = self.whole(length, n)
        if n.args[2].kind != "Number" or n.args[2].text.startswith("-"):
            k = R.checked(f"{k} < 0", k, "22023", "Length is negative", "int")
        return Expr(f"substring({x.sql}, {first}, {k})", varchar(x.type.a))

    f_substr = f_substring

    def f_position(self, n, needle, x) -> Expr:
        return Expr(f"CAST(position({self.chars(needle, n).sql}, {self.chars(x, n).sql}) AS BIGINT)", BIGINT)

    def f_concat(self, n, *args) -> Expr:
        if len(args) < 2:
            raise self.error("42883", "CONCAT takes two or more arguments", n)
        return self.concat(list(args), n)

    def f_replace(self, n, x, old, new=None) -> Expr:
        x, o = self.chars(x, n), self.chars(old, n)
        to = self.chars(new, n) if new else Expr("''", varchar(1))
        return Expr(f"replace({x.sql}, {o.sql}, {to.sql})", varchar(x.type.a * max(1, to.type.a)))

    def trimmed(self, n, side, x, chars) -> Expr:
        x = self.chars(x, n)
        if chars is None:
            return Expr(f"trim({side} ' ' FROM {x.sql})", varchar(x.type.a))
        c = self.chars(chars, n)
        if c.sql == "''":
            raise self.error("22023", "No characters to trim", n)
        return Expr(f"trim({side} {c.sql} FROM {x.sql})", varchar(x.type.a))

    def f_trim(self, n, x, chars=None) -> Expr:
        return self.trimmed(n, n.side, x, chars)

    def f_ltrim(self, n, x, chars=None) -> Expr:
        return self.trimmed(n, "LEADING", x, chars)

    def f_rtrim(self, n, x, chars=None) -> Expr:
        return self.trimmed(n, "TRAILING", x, chars)

    def f_abs(self, n, x) -> Expr:
        x = self.number(x, n)
        return Expr(f"abs({x.sql})", x.type)

    def f_mod(self, n, a, b) -> Expr:
        a, b = self.number(a, n), self.number(b, n)
        if a.type.kind in T.INTS and b.type.kind in T.INTS:
            t = T.common(a.type, b.type)
            return Expr(f"(CAST({a.sql} AS {t.spark}) % CAST({b.sql} AS {t.spark}))", t)
        if a.type.kind == b.type.kind == "DECIMAL":
            t = T.common(a.type, b.type)
            return Expr(f"CAST(({a.sql} % {b.sql}) AS {t.spark})", t)
        return Expr(f"(CAST({a.sql} AS DOUBLE) % CAST({b.sql} AS DOUBLE))", DOUBLE)

    def f_ceil(self, n, x) -> Expr:
        x, f = self.number(x, n), "floor" if n.name == "FLOOR" else "ceil"
        if x.type.kind in T.INTS:
            return x
        if x.type.kind == "DECIMAL":
            t = Type("DECIMAL", x.type.a, 0)
            return Expr(f"CAST({f}({x.sql}) AS {t.spark})", t)
        # beyond 2^53 a float has no fraction
        return Expr(f"(CASE WHEN abs({x.sql}) < 9007199254740992D THEN CAST({f}({x.sql}) AS {x.type.spark}) ELSE {x.sql} END)", x.type)

    f_ceiling = f_floor = f_ceil

    def f_power(self, n, a, b) -> Expr:
        a, b = self.number(a, n), self.number(b, n)
        return Expr(R.finite(f"power(CAST({a.sql} AS DOUBLE), CAST({b.sql} AS DOUBLE))"), DOUBLE)

    def f_sqrt(self, n, x) -> Expr:
        return Expr(R.finite(f"sqrt(CAST({self.number(x, n).sql} AS DOUBLE))"), DOUBLE)

    def f_round(self, n, x, digits=None) -> Expr:
        x = self.number(x, n)
        k = 0
        if digits is not None:
            arg = n.args[1]
            if arg.kind != "Number" or not arg.text.lstrip("-").isdigit():
                if x.type.kind in T.FLOATS:
                    return Expr(R.round_float(x.sql, self.whole(digits, n)), x.type)
                raise unsupported("ROUND of an exact number to a number of digits that is not a literal", n.at)
            k = int(arg.text)
        if abs(k) > 1000:
            raise self.error("22023", "Too many digits to round to", n)
        if x.type.kind in T.FLOATS:
            return Expr(R.round_float(f"CAST({x.sql} AS DOUBLE)", str(k)), DOUBLE) if k <= 300 else x
        if x.type.kind in T.INTS:
            return Expr(f"CAST(round(CAST({x.sql} AS DECIMAL(20,0)), {max(k, -38)}) AS {x.type.spark})" if k < 0 else x.sql, x.type)
        t = Type("DECIMAL", x.type.a, max(0, min(x.type.b, k)))
        return Expr(f"CAST(round({x.sql}, {max(-38, min(k, 38))}) AS {t.spark})", t)

    def f_coalesce(self, n, *args) -> Expr:
        if not args:
            raise self.error("42883", "COALESCE takes one or more arguments", n)
        t, fitted = self.together(*args)
        return Expr(f"coalesce({', '.join(e.sql for e in fitted)})", t)

    def f_nvl(self, n, a, b) -> Expr:
        return self.f_coalesce(n, a, b)

    def f_nullif(self, n, a, b) -> Expr:
        t, (x, _) = self.together(a, b)
        p, q = self.compared(a, b)
        return Expr(f"(CASE WHEN {p} = {q} THEN NULL ELSE {x.sql} END)", t)

    def f_current_date(self, n) -> Expr:
        return Expr(self.today, DATE)

    def clock_at(self, digits: int) -> str:
        """The statement's wall clock, cut to digits."""
        s = self.now.strftime("%Y-%m-%d %H:%M:%S.%f")
        return s[: 20 + digits].rstrip(".") if digits < 6 else s

    def digits(self, n, default) -> int:
        p = default if n.precision is None else n.precision
        if p > 6:
            raise self.error("22023", "Precision is at most 6", n)
        return p

    def f_localtimestamp(self, n) -> Expr:
        return Expr(f"TIMESTAMP_NTZ '{self.clock_at(p := self.digits(n, 6))}'", Type("TIMESTAMP", p))

    def f_current_timestamp(self, n) -> Expr:
        p = self.digits(n, 6)
        t = Type("TIMESTAMP", p)
        return Expr(R.cast(f"TIMESTAMP_NTZ '{self.clock_at(p)}'", t, Type("TIMESTAMPTZ", p), self.zone, self.today), Type("TIMESTAMPTZ", p))

    def f_localtime(self, n) -> Expr:
        p = self.digits(n, 0)
        unit = 10 ** (6 - p)
        micros = ((self.now.hour * 60 + self.now.minute) * 60 + self.now.second) * 10**6 + self.now.microsecond
        return Expr(f"{micros // unit * unit}L", Type("TIME", p))

    def f_current_time(self, n) -> Expr:
        t = self.f_localtime(n)
        to = Type("TIMETZ", t.type.a)
        return Expr(R.cast(t.sql, t.type, to, self.zone, self.today), to)

    def f_current_user(self, n) -> Expr:
        return Expr(R.quoted(self.user), varchar(128))

    def f_extract(self, n, x) -> Expr:
        x = self.settle(x)
        f, k = n.field, x.type.kind
        allowed = {"DATE": ("YEAR", "MONTH", "DAY"), "TIME": ("HOUR", "MINUTE", "SECOND"), "TIMETZ": ("HOUR", "MINUTE", "SECOND", "TIMEZONE_HOUR", "TIMEZONE_MINUTE"), "TIMESTAMP": ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"), "TIMESTAMPTZ": ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "TIMEZONE_HOUR", "TIMEZONE_MINUTE")}
        if f not in allowed.get(k, ()):
            raise self.error("42804", f"EXTRACT({f}) is not defined for {x.type}", n)
        if f.startswith("TIMEZONE"):
            return Expr(f"CAST({x.sql}.off {'DIV' if f.endswith('HOUR') else '%'} 60 AS BIGINT)", BIGINT)
        if k in ("TIME", "TIMETZ"):
            m = x.sql if k == "TIME" else f"pmod({x.sql}.t + {x.sql}.off * 60000000L, {R.DAY})"
            return Expr(f"CAST(({m} DIV {R.UNIT[f]}) % {24 if f == 'HOUR' else 60} AS BIGINT)", BIGINT)
        ts = f"timestampadd(MINUTE, {x.sql}.off, {x.sql}.ts)" if k == "TIMESTAMPTZ" else x.sql
        return Expr(f"CAST(floor(extract({f} FROM {ts})) AS BIGINT)", BIGINT)

    def format(self, n, i: int) -> str:
        if n.args[i].kind != "String":
            raise unsupported("A format that is not a literal", n.at)
        return n.args[i].text

    def f_to_char(self, n, x, fmt=None) -> Expr:
        x = self.settle(x)
        if R.numeric(x.type):
            if fmt is None:
                return Expr(R.text(x.sql, x.type), varchar(4000))
            return Expr(R.to_char_number(x.sql, self.format(n, 1)), varchar(4000))
        if x.type.family not in ("DATETIME", "TIME"):
            raise self.error("42804", f"TO_CHAR is not defined for {x.type}", n)
        if fmt is None:
            return Expr(R.text(x.sql, x.type), varchar(4000))
        k = x.type.kind
        if k in ("TIME", "TIMETZ"):
            m = x.sql if k == "TIME" else f"pmod({x.sql}.t + {x.sql}.off * 60000000L, {R.DAY})"
            ts = f"timestampadd(MICROSECOND, {m}, TIMESTAMP_NTZ '1970-01-01 00:00:00')"
        else:
            ts = f"timestampadd(MINUTE, {x.sql}.off, {x.sql}.ts)" if k == "TIMESTAMPTZ" else f"CAST({x.sql} AS TIMESTAMP_NTZ)"
        return Expr(R.to_char_datetime(ts, self.format(n, 1)), varchar(4000))

    def f_to_date(self, n, x, fmt=None) -> Expr:
        t = Type("TIMESTAMP", 0)
        x = self.chars(x, n)
        if fmt is None:
            return Expr(R.cast(x.sql, x.type, t, self.zone, self.today), t)
        return Expr(R.to_date(x.sql, self.format(n, 1)), t)

    # sources

    def table(self, n: Node, scope_parent) -> tuple[str, Source]:
        space = n.name.space or self.space
        r = self.catalog(n.name.space, n.name.name, n.at) if not self.viewing or n.name.space else self.catalog(space, n.name.name, n.at)
        key = r.key or (space, n.name.name)
        if r.view is not None:
            if key in self.viewing:
                raise self.error("42P17", f"View {n.name.name} refers to itself", n)
            saved = self.space, self.params
            self.viewing.append(key)
            self.space, self.params = key[0], []
            bound = self.query(parse(r.view).query, None)
            self.viewing.pop()
            self.space, self.params = saved
            columns = [(c, t) for c, (_, t) in zip(r.view_columns or [c for c, _ in bound.columns], bound.columns, strict=True)]
            sql, fields = bound.sql, [f"c{i}" for i in range(len(columns))]
        else:
            sql, columns, fields = r.sql, r.columns, [c for c, _ in r.columns]
        name = f"s{next(self.ids)}"
        quals = [(n.alias,)] if n.alias else [(n.name.name,), (key[0], n.name.name)]
        source = Source(quals, [Field(c, t, f"{name}.{tick(f)}") for (c, t), f in zip(columns, fields, strict=True)], key if r.view is None else None)
        return f"({sql}) {name}" if r.view is not None or not sql.startswith("`") else f"{sql} {name}", source

    def source(self, n: Node, parent: Scope | None) -> tuple[str, list[Source]]:
        if n.kind == "Table":
            sql, s = self.table(n, parent)
            return sql, [s]
        if n.kind == "Derived":
            q = self.query(n.query, None if parent is None else Scope([], parent))
            name = f"s{next(self.ids)}"
            if n.columns and len(n.columns) != len(q.columns):
                raise self.error("42804", "The column list does not have as many names as the query has columns", n)
            names = n.columns or [c for c, _ in q.columns]
            return f"({q.sql}) {name}", [Source([(n.alias,)] if n.alias else [], [Field(c, t, f"{name}.c{i}") for i, (c, (_, t)) in enumerate(zip(names, q.columns, strict=True))])]
        left, ls = self.source(n.left, parent)
        right, rs = self.source(n.right, parent)
        if n.how == "CROSS":
            return f"{left} CROSS JOIN {right}", ls + rs
        if n.using is None:
            cond = self.boolean(self.expr(n.on, Scope(ls + rs, parent), "conjunct" if n.how == "INNER" else "value"), n)
        else:
            conds = []
            for c in n.using:
                pair = []
                for side in (ls, rs):
                    found = [f for s in side for f in s.fields if f.name == c and not f.hidden]
                    if len(found) != 1:
                        raise self.error("42702" if found else "42703", f"Column {c} of USING is {'ambiguous' if found else 'not on both sides'}", n)
                    pair.append(found[0])
                a, b = pair
                x, y = self.compared(Expr(a.sql, a.type), Expr(b.sql, b.type))
                conds.append(f"{x} = {y}")
                merged = T.common(a.type, b.type)
                if n.how in ("RIGHT", "FULL"):
                    _, (p, q) = self.together(Expr(a.sql, a.type), Expr(b.sql, b.type))
                    a.sql, a.type = f"coalesce({p.sql}, {q.sql})", merged
                b.hidden = True
            cond = " AND ".join(conds)
        return f"{left} {n.how} JOIN {right} ON {cond}" if n.right.kind != "Join" else f"{left} {n.how} JOIN ({right}) ON {cond}", ls + rs

    # queries

    def query(self, n: Node, parent: Scope | None) -> Bound:
        if n.kind == "Select":
            return self.select(n, parent, None)
        if n.kind == "SetOp":
            return self.set_op(n, parent)
        if n.body.kind == "Select":
            return self.select(n.body, parent, n)
        inner = self.query(n.body, parent)
        name = f"s{next(self.ids)}"
        outputs = [Field(c, t, f"{name}.c{i}") for i, (c, t) in enumerate(inner.columns)]
        scope = Scope([], parent, outputs)
        cols = ", ".join(f"{name}.c{i}" for i in range(len(outputs)))
        return Bound(f"SELECT {cols} FROM ({inner.sql}) {name}{self.ordering(n, scope)}{self.limits(n)}", inner.columns)

    def ordering(self, n: Node, scope: Scope) -> str:
        keys = []
        for o in n.order:
            if o.expr.kind in ("Number", "String", "Param", "Constant"):
                continue  # a constant orders nothing
            e = self.settle(self.expr(o.expr, scope))
            nulls_first = o.desc if o.nulls_first is None else o.nulls_first
            x = f"rtrim({e.sql})" if e.type.kind == "CHAR" else self.key(e)
            keys.append(f"{x} {'DESC' if o.desc else 'ASC'} NULLS {'FIRST' if nulls_first else 'LAST'}")
        return f" ORDER BY {', '.join(keys)}" if keys else ""

    def limits(self, n: Node) -> str:
        out = ""
        for word, e in (("LIMIT", n.limit), ("OFFSET", n.offset)):
            if e is None:
                continue
            if e.kind == "Param" and self.describing:
                continue
            v = self.params[e.index - 1] if e.kind == "Param" else int(e.text) if e.kind == "Number" and e.text.lstrip("-").isdigit() else None
            if isinstance(v, bool) or not isinstance(v, int) or v < 0:
                raise self.error("22023", f"{word} takes a whole number from 0", e)
            out += f" {word} {v}"
        return out

    def set_op(self, n: Node, parent) -> Bound:
        a, b = self.query(n.left, parent), self.query(n.right, parent)
        if len(a.columns) != len(b.columns):
            raise self.error("42804", f"The sides of {n.op} have {len(a.columns)} and {len(b.columns)} columns")
        types = [T.common(x, y) for (_, x), (_, y) in zip(a.columns, b.columns, strict=True)]

        def side(q: Bound) -> str:
            s = f"s{next(self.ids)}"
            cols = [f"{R.cast(f'{s}.c{i}', t, to, self.zone, self.today) if t.kind not in T.CHARS or to.kind not in T.CHARS else f'{s}.c{i}'} AS c{i}" for i, ((_, t), to) in enumerate(zip(q.columns, types, strict=True))]
            return f"SELECT {', '.join(cols)} FROM ({q.sql}) {s}"

        sql = f"({side(a)}) {n.op}{' ALL' if n.all else ''} ({side(b)})"
        name = f"s{next(self.ids)}"
        cols = ", ".join(f"{name}.c{i}" for i in range(len(types)))
        return Bound(f"SELECT {cols} FROM ({sql}) {name}", [(c, t) for (c, _), t in zip(a.columns, types, strict=True)])

    def select(self, n: Node, parent: Scope | None, outer: Node | None) -> Bound:
        parts, sources = [], []
        for s in n.sources:
            sql, got = self.source(s, parent)
            parts.append(sql)
            sources += got
        if len({q for s in sources for q in s.qualifiers[:1]}) < sum(1 for s in sources if s.qualifiers):
            raise self.error("42712", "Two sources have the same name; give one an alias")
        scope = Scope(sources, parent)
        items: list[tuple[str, Expr]] = []
        scope.grouped = n.groups is not None or _aggregated(n.items) or n.having is not None and _aggregated(n.having)
        for it in n.items:
            if it.kind == "Star":
                q = tuple(it.qualifier)
                found = [f for s in sources if not q or q in s.qualifiers for f in s.fields if q or not f.hidden]
                if q and not any(q in s.qualifiers for s in sources):
                    raise self.error("42703", f"{'.'.join(q)}.* names no source", it)
                items += [(f.name, Expr(f.sql, f.type)) for f in found]
                continue
            e = self.settle(self.expr(it.expr, scope))
            name = it.alias or (it.expr.parts[-1] if it.expr.kind == "Column" else f"COL{len(items) + 1}")
            if e.type.kind == "NULL":
                e = Expr("CAST(NULL AS string)", varchar(1), None, e.agg)
            items.append((name, e))
        if not items:
            raise self.error("42601", "No columns to select")
        grouped, scope.grouped = scope.grouped, False
        where = self.boolean(self.condition(n.where, scope, "WHERE")) if n.where else None
        groups = []
        for g in n.groups or []:
            e = self.settle(self.expr(g, scope))
            if e.agg:
                raise self.error("42803", "An aggregate cannot be grouped by", g)
            groups.append(e.sql)
        scope.grouped = grouped
        having = self.boolean(self.expr(n.having, scope, "conjunct")) if n.having else None
        if grouped and n.groups is None:
            self.check_global(n, sources)
        sql = f"SELECT {'DISTINCT ' if n.distinct else ''}{', '.join(f'{e.sql} AS c{i}' for i, (_, e) in enumerate(items))}"
        if parts:
            sql += f" FROM {' CROSS JOIN '.join(parts)}"
        if where:
            sql += f" WHERE {where}"
        if groups:
            sql += f" GROUP BY {', '.join(groups)}"
        if having:
            # without groups or aggregates HAVING is a condition on the rows there are
            sql += f" HAVING {having}" if grouped else f"{' AND' if where else ' WHERE'} {having}"
        columns = [(c, e.type) for c, e in items]
        if outer is not None:
            if outer.for_update and (n.distinct or grouped or any(s.table is None for s in sources)):
                raise self.error("0A000", "FOR UPDATE needs rows of base tables")
            if outer.order:
                outputs = [Field(c, e.type, f"c{i}") for i, (c, e) in enumerate(items)]
                sql += self.ordering(outer, Scope(sources, parent, outputs))
            sql += self.limits(outer)
        return Bound(sql, columns)

    def condition(self, n: Node, scope: Scope, clause: str) -> Expr:
        e = self.expr(n, scope, "conjunct")
        if e.agg:
            raise self.error("42803", f"An aggregate cannot be in {clause}", n)
        return e

    def check_global(self, n: Node, sources: list[Source]) -> None:
        """Without GROUP BY, a column beside an aggregate has no one value."""

        def bare(x) -> bool:
            if isinstance(x, list):
                return any(map(bare, x))
            if not isinstance(x, Node) or x.kind in ("Scalar", "Exists", "InQuery", "Quantified") or x.kind == "Call" and x.name in AGGREGATES:
                return False
            if x.kind == "Star":
                return True
            if x.kind == "Column":
                return any(f.name == x.parts[-1] for s in sources for f in s.fields)
            return any(bare(v) for v in x.__dict__.values() if isinstance(v, (Node, list)))

        if bare(n.items) or n.having is not None and bare(n.having):
            raise self.error("42803", "A column must be grouped by or inside an aggregate", n)


def _aggregated(n) -> bool:
    """Whether a tree has an aggregate of its own, not of a subquery."""
    if isinstance(n, list):
        return any(map(_aggregated, n))
    if not isinstance(n, Node) or n.kind in ("Scalar", "Exists"):
        return False
    return n.kind == "Call" and n.name in AGGREGATES or any(_aggregated(v) for k, v in n.__dict__.items() if k != "query")


def _has_zone(text: str) -> bool:
    return bool(re.search(r":\d\d([.]\d*)?\s*(Z|[+-]\d\d?:?\d\d)\s*$", text))
