"""Lexer, parser and types, without Spark."""

from __future__ import annotations

import random

import pytest

from larkspur.cli import split
from larkspur.dialect import types as T
from larkspur.dialect.lexer import tokens
from larkspur.dialect.parser import parse
from larkspur.errors import SqlError


def state(text: str) -> str:
    with pytest.raises(SqlError) as e:
        parse(text)
    return e.value.sqlstate


@pytest.mark.parametrize(
    "text",
    [
        "WITH x AS (SELECT 1) SELECT 1", "MERGE INTO t", "EXPLAIN SELECT 1", "VALUES (1)", "SELECT 1 INTO t", "SELECT a FROM t GROUP BY ROLLUP (a)", "SELECT SUM(a) OVER () FROM t", "SELECT COUNT(*) FILTER (WHERE a) FROM t",
        "SELECT * FROM a NATURAL JOIN b", "SELECT * FROM a, LATERAL (SELECT 1) b", "SELECT a IS DISTINCT FROM b FROM t", "SELECT 1 BETWEEN SYMMETRIC 1 AND 2", "SELECT 1 LIMIT 1, 2", "SELECT 1 FETCH FIRST 5 PERCENT ROWS ONLY",
        "SELECT 1 FETCH FIRST 1 ROW WITH TIES", "SELECT 1 INTERSECT ALL SELECT 1", "SELECT 1 EXCEPT ALL SELECT 1", "SELECT (1, 2)", "SELECT 1 FOR SHARE", "CREATE TABLE t (a INT UNIQUE)", "CREATE TABLE t (a INT CHECK (a > 1))",
        "CREATE TABLE t AS SELECT 1", "CREATE UNIQUE INDEX i ON t (a)", "CREATE INDEX i ON t (LOWER(a))", "ALTER TABLE t MODIFY a INT", "ALTER TABLE t ALTER a TYPE INT", "INSERT INTO t VALUES (1) RETURNING a", "UPDATE t SET (a, b) = (1, 2)",
        "DELETE FROM t USING u", "GRANT SELECT ON t TO u WITH GRANT OPTION", "GRANT SELECT (a) ON t TO u", "SET TRANSACTION ISOLATION LEVEL SERIALIZABLE", "COMMIT AND CHAIN", "CREATE TABLE t (a CLOB)", "CREATE SEQUENCE s",
    ],
)
def test_rejected(text):
    assert state(text) == "0A000"


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT 1 2", "SELECT 1; SELECT 2", "SELECT 1 %", "SELECT 'a", "SELECT X'0'", "SELECT 1a", "/* x", "SELECT * FROM t JOIN u", "SELECT * FROM t CROSS JOIN u ON 1 = 1", "SELECT FROM t", "INSERT t", "SELECT CASE END", 'SELECT ""'])
def test_syntax_errors(text):
    assert state(text) == "42601"


def test_limits():
    assert state("SELECT " + "(" * 250 + "1" + ")" * 250) == "54001"
    assert state("SELECT " + " + ".join(["1"] * 1100)) == "54001"
    assert state("SELECT " + "a" * 129) == "42622"
    parse("SELECT " + " AND ".join(["TRUE"] * 3000))
    parse("SELECT 1 WHERE 1 IN (" + ", ".join(["1"] * 5000) + ")")


def test_positions():
    with pytest.raises(SqlError) as e:
        parse("SELECT 1,\r\n  FROM t")
    assert e.value.position == (13, 2, 3) and e.value.message.startswith('Unexpected "FROM"; expected an expression')


def test_precedence():
    e = parse("SELECT a OR b AND NOT c = 1 + 2 * -d || 'x'").query.body.items[0].expr
    assert repr(e) == "Or(parts=[Column(parts=['A']), And(parts=[Column(parts=['B']), Not(arg=Compare(op='=', left=Column(parts=['C']), right=Binary(op='||', left=Binary(op='+', left=Number(text='1'), right=Binary(op='*', left=Number(text='2'), right=Sign(op='-', arg=Column(parts=['D'])))), right=String(text='x'))))])])"
    q = parse("SELECT 1 UNION SELECT 2 INTERSECT SELECT 3").query.body
    assert q.op == "UNION" and q.right.op == "INTERSECT"


def test_names_and_literals():
    items = parse("SELECT \"a\"\"b\", 한글, date, DATE '2024-01-01', INTERVAL -'5' DAY, N'it''s', -2147483648, x.y.z, COUNT FROM t").query.body.items
    assert [i.expr.kind for i in items] == ["Column", "Column", "Column", "Temporal", "Interval", "String", "Number", "Column", "Column"]
    assert items[0].expr.parts == ['a"b'] and items[5].expr.text == "it's" and items[6].expr.text == "-2147483648"


def test_parenthesis_kinds():
    assert parse("((SELECT 1))").query.body.kind == "Select"
    assert parse("SELECT * FROM ((SELECT 1) a CROSS JOIN b)").query.body.sources[0].kind == "Join"
    assert parse("SELECT ((SELECT 1) + 1)").query.body.items[0].expr.kind == "Binary"
    assert parse("SELECT * FROM ((SELECT 1) UNION (SELECT 2)) x").query.body.sources[0].kind == "Derived"


def test_split_script():
    assert split("SELECT ';'; -- a;b\nSELECT \";\" /* ; */;;") == ["SELECT ';'", '-- a;b\nSELECT ";" /* ; */']


def test_mutations_raise_only_our_error():
    rng = random.Random(5)
    seeds = ["SELECT a, COUNT(*) FROM t JOIN u USING (x) WHERE a BETWEEN 1 AND 2 GROUP BY a ORDER BY 1 DESC LIMIT 3", "CREATE TABLE t (a INT PRIMARY KEY, b DECIMAL(5,2) DEFAULT 1.5 REFERENCES u (c) ON DELETE CASCADE)", "UPDATE t SET a = CASE WHEN b THEN 1 END WHERE EXISTS (SELECT 1)"]
    words = [t.text for s in seeds for t in tokens(s)] + ["(", ")", "'", '"', "?", "--", "/*", "\x00", "é", "1e9"]
    for _ in range(1500):
        parts = rng.choice(seeds).split(" ")
        for _ in range(rng.randrange(1, 4)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        try:
            parse(" ".join(parts))
        except SqlError:
            pass


def test_types():
    d = lambda p, s: T.Type("DECIMAL", p, s)
    assert T.resolve("DECIMAL", []) == d(10, 3) and T.resolve("NUMERIC", [5]) == d(5, 0)
    assert T.resolve("FLOAT", [24]) == T.REAL and T.resolve("FLOAT", []) == T.DOUBLE
    assert T.arithmetic("+", d(10, 2), T.INTEGER) == d(13, 2) and T.arithmetic("*", d(10, 2), d(5, 3)) == d(16, 5) and T.arithmetic("/", d(10, 2), T.INTEGER) == d(21, 13)
    assert T.arithmetic("+", T.SMALLINT, T.SMALLINT) == T.INTEGER and T.arithmetic("/", T.REAL, T.REAL) == T.REAL and T.arithmetic("*", T.REAL, T.INTEGER) == T.DOUBLE
    assert T.common(d(10, 2), T.BIGINT) == d(21, 2) and T.common(T.DATE, T.Type("TIMESTAMP", 3)) == T.Type("TIMESTAMP", 3)
    assert T.decimal(45, 10) == d(38, 6) and T.decimal(45, 3) == d(38, 3)
    for x, y in ((T.INTEGER, T.varchar(3)), (T.BOOLEAN, T.INTEGER), (T.DATE, T.Type("TIME", 0))):
        with pytest.raises(SqlError) as e:
            T.common(x, y)
        assert e.value.sqlstate == "42804"
    assert T.can_cast(T.INTEGER, T.varchar(5)) and not T.can_cast(T.INTEGER, T.BOOLEAN) and not T.can_cast(T.Type("BINARY", 3), T.varchar(5))
    for words, args in (("CHAR", [2001]), ("DECIMAL", [39]), ("DECIMAL", [5, 6]), ("TIMESTAMP", [7]), ("VARCHAR", [0])):
        with pytest.raises(SqlError) as e:
            T.resolve(words, args)
        assert e.value.sqlstate == "22023"
