"""Statements end to end on small tables."""

from __future__ import annotations

import datetime as dt
import multiprocessing
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal as D

import pytest

from larkspur import cli, dbapi
from larkspur.errors import SqlError
from larkspur.session import Database


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


@pytest.fixture
def s(db):
    session = db.connect()
    for text in ("CREATE TABLESPACE APP", "USE APP"):
        session.execute(text)
    return session


def load(s, *statements):
    for text in statements:
        s.execute(text)


def rows(s, text, params=()):
    return s.execute(text, params).rows()


def one(s, text, params=()):
    return rows(s, text, params)[0][0]


def fails(s, text, params=()) -> str:
    with pytest.raises(SqlError) as e:
        s.execute(text, params).rows()
    return e.value.sqlstate


BOAT = (
    "CREATE TABLE BOAT (NR INTEGER PRIMARY KEY, LABEL VARCHAR(20), TONS DECIMAL(10,2), BUILT DATE, CREW INTEGER)",
    "INSERT INTO BOAT VALUES (10, 'Tern', 12.25, '1998-04-02', 3), (20, 'Gull', 80, '2003-11-17', 9), (30, NULL, 12.25, '2011-07-30', NULL), (40, 'Skua', 45.20, '2003-11-17', 3), (50, 'Coot', 80, '2020-02-29', 7)",
)


def test_queries(s):
    load(s, *BOAT)
    assert [r[0] for r in rows(s, "SELECT NR FROM BOAT ORDER BY LABEL, NR")] == [50, 20, 40, 10, 30]
    assert [r[0] for r in rows(s, "SELECT NR FROM BOAT ORDER BY LABEL DESC, NR")] == [30, 10, 40, 20, 50]
    assert [r[0] for r in rows(s, "SELECT NR FROM BOAT ORDER BY LABEL NULLS FIRST, NR")] == [30, 50, 20, 40, 10]
    assert rows(s, "SELECT DISTINCT TONS FROM BOAT WHERE TONS > 50") == [(D("80.00"),)]
    assert rows(s, "SELECT SUM(TONS), AVG(TONS), MIN(LABEL), COUNT(LABEL), COUNT(*), COUNT(DISTINCT CREW) FROM BOAT") == [(D("229.70"), D("45.940000"), "Coot", 4, 5, 3)]
    assert rows(s, "SELECT TONS, COUNT(*) AS N FROM BOAT GROUP BY TONS HAVING COUNT(*) > 1 ORDER BY TONS") == [(D("12.25"), 2), (D("80.00"), 2)]
    assert rows(s, "SELECT NR FROM BOAT B WHERE TONS >= ALL (SELECT TONS FROM BOAT) ORDER BY NR") == [(20,), (50,)]
    assert rows(s, "SELECT NR FROM BOAT B WHERE TONS = (SELECT MAX(TONS) FROM BOAT X WHERE X.BUILT < B.BUILT) ORDER BY NR") == [(50,)]
    assert rows(s, "SELECT NR FROM BOAT WHERE BUILT BETWEEN '2003-01-01' AND '2011-07-30' ORDER BY NR") == [(20,), (30,), (40,)]
    assert one(s, "SELECT 'Wren' NOT IN (SELECT LABEL FROM BOAT)") is None
    assert rows(s, "SELECT NR FROM BOAT WHERE NOT (LABEL IN (SELECT 'Tern' FROM DUAL)) OR NR = 10 ORDER BY NR") == [(10,), (20,), (40,), (50,)]
    assert [c for c, _ in s.execute("SELECT NR, NR + 1, LABEL X FROM BOAT").columns] == ["NR", "COL2", "X"]
    assert rows(s, "SELECT NR FROM BOAT ORDER BY NR OFFSET 1 ROW FETCH NEXT ROW ONLY") == [(20,)]
    assert rows(s, "SELECT NR FROM BOAT WHERE LABEL = ? AND BUILT >= ?", ("Skua", "2003-01-01")) == [(40,)]
    assert fails(s, "SELECT NR FROM BOAT WHERE NR = ?") == "07001"
    assert fails(s, "SELECT LABEL, COUNT(*) FROM BOAT") == "42803"
    assert fails(s, "SELECT NR FROM BOAT WHERE COUNT(*) > 1") == "42803"
    assert fails(s, "SELECT NOPE FROM BOAT") == "42703" and fails(s, "SELECT 1 FROM NOPE") == "42P01"
    assert fails(s, "SELECT B.NR FROM BOAT B WHERE BOAT.NR = 1") == "42703"
    assert fails(s, "SELECT NR FROM BOAT A, BOAT B") == "42702" and fails(s, "SELECT 1 FROM BOAT, BOAT") == "42712"
    assert fails(s, "SELECT NR FROM BOAT UNION SELECT LABEL FROM BOAT") == "42804"
    assert fails(s, "SELECT NR FROM BOAT LIMIT 1 + 1") == "22023"
    assert fails(s, "SELECT (SELECT NR FROM BOAT)") == "21000" and fails(s, "SELECT (SELECT 1, 2)") == "21000"


def test_joins(s):
    load(s, "CREATE TABLE L (ID INTEGER, V VARCHAR(5))", "CREATE TABLE R (ID INTEGER, W VARCHAR(5))", "INSERT INTO L VALUES (1, 'a'), (2, 'b'), (NULL, 'n')", "INSERT INTO R VALUES (2, 'x'), (3, 'y'), (NULL, 'm')")
    assert rows(s, "SELECT * FROM L JOIN R USING (ID)") == [(2, "b", "x")]
    assert sorted(map(str, rows(s, "SELECT ID, L.ID, R.ID, V, W FROM L FULL JOIN R USING (ID)"))) == sorted(map(str, [(1, 1, None, "a", None), (2, 2, 2, "b", "x"), (3, 3, 3, None, "y"), (None, None, None, "n", None), (None, None, None, None, "m")]))
    assert len(rows(s, "SELECT 1 FROM L FULL JOIN R ON L.ID < R.ID")) == 5
    assert rows(s, "SELECT V, W FROM L LEFT JOIN R ON L.ID = R.ID AND W = 'x' ORDER BY V") == [("a", None), ("b", "x"), ("n", None)]
    assert len(rows(s, "SELECT * FROM L, R")) == 9 and len(rows(s, "SELECT * FROM L CROSS JOIN R")) == 9


@pytest.mark.parametrize(
    "text, value",
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("CAST(2.5 AS INTEGER)", 3), ("CAST(-2.5 AS INTEGER)", -3), ("ROUND(2.5)", D(3)), ("ROUND(-2.5E0)", -2.0), ("ROUND(125, -1)", 130), ("1 BETWEEN 2 AND NULL", None), ("1 NOT IN (2, NULL)", None),
        ("'a%b' LIKE 'a!%b' ESCAPE '!'", True), ("'a\\b' LIKE 'a\\b'", True), ("'A' LIKE 'a'", False), ("SUBSTRING('hello', -10, 3)", "hel"), ("SUBSTRING('hello' FROM 2 FOR 2)", "el"), ("SUBSTR('hello', -3)", "llo"),
        ("POSITION('l' IN 'hello')", 3), ("POSITION('' IN 'x')", 1), ("TRIM(BOTH 'x' FROM 'xax')", "a"), ("LTRIM('xya', 'yx')", "a"), ("REPLACE('aXbX', 'X')", "ab"), ("CONCAT('a', NULL)", None), ("LENGTH('한글😀')", 3), ("OCTET_LENGTH('é')", 2),
        ("MOD(-7, 3)", -1), ("CEIL(1.2)", D(2)), ("FLOOR(-1.5E0)", -2.0), ("NVL(NULL, 3)", 3), ("NULLIF(1, 1)", None), ("CAST(TRUE AS VARCHAR(5))", "TRUE"), ("CAST(1E6 AS VARCHAR(9))", "1000000"), ("CAST(1.5E300 AS VARCHAR(30))", "1.5e+300"),
        ("CAST(0.5E0 AS VARCHAR(9))", "0.5"), ("CAST(X'0aff' AS VARBINARY(4))", b"\x0a\xff"), ("CAST('abc' AS CHAR(5)) || '|'", "abc  |"), ("CAST('ab   ' AS VARCHAR(3))", "ab "), ("CAST('a' AS CHAR(3)) = CAST('a' AS CHAR(5))", True),
        ("DATE '2024-01-31' + INTERVAL '1' MONTH", dt.date(2024, 2, 29)), ("DATE '2024-03-01' - DATE '2024-02-01'", 29), ("DATE '2024-01-01' + INTERVAL '25' HOUR", dt.datetime(2024, 1, 2, 1)), ("TIME '23:30:00' + INTERVAL '1' HOUR", "00:30:00"),
        ("INTERVAL '1' DAY / 2", "0"), ("INTERVAL '1-6' YEAR TO MONTH * 2", "3-00"), ("CAST(TIMESTAMP '2024-01-02 00:00:00' - DATE '2024-01-01' AS VARCHAR(30))", "1 00:00:00.000000"), ("EXTRACT(SECOND FROM TIMESTAMP '2024-01-01 00:00:05.9')", 5),
        ("EXTRACT(TIMEZONE_MINUTE FROM TIMESTAMP '2024-01-01 00:00:00+05:30')", 30), ("TIMESTAMP '2024-01-01 00:00:00+09:00' = TIMESTAMP '2023-12-31 15:00:00+00:00'", True), ("CAST('12:34:56.789' AS TIME(1))", "12:34:56.8"),
        ("TO_CHAR(DATE '2024-03-05', '\"Y:\"YYYY')", "Y:2024"), ("TO_CHAR(TIMESTAMP '2024-03-05 14:07:09', 'HH12:MI:SS PM')", "02:07:09 PM"), ("TO_CHAR(-45.6, 'FM999.99')", "-45.60"), ("TO_CHAR(1234567, 'FM9,999,999')", "1,234,567"),
        ("TO_CHAR(5, '000')", " 005"), ("TO_CHAR(12345, '999')", "###"), ("TO_CHAR(-5, '999')", "-  5"), ("TO_DATE('5.3.24', 'DD.MM.YY')", dt.datetime(2024, 3, 5)), ("CAST(' 12 ' AS INTEGER)", 12), ("CAST('unknown' AS BOOLEAN)", None),
        ("CASE 1 WHEN 2 THEN 'a' END", None), ("COALESCE(NULL, 1, 2.5)", D("1.0")), ("1 = ANY (SELECT 2 FROM DUAL WHERE 1 = 0)", False), ("1 = ALL (SELECT 2 FROM DUAL WHERE 1 = 0)", True), ("CURRENT_USER", "SYSTEM"),
        ("9223372036854775807", 9223372036854775807), ("1.0 / 3", D("0.333333333333")), ("CAST(5 AS INTERVAL DAY)", "5"), ("CAST(INTERVAL '90' MINUTE AS INTEGER)", 90), ("POWER(2, 10)", 1024.0), ("(1 = 2) IS NOT TRUE", True),
    ],
)
def test_scalars(spark, text, value):
    got = Database(spark).connect().execute(f"SELECT {text}").rows()[0][0]
    assert got == value and type(got) is type(value)


@pytest.mark.parametrize(
    "text, state",
    [
        ("1 / 0", "22012"), ("1.5 / 0", "22012"), ("MOD(1, 0)", "22012"), ("2147483647 + 1", "22003"), ("CAST(99999 AS SMALLINT)", "22003"), ("POWER(10, 400)", "22003"), ("SQRT(-1)", "22003"), ("CAST('1x' AS INTEGER)", "22018"), ("CAST('yes' AS BOOLEAN)", "22018"),
        ("CAST('abc' AS VARCHAR(2))", "22001"), ("CAST('2024-13-01' AS DATE)", "22008"), ("CAST('hello' AS DATE)", "22007"), ("TO_DATE('x', 'YYYY')", "22007"), ("1 = DATE '2024-01-01'", "42804"), ("'a' + TRUE", "42804"), ("UPPER(1)", "42804"), ("CAST(1 AS BOOLEAN)", "42846"),
        ("CAST(X'01' AS VARCHAR(3))", "42846"), ("NOPE(1)", "42883"), ("LOWER()", "42883"), ("'a' LIKE 'b' ESCAPE 'xy'", "22019"), ("SUBSTRING('a', 1, -1)", "22023"), ("INTERVAL '13' MONTH || 'x'", "42804"), ("INTERVAL '123' DAY(2)", "22015"), ("COALESCE(1, 'x', DATE '2024-01-01')", "42804"), ("NOT 1", "42804"),
    ],
)
def test_errors(spark, text, state):
    assert fails(Database(spark).connect(), f"SELECT {text}") == state


def test_all_types_round_trip(s):
    load(s, "CREATE TABLE T (A CHAR(5), B VARCHAR(10), C BINARY(3), D VARBINARY(5), E SMALLINT, F BIGINT, G NUMERIC(10,3), H REAL, I DOUBLE PRECISION, J BOOLEAN, K DATE, L TIME(3), M TIME WITH TIME ZONE, N TIMESTAMP(0), O TIMESTAMP(3) WITH TIME ZONE, P INTERVAL YEAR TO MONTH, Q INTERVAL DAY TO SECOND(2))")
    s.execute("INSERT INTO T VALUES ('ab', 'x', X'01', 'FF', 1, 2, 1.2345, 1.5, 2.5, TRUE, '2024-02-29', '10:11:12.3456', '10:11:12+09:00', '2024-02-29 01:02:03.5', '2024-02-29 01:02:03.1236+09:00', '1-06', '3 04:05:06.789')")
    load(s, "INSERT INTO T DEFAULT VALUES")
    got = sorted(rows(s, "SELECT * FROM T"), key=str)
    assert got == [("ab   ", "x", b"\x01\x00\x00", b"\xff", 1, 2, D("1.235"), 1.5, 2.5, True, dt.date(2024, 2, 29), "10:11:12.346", "10:11:12+09:00", dt.datetime(2024, 2, 29, 1, 2, 4), "2024-02-29 01:02:03.124+09:00", "1-06", "3 04:05:06.78"), (None,) * 17]
    assert fails(s, "INSERT INTO T (A) VALUES ('abcdef')") == "22001" and fails(s, "INSERT INTO T (E) VALUES ('x')") == "22018" and fails(s, "INSERT INTO T (K) VALUES (1)") == "42804"
    assert len(rows(s, "SELECT 1 FROM T")) == 2


def test_dml_and_keys(s):
    load(s, "CREATE TABLE P (ID INTEGER PRIMARY KEY, N VARCHAR(5) DEFAULT 'd' NOT NULL)", "INSERT INTO P (ID) VALUES (1), (2)", "INSERT INTO P VALUES (3, 'x')")
    assert fails(s, "INSERT INTO P (ID) VALUES (3)") == "23505" and fails(s, "INSERT INTO P VALUES (9, NULL)") == "23502" and fails(s, "INSERT INTO P (ID) VALUES (8), (8)") == "23505"
    assert s.execute("UPDATE P SET ID = 4 - ID").count == 3  # keys change places within the statement
    assert rows(s, "SELECT * FROM P ORDER BY ID") == [(1, "x"), (2, "d"), (3, "d")]
    assert fails(s, "UPDATE P SET ID = 1") == "23505"
    assert s.execute("UPDATE P SET N = (SELECT MAX(N) FROM P) WHERE ID > (SELECT MIN(ID) FROM P)").count == 2
    assert s.execute("UPDATE P SET N = DEFAULT WHERE ID = 1").message == "UPDATE 1"
    assert s.execute("INSERT INTO P SELECT ID + 10, N FROM P").count == 3
    assert s.execute("DELETE FROM P X WHERE X.ID > 10 AND EXISTS (SELECT 1 FROM P Y WHERE Y.ID = X.ID - 10)").count == 3
    assert rows(s, "SELECT * FROM P ORDER BY ID") == [(1, "d"), (2, "x"), (3, "x")]
    assert fails(s, "INSERT INTO P VALUES (1)") == "42804" and fails(s, "UPDATE P SET N = 'a', N = 'b'") == "42701" and fails(s, "INSERT INTO P (ID, X) VALUES (1, 1)") == "42703"


def test_repeated_rows_change_one_by_one(s):
    load(s, "CREATE TABLE T (A INTEGER, B INTEGER)", "INSERT INTO T VALUES (1, 1), (1, 1), (2, 2), (NULL, NULL)")
    assert s.execute("UPDATE T SET B = 5 WHERE A = 1").count == 2
    assert s.execute("DELETE FROM T WHERE A = 2").count == 1
    assert sorted(rows(s, "SELECT * FROM T"), key=str) == [(1, 5), (1, 5), (None, None)]


@pytest.mark.parametrize("action, after_delete, after_update", [("CASCADE", [(2, 2)], [(1, 11), (2, 12), (3, None)]), ("SET NULL", [(1, None), (2, 2), (3, None)], [(1, None), (2, None), (3, None)]), ("NO ACTION", "23503", "23503"), ("RESTRICT", "23503", "23503")])
def test_referential_actions(s, action, after_delete, after_update):
    load(s, "CREATE TABLE P (ID INTEGER PRIMARY KEY)", f"CREATE TABLE C (ID INTEGER PRIMARY KEY, PID INTEGER REFERENCES P ON DELETE {action} ON UPDATE {action})", "INSERT INTO P VALUES (1), (2)", "INSERT INTO C VALUES (1, 1), (2, 2), (3, NULL)")
    assert fails(s, "INSERT INTO C VALUES (4, 9)") == "23503" and fails(s, "UPDATE C SET PID = 9") == "23503"
    for text, after in (("DELETE FROM P WHERE ID = 1", after_delete), ("UPDATE P SET ID = ID + 10", after_update)):
        s.execute("BEGIN")
        if isinstance(after, str):
            assert fails(s, text) == after
        else:
            s.execute(text)
            want = after if "UPDATE" in text or action != "CASCADE" else [(2, 2), (3, None)]
            assert rows(s, "SELECT * FROM C ORDER BY ID") == want
        s.execute("ROLLBACK")
    assert rows(s, "SELECT * FROM C ORDER BY ID") == [(1, 1), (2, 2), (3, None)]


def test_vacuum_keeps_what_tables_hold(s, db):
    load(s, *BOAT, "BEGIN", "DELETE FROM BOAT", "ROLLBACK", "UPDATE BOAT SET TONS = 1 WHERE NR < 30")
    for _ in range(6):
        s.execute("INSERT INTO BOAT (NR) SELECT MAX(NR) + 1 FROM BOAT")
    assert db.store.vacuum() > 0 and db.store.vacuum() == 0
    assert rows(s, "SELECT COUNT(*), SUM(TONS) FROM BOAT") == [(11, D("139.45"))]


def _table(db, name):
    return db.load()[1]["spaces"]["APP"]["tables"][name]


def test_ranges_of_keys_spare_segments(s, db):
    from larkspur.sources.store import overlapping

    load(s, "CREATE TABLE P (A INTEGER, B VARCHAR(80), X INTEGER, PRIMARY KEY (A, B))", "INSERT INTO P VALUES (1, 'a', NULL), (5, 'c', 0)", "INSERT INTO P VALUES (11, 'a', 0), (15, 'é', 0)", f"INSERT INTO P VALUES (21, '{'z' * 70}', 0)")
    t = _table(db, "P")
    a, b = (c["id"] for c in t["columns"][:2])
    assert [(x["rows"], x["ranges"]) for x in map(t["stats"].get, t["segments"])] == [(2, {a: [1, 5], b: ["a", "c"]}), (2, {a: [11, 15], b: ["a", "é"]}), (1, {a: [21, 21]})]
    at = lambda ranges: [t["segments"].index(x) for x in overlapping(t, ranges)]
    assert at({a: [5, 11]}) == [0, 1] and at({a: [6, 10]}) == [] and at({b: ["d", "d"]}) == [1, 2] and at({a: [1, 99], b: ["a", "a"]}) == [0, 1, 2]
    assert at({}) == [0, 1, 2] and at({a: ["x", "y"]}) == [0, 1, 2]
    assert overlapping({**t, "stats": {}}, {a: [6, 10]}) == t["segments"]
    assert fails(s, "INSERT INTO P VALUES (99, 'a', 0), (15, 'é', 1)") == "23505" and fails(s, f"INSERT INTO P VALUES (21, '{'z' * 70}', 1)") == "23505"
    assert fails(s, "UPDATE P SET A = 11 WHERE A = 1") == "23505" and s.execute("UPDATE P SET A = 12 WHERE A = 1").count == 1
    t = _table(db, "P")
    assert sorted(x["rows"] for x in map(t["stats"].get, t["segments"])) == [1, 1, 1, 2] and fails(s, "INSERT INTO P VALUES (12, 'a', 0)") == "23505"
    load(s, "CREATE TABLE C (N INTEGER, A SMALLINT, B VARCHAR(80), FOREIGN KEY (A, B) REFERENCES P)", "INSERT INTO C VALUES (1, 12, 'a'), (2, NULL, 'q'), (3, 15, 'é')")
    assert fails(s, "INSERT INTO C VALUES (4, 7, 'c')") == "23503" and fails(s, "INSERT INTO C VALUES (4, 500, 'a'), (5, 12, 'a')") == "23503"
    assert fails(s, "UPDATE C SET A = 21 WHERE N = 1") == "23503" and s.execute("UPDATE C SET A = 11 WHERE N = 1").count == 1
    load(s, "DELETE FROM C", "INSERT INTO C VALUES (1, NULL, NULL)")
    assert len(_table(db, "C")["segments"]) == 1
    load(s, "ALTER TABLE P ADD COLUMN Y INTEGER DEFAULT 4", "INSERT INTO P (A, B) VALUES (30, 'a')")
    assert fails(s, "INSERT INTO P (A, B) VALUES (12, 'a')") == "23505" and one(s, "SELECT COUNT(*) FROM P") == 6


def test_small_segments_are_joined(s, db, monkeypatch):
    from larkspur.sources import store

    monkeypatch.setattr(store, "MANY", 4)
    load(s, "CREATE TABLE T (K INTEGER PRIMARY KEY, V VARCHAR(5))", "BEGIN")
    for k in range(1, 4):
        s.execute("INSERT INTO T VALUES (?, 'v')", (k,))
    load(s, "SAVEPOINT A", "INSERT INTO T VALUES (4, NULL)")
    assert len(s.manifest["spaces"]["APP"]["tables"]["T"]["segments"]) == 1
    load(s, "ROLLBACK TO A", "COMMIT")
    assert len(_table(db, "T")["segments"]) == 3 and fails(s, "INSERT INTO T VALUES (2, 'w')") == "23505"
    load(s, "INSERT INTO T VALUES (9, 'w')", "INSERT INTO T VALUES (7, 'x')")
    t = _table(db, "T")
    assert [(x["rows"], list(x["ranges"].values())) for x in map(t["stats"].get, t["segments"])] == [(4, [[1, 9]]), (1, [[7, 7]])]
    assert fails(s, "INSERT INTO T VALUES (3, 'w')") == "23505" and rows(s, "SELECT * FROM T ORDER BY K") == [(1, "v"), (2, "v"), (3, "v"), (7, "x"), (9, "w")]


def _claim(draft: str, final: str, won) -> None:
    from larkspur.sources.store import claim_local

    if claim_local(draft, final):
        won.put(draft)


def test_one_of_many_processes_makes_a_version(tmp_path):
    made = multiprocessing.get_context("spawn")
    won, drafts = made.Queue(), []
    for k in range(6):
        drafts.append(str(tmp_path / f"draft-{k}"))
        (tmp_path / f"draft-{k}").write_text(str(k))
    at = [made.Process(target=_claim, args=(d, str(tmp_path / "manifest"), won)) for d in drafts]
    for x in at:
        x.start()
    for x in at:
        x.join()
    winner = won.get(timeout=10)
    assert won.empty() and (tmp_path / "manifest").read_text() == winner[-1]


def test_writers_of_one_version_conflict(spark, tmp_path):
    from larkspur.sources.store import Store, new_manifest

    stores = [Store(spark, f"file://{tmp_path}/db") for _ in range(4)]
    for base in range(3):
        with ThreadPoolExecutor(4) as pool:
            outcome = list(pool.map(lambda x, base=base: _saved(x, base, new_manifest()), stores))
        assert sorted(outcome) == sorted(["40001"] * 3 + [str(base + 1)])
    assert stores[0].load()[0] == 3


def _saved(store, base, manifest) -> str:
    try:
        return str(store.save(base, manifest))
    except SqlError as e:
        return e.sqlstate


def test_rows_read_for_update_must_not_change(s, db):
    load(s, *BOAT, "CREATE TABLE LOG (N INTEGER)")
    other = db.connect(space="APP")
    for change, state in (("UPDATE BOAT SET CREW = 1 WHERE NR = 10", "40001"), ("INSERT INTO LOG VALUES (0)", None)):
        s.execute("BEGIN")
        assert rows(s, "SELECT NR FROM BOAT WHERE NR = 20 FOR UPDATE") == [(20,)]
        other.execute(change)
        assert one(s, "SELECT CREW FROM BOAT WHERE NR = 10") in (1, 3)
        s.execute("INSERT INTO LOG VALUES (1)") if state else s.execute("UPDATE BOAT SET CREW = 0 WHERE NR = 20")
        if state:
            assert fails(s, "COMMIT") == state
        else:
            s.execute("COMMIT")
    assert rows(s, "SELECT CREW FROM BOAT WHERE NR < 30 ORDER BY NR") == [(1,), (0,)] and rows(s, "SELECT N FROM LOG") == [(0,)]


def test_cascades_reach_a_fixpoint(s):
    load(s, "CREATE TABLE T (ID INTEGER PRIMARY KEY, UP INTEGER REFERENCES T ON DELETE CASCADE)", "INSERT INTO T VALUES (1, NULL), (2, 1), (3, 2), (4, 3), (9, NULL)")
    assert s.execute("DELETE FROM T WHERE ID = 1").count == 1
    assert rows(s, "SELECT * FROM T") == [(9, None)]
    load(s, "CREATE TABLE U (ID INTEGER REFERENCES T)", "INSERT INTO U VALUES (9)")
    assert fails(s, "TRUNCATE TABLE T") == "23503" and fails(s, "DROP TABLE T") == "55006"
    load(s, "TRUNCATE U", "TRUNCATE T", "DROP TABLE T CASCADE")


def test_transactions(s, db):
    load(s, *BOAT, "BEGIN", "DELETE FROM BOAT WHERE NR = 10", "SAVEPOINT A", "UPDATE BOAT SET TONS = 0", "SAVEPOINT B", "DELETE FROM BOAT")
    other = db.connect(space="APP")
    assert one(other, "SELECT COUNT(*) FROM BOAT") == 5  # uncommitted changes are not seen
    assert fails(s, "BEGIN") == "25001" and fails(s, "ROLLBACK TO NOPE") == "3B001"
    s.execute("ROLLBACK TO SAVEPOINT A")
    assert rows(s, "SELECT COUNT(*), MIN(TONS) FROM BOAT") == [(4, D("12.25"))] and fails(s, "ROLLBACK TO B") == "3B001"
    assert fails(s, "INSERT INTO BOAT (NR) VALUES (20)") == "23505"  # a failed statement leaves the transaction open
    other.execute("INSERT INTO BOAT (NR) VALUES (7)")
    with pytest.raises(SqlError) as e:
        s.execute("COMMIT")
    assert e.value.sqlstate == "40001"
    assert one(s, "SELECT COUNT(*) FROM BOAT") == 6
    load(s, "SET AUTOCOMMIT OFF", "DELETE FROM BOAT", "ROLLBACK", "DELETE FROM BOAT WHERE NR = 7", "COMMIT")
    assert one(other, "SELECT COUNT(*) FROM BOAT") == 5 and fails(other, "SAVEPOINT X") == "25P01"


def test_transactions_on_different_tables_both_commit(s, db):
    load(s, "CREATE TABLE A (X INT)", "CREATE TABLE B (X INT)", "CREATE TABLE P (K INT PRIMARY KEY)", "CREATE TABLE C (K INT REFERENCES P)", "INSERT INTO P VALUES (1)")
    other = db.connect(space="APP")
    load(s, "BEGIN", "INSERT INTO A VALUES (1)")
    load(other, "INSERT INTO B VALUES (2)")
    assert rows(s, "SELECT * FROM B") == [(2,)]  # committed rows are seen within the transaction
    s.execute("COMMIT")
    assert rows(other, "SELECT A.X, B.X FROM A, B") == [(1, 2)]
    load(s, "BEGIN", "INSERT INTO C VALUES (1)")
    other.execute("DELETE FROM P")
    assert fails(s, "COMMIT") == "40001"  # a key links the two
    assert rows(s, "SELECT * FROM C") == []


def test_views(s):
    load(s, *BOAT, "CREATE VIEW HEAVY (K, N, LOAD, TWICE) AS SELECT NR, LABEL, TONS, TONS * 2 FROM BOAT WHERE TONS > 40", "CREATE VIEW H2 AS SELECT * FROM HEAVY WHERE K < 45")
    assert rows(s, "SELECT K, TWICE FROM H2 ORDER BY K") == [(20, D("160.00")), (40, D("90.40"))]
    assert s.execute("UPDATE H2 SET LOAD = LOAD + 1").count == 2
    assert s.execute("DELETE FROM H2 WHERE K = 10").count == 0 and s.execute("DELETE FROM H2 WHERE K = 20").count == 1
    assert s.execute("INSERT INTO HEAVY (K, LOAD) VALUES (8, 1)").count == 1
    assert fails(s, "UPDATE HEAVY SET TWICE = 1") == "42P17"
    load(s, "CREATE VIEW AGG AS SELECT COUNT(*) N FROM BOAT")
    assert fails(s, "DELETE FROM AGG") == "42P17" and fails(s, "CREATE OR REPLACE VIEW HEAVY AS SELECT * FROM H2") == "42P17"
    assert fails(s, "ALTER TABLE BOAT DROP COLUMN LABEL") == "55006" and fails(s, "DROP TABLE BOAT") == "55006"
    s.execute("DROP TABLE BOAT CASCADE")
    assert rows(s, "SELECT * FROM SYS_VIEWS") == []


def test_alter_table_and_dictionary(s):
    load(s, *BOAT, "ALTER TABLE BOAT ADD COLUMN NOTE VARCHAR(5) DEFAULT 'q' NOT NULL", "ALTER TABLE BOAT RENAME COLUMN NOTE TO MEMO", "ALTER TABLE BOAT ALTER MEMO DROP DEFAULT", "CREATE INDEX ON BOAT (LABEL DESC, NR)")
    assert rows(s, "SELECT NR, MEMO FROM BOAT ORDER BY NR") == [(i, "q") for i in range(10, 51, 10)]
    assert fails(s, "INSERT INTO BOAT (NR) VALUES (5)") == "23502" and fails(s, "ALTER TABLE BOAT ALTER LABEL SET NOT NULL") == "23502" and fails(s, "ALTER TABLE BOAT DROP COLUMN NR") == "55006"
    load(s, "ALTER TABLE BOAT DROP COLUMN MEMO", "ALTER TABLE BOAT RENAME TO FLEET")
    assert rows(s, "SELECT COLUMN_NAME, DATA_TYPE, IS_NULLABLE FROM SYS_COLUMNS WHERE TABLE_NAME = 'FLEET' ORDER BY ORDINAL_POSITION") == [("NR", "INTEGER", "NO"), ("LABEL", "VARCHAR(20)", "YES"), ("TONS", "DECIMAL(10,2)", "YES"), ("BUILT", "DATE", "YES"), ("CREW", "INTEGER", "YES")]
    assert rows(s, "SELECT INDEX_NAME, COLUMN_NAME, IS_DESCENDING FROM SYS_INDEX_COLUMNS ORDER BY 1, INDEX_NAME, ORDINAL_POSITION") == [("IX_BOAT_1", "LABEL", "YES"), ("IX_BOAT_1", "NR", "NO"), ("PK_BOAT", "NR", "NO")]
    assert fails(s, "DELETE FROM DUAL") == "42809" and fails(s, "DROP TABLE SYS_USERS") == "42809" and fails(s, "CREATE TABLE FLEET (A INT)") == "42P07" and fails(s, "DROP INDEX NOPE") == "42704"
    assert one(s, "SELECT COUNT(*) FROM SYS_TABLESPACES") == 2 and fails(s, "DROP TABLESPACE APP") == "55006"
    s.execute("DROP TABLESPACE APP INCLUDING CONTENTS")
    assert fails(s, "SELECT * FROM FLEET") == "3F000"


def test_privileges(s, db):
    load(s, *BOAT, "CREATE USER BOB IDENTIFIED BY 'pw' DEFAULT TABLESPACE APP", "CREATE VIEW V AS SELECT NR, TONS FROM BOAT WHERE NR < 25", "GRANT UPDATE, SELECT ON V TO BOB")
    with pytest.raises(SqlError) as e:
        db.connect("BOB", "wrong")
    assert e.value.sqlstate == "28000"
    bob = db.connect("BOB", "pw")
    assert fails(bob, "SELECT * FROM BOAT") == "42501" and bob.execute("UPDATE V SET TONS = 1").count == 2  # a view's privilege covers its base
    assert fails(bob, "CREATE TABLE T (A INT)") == "42501" and fails(bob, "GRANT SELECT ON BOAT TO BOB") == "42501" and fails(bob, "CREATE USER X IDENTIFIED BY 'x'") == "42501"
    assert rows(bob, "SELECT TABLE_NAME FROM SYS_TABLES") == []
    load(s, "GRANT CREATE ON TABLESPACE APP TO BOB", "GRANT SELECT ON BOAT TO BOB")
    load(bob, "CREATE TABLE OWN (A INT)", "INSERT INTO OWN SELECT NR FROM BOAT", "CREATE VIEW W AS SELECT NR FROM BOAT")
    assert one(bob, "SELECT COUNT(*) FROM W") == 5
    s.execute("REVOKE SELECT ON BOAT FROM BOB")
    assert fails(bob, "SELECT * FROM W") == "42501"
    s.execute("GRANT OFFICER TO BOB")
    assert one(bob, "SELECT COUNT(*) FROM BOAT") == 5 and fails(s, "GRANT CREATE ON BOAT TO BOB") == "0LP01" and fails(s, "DROP USER BOB") == "55006"
    s.execute("DROP USER BOB CASCADE")
    assert rows(s, "SELECT USER_NAME FROM SYS_USERS") == [("SYSTEM",)]


def test_prepared_and_paged(s):
    load(s, "CREATE TABLE T (N INTEGER PRIMARY KEY, V VARCHAR(100))")
    s.execute("INSERT INTO T VALUES " + ", ".join(f"({i}, '{i % 4}')" for i in range(50)))
    p = s.prepare("SELECT V, COUNT(*) AS C FROM T WHERE N < ? GROUP BY V")
    assert [(c, str(t)) for c, t in p.columns] == [("V", "VARCHAR(100)"), ("C", "BIGINT")]
    assert sorted(p.execute((8,)).rows()) == [(str(i), 2) for i in range(4)]
    pages = list(s.execute("SELECT N FROM T ORDER BY N").fetch(20))
    assert [len(x) for x in pages] == [20, 20, 10] and [r[0] for x in pages for r in x] == list(range(50))
    assert s.prepare("SELECT N FROM T ORDER BY N LIMIT ?").execute((2,)).rows() == [(0,), (1,)]
    spool = s.execute("SELECT N, V FROM T ORDER BY N DESC").spool()
    assert spool.count == 50 and spool.read(0, 2) == [(49, "1"), (48, "0")] and spool.read(45) == [(4, "0"), (3, "3"), (2, "2"), (1, "1"), (0, "0")] and spool.read(10, 1) == [(39, "3")] and spool.read(50) == []
    spool.close()
    held = s.execute("SELECT COUNT(*) FROM T")
    s.execute("ALTER TABLE T ADD X INTEGER")
    with pytest.raises(SqlError) as e:
        p.execute((8,))
    assert e.value.sqlstate == "0A000"
    s.execute("DELETE FROM T")
    assert held.rows() == [(50,)]  # a result is a snapshot


def test_pages_end_at_a_mebibyte(s):
    load(s, "CREATE TABLE T (N INTEGER, V VARCHAR(60000))", "INSERT INTO T VALUES " + ", ".join(f"({i}, '{'é' * 30_000}')" for i in range(20)), "INSERT INTO T (N) VALUES (99)")
    pages = list(s.execute("SELECT N, V FROM T ORDER BY N").fetch())
    assert [len(x) for x in pages] == [18, 3] and [r[0] for x in pages for r in x] == [*range(20), 99]


def test_a_connection_reads_sixteen_results(spark, tmp_path):
    c = dbapi.connect(f"file://{tmp_path}/d", spark=spark)
    held = [c.cursor().execute("SELECT 1 FROM DUAL") for _ in range(dbapi.MAX_CURSORS)]
    late = c.cursor()
    with pytest.raises(dbapi.DatabaseError) as e:
        late.execute("SELECT 2 FROM DUAL")
    assert e.value.sqlstate == "53400"
    assert held[0].fetchall() == [(1,)] and late.execute("SELECT 2 FROM DUAL").fetchone() == (2,)
    held[1].close()
    assert held[2].execute("SELECT 3 FROM DUAL").fetchone() == (3,) and c.cursor().execute("SELECT 4 FROM DUAL").fetchone() == (4,)


def test_dbapi_and_shell(spark, tmp_path, capsys):
    folder = f"file://{tmp_path}/d"
    assert cli.main([folder, "-e", "CREATE TABLESPACE A; CREATE TABLE A.T (X INT PRIMARY KEY, Y VARCHAR(9)); INSERT INTO A.T VALUES (1, 'a;b'); SELECT * FROM A.T"]) == 0
    assert "X | Y\n--+----\n1 | a;b\n(1 row)" in capsys.readouterr().out
    assert cli.main([folder, "-e", "SELECT 1/0"]) == 1
    with dbapi.connect(folder, tablespace="A", spark=spark) as c:
        cur = c.cursor().executemany("INSERT INTO T VALUES (?, ?)", [(2, "b"), (3, None)])
        assert cur.rowcount == 2
        c.rollback()
        cur.executemany("INSERT INTO T VALUES (?, ?)", [(4, "d"), (5, "e")])
        c.commit()
        cur.execute("SELECT X, Y FROM T WHERE X > ? ORDER BY X", (1,))
        assert cur.description[0][0] == "X" and cur.description[0][1] == dbapi.NUMBER and cur.fetchone() == (4, "d") and cur.fetchall() == [(5, "e")]
        with pytest.raises(dbapi.IntegrityError):
            cur.execute("INSERT INTO T VALUES (4, 'x')")
        with pytest.raises(dbapi.NotSupportedError):
            cur.callproc("x")
