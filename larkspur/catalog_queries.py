"""One query for each operator of the dialect, with the SQL that says the same to another engine.

Texts are the dialect's, run through parser, binder and Spark; `same` texts mean the same elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.errors import SqlError
from larkspur.session import Database, Session
from larkspur.sources.store import scratch_folder

TABLES = ("REGION", "NATION", "CUSTOMER", "SUPPLIER", "PART", "ORDERS", "LINEITEM", "EVENTS", "EMBEDDINGS")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def run_dialect(spark: SparkSession, sf_dir: str, text: str, params=(), zone: str | None = None, use: Callable[[Session], DataFrame] | None = None) -> DataFrame:
    """A dialect query over the Parquet tables of a folder, or what `use` makes with the session."""
    db = Database(spark)
    words = set(re.findall(r"\w+", text.upper()))
    db.attach("SF", {t: spark.read.parquet(f"{sf_dir}/{t.lower()}.parquet") for t in TABLES if t in words})
    session = db.connect(space="SF")
    if zone:
        session.zone = zone
    try:
        return use(session) if use else session.query(text, params)
    finally:
        session.close()
        db.detach()


def run_scenario(spark: SparkSession, sf_dir: str, statements: list, text: str) -> DataFrame:
    """Statements in a new database beside the Parquet tables of a folder (tablespace SF), then a query.

    A statement (text, state) must be refused with that SQLSTATE; (text, state, user) is run by that user, whose password is `pw`."""
    statements = [x if isinstance(x, tuple) else (x, None) for x in statements]
    db = Database(spark, scratch_folder(spark))
    words = set(re.findall(r"\bSF\.(\w+)", " ".join([*(x[0] for x in statements), text]).upper()))
    db.attach("SF", {t: spark.read.parquet(f"{sf_dir}/{t.lower()}.parquet") for t in TABLES if t in words})
    session = db.connect()
    try:
        for statement, refused, *user in [("CREATE TABLESPACE APP", None), ("USE APP", None), *statements]:
            own = db.connect(user[0], "pw") if user else session
            try:
                got = own.execute(statement)
                if refused:
                    got.rows()
            except SqlError as e:
                if e.sqlstate != refused:
                    raise
            else:
                if refused:
                    raise AssertionError(f"not refused with {refused}: {statement}")
            finally:
                if user:
                    own.close()
        return session.query(text)
    finally:
        session.close()
        db.detach()


def scenario(name: str, statements: list, text: str, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run_scenario(spark, sf_dir, statements, text)
    ORACLE_SQL[name] = oracle


def same(name: str, text: str) -> None:
    both(name, text, text)


def both(name: str, text: str, oracle: str | None, params=()) -> None:
    # names without quotes are upper-cased by the dialect; here all are shown in lower case
    shown = lambda df: df.toDF(*[c.lower() if c.isupper() else c for c in df.columns])
    QUERIES[name] = lambda spark, sf_dir: shown(run_dialect(spark, sf_dir, text, params))
    if oracle is not None:
        ORACLE_SQL[name] = oracle


MONEY = "CAST(l_extendedprice AS DECIMAL(18,2))"

# 2.1 sources

same("s1_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
same("s2_range_predicate", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 100 AND 200 AND l_linenumber = 2")
same("s4_point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
same("s7_inline_view", 'SELECT x.k AS "k", x.c AS "c" FROM (SELECT n_regionkey, COUNT(*) FROM nation GROUP BY n_regionkey) x (k, c) WHERE x.c > 3')
both("s8_dual", 'SELECT DUMMY AS "dummy", 1 + 1 AS "two" FROM DUAL', "SELECT 'X' AS dummy, 2 AS two")
same("s9_no_from", "SELECT 'a' || 'b' AS \"ab\", 6 * 7 AS \"n\"")

# 2.2 projection, filter, predicates, scalar operators

both("p1_default_names", "SELECT n_name, n_nationkey + 1, UPPER(n_name) FROM nation", 'SELECT n_name AS "n_name", n_nationkey + 1 AS "col2", upper(n_name) AS "col3" FROM nation')
both("p2_stars", "SELECT r.*, n.N_NAME FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey", 'SELECT r.r_regionkey AS "r_regionkey", r.r_name AS "r_name", n.n_name AS "n_name" FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey')
same("p3_where", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
both("p5_comparisons", 'SELECT o_orderkey, o_orderstatus <> \'F\' AS "ne", o_totalprice >= 100000 AS "ge", NULLIF(o_orderstatus, \'O\') < \'P\' AS "lt" FROM orders', "SELECT o_orderkey, o_orderstatus <> 'F' AS ne, o_totalprice >= 100000 AS ge, nullif(o_orderstatus, 'O') < 'P' AS lt FROM orders")
same("p6_three_valued_logic", "SELECT o_orderkey, (NULLIF(o_orderstatus, 'O') = 'F') OR (o_orderkey < 100) AS \"o\", (NULLIF(o_orderstatus, 'O') = 'F') AND (o_orderkey < 100) AS \"a\", NOT (NULLIF(o_orderstatus, 'O') = 'F') AS \"n\" FROM orders")
same("p7_is_null", "SELECT o_orderkey, NULLIF(o_orderstatus, 'O') IS NULL AS \"x\", NULLIF(o_orderstatus, 'F') IS NOT NULL AS \"y\" FROM orders")
both("p8_is_truth", "SELECT o_orderkey, (NULLIF(o_orderstatus, 'O') = 'F') IS TRUE AS \"t\", (NULLIF(o_orderstatus, 'O') = 'F') IS UNKNOWN AS \"u\", (NULLIF(o_orderstatus, 'O') = 'F') IS NOT FALSE AS \"f\" FROM orders", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O') = 'F', false) AS t, (nullif(o_orderstatus, 'O') = 'F') IS NULL AS u, coalesce(nullif(o_orderstatus, 'O') = 'F', true) AS f FROM orders")
both("p9_between_null", "SELECT o_orderkey, o_orderkey BETWEEN 5 AND NULLIF(o_custkey, o_custkey) AS \"b\", o_orderkey NOT BETWEEN NULLIF(1, 1) AND 10 AS \"nb\", o_orderkey BETWEEN 5 AND 10 AS \"c\" FROM orders", "SELECT o_orderkey, CAST(NULL AS BOOLEAN) AS b, CAST(NULL AS BOOLEAN) AS nb, o_orderkey BETWEEN 5 AND 10 AS c FROM orders")
same("p10_in_list", "SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS \"i\", o_orderkey NOT IN (1, 2, NULL) AS \"n\" FROM orders")
both("p11_like", "SELECT p_partkey FROM part WHERE p_type LIKE '%E%' AND p_name NOT LIKE '_a%' AND p_brand LIKE 'Brand#1_' AND p_name LIKE '%!_%' ESCAPE '!' OR p_name LIKE '%a%\\%'", "SELECT p_partkey FROM part WHERE p_type LIKE '%E%' AND p_name NOT LIKE '_a%' AND p_brand LIKE 'Brand#1_' AND p_name LIKE '%!_%' ESCAPE '!'")
both("p11_like_escape", "SELECT p_partkey, p_brand LIKE 'Brand!#1%' ESCAPE '!' AS \"e\", '50%' LIKE '50!%' ESCAPE '!' AS \"p\", 'a\\b' LIKE 'a\\_' AS \"bs\" FROM part", "SELECT p_partkey, p_brand LIKE 'Brand#1%' AS e, true AS p, true AS bs FROM part")
both("p12_integer_arithmetic", 'SELECT o_orderkey, o_orderkey / 7 AS "q", -o_orderkey / 7 AS "nq", o_orderkey * 3 - 1 AS "m" FROM orders', "SELECT o_orderkey, o_orderkey // 7 AS q, -(o_orderkey // 7) AS nq, o_orderkey * 3 - 1 AS m FROM orders")
both("p12_decimal_arithmetic", f'SELECT l_orderkey, l_linenumber, {MONEY} * CAST(l_discount AS DECIMAL(4,2)) AS "m", {MONEY} + CAST(1.005 AS DECIMAL(5,3)) AS "a", CAST({MONEY} / 3 AS DECIMAL(20,4)) AS "d" FROM lineitem', "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(23,4)) AS m, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) + 1.005 AS DECIMAL(20,3)) AS a, CAST(round((CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(30,2)) * 1000000 / 3) / 1000000.0, 4) AS DECIMAL(20,4)) AS d FROM lineitem")
both("p13_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS \"d30\", CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS \"days\", CAST(o_orderdate AS DATE) + INTERVAL '1' MONTH AS \"m1\", CAST(o_orderdate AS DATE) + INTERVAL '36' HOUR AS \"h36\" FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS d30, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INTEGER) AS days, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS m1, CAST(o_orderdate AS DATE) + INTERVAL 36 HOUR AS h36 FROM orders")
both("p13_intervals", "SELECT o_orderkey, CAST(o_orderdate - TIMESTAMP '1995-01-01 00:00:00' AS VARCHAR(40)) AS \"age\", CAST(INTERVAL '1' DAY / 2 AS VARCHAR(20)) AS \"half\", CAST(INTERVAL '1-6' YEAR TO MONTH * 3 AS VARCHAR(20)) AS \"ym\" FROM orders", "SELECT o_orderkey, (CASE WHEN s < 0 THEN '-' ELSE '' END) || CAST(abs(s) // 86400 AS BIGINT) || ' ' || lpad(CAST(abs(s) % 86400 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(s) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(s) % 60 AS VARCHAR), 2, '0') || '.000000' AS age, '0' AS half, '4-06' AS ym FROM (SELECT o_orderkey, CAST(epoch(o_orderdate) - epoch(TIMESTAMP '1995-01-01') AS BIGINT) AS s FROM orders)")
both("p13_times", "SELECT n_nationkey, CAST(TIME '23:30:00' + CAST(n_nationkey AS INTERVAL HOUR) AS VARCHAR(8)) AS \"t\", CAST(TIME '10:00:00' - TIME '08:30:00' AS VARCHAR(20)) AS \"d\" FROM nation", "SELECT n_nationkey, strftime(TIMESTAMP '2000-01-01 23:30:00' + to_hours(n_nationkey), '%H:%M:%S') AS t, '1:30:00.000000' AS d FROM nation")
same("p14_signs", "SELECT s_suppkey, -s_suppkey AS \"neg\", +s_nationkey AS \"pos\", - (s_suppkey - 5) AS \"x\" FROM supplier")
both("p15_concat", "SELECT c_custkey, c_name || '-' || c_mktsegment AS \"a\", c_name || NULLIF(c_mktsegment, 'BUILDING') AS \"b\", CONCAT(c_name, '/', CAST(c_custkey AS VARCHAR(20))) AS \"c\" FROM customer", "SELECT c_custkey, c_name || '-' || c_mktsegment AS a, c_name || nullif(c_mktsegment, 'BUILDING') AS b, c_name || '/' || CAST(c_custkey AS VARCHAR) AS c FROM customer")
same("p16_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' END AS \"s\", CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 ELSE 0 END AS \"b\" FROM part")
both("p17_cast_numbers", 'SELECT l_orderkey, l_linenumber, CAST(l_quantity / 2 AS INTEGER) AS "i", CAST(l_extendedprice AS DECIMAL(18,1)) AS "d", CAST(l_linenumber AS VARCHAR(5)) AS "s", CAST(\' 42 \' AS INTEGER) AS "p" FROM lineitem', "SELECT l_orderkey, l_linenumber, CAST(round(l_quantity / 2) AS INTEGER) AS i, CAST(l_extendedprice AS DECIMAL(18,1)) AS d, CAST(l_linenumber AS VARCHAR) AS s, 42 AS p FROM lineitem")
both("p17_cast_texts", "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR(30)) AS \"ts\", CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS \"d\", CAST(o_orderkey > 50 AS VARCHAR(5)) AS \"b\", CAST(o_orderstatus AS CHAR(3)) AS \"c\", CAST('2024-02-29' AS DATE) AS \"leap\" FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '.000000' AS ts, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, upper(CAST(o_orderkey > 50 AS VARCHAR)) AS b, rpad(o_orderstatus, 3, ' ') AS c, DATE '2024-02-29' AS leap FROM orders")
same("p18_extract", 'SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS "y", EXTRACT(MONTH FROM o_orderdate) AS "m", EXTRACT(DAY FROM o_orderdate) AS "d" FROM orders')
both("p18_extract_time", "SELECT event_id, EXTRACT(HOUR FROM ts) AS \"h\", EXTRACT(MINUTE FROM ts) AS \"m\", EXTRACT(SECOND FROM ts) AS \"s\", EXTRACT(TIMEZONE_HOUR FROM TIMESTAMP '2024-01-01 00:00:00+09:00') AS \"z\" FROM events", "SELECT event_id, extract(hour FROM ts) AS h, extract(minute FROM ts) AS m, CAST(extract(second FROM ts) AS BIGINT) AS s, CAST(9 AS BIGINT) AS z FROM events")
both("p19_parameters", "SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ? AND o_orderdate >= ? LIMIT ?", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1994-01-01'", (100000, "F", "1994-01-01", 10_000_000))
both("p20_literals", "SELECT 1 AS \"i\", 3000000000 AS \"b\", 1.50 AS \"d\", 1.5E1 AS \"f\", N'it''s' AS \"s\", X'0aFF' AS \"x\", DATE '2024-02-29' AS \"dt\", TIMESTAMP '2024-02-29 12:34:56.789' AS \"ts\", TRUE AS \"t\", CAST(INTERVAL '2-3' YEAR TO MONTH AS VARCHAR(9)) AS \"ym\"", "SELECT 1 AS i, CAST(3000000000 AS BIGINT) AS b, CAST(1.50 AS DECIMAL(3,2)) AS d, CAST(15 AS DOUBLE) AS f, 'it''s' AS s, '\\x0A\\xFF'::BLOB AS x, DATE '2024-02-29' AS dt, TIMESTAMP '2024-02-29 12:34:56.789' AS ts, TRUE AS t, '2-03' AS ym")
both("p21_identifiers", 'SELECT N_NAME AS "Mixed Case", n_nationkey AS plain, "N_REGIONKEY" AS "q""uote" FROM Nation', 'SELECT n_name AS "Mixed Case", n_nationkey AS "plain", n_regionkey AS "q""uote" FROM nation')

# 2.3 joins

same("j1_inner_join", "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
same("j1_theta_join", "SELECT a.n_nationkey AS \"a\", b.n_nationkey AS \"b\" FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
same("j2_left_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 150000")
same("j3_right_join", "SELECT n.n_name, s.s_suppkey FROM supplier s RIGHT OUTER JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000")
same("j4_full_join", "SELECT a.n_nationkey AS \"a\", b.s_suppkey AS \"b\" FROM nation a FULL JOIN supplier b ON a.n_nationkey = b.s_suppkey")
same("j4_full_theta", "SELECT a.n_nationkey AS \"a\", b.r_regionkey AS \"b\" FROM nation a FULL JOIN region b ON a.n_nationkey < b.r_regionkey")
same("j5_cross_join", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
same("j6_comma_join", "SELECT s.s_name, n.n_name, r.r_name FROM supplier s, nation n, region r WHERE s.s_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey")
both("j7_using", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b USING (k)", 'SELECT k AS "k", n_name AS "n_name", s_name AS "s_name" FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b USING (k)')
both("j7_using_full", 'SELECT k AS "k", l.k AS "lk", r.k AS "rk", n_name AS "n", s_name AS "s" FROM (SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey < 15) l FULL JOIN (SELECT s_nationkey AS k, s_name FROM supplier WHERE s_nationkey > 5) r USING (k)', "SELECT coalesce(l.k, r.k) AS k, coalesce(l.k, r.k) AS lk, r.k AS rk, n_name AS n, s_name AS s FROM (SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey < 15) l FULL JOIN (SELECT s_nationkey AS k, s_name FROM supplier WHERE s_nationkey > 5) r ON l.k = r.k")
same("j8_join_tree", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c LEFT JOIN (nation n JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_regionkey < 3) ON c.c_nationkey = n.n_nationkey")
same("j9_self_join", "SELECT a.o_orderkey AS \"x\", b.o_orderkey AS \"y\" FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey")
same("j10_semi_join", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
same("j11_anti_join", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
same("j11_null_aware_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, -1) FROM orders)")

# 2.4 aggregates

same("a1_count", 'SELECT COUNT(*) AS "n", COUNT(NULLIF(o_orderstatus, \'O\')) AS "k", COUNT(DISTINCT o_custkey) AS "d" FROM orders')
both("a4_sum", f'SELECT l_returnflag, SUM(l_linenumber) AS "i", SUM({MONEY}) AS "m", ROUND(SUM(l_tax), 2) AS "f" FROM lineitem GROUP BY l_returnflag', "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS i, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS m, round(sum(l_tax), 2) AS f FROM lineitem GROUP BY l_returnflag")
both("a5_avg", f'SELECT l_returnflag, AVG(l_linenumber) AS "i", AVG({MONEY}) AS "m" FROM lineitem GROUP BY l_returnflag', "SELECT l_returnflag, CAST(round(CAST(sum(l_linenumber) AS DECIMAL(30,0)) * 100000000 // count(*) / 100000000.0, 6) AS DECIMAL(38,6)) AS i, CAST(round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) * 10000000 / count(*) / 10000000.0, 6) AS DECIMAL(38,6)) AS m FROM lineitem GROUP BY l_returnflag")
same("a6_min_max", 'SELECT o_orderstatus, MIN(o_orderdate) AS "a", MAX(o_orderpriority) AS "b", MIN(o_totalprice) AS "c", MAX(o_orderkey > 5) AS "d" FROM orders GROUP BY o_orderstatus')
both("a7_distinct_aggregates", 'SELECT l_linestatus, SUM(DISTINCT l_linenumber) AS "s", MIN(DISTINCT l_quantity) AS "m", COUNT(DISTINCT l_suppkey) AS "c", AVG(DISTINCT l_linenumber) AS "a" FROM lineitem GROUP BY l_linestatus', "SELECT l_linestatus, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, min(l_quantity) AS m, count(DISTINCT l_suppkey) AS c, CAST(round(CAST(avg(DISTINCT l_linenumber) AS DECIMAL(38,9)), 6) AS DECIMAL(38,6)) AS a FROM lineitem GROUP BY l_linestatus")
both("a8_empty_group", "SELECT COUNT(*) AS \"n\", SUM(o_orderkey) AS \"s\", AVG(o_orderkey) AS \"a\", MAX(o_orderstatus) AS \"m\" FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, CAST(avg(o_orderkey) AS DECIMAL(38,6)) AS a, max(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0")
both("a9_group_by", f"SELECT EXTRACT(YEAR FROM o_orderdate) AS \"y\", NULLIF(o_orderstatus, 'O') AS \"s\", COUNT(*) AS \"n\", SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS \"t\" FROM orders GROUP BY EXTRACT(YEAR FROM o_orderdate), NULLIF(o_orderstatus, 'O')", "SELECT extract(year FROM o_orderdate) AS y, nullif(o_orderstatus, 'O') AS s, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS t FROM orders GROUP BY 1, 2")
same("a11_having", 'SELECT o_custkey, COUNT(*) AS "n" FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15 AND MAX(o_totalprice) > 100000')
same("a12_distinct", "SELECT DISTINCT n_regionkey, n_regionkey * 2 AS \"twice\" FROM nation")
same("a14_correlated_group", "SELECT n_regionkey, COUNT(*) AS \"n\", (SELECT MAX(r_name) FROM region r WHERE r.r_regionkey = n.n_regionkey) AS \"r\" FROM nation n GROUP BY n_regionkey")

# 2.6 sorting and limits, 2.7 set operations

both("o1_order_nulls", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS \"r\" FROM nation ORDER BY NULLIF(n_regionkey, 2) DESC, n_nationkey LIMIT 9", "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY r DESC NULLS FIRST, n_nationkey LIMIT 9")
both("o2_order_by_alias", "SELECT p_partkey, p_size * 2 AS sz FROM part ORDER BY sz DESC, p_partkey FETCH FIRST 20 ROWS ONLY", 'SELECT p_partkey AS "p_partkey", p_size * 2 AS "sz" FROM part ORDER BY 2 DESC, 1 LIMIT 20')
both("o3_order_by_ordinal", "SELECT n_name FROM nation ORDER BY 1, n_nationkey DESC LIMIT 5", 'SELECT n_name AS "n_name" FROM nation ORDER BY n_nationkey DESC LIMIT 5')
both("o4_offset_fetch", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 10 ROWS FETCH NEXT 5 ROWS ONLY", 'SELECT c_custkey AS "c_custkey" FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 10')
both("o5_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
both("o6_for_update", "SELECT o_orderkey FROM orders WHERE o_orderkey < 20 FOR UPDATE", "SELECT o_orderkey FROM orders WHERE o_orderkey < 20")
same("u1_union_all", "SELECT n_regionkey AS \"k\" FROM nation UNION ALL SELECT r_regionkey FROM region")
both("u2_union", "SELECT n_regionkey AS \"k\" FROM nation UNION SELECT s_nationkey FROM supplier", "SELECT n_regionkey AS k FROM nation UNION SELECT s_nationkey FROM supplier")
same("u3_intersect", "SELECT n_nationkey AS \"k\" FROM nation INTERSECT SELECT s_nationkey FROM supplier UNION SELECT 99")
same("u4_except", "SELECT c_custkey AS \"k\" FROM customer EXCEPT SELECT o_custkey FROM orders")
both("u6_union_types", "SELECT 1 AS \"v\", 'a' AS \"s\" UNION ALL SELECT 2.5, 'bcd' UNION ALL SELECT 3000000000, NULL", "SELECT CAST(1 AS DECIMAL(20,1)) AS v, 'a' AS s UNION ALL SELECT 2.5, 'bcd' UNION ALL SELECT 3000000000, NULL")

# 2.8 subqueries

same("q1_scalar_subquery", 'SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS "m", (SELECT COUNT(*) FROM nation) AS "n" FROM customer c')
same("q2_exists_or", "SELECT c_custkey FROM customer c WHERE c_custkey < 10 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
both("q3_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
same("q3_in_as_value", "SELECT n_nationkey, n_nationkey IN (SELECT NULLIF(r_regionkey, 0) FROM region) AS \"i\", n_nationkey NOT IN (SELECT r_regionkey FROM region) AS \"o\" FROM nation")
same("q4_any", "SELECT p_partkey FROM part p WHERE p_retailprice > ANY (SELECT l_extendedprice / 10 FROM lineitem l WHERE l.l_partkey = p.p_partkey)")
both("q4_any_as_value", "SELECT n_nationkey, n_nationkey > SOME (SELECT NULLIF(r_regionkey, 1) FROM region) AS \"a\" FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey > 0 THEN TRUE ELSE NULL END AS a FROM nation")
same("q5_all", "SELECT o_orderkey FROM orders o WHERE o_totalprice >= ALL (SELECT x.o_totalprice FROM orders x WHERE x.o_custkey = o.o_custkey)")
both("q5_all_as_value", "SELECT n_nationkey, n_nationkey < ALL (SELECT r_regionkey + 3 FROM region) AS \"a\", n_nationkey = ALL (SELECT r_regionkey FROM region WHERE r_regionkey < 0) AS \"e\" FROM nation", "SELECT n_nationkey, n_nationkey < 3 AS a, TRUE AS e FROM nation")
same("q6_correlation", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT AVG(x.l_quantity) * 1.5E0 FROM lineitem x WHERE x.l_partkey = l.l_partkey)")
same("q7_derived", "SELECT t.n_name, t.cnt AS \"cnt\" FROM (SELECT n.n_name, COUNT(*) AS cnt FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name) t WHERE t.cnt > 50")

# 2.9 functions

both("f_upper_lower", "SELECT p_partkey, UPPER(p_name) AS \"u\", LOWER(p_type) AS \"l\" FROM part", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l FROM part")
both("f_lengths", "SELECT p_partkey, LENGTH(p_name) AS \"a\", CHAR_LENGTH(p_name || 'é') AS \"b\", OCTET_LENGTH(p_name || 'é') AS \"c\" FROM part", "SELECT p_partkey, length(p_name) AS a, length(p_name) + 1 AS b, strlen(p_name) + 2 AS c FROM part")
both("f_substring", "SELECT p_partkey, SUBSTRING(p_name FROM 2 FOR 3) AS \"a\", SUBSTR(p_name, -3) AS \"b\", SUBSTRING(p_name, 0, 2) AS \"c\", SUBSTRING('hello', -10, 3) AS \"d\", SUBSTRING(p_name, 1000) AS \"e\" FROM part", "SELECT p_partkey, substring(p_name, 2, 3) AS a, right(p_name, 3) AS b, left(p_name, 2) AS c, 'hel' AS d, '' AS e FROM part")
both("f_position", "SELECT p_partkey, POSITION('a' IN p_name) AS \"a\", POSITION('' IN p_name) AS \"e\" FROM part", "SELECT p_partkey, position('a' IN p_name) AS a, CAST(1 AS BIGINT) AS e FROM part")
both("f_replace", "SELECT p_partkey, REPLACE(p_name, 'a', '44') AS \"a\", REPLACE(p_name, 'e') AS \"b\", REPLACE(p_name, '', 'x') AS \"c\" FROM part", "SELECT p_partkey, replace(p_name, 'a', '44') AS a, replace(p_name, 'e', '') AS b, p_name AS c FROM part")
both("f_trim", "SELECT p_partkey, TRIM('  ' || p_name || ' ') AS \"a\", TRIM(LEADING 'xy' FROM 'xyyx' || p_brand) AS \"b\", RTRIM(p_brand, '0123456789') AS \"c\", LTRIM('  x') AS \"d\" FROM part", "SELECT p_partkey, trim('  ' || p_name || ' ') AS a, ltrim('xyyx' || p_brand, 'xy') AS b, rtrim(p_brand, '0123456789') AS c, 'x' AS d FROM part")
both("f_abs_mod", "SELECT c_custkey, ABS(c_acctbal) AS \"a\", MOD(c_custkey, 7) AS \"m\", MOD(-c_custkey, 7) AS \"n\", MOD(7.5, 2) AS \"x\" FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, c_custkey % 7 AS m, (-c_custkey) % 7 AS n, CAST(1.5 AS DOUBLE) AS x FROM customer")
both("f_ceil_floor", "SELECT c_custkey, CEIL(c_acctbal) AS \"a\", FLOOR(CAST(c_acctbal AS DECIMAL(12,2))) AS \"b\", CEILING(c_custkey) AS \"c\" FROM customer", "SELECT c_custkey, ceil(c_acctbal) AS a, CAST(floor(CAST(c_acctbal AS DECIMAL(12,2))) AS DECIMAL(12,0)) AS b, c_custkey AS c FROM customer")
both("f_power_sqrt", "SELECT p_partkey, POWER(p_size, 2) AS \"a\", ROUND(SQRT(p_size), 6) AS \"b\" FROM part", "SELECT p_partkey, CAST(p_size * p_size AS DOUBLE) AS a, floor(sqrt(p_size) * 1e6 + 0.5) / 1e6 AS b FROM part")
both("f_round", "SELECT n_nationkey, ROUND(n_nationkey * 1.005, 2) AS \"a\", ROUND(-2.5) AS \"b\", ROUND(-2.5E0) AS \"c\", ROUND(n_nationkey * 17, -1) AS \"d\" FROM nation", "SELECT n_nationkey, CAST(round(n_nationkey * 1.005, 2) AS DECIMAL(20,2)) AS a, CAST(-3 AS DECIMAL(2,0)) AS b, CAST(-2 AS DOUBLE) AS c, CAST(round(CAST(n_nationkey * 17 AS DECIMAL(18,0)) / 10) * 10 AS INTEGER) AS d FROM nation")
both("f_coalesce", "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'O'), NULLIF(o_orderpriority, '1-URGENT'), '-') AS \"c\", NVL(NULLIF(o_custkey, 1), 0) AS \"n\", NULLIF(o_orderkey, 3) AS \"x\" FROM orders", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), nullif(o_orderpriority, '1-URGENT'), '-') AS c, coalesce(nullif(o_custkey, 1), 0) AS n, nullif(o_orderkey, 3) AS x FROM orders")
both("f_current_time", 'SELECT CURRENT_DATE = CAST(CURRENT_TIMESTAMP AS DATE) AS "a", LOCALTIMESTAMP = LOCALTIMESTAMP AS "b", CURRENT_USER AS "u", CAST(LOCALTIMESTAMP AS DATE) - CURRENT_DATE AS "z", EXTRACT(HOUR FROM LOCALTIME) = EXTRACT(HOUR FROM CURRENT_TIME) AS "c"', "SELECT TRUE AS a, TRUE AS b, 'SYSTEM' AS u, 0 AS z, TRUE AS c")
both("f_to_char_datetime", "SELECT event_id, TO_CHAR(ts, 'YYYY-MM-DD HH24:MI:SS.FF3') AS \"a\", TO_CHAR(ts, 'DD/MM/YY \"at\" HH12:MI AM') AS \"b\", TO_CHAR(CAST(ts AS DATE)) AS \"c\" FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(CAST(microsecond(ts) % 1000000 // 1000 AS VARCHAR), 3, '0') AS a, strftime(ts, '%d/%m/%y at %I:%M %p') AS b, strftime(ts, '%Y-%m-%d') AS c FROM events")
both("f_to_char_number", "SELECT c_custkey, TO_CHAR(c_custkey, '999,999') AS \"a\", TO_CHAR(CAST(c_acctbal AS DECIMAL(12,2)), 'FM999990.00') AS \"b\", TO_CHAR(-5, '000') AS \"c\", TO_CHAR(12345, '999') AS \"d\" FROM customer", "SELECT c_custkey, lpad(format('{:,}', c_custkey), 8, ' ') AS a, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS b, '-005' AS c, '###' AS d FROM customer")
both("f_to_date", "SELECT o_orderkey, TO_DATE(TO_CHAR(o_orderdate, 'DD.MM.YYYY'), 'DD.MM.YYYY') AS \"a\", TO_DATE('5/3/24 7', 'DD/MM/YY HH24') AS \"b\", TO_DATE('2024-03-05 10:11:12') AS \"c\" FROM orders", "SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS a, TIMESTAMP '2024-03-05 07:00:00' AS b, TIMESTAMP '2024-03-05 10:11:12' AS c FROM orders")

# larger shapes

FLAGSHIP = """SELECT n.n_name AS "nation", SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS "revenue", COUNT(*) AS "orders"
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderdate >= TIMESTAMP '1994-01-01 00:00:00' GROUP BY n.n_name HAVING COUNT(*) > 3 ORDER BY "revenue" DESC, "nation" LIMIT 10"""
both("flagship", FLAGSHIP, "SELECT n_name AS nation, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS revenue, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1994-01-01' GROUP BY n_name HAVING count(*) > 3 ORDER BY 2 DESC, 1 LIMIT 10")
both("pricing_summary", f"""SELECT l_returnflag, l_linestatus, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS "q", SUM({MONEY}) AS "p",
SUM(CAST({MONEY} * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2))) AS "d", COUNT(*) AS "n" FROM lineitem
WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS q, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS p, CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS d, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
both("j11_not_in_with_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 1) FROM orders) OR c_custkey < 0", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders)")
same("j11_not_in_correlated", "SELECT p_partkey FROM part p WHERE p_size NOT IN (SELECT l_linenumber FROM lineitem l WHERE l.l_partkey = p.p_partkey)")
same("j11_not_in_empty", "SELECT n_nationkey FROM nation WHERE NULLIF(n_regionkey, 1) NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 90) AND NULLIF(n_nationkey, 3) NOT IN (SELECT r_regionkey FROM region)")
same("q4_any_of_all_rows", "SELECT o_orderkey FROM orders WHERE o_totalprice <= ANY (SELECT p_retailprice * 2 FROM part) AND o_orderkey = ANY (SELECT l_orderkey FROM lineitem) OR o_orderkey <> ANY (SELECT 5 FROM region WHERE r_regionkey < 0)")
same("q5_all_of_all_rows", "SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_suppkey < 20) AND c_nationkey <> ALL (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_custkey < ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 90)")
same("q45_as_values", "SELECT n_nationkey, n_regionkey = ANY (SELECT NULLIF(r_regionkey, 2) FROM region) AS \"a\", n_regionkey <> ALL (SELECT NULLIF(r_regionkey, 2) FROM region) AS \"b\", n_regionkey >= ALL (SELECT r_regionkey FROM region) AS \"c\", n_regionkey < ANY (SELECT NULLIF(r_regionkey, 4) FROM region) AS \"d\", n_regionkey = ALL (SELECT 1 FROM region) AS \"e\", n_regionkey <> ANY (SELECT NULLIF(1, 2) FROM region) AS \"f\" FROM nation")

same("p4_name_resolution", 'SELECT n.n_name AS "a", "N"."N_NATIONKEY" AS "b", n_regionkey AS "c" FROM nation n WHERE EXISTS (SELECT 1 FROM region n WHERE n.r_regionkey = n_regionkey AND n.r_regionkey > 1)')

# 2.1 views, overlays and dictionary, 2.10 DML, 2.11 DDL, 2.12 transactions

_NATION = ["CREATE TABLE REG (K INTEGER PRIMARY KEY, NAME VARCHAR(30) NOT NULL)", "CREATE TABLE NAT (K INTEGER PRIMARY KEY, NAME VARCHAR(30), R INTEGER REFERENCES REG ON DELETE {d} ON UPDATE {u}, N DECIMAL(10,2) DEFAULT 1.5)", "INSERT INTO REG SELECT r_regionkey, r_name FROM SF.region", "INSERT INTO NAT (K, NAME, R) SELECT n_nationkey, n_name, n_regionkey FROM SF.nation"]


def _nation(d: str = "NO ACTION", u: str = "NO ACTION") -> list[str]:
    return [t.format(d=d, u=u) for t in _NATION]


_ALL = 'SELECT K AS "k", NAME AS "name", R AS "r", N AS "n" FROM NAT'
_BASE = "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r, CAST(1.5 AS DECIMAL(10,2)) AS n FROM nation"

scenario("s3_read_own_changes", [*_nation(), "BEGIN", "UPDATE NAT SET N = N + K WHERE K < 10", "DELETE FROM NAT WHERE K = 3", "INSERT INTO NAT (K, NAME) VALUES (99, 'new')"], _ALL, f"SELECT k, name, r, CAST(CASE WHEN k < 10 THEN n + k ELSE n END AS DECIMAL(10,2)) AS n FROM ({_BASE}) WHERE k <> 3 UNION ALL SELECT 99, 'new', NULL, 1.5")
scenario("s6_view_expansion", ["CREATE VIEW A (X, Y) AS SELECT n_nationkey, n_regionkey FROM SF.nation WHERE n_nationkey > 3", "CREATE VIEW B AS SELECT Y, COUNT(*) AS C FROM A GROUP BY Y"], 'SELECT B.Y AS "y", C AS "c", X AS "x" FROM B JOIN A ON A.Y = B.Y', "WITH a AS (SELECT n_nationkey AS x, n_regionkey AS y FROM nation WHERE n_nationkey > 3), b AS (SELECT y, count(*) AS c FROM a GROUP BY y) SELECT b.y, c, x FROM b JOIN a ON a.y = b.y")
scenario("s10_dictionary", [*_nation("CASCADE", "SET NULL"), "CREATE INDEX ON NAT (NAME DESC, K)"], "SELECT C.CONSTRAINT_NAME AS \"c\", C.CONSTRAINT_TYPE AS \"t\", C.DELETE_RULE AS \"d\", C.UPDATE_RULE AS \"u\", K.COLUMN_NAME AS \"col\", T.DATA_TYPE AS \"type\" FROM SYS_CONSTRAINTS C JOIN SYS_CONSTRAINT_COLUMNS K ON C.CONSTRAINT_NAME = K.CONSTRAINT_NAME JOIN SYS_COLUMNS T ON T.TABLE_NAME = C.TABLE_NAME AND T.COLUMN_NAME = K.COLUMN_NAME", "SELECT * FROM (VALUES ('PK_REG', 'PRIMARY KEY', NULL, NULL, 'K', 'INTEGER'), ('PK_NAT', 'PRIMARY KEY', NULL, NULL, 'K', 'INTEGER'), ('FK_NAT_1', 'FOREIGN KEY', 'CASCADE', 'SET NULL', 'R', 'INTEGER')) v (c, t, d, u, col, type)")
scenario("m1_insert_values", ["CREATE TABLE T (A INTEGER PRIMARY KEY, B VARCHAR(5) DEFAULT 'd', C DECIMAL(6,2))", "INSERT INTO T VALUES (1, 'x', 1.005), (2, DEFAULT, '7'), (3, NULL, NULL)", "INSERT INTO T (A) VALUES (4)"], 'SELECT A AS "a", B AS "b", C AS "c" FROM T', "SELECT a, b, CAST(c AS DECIMAL(6,2)) AS c FROM (VALUES (1, 'x', 1.01), (2, 'd', 7.00), (3, NULL, NULL), (4, 'd', NULL)) v (a, b, c)")
scenario("m2_insert_select", _nation(), _ALL, _BASE)
scenario("m4_update", [*_nation(), "UPDATE NAT X SET N = (SELECT COUNT(*) FROM NAT Y WHERE Y.R = X.R), NAME = UPPER(NAME) || '!' WHERE K > 4 AND R IN (SELECT K FROM REG WHERE K < 3)"], _ALL, f"SELECT k, CASE WHEN k > 4 AND r < 3 THEN upper(name) || '!' ELSE name END AS name, r, CAST(CASE WHEN k > 4 AND r < 3 THEN (SELECT count(*) FROM nation y WHERE y.n_regionkey = r) ELSE n END AS DECIMAL(10,2)) AS n FROM ({_BASE})")
scenario("m5_delete", [*_nation(), "DELETE FROM NAT WHERE K > 4 AND NOT EXISTS (SELECT 1 FROM REG WHERE REG.K = NAT.R AND REG.K < 3)"], _ALL, f"SELECT * FROM ({_BASE}) WHERE NOT (k > 4 AND r >= 3)")
scenario("m6_truncate", [*_nation(), "TRUNCATE TABLE NAT", "INSERT INTO NAT (K) VALUES (5)"], _ALL, "SELECT 5 AS k, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS INTEGER) AS r, CAST(1.5 AS DECIMAL(10,2)) AS n")
scenario("m7_updatable_view", [*_nation(), "CREATE VIEW V (ID, PAY) AS SELECT K, N FROM NAT WHERE R = 1", "CREATE VIEW W AS SELECT * FROM V WHERE ID > 2", "UPDATE W SET PAY = PAY * 10", "DELETE FROM V WHERE ID < 3", "INSERT INTO V (ID) VALUES (77)"], _ALL, f"SELECT k, name, r, CAST(CASE WHEN r = 1 AND k > 2 THEN n * 10 ELSE n END AS DECIMAL(10,2)) AS n FROM ({_BASE}) WHERE NOT (r = 1 AND k < 3) UNION ALL SELECT 77, NULL, NULL, 1.5")
scenario("m9_cascade", [*_nation("CASCADE", "CASCADE"), "DELETE FROM REG WHERE K = 2", "UPDATE REG SET K = K + 100 WHERE K > 2"], _ALL, f"SELECT k, name, CASE WHEN r > 2 THEN r + 100 ELSE r END AS r, n FROM ({_BASE}) WHERE r <> 2")
scenario("m9_set_null", [*_nation("SET NULL", "SET NULL"), "DELETE FROM REG WHERE K = 2", "UPDATE REG SET K = K + 100 WHERE K > 3"], _ALL, f"SELECT k, name, CASE WHEN r > 3 OR r = 2 THEN NULL ELSE r END AS r, n FROM ({_BASE})")
scenario("d2_alter_table", [*_nation(), "ALTER TABLE NAT ADD COLUMN X VARCHAR(5) DEFAULT 'q' NOT NULL", "ALTER TABLE NAT DROP COLUMN NAME", "ALTER TABLE NAT RENAME COLUMN N TO M", "ALTER TABLE NAT RENAME TO LAND", "INSERT INTO LAND (K, M) VALUES (50, 2)"], 'SELECT K AS "k", R AS "r", M AS "m", X AS "x" FROM LAND', f"SELECT k, r, n AS m, 'q' AS x FROM ({_BASE}) UNION ALL SELECT 50, NULL, 2, 'q'")
scenario("t2_savepoints", [*_nation(), "BEGIN", "DELETE FROM NAT WHERE K > 20", "SAVEPOINT A", "UPDATE NAT SET N = 0", "ROLLBACK TO A", "INSERT INTO NAT (K) VALUES (60)", "COMMIT", "BEGIN", "DELETE FROM NAT", "ROLLBACK"], _ALL, f"SELECT * FROM ({_BASE}) WHERE k <= 20 UNION ALL SELECT 60, NULL, NULL, 1.5")
scenario("t3_autocommit_off", [*_nation(), "SET AUTOCOMMIT OFF", "DELETE FROM NAT WHERE K = 1", "COMMIT", "DELETE FROM NAT", "ROLLBACK", "SET AUTOCOMMIT ON"], _ALL, f"SELECT * FROM ({_BASE}) WHERE k <> 1")
scenario("s5_foreign_key_lookup", _nation(), 'SELECT C.K AS "k", P.NAME AS "p" FROM NAT C JOIN REG P ON P.K = C.R WHERE C.R = 2', "SELECT n_nationkey AS k, r_name AS p FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey = 2")
scenario("m3_default_values", ["CREATE TABLE T (A INTEGER DEFAULT 7, B VARCHAR(5) DEFAULT 'd', C DATE)", "INSERT INTO T DEFAULT VALUES", "INSERT INTO T DEFAULT VALUES"], 'SELECT A AS "a", B AS "b", C AS "c" FROM T', "SELECT 7 AS a, 'd' AS b, CAST(NULL AS DATE) AS c FROM range(2)")
scenario("m8_constraints", [*_nation(), ("INSERT INTO REG VALUES (1, 'again')", "23505"), ("INSERT INTO REG VALUES (77, NULL)", "23502"), ("INSERT INTO NAT (K, R) VALUES (99, 99)", "23503"), ("UPDATE REG SET NAME = NULL", "23502"), ("UPDATE NAT SET K = 1", "23505"), ("UPDATE NAT SET R = 99 WHERE K = 3", "23503")], _ALL, _BASE)
scenario("m9_no_action", [*_nation(), ("DELETE FROM REG WHERE K = 2", "23503"), ("UPDATE REG SET K = K + 100 WHERE K > 2", "23503"), "DELETE FROM NAT WHERE R = 2", "DELETE FROM REG WHERE K = 2"], _ALL, f"SELECT * FROM ({_BASE}) WHERE r <> 2")
scenario("m9_restrict", [*_nation("RESTRICT", "RESTRICT"), ("DELETE FROM REG", "23503"), ("UPDATE REG SET K = K + 100 WHERE K = 0", "23503"), "INSERT INTO REG VALUES (50, 'x')", "UPDATE REG SET K = 51 WHERE K = 50", "INSERT INTO NAT (K, R) VALUES (60, 51)"], _ALL, f"SELECT * FROM ({_BASE}) UNION ALL SELECT 60, NULL, 51, 1.5")
scenario("m10_rejected", [*_nation(), *((t, "0A000") for t in ("MERGE INTO NAT USING REG ON NAT.R = REG.K WHEN MATCHED THEN DELETE", "DELETE FROM NAT WHERE K = 1 RETURNING K", "INSERT INTO REG VALUES (9, 'n') ON CONFLICT DO NOTHING", "SELECT K FROM NAT INTERSECT ALL SELECT K FROM REG"))], _ALL, _BASE)
scenario("d3_drop_table", [*_nation(), "CREATE TABLE T (A INTEGER)", ("DROP TABLE REG", "55006"), "DROP TABLE T", ("SELECT * FROM T", "42P01"), "DROP TABLE REG CASCADE", "INSERT INTO NAT (K, R) VALUES (99, 99)"], _ALL, f"SELECT * FROM ({_BASE}) UNION ALL SELECT 99, NULL, 99, 1.5")
scenario("d7_users", ["CREATE USER BOB IDENTIFIED BY 'pw' DEFAULT TABLESPACE APP", "CREATE USER EVE IDENTIFIED BY 'pw'", ("CREATE USER BOB IDENTIFIED BY 'x'", "42710"), ("CREATE USER ZOE IDENTIFIED BY 'x'", "42501", "EVE"), "DROP USER EVE"], 'SELECT USER_NAME AS "u" FROM SYS_USERS', "SELECT * FROM (VALUES ('SYSTEM'), ('BOB')) v (u)")
scenario("t4_statement_atomicity", [*_nation(), "BEGIN", "UPDATE NAT SET N = 0 WHERE K < 5", ("INSERT INTO NAT (K) SELECT K + 20 FROM NAT", "23505"), "COMMIT"], _ALL, f"SELECT k, name, r, CAST(CASE WHEN k < 5 THEN 0 ELSE n END AS DECIMAL(10,2)) AS n FROM ({_BASE})")
scenario("t6_ddl_commits", [*_nation(), "BEGIN", "DELETE FROM NAT WHERE K > 20", "CREATE TABLE Z (A INTEGER)", "ROLLBACK"], _ALL, f"SELECT * FROM ({_BASE}) WHERE k <= 20")
scenario("t7_use_and_time_zone", ["CREATE TABLESPACE OTHER", "USE OTHER", "CREATE TABLE T (A INTEGER)", "INSERT INTO T VALUES (1)", "USE APP", "CREATE TABLE T (A INTEGER)", "INSERT INTO T VALUES (2)", "SET TIME ZONE '+05:30'"], 'SELECT X.A AS "a", O.A AS "b", EXTRACT(TIMEZONE_MINUTE FROM CURRENT_TIMESTAMP) AS "m" FROM T X, OTHER.T O', "SELECT 2 AS a, 1 AS b, 30 AS m")
scenario("t10_privileges", [*_nation(), "CREATE USER BOB IDENTIFIED BY 'pw' DEFAULT TABLESPACE APP", "GRANT SELECT, UPDATE ON NAT TO BOB", ("UPDATE NAT SET N = 9 WHERE K = 1", None, "BOB"), ("DELETE FROM NAT", "42501", "BOB"), ("SELECT * FROM REG", "42501", "BOB"), "REVOKE UPDATE ON NAT FROM BOB", ("UPDATE NAT SET N = 0", "42501", "BOB")], _ALL, f"SELECT k, name, r, CAST(CASE WHEN k = 1 THEN 9 ELSE n END AS DECIMAL(10,2)) AS n FROM ({_BASE})")
scenario("j12_rejected", [("SELECT 1 FROM SF.nation NATURAL JOIN SF.region", "0A000"), ("SELECT 1 FROM SF.nation, LATERAL (SELECT 1 FROM DUAL) x", "0A000")], 'SELECT 1 AS "n" FROM DUAL', "SELECT 1 AS n")
scenario("a13_rejected", [(f"SELECT n_regionkey FROM SF.nation GROUP BY {g}", "0A000") for g in ("ROLLUP (n_regionkey)", "CUBE (n_regionkey)", "GROUPING SETS ((n_regionkey), ())")], 'SELECT 1 AS "n" FROM DUAL', "SELECT 1 AS n")

# 2.1 results read otherwise than as a DataFrame, 2.12 prepared statements


def used(name: str, text: str, use: Callable[[Session, str], DataFrame], oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run_dialect(spark, sf_dir, text, use=lambda session: use(session, text))
    ORACLE_SQL[name] = oracle


def _spooled(session: Session, text: str) -> DataFrame:
    spool = session.execute(text).spool()
    return spool.rows.select(*[F.col(f"c{i}").alias(c) for i, (c, _) in enumerate(spool.columns)])


def _paged(session: Session, text: str) -> DataFrame:
    result = session.execute(text)
    rows = [(*r, page) for page, own in enumerate(result.fetch(7)) for r in own]
    return session.spark.createDataFrame(rows, StructType(result.frame.schema.fields).add("page", "long"))


def _prepared(session: Session, text: str) -> DataFrame:
    statement = session.prepare(text)
    frames = [statement.execute((k, k + 1)).frame for k in (0, 3)]
    if any(f.columns != [c for c, _ in statement.columns] for f in frames):
        raise AssertionError("a prepared statement has other columns than it described")
    return frames[0].unionAll(frames[1])


used("s13_spooled_cursor", 'SELECT o_orderkey AS "o_orderkey", o_custkey AS "o_custkey", CAST(o_totalprice AS DECIMAL(18,2)) AS "p" FROM orders ORDER BY o_orderkey DESC', _spooled, "SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders")
used("s14_paged_fetch", 'SELECT n_nationkey AS "n_nationkey", n_name AS "n_name" FROM nation ORDER BY n_name', _paged, "SELECT n_nationkey, n_name, (row_number() OVER (ORDER BY n_name) - 1) // 7 AS page FROM nation")
used("t8_prepared_statement", 'SELECT n_nationkey AS "n_nationkey", n_name AS "n_name" FROM nation WHERE n_regionkey IN (?, ?)', _prepared, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (0, 1, 3, 4)")
