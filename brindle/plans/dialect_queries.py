"""Queries in the dialect, each run by Database.query, and the same questions in SQL for another engine.

Tables of the test data are registered with a private database and read in
place; statements that change rows work on copies in managed tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from brindle.plans.registry import ORACLE_SQL, QUERIES, table


def database(spark: SparkSession):
    """A private, empty database in the folder that all executors share."""
    from brindle.database import Database
    from brindle.sources.shared import shared_dir

    return Database(spark, f"{shared_dir(spark)}/db-{uuid.uuid4().hex}")


def ask(name: str, tables: str, sql: str, oracle: str | None = None, before: str = "") -> None:
    """Registers a query of one dialect statement over registered tables, after other statements that build its own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark)
        for t in tables.split():
            db.register_table(t, table(spark, sf_dir, t))
        if before:
            db.execute(before)
        return db.query(sql).df

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or sql


# projection, filter, operators
ask("sql_project_star", "nation region", "SELECT n.*, r_name AS region_name FROM nation n, region WHERE n_regionkey = r_regionkey")
ask(
    "sql_arithmetic", "customer", "SELECT c_custkey, c_custkey + 1 AS a, c_custkey * 2 - 3 AS b, -c_custkey AS c, c_custkey / 7 AS q, c_custkey % 7 AS r, c_acctbal / 2 AS h, c_custkey / 0 AS z FROM customer",
    "SELECT c_custkey, c_custkey + 1 AS a, c_custkey * 2 - 3 AS b, -c_custkey AS c, c_custkey // 7 AS q, c_custkey % 7 AS r, c_acctbal / 2 AS h, CAST(NULL AS BIGINT) AS z FROM customer",
)
ask("sql_bits", "customer", "SELECT c_custkey, c_custkey & 7 AS a, c_custkey | 8 AS o, c_custkey << 2 AS l, c_custkey >> 1 AS r, ~c_custkey AS n FROM customer")
ask(
    "sql_concat", "customer", "SELECT c_custkey, c_name || '-' || c_custkey || '/' || c_acctbal AS s, c_name || NULL AS n FROM customer",
    "SELECT c_custkey, c_name || '-' || c_custkey || '/' || regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '') AS s, CAST(NULL AS VARCHAR) AS n FROM customer",
)
ask(
    "sql_compare_truth", "orders", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_orderpriority <> '1-URGENT') AND o_totalprice >= 1000 AND '5' <> 5 AND o_custkey",
    "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_orderpriority <> '1-URGENT') AND o_totalprice >= 1000 AND o_custkey <> 0",
)
ask(
    "sql_between_in_like", "customer", "SELECT c_custkey FROM customer WHERE c_name LIKE 'CUSTOMER#00000%_1' AND c_nationkey NOT IN (1, 2) AND c_acctbal NOT BETWEEN 0 AND 1000",
    "SELECT c_custkey FROM customer WHERE c_name ILIKE 'CUSTOMER#00000%_1' AND c_nationkey NOT IN (1, 2) AND c_acctbal NOT BETWEEN 0 AND 1000",
)
ask(
    "sql_nulls", "nation", "SELECT n_nationkey, NULLIF(n_regionkey, 1) IS NULL AS gone, COALESCE(NULLIF(n_regionkey, 1), 99) AS filled, IFNULL(NULLIF(n_name, 'NATION_3'), '?') AS name, NULLIF(n_regionkey, 1) > 2 AS big, n_regionkey IS NOT NULL AS there FROM nation",
    "SELECT n_nationkey, CAST(n_regionkey = 1 AS BIGINT) AS gone, CAST(coalesce(nullif(n_regionkey, 1), 99) AS BIGINT) AS filled, coalesce(nullif(n_name, 'NATION_3'), '?') AS name, CAST(nullif(n_regionkey, 1) > 2 AS BIGINT) AS big, CAST(1 AS BIGINT) AS there FROM nation",
)
ask(
    "sql_case_iif", "part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 END AS code, IIF(p_size > 25, 'a', 'b') AS i, MAX(p_partkey, 10, 5) AS most, MIN(p_partkey, 10) AS least FROM part",
    "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, CAST(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 END AS BIGINT) AS code, CASE WHEN p_size > 25 THEN 'a' ELSE 'b' END AS i, greatest(p_partkey, 10, 5) AS most, least(p_partkey, 10) AS least FROM part",
)
ask(
    "sql_cast", "customer", "SELECT c_custkey, CAST(c_acctbal AS INTEGER) AS whole, CAST(c_custkey AS TEXT) AS shown, CAST(c_name AS INTEGER) AS none, CAST(c_custkey AS REAL) AS r, TYPEOF(c_acctbal) AS t, TYPEOF(c_custkey) AS k, TYPEOF(c_name) AS n, TYPEOF(NULL) AS z FROM customer",
    "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS whole, CAST(c_custkey AS VARCHAR) AS shown, CAST(NULL AS BIGINT) AS none, CAST(c_custkey AS DOUBLE) AS r, 'real' AS t, 'integer' AS k, 'text' AS n, 'null' AS z FROM customer",
)
ask("sql_collate", "part", "SELECT p_partkey FROM part WHERE p_brand COLLATE NOCASE = 'BRAND#2'", "SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#2'")
ask("sql_constants", "", "SELECT 1 AS one, 'it''s' AS t, NULL IS NULL AS n, 1 + 2 * 3 AS x, 7 / 2 AS q, TRUE AS b", "SELECT CAST(1 AS BIGINT) AS one, 'it''s' AS t, CAST(1 AS BIGINT) AS n, CAST(7 AS BIGINT) AS x, CAST(3 AS BIGINT) AS q, CAST(1 AS BIGINT) AS b")
ask("sql_output_names", "nation", "SELECT n_name, n_regionkey + 1, COUNT(*) OVER () FROM nation", 'SELECT n_name, CAST(n_regionkey + 1 AS BIGINT) AS "n_regionkey + 1", count(*) OVER () AS "COUNT(*) OVER ()" FROM nation')

# subqueries
ask("sql_scalar_subquery", "customer", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)")
ask("sql_exists", "customer orders", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
ask("sql_not_exists", "customer orders", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
ask("sql_in_subquery", "supplier nation", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR s_suppkey NOT IN (SELECT n_nationkey FROM nation)")
ask("sql_derived_table", "orders", "SELECT k, n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 15", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE n > 15")

# joins
ask("sql_join_three", "customer nation region", "SELECT r.r_name, COUNT(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey INNER JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name")
ask("sql_join_left", "customer orders", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
ask("sql_join_right", "customer orders", "SELECT o_orderkey, c_custkey FROM orders RIGHT OUTER JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'")
ask("sql_join_full", "supplier customer", "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey + 50")
ask("sql_join_cross", "nation region", "SELECT n_name, r_name FROM nation CROSS JOIN region")
ask("sql_join_theta_left", "nation region", "SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_regionkey < r_regionkey - 1")
ask("sql_join_theta_right", "nation region", "SELECT n_nationkey, r_regionkey FROM nation RIGHT JOIN region ON n_regionkey > r_regionkey + 1")
ask("sql_join_using", "supplier customer", "SELECT k, n, m FROM (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY s_nationkey) x JOIN (SELECT c_nationkey AS k, COUNT(*) AS m FROM customer GROUP BY c_nationkey) y USING (k)")
ask("sql_join_natural", "nation region", "SELECT n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r")
ask("sql_join_cte", "customer orders", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 450000) SELECT c.c_name, b.o_totalprice FROM big b JOIN customer c ON b.o_custkey = c.c_custkey")

# aggregates
ask(
    "sql_group_by", "lineitem", "SELECT l_returnflag AS flag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty, ROUND(AVG(l_extendedprice), 2) AS price, MIN(l_discount) AS low, MAX(l_tax) AS high, COUNT(*) * 2 + 1 AS m FROM lineitem GROUP BY flag, 2",
    "SELECT l_returnflag AS flag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS price, min(l_discount) AS low, max(l_tax) AS high, count(*) * 2 + 1 AS m FROM lineitem GROUP BY 1, 2",
)
ask("sql_having", "orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 12 AND MAX(o_totalprice) > 200000")
ask("sql_count_distinct", "lineitem", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, SUM(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
ask(
    "sql_agg_empty", "orders", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, TOTAL(o_totalprice) AS t, MAX(o_orderkey) AS m, COALESCE(SUM(o_custkey), 0) AS z FROM orders WHERE o_orderkey < 0",
    "SELECT count(*) AS n, sum(o_totalprice) AS s, CAST(0 AS DOUBLE) AS t, max(o_orderkey) AS m, CAST(0 AS BIGINT) AS z FROM orders WHERE o_orderkey < 0",
)
ask(
    "sql_agg_total_concat", "nation", "SELECT region, TOTAL(id) AS t, GROUP_CONCAT(name) AS names, GROUP_CONCAT(name, ' + ') AS more FROM t GROUP BY region",
    "SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(sum(n_nationkey) AS DOUBLE) AS t, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, string_agg(n_name, ' + ' ORDER BY n_nationkey) AS more FROM nation GROUP BY n_regionkey",
    "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, region INTEGER); INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation",
)
ask(
    "sql_bare_columns", "nation", "SELECT region, name, COUNT(*) AS n, MAX(id) AS last FROM t GROUP BY region",
    "SELECT CAST(n_regionkey AS BIGINT) AS region, arg_min(n_name, n_nationkey) AS name, count(*) AS n, CAST(max(n_nationkey) AS BIGINT) AS last FROM nation GROUP BY n_regionkey",
    "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, region INTEGER); INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation",
)
ask(
    "sql_agg_expressions", "orders", "SELECT SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, CAST(AVG(o_totalprice) AS INTEGER) AS a, MAX(MAX(o_orderkey), 5) AS m, UPPER(MIN(o_orderpriority)) AS u FROM orders",
    "SELECT CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(trunc(avg(o_totalprice)) AS BIGINT) AS a, greatest(max(o_orderkey), 5) AS m, upper(min(o_orderpriority)) AS u FROM orders",
)

# windows
ask(
    "sql_window_ranks", "part", "SELECT p_partkey, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS n, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS d, NTILE(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS q, ROUND(PERCENT_RANK() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS p, ROUND(CUME_DIST() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS c FROM part",
    "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS n, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS q, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS p, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS c FROM part",
)
ask(
    "sql_window_values", "orders", "SELECT o_orderkey, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, LEAD(o_totalprice, 2, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS l, NTH_VALUE(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM orders",
    "SELECT o_orderkey, lag(o_totalprice) OVER w AS a, lead(o_totalprice, 2, 0.0) OVER w AS b, first_value(o_orderkey) OVER w AS f, o_orderkey AS l, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
)
ask(
    "sql_window_frames", "events", "SELECT event_id, SUM(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS running, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before, MAX(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ahead, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, MIN(event_id) OVER (PARTITION BY user_id) AS first FROM events",
    "SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ahead, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, min(event_id) OVER (PARTITION BY user_id) AS first FROM events",
)
ask(
    "sql_window_default_frame", "nation", "SELECT id, SUM(id) OVER (ORDER BY region) AS s, TOTAL(id) OVER (PARTITION BY region ORDER BY id) AS t FROM t",
    "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(sum(n_nationkey) OVER (ORDER BY n_regionkey, n_nationkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS t FROM nation",
    "CREATE TABLE t (id INTEGER PRIMARY KEY, region INTEGER); INSERT INTO t SELECT n_nationkey, n_regionkey FROM nation",
)

# sort, limit, distinct, sets, CTEs
ask("sql_sort_limit", "customer", "SELECT c_custkey, c_acctbal FROM customer ORDER BY 2 DESC NULLS LAST, c_custkey LIMIT 7 OFFSET 5")
ask("sql_sort_expression", "customer", "SELECT c_custkey FROM customer ORDER BY c_acctbal * -1 DESC, c_custkey DESC LIMIT 4, 6", "SELECT c_custkey FROM customer ORDER BY c_acctbal * -1 DESC, c_custkey DESC LIMIT 6 OFFSET 4")
ask("sql_distinct", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
ask("sql_union_all", "supplier customer", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer")
ask("sql_union", "supplier nation", "SELECT s_nationkey AS k FROM supplier UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
ask("sql_intersect", "supplier customer", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000 INTERSECT SELECT c_nationkey FROM customer")
ask("sql_except", "nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
ask("sql_except_all", "customer nation", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT n_nationkey FROM nation")
ask("sql_intersect_all", "supplier customer", "SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer")
ask(
    "sql_set_chain", "nation supplier customer", "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9800",
    "(SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier) INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9800",
)
ask("sql_set_tail", "nation supplier", "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey + 100 FROM supplier ORDER BY k DESC LIMIT 6 OFFSET 2", "SELECT CAST(k AS BIGINT) AS k FROM (SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey + 100 FROM supplier) ORDER BY k DESC LIMIT 6 OFFSET 2")
ask("sql_values", "", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v", "SELECT CAST(col1 AS BIGINT) AS col1, col2 FROM (VALUES (1, 'a'), (2, 'b')) v(col1, col2)")
ask("sql_cte_chain", "customer orders", "WITH spent(k, s) AS (SELECT o_custkey, SUM(o_totalprice) FROM orders GROUP BY o_custkey), best AS (SELECT k FROM spent WHERE s > 1500000) SELECT c_name FROM customer JOIN best ON c_custkey = k")
ask(
    "sql_cte_recursive", "", "WITH RECURSIVE f(a, b, k) AS (SELECT 0, 1, 1 UNION ALL SELECT b, a + b, k + 1 FROM f WHERE k < 60) SELECT k, a FROM f",
    "WITH RECURSIVE f(a, b, k) AS (SELECT CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT b, a + b, k + 1 FROM f WHERE k < 60) SELECT k, a FROM f",
)
ask(
    "sql_cte_recursive_distinct", "nation", "WITH RECURSIVE start AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 1), reach(k) AS (SELECT n_nationkey FROM start UNION SELECT (k * 7 + 3) % 50 FROM reach) SELECT k FROM reach WHERE k > 5",
    "WITH RECURSIVE reach(k) AS (SELECT 1 UNION SELECT (k * 7 + 3) % 50 FROM reach) SELECT CAST(k AS INTEGER) AS k FROM reach WHERE k > 5",
)

# scalar functions
ask(
    "sql_fn_text", "part", "SELECT p_partkey, LENGTH(p_name) AS n, LEN(p_brand) AS m, UPPER(p_name) AS u, LOWER(p_type) AS l, SUBSTR(p_name, 2, 4) AS s, SUBSTR(p_name, 3) AS e, TRIM('  ' || p_name || ' ') AS t, LTRIM(p_name, 'rs') AS lt, RTRIM(p_name, 'tg') AS rt, REPLACE(p_name, 'e', '**') AS r, INSTR(p_name, 'e') AS i FROM part",
    "SELECT p_partkey, length(p_name) AS n, length(p_brand) AS m, upper(p_name) AS u, lower(p_type) AS l, substring(p_name, 2, 4) AS s, substring(p_name, 3) AS e, p_name AS t, ltrim(p_name, 'rs') AS lt, rtrim(p_name, 'tg') AS rt, replace(p_name, 'e', '**') AS r, instr(p_name, 'e') AS i FROM part",
)
ask(
    "sql_fn_codes", "part", "SELECT p_partkey, HEX(p_name) AS h, QUOTE('it''s ' || p_name) AS q, QUOTE(p_size) AS z, UNICODE(p_name) AS u, CHAR(p_size + 64, 233, 128512) AS c, PRINTF('%d:%s|%f%%', p_size, p_name, p_retailprice) AS f, HEX(ZEROBLOB(2)) AS b FROM part",
    "SELECT p_partkey, hex(p_name) AS h, '''it''''s ' || p_name || '''' AS q, CAST(p_size AS VARCHAR) AS z, CAST(unicode(p_name) AS BIGINT) AS u, chr(p_size + 64) || 'é😀' AS c, p_size || ':' || p_name || '|' || printf('%.6f', p_retailprice) || '%' AS f, '0000' AS b FROM part",
)
ask(
    "sql_fn_math", "customer", "SELECT c_custkey, ABS(c_acctbal) AS a, ROUND(c_acctbal) AS r, ROUND(c_acctbal, 1) AS d, RANDOM() IS NOT NULL AS x, ABS('x') AS none FROM customer",
    "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal) AS r, round(c_acctbal, 1) AS d, CAST(1 AS BIGINT) AS x, CAST(NULL AS BIGINT) AS none FROM customer",
)
ask(
    "sql_fn_json", "events", "SELECT event_id, CAST(JSON_EXTRACT(props, '$.k') AS INTEGER) AS k, JSON_EXTRACT(props, '$.none') AS missing, JSON_TYPE(props, '$.k') AS t, JSON_TYPE(props) AS o, JSON_VALID(props) AS v, JSON_VALID('{') AS w, JSON_ARRAY_LENGTH('[1,2,3]') AS n, JSON(props) AS small FROM events",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing, 'integer' AS t, 'object' AS o, CAST(1 AS BIGINT) AS v, CAST(0 AS BIGINT) AS w, CAST(3 AS BIGINT) AS n, replace(props, ' ', '') AS small FROM events",
)
ask(
    "sql_fn_json_build", "nation", "SELECT n_nationkey, JSON_ARRAY(n_nationkey, n_name, NULL, 1.5) AS a, JSON_OBJECT('n', n_name, 'k', n_regionkey) AS o FROM nation",
    "SELECT n_nationkey, '[' || n_nationkey || ',\"' || n_name || '\",null,1.5]' AS a, '{\"n\":\"' || n_name || '\",\"k\":' || n_regionkey || '}' AS o FROM nation",
)
ask(
    "sql_fn_date", "orders", "SELECT o_orderkey, DATE(o_orderdate, '+1 month') AS m, DATE(o_orderdate, 'start of year', '-3 days') AS y, DATETIME(o_orderdate, '+2 years') AS t, TIME(o_orderdate) AS c, STRFTIME('%Y/%m/%d %j %w', o_orderdate) AS f, JULIANDAY(o_orderdate) AS j, DATE('nope') AS none FROM orders",
    "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS m, strftime(date_trunc('year', o_orderdate) - INTERVAL 3 DAY, '%Y-%m-%d') AS y, strftime(o_orderdate + INTERVAL 2 YEAR, '%Y-%m-%d %H:%M:%S') AS t, strftime(o_orderdate, '%H:%M:%S') AS c, strftime(o_orderdate, '%Y/%m/%d %j %w') AS f, epoch_us(o_orderdate) / 86400000000.0::DOUBLE + 2440587.5::DOUBLE AS j, CAST(NULL AS VARCHAR) AS none FROM orders",
)

# changes
_NATIONS = "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, region INTEGER DEFAULT 9); INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation; "
_T = "CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region"
ask("sql_insert_defaults", "nation", "SELECT * FROM t", f"SELECT {_T} FROM nation UNION ALL VALUES (40, 'a', 9), (41, 'b', NULL), (42, 'c', 9)", _NATIONS + "INSERT INTO t (id, name) VALUES (40, 'a'); INSERT INTO t (name, region) VALUES ('b', NULL); INSERT INTO t (name) SELECT 'c'")
ask(
    "sql_rowids", "customer", "SELECT id, name FROM t", "SELECT row_number() OVER (ORDER BY c_custkey) AS id, c_name AS name FROM customer",
    "CREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT); INSERT INTO t (name) SELECT c_name FROM customer ORDER BY c_custkey",
)
ask(
    "sql_or_replace", "nation", "SELECT * FROM t",
    "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS u, CAST(n_regionkey AS BIGINT) AS v FROM nation WHERE n_nationkey NOT IN (3, 5, 7) UNION ALL VALUES (30, NULL, 1), (31, NULL, 2), (3, 'z', 8), (32, 'NATION_5', 4), (33, 'same', 6)",
    "CREATE TABLE t (id INTEGER PRIMARY KEY, u TEXT UNIQUE, v INTEGER); INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation; INSERT OR REPLACE INTO t VALUES (30, NULL, 1), (31, NULL, 2); INSERT OR REPLACE INTO t VALUES (3, 'y', 7), (3, 'z', 8), (32, 'NATION_5', 4); REPLACE INTO t VALUES (7, 'same', 5), (33, 'same', 6)",
)
ask(
    "sql_update_subquery", "nation region", "SELECT * FROM t",
    "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_regionkey IN (2, 3) THEN lower(n_name) ELSE n_name END AS name, CAST(CASE WHEN n_regionkey IN (2, 3) THEN n_nationkey + n_regionkey ELSE n_regionkey END AS BIGINT) AS region FROM nation WHERE n_regionkey <> 0",
    _NATIONS + "UPDATE t SET name = LOWER(name), region = id + region WHERE region IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE')); DELETE FROM t WHERE region = (SELECT MIN(r_regionkey) FROM region)",
)
ask("sql_returning", "nation", "UPDATE t SET region = region * 10 WHERE id < 5 RETURNING id, region AS r, name || '!'", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey * 10 AS BIGINT) AS r, n_name || '!' AS \"name || '!'\" FROM nation WHERE n_nationkey < 5", _NATIONS)
ask("sql_delete_returning", "nation", "DELETE FROM t WHERE region > 2 RETURNING *", f"SELECT {_T} FROM nation WHERE n_regionkey > 2", _NATIONS)
ask(
    "sql_generated", "nation", "SELECT * FROM g", "SELECT CAST(n_nationkey + 1 AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b, CAST(n_nationkey + 1 + n_regionkey AS BIGINT) AS s, CAST((n_nationkey + 1) * n_regionkey AS BIGINT) AS v FROM nation",
    "CREATE TABLE g (a INTEGER, b INTEGER, s INTEGER GENERATED ALWAYS AS (a + b) STORED, v INTEGER AS (a * b)); INSERT INTO g (a, b) SELECT n_nationkey, n_regionkey FROM nation; UPDATE g SET a = a + 1",
)
ask(
    "sql_alter", "nation", "SELECT * FROM u", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS label, CASE WHEN n_nationkey = 1 THEN NULL WHEN n_nationkey = 2 THEN 'Y' ELSE 'X' END AS city FROM nation UNION ALL VALUES (50, 'new', NULL), (-5, 'low', NULL)",
    _NATIONS + "ALTER TABLE t ADD COLUMN city TEXT DEFAULT 'X'; ALTER TABLE t RENAME COLUMN name TO label; ALTER TABLE t DROP COLUMN region; ALTER TABLE t RENAME TO u; UPDATE u SET city = NULL WHERE id = 1; UPDATE u SET city = 'Y' WHERE id = 2; INSERT INTO u VALUES (50, 'new', NULL), (-5, 'low', NULL)",
)
ask("sql_view", "nation", "SELECT who, n FROM v JOIN (SELECT COUNT(*) AS n FROM v) x WHERE r = 1", "SELECT n_name AS who, (SELECT count(*) FROM nation WHERE n_regionkey < 3) AS n FROM nation WHERE n_regionkey = 1", _NATIONS + "CREATE VIEW v(who, r) AS WITH w AS (SELECT name, region FROM t WHERE region < 3) SELECT name, region FROM w")
ask(
    "sql_trigger", "nation", "SELECT what, COUNT(*) AS n FROM log GROUP BY what", "SELECT * FROM (VALUES ('gone', CAST(1 AS BIGINT)), ('renamed', 1), ('instead', 1)) v(what, n)",
    _NATIONS
    + "CREATE TABLE log (id INTEGER PRIMARY KEY, what TEXT); CREATE VIEW v AS SELECT * FROM t; CREATE TRIGGER a AFTER DELETE ON t BEGIN INSERT INTO log (what) VALUES ('gone'); END; CREATE TRIGGER b AFTER UPDATE OF name ON t BEGIN INSERT INTO log (what) VALUES ('renamed'); END;"
    " CREATE TRIGGER c BEFORE DELETE ON t WHEN 1 = 0 BEGIN INSERT INTO log (what) VALUES ('never'); END; CREATE TRIGGER d INSTEAD OF INSERT ON v BEGIN INSERT INTO log (what) VALUES ('instead'); END;"
    " DELETE FROM t WHERE id = 1; UPDATE t SET region = 1; UPDATE t SET name = 'x' WHERE id = 2; INSERT INTO v VALUES (1, 'a', 2)",
)
ask("sql_transaction", "nation", "SELECT * FROM t", f"SELECT {_T} FROM nation WHERE n_nationkey <> 4", _NATIONS + "BEGIN; DELETE FROM t; CREATE TABLE other (a INTEGER); ROLLBACK; BEGIN TRANSACTION; DELETE FROM t WHERE id = 4; COMMIT; VACUUM; ATTACH DATABASE '/x' AS y; DETACH y")
ask(
    "sql_create_as_drop", "nation", "SELECT rowid, region, n FROM s", "SELECT row_number() OVER (ORDER BY n_regionkey) AS rowid, CAST(n_regionkey AS BIGINT) AS region, count(*) AS n FROM nation GROUP BY n_regionkey",
    _NATIONS + "CREATE TABLE s AS SELECT region, COUNT(*) AS n FROM t GROUP BY region ORDER BY region; CREATE UNIQUE INDEX i ON s (region); DROP INDEX i; DROP TABLE t; DROP TABLE IF EXISTS t; CREATE TABLE IF NOT EXISTS s (x)",
)
ask("sql_column_collation", "region", "SELECT id FROM c WHERE name = 'ASIA' OR name IN ('europe') ORDER BY name", "SELECT CAST(r_regionkey AS BIGINT) AS id FROM region WHERE r_name IN ('ASIA', 'EUROPE')", "CREATE TABLE c (id INTEGER PRIMARY KEY, name TEXT COLLATE NOCASE UNIQUE); INSERT INTO c SELECT r_regionkey, LOWER(r_name) FROM region; INSERT OR REPLACE INTO c SELECT r_regionkey, r_name FROM region")
ask("sql_pragma_table_info", "", "PRAGMA table_info(t)", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'id', 'INTEGER', CAST(1 AS BIGINT), CAST(NULL AS VARCHAR), CAST(1 AS BIGINT)), (1, 'name', 'TEXT', 1, NULL, 0), (2, 'x', 'REAL', 0, NULL, 0)) v(cid, name, type, \"notnull\", dflt_value, pk)", "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, x REAL)")
ask("sql_pragma_indexes", "", "PRAGMA index_info(i)", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(1 AS BIGINT), 'name'), (1, 0, 'id')) v(seqno, cid, name)", "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT); CREATE INDEX i ON t (name, id)")

# full text and boxes
_FTS = "CREATE VIRTUAL TABLE d USING fts5(name, type); INSERT INTO d SELECT p_name, p_type FROM part ORDER BY p_partkey; CREATE VIRTUAL TABLE d_x USING fts5(name); INSERT INTO d_x SELECT p_brand FROM part ORDER BY p_partkey; "
_N = "row_number() OVER (ORDER BY p_partkey)"
ask("sql_fts_match", "part", "SELECT rowid, name FROM d WHERE d MATCH 'RING small'", f"SELECT rowid, name FROM (SELECT {_N} AS rowid, p_name AS name, p_type FROM part) WHERE name LIKE '%ring%' AND (name LIKE '%small%' OR p_type = 'SMALL')", _FTS)
ask("sql_fts_function", "part", "SELECT rowid FROM d('bolt')", f"SELECT rowid FROM (SELECT {_N} AS rowid, p_name FROM part) WHERE p_name LIKE '%bolt%'", _FTS)
ask("sql_fts_two_tables", "part", "SELECT d.rowid AS a, d_x.name AS b FROM d JOIN d_x ON d.rowid = d_x.rowid WHERE d MATCH 'gear'", f"SELECT a, b FROM (SELECT {_N} AS a, p_brand AS b, p_name FROM part) WHERE p_name LIKE '%gear%'", _FTS)
ask("sql_fts_or", "part", "SELECT rowid FROM d WHERE d MATCH 'gear' OR rowid <= 3", f"SELECT rowid FROM (SELECT {_N} AS rowid, p_name FROM part) WHERE p_name LIKE '%gear%' OR rowid <= 3", _FTS)
ask(
    "sql_fts_rank", "part", "SELECT rowid, ROUND(bm25(d), 6) AS score, ROUND(rank, 6) AS rank FROM d WHERE d MATCH 'ring'",
    f"WITH t AS (SELECT {_N} AS rowid, string_split(lower(p_name || ' ' || p_type), ' ') AS w FROM part), c AS (SELECT rowid, len(w) AS dl, len(list_filter(w, lambda x: x = 'ring')) AS tf FROM t), s AS (SELECT count(*) AS n, avg(dl) AS adl, count(*) FILTER (tf > 0) AS df FROM c)"
    " SELECT rowid, round(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / adl)), 6) AS score, round(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / adl)), 6) AS rank FROM c, s WHERE tf > 0",
    _FTS,
)
ask(
    "sql_fts_marks", "part", "SELECT rowid, highlight(d, 0, '<', '>') AS h, snippet(d, 0, '[', ']', '...', 1) AS s FROM d WHERE d MATCH 'ring'",
    f"SELECT rowid, replace(p_name, 'ring', '<ring>') AS h, '...[ring]' AS s FROM (SELECT {_N} AS rowid, p_name FROM part) WHERE p_name LIKE '% ring'", _FTS,
)
ask("sql_fts_star", "part", "SELECT * FROM d WHERE rowid < 4", f"SELECT name, type, CAST(0 AS DOUBLE) AS rank FROM (SELECT {_N} AS rowid, p_name AS name, p_type AS type FROM part) WHERE rowid < 4", _FTS)
ask("sql_fts_delete", "part", "SELECT COUNT(*) AS n FROM d", "SELECT count(*) AS n FROM (SELECT row_number() OVER (ORDER BY p_partkey) AS rowid, p_name FROM part) WHERE p_name NOT LIKE '%ring%' AND rowid <> 5", _FTS + "DELETE FROM d WHERE d MATCH 'ring'; DELETE FROM d WHERE rowid = 5")
_BOX = "CREATE VIRTUAL TABLE r USING rtree(id, x0, x1, y0, y1); INSERT INTO r SELECT p_partkey, p_size - 1, p_size + 1, p_retailprice - 5, p_retailprice + 5 FROM part; "
ask("sql_rtree", "part", "SELECT id, x0 FROM r WHERE x0 <= 20 AND x1 >= 10 AND y0 <= 915 AND y1 >= 905 AND id <> 7", "SELECT p_partkey AS id, CAST(p_size - 1 AS DOUBLE) AS x0 FROM part WHERE p_size - 1 <= 20 AND p_size + 1 >= 10 AND p_retailprice - 5 <= 915 AND p_retailprice + 5 >= 905 AND p_partkey <> 7", _BOX)
ask("sql_rtree_change", "part", "SELECT COUNT(*) AS n, MIN(x0) AS low FROM r", "SELECT count(*) AS n, CAST(-3 AS DOUBLE) AS low FROM part WHERE p_size <= 40 OR p_partkey = 0", _BOX + "INSERT INTO r VALUES (0, -3, -2, 0, 1); DELETE FROM r WHERE x1 > 41")
