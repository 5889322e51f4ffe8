"""Queries for each relational operator: scans, filters, joins, aggregates, windows, sets, CTEs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.plans.dialect_queries import database
from brindle.plans.registry import ORACLE_SQL, QUERIES, query, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def shared(name: str, sql: str, oracle: str | None = None) -> None:
    """A query whose text both engines take; oracle where the other engine spells it in another way."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    text = sql
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN|,) {t}\b(?! AS)", rf"\1 {{{t}}} AS {t}", text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used if f"{{{t}}}" in text})

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or sql


# projection, filter, predicates
shared("project_arithmetic", "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS x, -l_quantity AS neg, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 45")
shared("filter_range_pushdown", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey >= 200 AND l_orderkey < 900 AND l_discount BETWEEN 0.03 AND 0.07")
shared("filter_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 500")
shared("filter_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('P')")
shared("filter_like", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%0000001%'")
shared("filter_or_not", "SELECT p_partkey FROM part WHERE NOT (p_size < 10 OR p_size > 40) AND p_retailprice IS NOT NULL")
shared("case_searched_simple", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS code FROM lineitem WHERE l_linenumber = 1")
shared("null_logic", "SELECT n_nationkey, nullif(n_regionkey, 1) AS r, nullif(n_regionkey, 1) IS NULL AS gone, coalesce(nullif(n_regionkey, 1), 99) AS filled, (nullif(n_regionkey, 1) > 2) AS big FROM nation")
shared("cast_types", "SELECT p_partkey, CAST(p_retailprice AS VARCHAR(40)) LIKE '9%' AS nine, CAST(p_size AS DOUBLE) / 4 AS quarter, CAST(p_partkey AS INTEGER) AS k FROM part")
shared("integer_division", "SELECT o_orderkey, o_custkey div 7 AS q, o_custkey % 7 AS r FROM orders", "SELECT o_orderkey, o_custkey // 7 AS q, o_custkey % 7 AS r FROM orders")
shared("bitwise", "SELECT c_custkey, c_custkey & 7 AS a, c_custkey | 8 AS o, shiftleft(c_custkey, 2) AS l, shiftright(c_custkey, 1) AS r FROM customer", "SELECT c_custkey, c_custkey & 7 AS a, c_custkey | 8 AS o, c_custkey << 2 AS l, c_custkey >> 1 AS r FROM customer")
shared("constant_select", "SELECT CAST(1 AS BIGINT) AS one, 'x' AS x, CAST(NULL AS VARCHAR(3)) AS n")
shared("scalar_subquery", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
shared("exists_correlated", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
shared("not_exists_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
shared("in_subquery", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
shared("not_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
shared("derived_table", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE n > 15")

# joins
shared("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
shared("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
shared("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey")
shared("join_full", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
shared("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
shared("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey".replace("nation a", "nation AS a").replace("nation b", "nation AS b"))
shared("join_using", "SELECT n_nationkey, n, m FROM (SELECT s_nationkey AS n_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) x JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS m FROM customer GROUP BY c_nationkey) y USING (n_nationkey)")
shared("join_three_way", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
QUERIES["join_theta"] = lambda spark, sf_dir: spark.sql("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {n} a JOIN {n} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", n=table(spark, sf_dir, "nation"))

# aggregates
shared("agg_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS price, min(l_discount) AS low, max(l_tax) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus")
shared("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders")
shared("agg_empty_input", "SELECT count(*) AS n, sum(o_totalprice) AS total, coalesce(sum(o_totalprice), 0) AS filled FROM orders WHERE o_orderkey < 0")
shared("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND max(o_totalprice) > 200000")
shared("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
shared("agg_expression_key", "SELECT l_quantity > 25 AS big, round(avg(l_discount) * 100, 3) AS pct FROM lineitem GROUP BY l_quantity > 25")
shared("agg_case", "SELECT sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o FROM orders", "SELECT CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o FROM orders")
shared("agg_group_concat", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
shared("agg_total", "SELECT c_mktsegment, coalesce(round(sum(CASE WHEN c_acctbal > 9990 THEN c_acctbal END), 2), 0) AS total FROM customer GROUP BY c_mktsegment")
shared("agg_first_row", "SELECT o_custkey, min_by(o_orderpriority, o_orderkey) AS first_priority, count(*) AS n FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_priority, count(*) AS n FROM orders GROUP BY o_custkey")
shared("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")

# windows
shared("window_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
shared("window_rank_ties", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d FROM part")
shared("window_lag_lead", "SELECT o_orderkey, lag(o_totalprice, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_totalprice, 2, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders", "SELECT o_orderkey, lag(o_totalprice, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_totalprice, 2, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders")
shared("window_running_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running FROM events")
shared("window_moving_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS moving, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM events")
shared("window_first_last", "SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_key, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key FROM orders")
shared("window_partition_totals", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")

# sort, limit, distinct, sets
shared("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
shared("sort_limit_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 7 OFFSET 5")
shared("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
shared("set_union_all", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey AS k FROM customer")
shared("set_union", "SELECT s_nationkey AS k FROM supplier UNION SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2")
shared("set_intersect", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey AS k FROM customer")
shared("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 9000")
shared("set_left_associative", "(SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey AS k FROM supplier) INTERSECT SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000")

# CTEs
shared("cte_chain", "WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey FROM spent WHERE s > 1500000) SELECT c_name FROM customer JOIN top ON c_custkey = o_custkey")
shared("cte_recursive_counter", "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 60) SELECT n FROM c")
shared("cte_recursive_fibonacci", "WITH RECURSIVE f(a, b, k) AS (SELECT CAST(0 AS BIGINT), CAST(1 AS BIGINT), 1 UNION ALL SELECT b, a + b, k + 1 FROM f WHERE k < 40) SELECT a FROM f")


@query("WITH RECURSIVE reach(k) AS (SELECT 1 UNION SELECT (k * 7 + 3) % 50 FROM reach) SELECT CAST(k AS BIGINT) AS k FROM reach")
def recursive_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursion with UNION: rows found before are dropped, so the cycle ends."""
    from brindle.operators.recursion import recursive_union

    return recursive_union(spark.range(1, 2, 1, 1).select(F.col("id").alias("k")), lambda new: new.select(((F.col("k") * 7 + 3) % 50).alias("k")))


# scalar functions
shared("fn_string", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, substring(p_name, 2, 4) AS s, replace(p_type, 'A', '*') AS r, trim(concat('  ', p_brand, ' ')) AS t, CAST(length(p_name) AS BIGINT) AS n, CAST(instr(p_name, 'a') AS BIGINT) AS i, concat(p_brand, '-', p_type) AS c FROM part")
shared("fn_math", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal) AS r, greatest(c_acctbal, 0.0) AS g, least(c_custkey, 10) AS l, CAST(floor(c_acctbal / 7) AS BIGINT) AS f FROM customer")
shared("fn_hex_quote", "SELECT n_nationkey, hex(n_name) AS h, concat('''', replace(n_name, 'A', 'a'), '''') AS q, CAST(ascii(n_name) AS BIGINT) AS u FROM nation")
shared("fn_date", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS d, date_format(add_months(o_orderdate, 1), 'yyyy-MM-dd') AS m, date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd') AS s, CAST(dayofyear(o_orderdate) AS BIGINT) AS j, CAST(dayofweek(o_orderdate) - 1 AS BIGINT) AS w FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS m, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS s, dayofyear(o_orderdate) AS j, dayofweek(o_orderdate) AS w FROM orders")
shared("fn_julian_day", "SELECT o_orderkey, unix_micros(CAST(o_orderdate AS TIMESTAMP)) / 86400000000.0D + 2440587.5D AS jd FROM orders", "SELECT o_orderkey, epoch_us(o_orderdate) / 86400000000.0::DOUBLE + 2440587.5::DOUBLE AS jd FROM orders")
shared("fn_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, CAST(get_json_object(props, '$.none') AS BIGINT) AS missing, try_parse_json(props) IS NOT NULL AS valid FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.none') AS BIGINT) AS missing, json_valid(props) AS valid FROM events")
shared("fn_json_build", "SELECT n_nationkey, concat('[', n_nationkey, ',', to_json(named_struct('n', n_name)), ']') AS j FROM nation", "SELECT n_nationkey, '[' || n_nationkey || ',{\"n\":\"' || n_name || '\"}]' AS j FROM nation")

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_'']+')"


def _bm25_sql(terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    idf = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / adl))" for i in range(len(terms)))
    return (
        f"WITH t AS (SELECT doc_id, list_filter(list_transform({_WORDS}, lambda x: trim(x, '''_')), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, len(w) AS dl, {tf} FROM t),"
        f" s AS (SELECT count(*) AS n, avg(dl) AS adl, {idf} FROM c) SELECT doc_id, round({score}, 6) AS rank FROM c, s WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(terms)))}"
    )


@query(_bm25_sql(["license", "version"]))
def fts_match_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.operators.full_text import match

    return match(table(spark, sf_dir, "documents"), "doc_id", ["text"], "license version").withColumn("rank", F.round("rank", 6))


@query("SELECT doc_id, regexp_replace(text, '(^|\\s)(\\S*\\blicense\\b\\S*)', '\\1<b>\\2</b>', 'gi') AS marked FROM documents WHERE text ILIKE '%license%'")
def fts_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.operators.full_text import highlight

    rows = table(spark, sf_dir, "documents").where(F.col("text").ilike("%license%"))
    return rows.select("doc_id", highlight(F.col("text"), "license", "<b>", "</b>").alias("marked"))


_BOXES = "SELECT p_partkey AS id, p_size - 1.0 AS x0, p_size + 1.0 AS x1, p_retailprice - 5 AS y0, p_retailprice + 5 AS y1 FROM part"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") - 1.0).alias("x0"), (F.col("p_size") + 1.0).alias("x1"), (F.col("p_retailprice") - 5).alias("y0"), (F.col("p_retailprice") + 5).alias("y1"))


@query(f"SELECT id FROM ({_BOXES}) WHERE x0 <= 20 AND x1 >= 10 AND y0 <= 915 AND y1 >= 905")
def rtree_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.operators.boxes import overlaps

    return _boxes(spark, sf_dir).where(overlaps([(10, 20), (905, 915)], [("x0", "x1"), ("y0", "y1")])).select("id")


@query(f"WITH b AS ({_BOXES}) SELECT l.id AS left_id, r.id AS right_id FROM b l JOIN b r ON l.x0 <= r.x1 AND r.x0 <= l.x1 AND l.y0 <= r.y1 AND r.y0 <= l.y1 WHERE l.id < r.id")
def rtree_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equi-join on grid cells instead of a nested loop."""
    from brindle.operators.boxes import overlap_join

    boxes = _boxes(spark, sf_dir)
    return overlap_join(boxes, boxes, ("x0", "x1"), ("y0", "y1"), 10.0).where("left_id < right_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.streaming.windows import tumbling

    return tumbling(table(spark, sf_dir, "events"), "1 hour")


# the database layer: each query runs statements on a private copy
def _with_table(spark: SparkSession, sf_dir: str, name: str, sql: str, key: str):
    db = database(spark)
    view = f"src_{db.prefix}"
    table(spark, sf_dir, name).createOrReplaceTempView(view)
    db.execute(sql)
    db.execute(f"INSERT INTO t SELECT {key} FROM {view}")
    return db


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS name, CAST(CASE WHEN n_regionkey = 1 THEN n_regionkey + 10 ELSE n_regionkey END AS BIGINT) AS region FROM nation WHERE n_regionkey <> 3")
def dml_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _with_table(spark, sf_dir, "nation", "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, region INTEGER)", "n_nationkey, n_name, n_regionkey")
    db.execute("UPDATE t SET name = UPPER(name) || '!', region = region + 10 WHERE region = 1; DELETE FROM t WHERE region = 3; BEGIN; DELETE FROM t; ROLLBACK")
    return db.query("SELECT id, name, region FROM t").df.withColumn("id", F.col("id").cast("int"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey < 3 THEN 'new' ELSE n_name END AS name FROM nation UNION ALL SELECT 100, 'added'")
def dml_insert_or_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _with_table(spark, sf_dir, "nation", "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)", "n_nationkey, n_name")
    db.execute("INSERT OR REPLACE INTO t VALUES (0, 'new'), (1, 'new'), (2, 'new'), (100, 'added')")
    return db.query("SELECT id, name FROM t").df.withColumn("id", F.col("id").cast("int"))


@query("SELECT c_nationkey AS nation, count(*) AS n, round(sum(c_acctbal * 0.1), 2) AS tax FROM customer GROUP BY c_nationkey")
def dialect_generated_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _with_table(spark, sf_dir, "customer", "CREATE TABLE t (id INTEGER PRIMARY KEY, nation INTEGER, bal REAL, tax REAL GENERATED ALWAYS AS (bal * 0.1) STORED)", "c_custkey, c_nationkey, c_acctbal")
    return db.query("SELECT nation, COUNT(*) AS n, ROUND(SUM(tax), 2) AS tax FROM t GROUP BY nation").df.withColumn("nation", F.col("nation").cast("int"))


def top_per_group(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key; Spark limits each group before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= n)


@query("SELECT c_mktsegment, c_custkey, rn FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3")
def window_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per_group(table(spark, sf_dir, "customer"), "c_mktsegment", [F.desc("c_acctbal"), "c_custkey"], 3).select("c_mktsegment", "c_custkey", F.col("rn").cast("long").alias("rn"))


for _name in ("window_row_number",):
    _run = QUERIES[_name]
    QUERIES[_name] = lambda spark, sf_dir, run=_run: run(spark, sf_dir).withColumn("rn", F.col("rn").cast("long"))
