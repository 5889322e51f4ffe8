"""Every registered query that has SQL for another engine gives that engine's rows."""

import duckdb
import pytest

from brindle.plans import registry, relational  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cur = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    at = [columns.index(c) for c in sorted(columns)]
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}
    own = {d[0]: str(d[1]) for d in cur.description}
    if name.startswith("sql_"):
        assert {c: kinds[k] for c, k in df.dtypes} == own
    got = df.select(*sorted(columns)).collect()
    assert got or not name.startswith("sql_")
    assert shown(map(tuple, got)) == shown(tuple(r[i] for i in at) for r in cur.fetchall())


def test_filter_reaches_the_scan(spark, sf):
    plan = registry.QUERIES["filter_range_pushdown"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey)" in plan.replace("\n", "") or "GreaterThanOrEqual(l_orderkey,200)" in plan
    assert "l_comment" not in plan


def test_streaming_matches_batch(spark, sf, tmp_path):
    from brindle.streaming.windows import tumbling

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.withColumn("ts", events.ts.cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    stream = tumbling(spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in")), "1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    assert shown(map(tuple, spark.table("tumbled").collect())) == shown(map(tuple, tumbling(stored, "1 hour").collect()))


def test_overlap_join_deals_out_a_dense_cell(spark, monkeypatch):
    """Equal, touching, wide, reversed, endless and boundless boxes, ids twice and null: each pair once, and no task makes most of them."""
    from pyspark.sql import functions as F

    from brindle.operators import boxes

    monkeypatch.setattr(boxes, "BLOCK", 4, raising=False)
    monkeypatch.setattr(boxes, "STRIPE", 20, raising=False)
    same = [(i, 1.0, 3.0, 2.0, 8.0) for i in range(90)]
    near = [(i, i % 5 / 2, i % 5 / 2 + 1, i % 7 * 1.0, i % 7 + 1.0) for i in range(80, 150)]
    inf, nan = float("inf"), float("nan")
    odd = [(200, -25.0, 35.0, -5.0, 15.0), (201, 3.0, 3.0, 8.0, 8.0), (202, 4.0, 2.0, 4.0, 2.0), (203, None, 3.0, 2.0, 8.0), (None, 1.0, 3.0, 2.0, 8.0), (204, inf, inf, 2.0, 8.0), (205, inf, inf, 8.0, 9.0), (206, 1.0, 3.0, nan, nan), (207, -0.0, 0.0, 0.0, -0.0), (208, 10.0, 10.0, 0.0, 10.0)]
    kind = "id bigint, x0 double, x1 double, y0 double, y1 double"
    left, right = spark.createDataFrame(same + near + odd, kind), spark.createDataFrame(near + odd + same[:30], kind)
    for a, b in ((left, left), (left, right), (right, left), (left, right.limit(0))):
        got = boxes.overlap_join(a, b, ("x0", "x1"), ("y0", "y1"), 10.0).withColumn("task", F.spark_partition_id()).collect()
        a.createOrReplaceTempView("box_a")
        b.createOrReplaceTempView("box_b")
        want = spark.sql("SELECT a.id, b.id FROM box_a a, box_b b WHERE a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1").collect()
        assert shown((r.left_id, r.right_id) for r in got) == shown(map(tuple, want))
        tasks = [r.task for r in got]
        assert all(2 * tasks.count(t) < len(tasks) for t in set(tasks))
