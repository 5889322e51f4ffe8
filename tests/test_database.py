"""The dialect over copy-on-write tables."""

import pytest

from brindle.database import Database
from brindle.errors import BrindleError, CatalogError, ConstraintError, ParseError, TransactionError


@pytest.fixture
def db(spark, tmp_path):
    d = Database(spark, str(tmp_path / "db"))
    yield d
    d.close()


@pytest.fixture
def users(db):
    db.execute("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, age INTEGER); INSERT INTO users (name, age) VALUES ('Alice', 30), ('Bob', '25'), ('O''Hara', NULL)")
    return db


def rows(db, sql, *params):
    return [tuple(r) for r in db.query(sql, params)]


SCALARS = [
    ("7 / 2", 3), ("-7 / 2", -3), ("7 / 2.0", 3.5), ("1 / 0", None), ("7 % 3", 1), ("'5' = 5", 0), ("'a' || 1.0", "a1"), ("NULL || 'x'", None), ("6 & 3", 2), ("1 << 4", 16), ("~5", -6),
    ("'HELLO' LIKE 'h%'", 1), ("2 BETWEEN 1 AND 3", 1), ("3 NOT IN (1, 2)", 1), ("NULL IS NULL", 1), ("CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END", "b"), ("CAST('12' AS INTEGER)", 12), ("CAST(3.7 AS TEXT)", "3.7"),
    ("LENGTH('héllo')", 5), ("SUBSTR('hello', 0, 3)", "hel"), ("SUBSTR('hello', 2)", "ello"), ("TRIM(' a\t')", "a"), ("REPLACE('abc', 'b', 'x')", "axc"), ("INSTR('abc', 'c')", 3), ("HEX('ab')", "6162"), ("HEX(26)", "3236"),
    ("QUOTE('it''s')", "'it''s'"), ("QUOTE(NULL)", "NULL"), ("UNICODE('é')", 233), ("CHAR(72, 128512)", "H\U0001f600"), ("PRINTF('%d-%s-%f%%', 3, 'x', 1.5)", "3-x-1.500000%"), ("ABS(-3)", 3), ("ABS('x')", None), ("ROUND(2.5)", 3.0),
    ("MAX(1, 3, 2)", 3), ("MIN(4, 2)", 2), ("COALESCE(NULL, 2)", 2), ("IFNULL(NULL, 'x')", "x"), ("NULLIF(1, 1)", None), ("IIF(1 > 2, 'a', 'b')", "b"), ("TYPEOF(1.5)", "real"), ("TYPEOF(NULL)", "null"),
    ("JSON_EXTRACT('{\"a\":[1,{\"b\":\"x\"}]}', '$.a[1].b')", "x"), ("JSON_TYPE('{\"a\":1.5}', '$.a')", "real"), ("JSON_ARRAY(1, 'a', NULL)", '[1,"a",null]'), ("JSON_OBJECT('k', 2)", '{"k":2}'), ("JSON_ARRAY_LENGTH('[1,2]')", 2), ("JSON_VALID('{')", 0), ("JSON(' {\"b\": 1, \"a\": [ 1 ]}')", '{"b":1,"a":[1]}'),
    ("DATE('2024-01-31', '+1 month')", "2024-02-29"), ("DATETIME('2024-03-01 12:34:56', 'start of month')", "2024-03-01 00:00:00"), ("STRFTIME('%Y-%j', '2024-03-01')", "2024-061"), ("JULIANDAY('2000-01-01')", 2451544.5), ("DATE('nope')", None), ("TIME('2024-01-01T01:02:03')", "01:02:03"),
    ("0.1 + 0.2 || ''", "0.30000000000000004"), ("10000000000.0 || ''", "10000000000"), ("1 + 2 * 3", 7), ("TRUE", 1), ("X'6162' IS NOT NULL", 1), ("ZEROBLOB(2) = X'0000'", 1),
]


def test_scalars(db):
    got = db.query("SELECT " + ", ".join(f"{e} AS c{i}" for i, (e, _) in enumerate(SCALARS)))[0]
    assert [(e, v) for (e, _), v in zip(SCALARS, got, strict=True)] == SCALARS


def test_crud(users):
    assert rows(users, "SELECT * FROM users ORDER BY id") == [(1, "Alice", 30), (2, "Bob", 25), (3, "O'Hara", None)]
    assert users.query("SELECT NAME FROM users WHERE id = ?", [2])[0].get("Name") == "Bob"
    assert users.execute("UPDATE users SET age = age + 1 WHERE id <= 2") == 2
    assert users.execute("INSERT OR REPLACE INTO users VALUES (2, 'Bobby', 1)") == 1
    assert rows(users, "DELETE FROM users WHERE age IS NULL RETURNING id") == [(3,)]
    assert rows(users, "INSERT INTO users (name) VALUES ('Z') RETURNING id, name") == [(4, "Z")]
    assert rows(users, "SELECT id, name, age FROM users ORDER BY id DESC LIMIT 2 OFFSET 1") == [(2, "Bobby", 1), (1, "Alice", 31)]


def test_constraints_leave_no_trace(users):
    for bad in ("INSERT INTO users VALUES (1, 'x', 1)", "INSERT INTO users VALUES (8, 'y', 1), (9, NULL, 1)", "INSERT INTO users VALUES (9, 'x', 'abc')", "UPDATE users SET name = NULL"):
        with pytest.raises(ConstraintError):
            users.execute(bad)
    users.execute("CREATE UNIQUE INDEX i ON users (name)")
    with pytest.raises(ConstraintError):
        users.execute("INSERT INTO users (name) VALUES ('Alice')")
    assert rows(users, "SELECT COUNT(*) FROM users") == [(3,)]
    with pytest.raises(CatalogError):
        users.execute("CREATE TABLE users (x)")
    with pytest.raises(ParseError):
        users.query("SELECT FROM WHERE")
    with pytest.raises(BrindleError):
        users.query("SELECT nope FROM users")


def test_transactions_and_reopening(spark, users, tmp_path):
    users.execute("BEGIN; DELETE FROM users; CREATE TABLE t2 (a INTEGER); ROLLBACK")
    assert rows(users, "SELECT COUNT(*) FROM users") == [(3,)]
    with pytest.raises(CatalogError):
        users.query("SELECT * FROM t2")
    users.execute("BEGIN; DELETE FROM users WHERE id = 1; COMMIT; CREATE VIEW v AS SELECT name FROM users")
    with pytest.raises(TransactionError):
        users.execute("COMMIT")
    again = Database(spark, str(users.store.path))
    assert rows(again, "SELECT COUNT(*) FROM v") == [(2,)]


def test_alter_generated_default(users):
    users.execute("ALTER TABLE users ADD COLUMN city TEXT DEFAULT 'X'; ALTER TABLE users RENAME COLUMN city TO town; ALTER TABLE users DROP COLUMN age; INSERT INTO users (name) VALUES ('New')")
    assert rows(users, "SELECT id, town FROM users ORDER BY 1") == [(1, "X"), (2, "X"), (3, "X"), (4, "X")]
    users.execute("CREATE TABLE g (a INTEGER, b INTEGER, c INTEGER GENERATED ALWAYS AS (a + b) STORED, d INTEGER AS (a * b)); INSERT INTO g (a, b) VALUES (2, 3); UPDATE g SET a = 10")
    assert rows(users, "SELECT * FROM g") == [(10, 3, 13, 30)]
    users.execute("ALTER TABLE g RENAME TO h")
    assert rows(users, "SELECT c FROM h") == [(13,)]


def test_triggers_views_pragma_explain(users):
    users.execute("CREATE TABLE log (id INTEGER PRIMARY KEY, what TEXT); CREATE TRIGGER tr AFTER DELETE ON users BEGIN INSERT INTO log (what) VALUES ('gone'); END; DELETE FROM users WHERE id = 1")
    assert rows(users, "SELECT what FROM log") == [("gone",)]
    users.execute("CREATE VIEW v(n) AS SELECT name FROM users")
    assert rows(users, "SELECT n FROM v ORDER BY n") == [("Bob",), ("O'Hara",)]
    assert [r[1] for r in rows(users, "PRAGMA table_info(users)")] == ["id", "name", "age"]
    assert "SCAN TABLE users" in [r[3] for r in rows(users, "EXPLAIN QUERY PLAN SELECT * FROM users ORDER BY age")]
    assert [r[1] for r in rows(users, "EXPLAIN SELECT COUNT(*) FROM users")][-1] == "Halt"
    users.execute("ATTACH DATABASE '/tmp/x' AS other; VACUUM; DETACH other")


def test_queries(users):
    users.execute("CREATE TABLE tags (id INTEGER PRIMARY KEY, uid INTEGER, tag TEXT); INSERT INTO tags (uid, tag) VALUES (1, 'a'), (1, 'b'), (2, 'c')")
    assert rows(users, "SELECT u.name, GROUP_CONCAT(t.tag, '+') FROM tags t JOIN users u ON u.id = t.uid GROUP BY u.name ORDER BY u.name") == [("Alice", "a+b"), ("Bob", "c")]
    assert rows(users, "SELECT uid, tag, COUNT(*) FROM tags GROUP BY uid ORDER BY uid") == [(1, "a", 2), (2, "c", 1)]
    assert rows(users, "SELECT name FROM users WHERE id NOT IN (SELECT uid FROM tags)") == [("O'Hara",)]
    assert rows(users, "SELECT tag, SUM(id) OVER (ORDER BY uid) AS s, RANK() OVER (ORDER BY uid) FROM tags ORDER BY id") == [("a", 1, 1), ("b", 3, 1), ("c", 6, 3)]
    assert rows(users, "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 250) SELECT COUNT(*) FROM c") == [(250,)]
    assert rows(users, "SELECT 1 UNION SELECT 2 INTERSECT SELECT 2") == [(2,)]
    assert rows(users, "SELECT a.name, b.name FROM users a LEFT JOIN users b ON a.id = b.id + 1 ORDER BY a.id") == [("Alice", None), ("Bob", "Alice"), ("O'Hara", "Bob")]
    assert rows(users, "SELECT COUNT(DISTINCT uid), TOTAL(id), AVG(id) FROM tags HAVING COUNT(*) > 1") == [(2, 6.0, 2.0)]
    assert rows(users, "SELECT name FROM users ORDER BY name COLLATE NOCASE DESC LIMIT 1") == [("O'Hara",)]


def test_full_text_and_boxes(db):
    db.execute("CREATE VIRTUAL TABLE d USING fts5(title, body); INSERT INTO d VALUES ('Rust lang', 'fast rust code'), ('Python', 'slow, but rust?'), ('Go', 'x')")
    assert rows(db, "SELECT title, highlight(d, 1, '<', '>') FROM d WHERE d MATCH 'rust' ORDER BY rank DESC") == [("Rust lang", "fast <rust> code"), ("Python", "slow, but <rust?>")]
    assert rows(db, "SELECT title FROM d('rust slow')") == [("Python",)]
    assert db.execute("DELETE FROM d WHERE d MATCH 'go'") == 1
    db.execute("CREATE VIRTUAL TABLE r USING rtree(id, x0, x1, y0, y1); INSERT INTO r VALUES (1,0,10,0,10),(2,5,15,5,15),(3,20,30,20,30),(4,8,12,8,12)")
    assert rows(db, "SELECT id FROM r WHERE x0 <= 11 AND x1 >= 3 AND y0 <= 11 AND y1 >= 3 ORDER BY id") == [(1,), (2,), (4,)]
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO r VALUES (5, 3, 1, 0, 1)")


def test_two_writers_lose_nothing(spark, users):
    other = Database(spark, str(users.store.path))
    users.execute("INSERT INTO users (name) VALUES ('from a')")
    other.execute("INSERT INTO users (name) VALUES ('from b')")
    users.execute("INSERT INTO users (name) VALUES ('a again')")
    assert rows(other, "SELECT id, name FROM users WHERE id > 3 ORDER BY id") == [(4, "from a"), (5, "from b"), (6, "a again")]
    users.execute("BEGIN; DELETE FROM users WHERE id = 4")
    other.execute("DELETE FROM users WHERE id = 5")
    with pytest.raises(TransactionError):
        users.execute("COMMIT")
    assert rows(users, "SELECT id FROM users WHERE id > 3 ORDER BY id") == [(4,), (6,)]


def test_a_conflict_inside_a_statement_is_retried(spark, users, monkeypatch):
    other = Database(spark, str(users.store.path))
    plain, calls = users._change, []

    def change(sql, params):
        n = plain(sql, params)
        if not calls:
            other.execute("INSERT INTO users (name) VALUES ('between')")
        calls.append(sql)
        return n

    monkeypatch.setattr(users, "_change", change)
    users.execute("INSERT INTO users (name) VALUES ('mine')")
    assert len(calls) == 2 and rows(users, "SELECT id, name FROM users WHERE id > 3 ORDER BY id") == [(4, "between"), (5, "mine")]


def test_or_replace_keeps_nulls_and_the_last(db):
    db.execute("CREATE TABLE k (id INTEGER PRIMARY KEY, u TEXT UNIQUE, n INTEGER); INSERT OR REPLACE INTO k VALUES (9, NULL, 1), (10, NULL, 2); INSERT OR REPLACE INTO k VALUES (3, 'z', 7), (3, 'z', 8)")
    assert rows(db, "SELECT * FROM k ORDER BY id") == [(3, "z", 8), (9, None, 1), (10, None, 2)]


def test_null_over_an_added_default(users):
    users.execute("ALTER TABLE users ADD COLUMN city TEXT DEFAULT 'X'; UPDATE users SET city = NULL WHERE id = 2; INSERT INTO users VALUES (-1, 'low', 1, NULL)")
    assert rows(users, "SELECT id, city FROM users ORDER BY id") == [(-1, None), (1, "X"), (2, None), (3, "X")]


def test_ids_without_gaps(spark, db):
    spark.range(0, 1000, 1, 8).createOrReplaceTempView("thousand")
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, x INTEGER); INSERT INTO t (x) SELECT id FROM thousand; INSERT INTO t (x) VALUES (-1); CREATE TABLE c AS SELECT id AS x FROM thousand")
    assert rows(db, "SELECT MIN(id), MAX(id), COUNT(DISTINCT id), SUM(id - x = 1) FROM t") == [(1, 1001, 1001, 1000)]
    assert rows(db, "SELECT MAX(rowid), MIN(rowid), COUNT(DISTINCT rowid) FROM c") == [(1000, 1, 1000)]


def test_only_touched_files_are_rewritten(users):
    users.execute("INSERT INTO users (name) VALUES ('one more')")
    before = users.manifest["tables"]["users"]["files"]
    users.execute("UPDATE users SET age = 1 WHERE id = 4")
    after = users.manifest["tables"]["users"]["files"]
    assert set(before[:-1]) <= set(after) and before[-1] not in after
    assert users.execute("DELETE FROM users WHERE id = 99") == 0 and users.manifest["tables"]["users"]["files"] == after
    users.execute("VACUUM")
    assert rows(users, "SELECT COUNT(*) FROM users") == [(4,)] and not set(users.manifest["tables"]["users"]["files"]) & set(before)


def test_triggers_refuse_rows(users):
    for bad in ("CREATE TRIGGER t AFTER DELETE ON users BEGIN DELETE FROM users WHERE id = OLD.id; END", "CREATE TRIGGER t AFTER DELETE ON users WHEN OLD.id > 1 BEGIN DELETE FROM users; END", "INSERT INTO nowhere VALUES (1)"):
        with pytest.raises(BrindleError):
            users.execute(bad)
    users.execute("CREATE VIEW v AS SELECT name FROM users")
    with pytest.raises(CatalogError):
        users.execute("DELETE FROM v")


def test_collation_of_a_column(db):
    db.execute("CREATE TABLE c (n TEXT COLLATE NOCASE UNIQUE); INSERT INTO c VALUES ('b'), ('Ab'), ('C')")
    assert rows(db, "SELECT n FROM c WHERE n = 'AB'") == [("Ab",)] and rows(db, "SELECT n FROM c ORDER BY n") == [("Ab",), ("b",), ("C",)]
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO c VALUES ('aB')")
