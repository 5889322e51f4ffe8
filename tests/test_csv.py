from brindle.database import Database
from brindle.sources.csv import dump, import_csv


def test_import_and_dump(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,score\n1,"a ""q"", b",1.5\n2,"two\nlines",\n')
    db = Database(spark, str(tmp_path / "db"))
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, score REAL)")
    assert import_csv(db, str(tmp_path / "a.csv"), "t") == 2 and import_csv(db, str(tmp_path / "a.csv"), "new") == 2
    assert [tuple(r) for r in db.query("SELECT * FROM t ORDER BY id")] == [(1, 'a "q", b', 1.5), (2, "two\nlines", None)]
    again = Database(spark, str(tmp_path / "copy"))
    again.execute("\n".join(dump(db)))
    assert [tuple(r) for r in again.query("SELECT * FROM t ORDER BY id")] == [(1, 'a "q", b', 1.5), (2, "two\nlines", None)]


def test_inferred_types_and_definitions(spark, tmp_path):
    from brindle.sources.output import read_file, rendered, schema

    (tmp_path / "a.csv").write_text("a,b,c\n1,1.5,x\n,2,y\n")
    db = Database(spark, str(tmp_path / "db"))
    assert import_csv(db, str(tmp_path / "a.csv"), "new") == 2
    assert [r[2] for r in db.query("PRAGMA table_info(new)")] == ["INTEGER", "REAL", "TEXT"]
    db.execute("CREATE UNIQUE INDEX i ON new (c); CREATE VIEW v AS SELECT c FROM new; CREATE TRIGGER t AFTER DELETE ON new WHEN 1 = 1 BEGIN INSERT INTO new (c) VALUES ('gone'); END")
    (tmp_path / "dump.sql").write_text("\n".join(dump(db)))
    again = Database(spark, str(tmp_path / "again"))
    assert read_file(again, str(tmp_path / "dump.sql")) == 2 and schema(again) == schema(db) and len(schema(db)) == 4
    again.execute("DELETE FROM new WHERE a = 1")
    shown = lambda mode: list(rendered(again.query("SELECT a, b, c FROM new ORDER BY c DESC"), mode, null="-"))
    assert shown("list") == ["a|b|c", "-|2|y", "-|-|gone"] and shown("csv")[0] == "a,b,c"
    assert shown("json") == ["[", '  {"a": null, "b": 2.0, "c": "y"},', '  {"a": null, "b": null, "c": "gone"}', "]"]
    assert shown("line")[:4] == ["a = -", "b = 2", "c = y", ""] and shown("column")[1].startswith("-  -  ----")
    assert shown("table")[1] == "| a | b | c    |" and list(rendered(again.query("SELECT 1 AS x WHERE 1 = 0"), "json")) == ["[", "]"]
