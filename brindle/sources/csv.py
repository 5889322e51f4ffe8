"""CSV import into a table, and a dump of a database as SQL text."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import functions as F

from brindle.database import Database
from brindle.plans.dialect import quote
from brindle.sources.store import find


def import_csv(db: Database, path: str, table: str) -> int:
    """Appends a CSV file with a header; empty fields are NULL, quotes double, fields may hold line feeds.

    A table that does not exist is made with a column for each field: of
    integers or reals if all its values are such numbers, else of text.
    The file is read in parallel only where it has no quoted line feeds, so
    large files should be Parquet.
    """
    df = db.spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, nullValue="")
    names = ", ".join(f'"{c}"' for c in df.columns)
    if find(db.manifest["tables"], table) is None:
        tests = [F.count_if(F.col(quote(c)).isNotNull() & F.col(quote(c)).try_cast(k).isNull()).alias(f"{k}{i}") for i, c in enumerate(df.columns) for k in ("bigint", "double")]
        bad = df.agg(*tests).first()
        kinds = ["INTEGER" if not bad[f"bigint{i}"] else "REAL" if not bad[f"double{i}"] else "TEXT" for i in range(len(df.columns))]
        columns = ", ".join(f'"{c}" {k}' for c, k in zip(df.columns, kinds, strict=True))
        db.execute(f'CREATE TABLE "{table}" ({columns})')
    view = f"{db.prefix}_csv"
    df.createOrReplaceTempView(view)
    return db.execute(f'INSERT INTO "{table}" ({names}) SELECT {names} FROM {view}')


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bytes | bytearray):
        return f"X'{bytes(v).hex()}'"
    return str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"


def definition(db: Database) -> Iterator[str]:
    """CREATE statements of tables, indexes, views and triggers. Defaults, checks and generated columns, which are kept as Spark SQL, are left out."""
    manifest = db.manifest
    for name, table in manifest["tables"].items():
        if table["module"]:
            yield f'CREATE VIRTUAL TABLE "{name}" USING {table["module"]}({", ".join(c["name"] for c in table["columns"])});'
        else:
            own = [c for c in table["columns"] if not c.get("generated")]
            several = [c["name"] for c in own if c.get("pk")] if sum(bool(c.get("pk")) for c in own) > 1 else []
            columns = [f'"{c["name"]}" {c["type"]}'.strip() + " PRIMARY KEY" * bool(c.get("pk") and not several) + " NOT NULL" * bool(c.get("notnull")) + " UNIQUE" * bool(c.get("unique")) + (f" COLLATE {c['collate']}" if c.get("collate") else "") for c in own]
            keys = [("PRIMARY KEY", several)] * bool(several) + [("UNIQUE", k) for k in table["keys"]]
            columns += [f"{what} ({', '.join(json.dumps(k) for k in key)})" for what, key in keys]
            yield f'CREATE TABLE "{name}" ({", ".join(columns)});'
    for name, x in manifest["indexes"].items():
        yield f'CREATE {"UNIQUE " * x["unique"]}INDEX "{name}" ON "{x["table"]}" ({", ".join(json.dumps(c) for c in x["columns"])});'
    for name, x in manifest["views"].items():
        shown = f"({', '.join(json.dumps(c) for c in x['columns'])})" if x["columns"] else ""
        yield f'CREATE VIEW "{name}"{shown} AS {x["sql"]};'
    for name, x in manifest["triggers"].items():
        of = f" OF {', '.join(x['of'])}" if x.get("of") else ""
        when = f" WHEN {x['when']}" if x.get("when") else ""
        yield f'CREATE TRIGGER "{name}" {x["timing"]} {x["event"]}{of} ON "{x["table"]}"{when} BEGIN {" ".join(b + ";" for b in x["body"])} END;'


def dump(db: Database) -> Iterator[str]:
    """Statements that make the database again; rows stream through the driver one partition at a time, triggers come last."""
    made = list(definition(db))
    late = [x for x in made if x.startswith("CREATE TRIGGER")]
    yield from (x for x in made if x not in late)
    for name, table in db.manifest["tables"].items():
        own = [c for c in table["columns"] if not c.get("generated")]
        rows = db.frame(name).orderBy("_rowid").select(*(F.col(quote(c["name"])) for c in own))
        for r in rows.toLocalIterator():
            yield f'INSERT INTO "{name}" ({", ".join(json.dumps(c["name"]) for c in own)}) VALUES ({", ".join(map(_value, r))});'
    yield from late
