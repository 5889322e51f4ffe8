"""Database: SQL in the dialect over copy-on-write tables."""

from __future__ import annotations

import copy
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.errors import BrindleError, CatalogError, ConstraintError, ParseError, TransactionError
from brindle.functions import dialect_functions as fn
from brindle.functions.dialect_functions import SPARK_TYPES, Expr
from brindle.operators import full_text
from brindle.operators.recursion import recursive_union
from brindle.plans import dialect
from brindle.plans.dialect import Translator, quote
from brindle.sources.store import Store, find, must_find, new_table


class Row:
    """A result row: by position, or by name whatever its case."""

    def __init__(self, columns: list[str], values: tuple):
        self.columns, self.values = columns, values

    def get(self, name: str):
        at = [c.lower() for c in self.columns]
        return self.values[at.index(name.lower())] if name.lower() in at else None

    def __getitem__(self, key):
        return self.values[key] if isinstance(key, int) else self.get(key)

    def __iter__(self):
        return iter(self.values)

    def __eq__(self, other) -> bool:
        return tuple(self.values) == tuple(other)

    def __repr__(self) -> str:
        return f"Row({', '.join(f'{c}={v!r}' for c, v in zip(self.columns, self.values, strict=True))})"


class Result:
    """Lazy rows of a query; df is the DataFrame for further work."""

    def __init__(self, df: DataFrame, columns: list[str] | None = None):
        self.df, self.columns = df, columns or df.columns
        self._rows: list[Row] | None = None

    def rows(self) -> list[Row]:
        if self._rows is None:
            try:
                self._rows = [Row(self.columns, tuple(r)) for r in self.df.collect()]
            except BrindleError:
                raise
            except Exception as e:
                raise BrindleError(_reason(e)) from e
        return self._rows

    def __iter__(self) -> Iterator[Row]:
        return iter(self.rows())

    def __len__(self) -> int:
        return len(self.rows())

    def __getitem__(self, i: int) -> Row:
        return self.rows()[i]

    def is_empty(self) -> bool:
        return not self.rows()


def _reason(e: Exception) -> str:
    found = re.search(r"\[USER_RAISED_EXCEPTION\] (.*?)( SQLSTATE|\n|$)", str(e))
    return found[1] if found else str(e).split("\n")[0]


class Database:
    MOST_NESTED = 32
    MOST_TRIES = 50

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)
        self.prefix = f"b{uuid.uuid4().hex[:8]}"
        self.staged: dict | None = None
        self.explicit = False
        self.nested = 0
        self.returned: DataFrame | None = None
        self.registered: dict[str, tuple[DataFrame, list[tuple[str, str]]]] = {}
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "10000")
        spark.conf.set("spark.sql.cteRecursionRowLimit", "100000000")

    open = classmethod(lambda cls, spark, path: cls(spark, path))

    def close(self) -> None:
        if self.explicit:
            self.staged, self.explicit = None, False
        for v in self.spark.catalog.listTables():
            if v.name.startswith(self.prefix):
                self.spark.catalog.dropTempView(v.name)

    def register_function(self, name: str, f, kind: str = "text") -> None:
        self.spark.udf.register(name.lower(), f, SPARK_TYPES[kind])
        fn.REGISTERED[name.upper()] = kind

    def register_table(self, name: str, df: DataFrame) -> None:
        """Lets statements of this object read df under a name; nothing is copied."""
        kinds = {"string": "text", "binary": "blob", "double": "real", "float": "real", "boolean": "int", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int"}
        self.registered[name] = (df, [(c, kinds.get(k, "real" if k.startswith("decimal") else "")) for c, k in df.dtypes])

    # entry points
    def execute(self, sql: str, params: list | tuple = ()) -> int:
        """Runs all statements in order; the number of changed rows. Each is atomic unless BEGIN opened a transaction."""
        return sum(self._atomic(s, params) for s in dialect.statements(sql))

    def query(self, sql: str, params: list | tuple = ()) -> Result:
        """The rows of one statement: SELECT, WITH, VALUES, PRAGMA, EXPLAIN, or a change with RETURNING."""
        one = dialect.statements(sql)
        if not one:
            raise ParseError("empty statement")
        word = one[0].lstrip().split(None, 1)[0].upper()
        if self.staged is None:
            self.store.refresh()
        if word in ("SELECT", "WITH", "VALUES"):
            return Result(self._select(one[0], params))
        if word == "PRAGMA":
            return self._pragma(one[0])
        if word == "EXPLAIN":
            return self._explain(one[0])
        self.returned = None
        self._atomic(one[0], params)
        if self.returned is None:
            raise ParseError("the statement returns no rows")
        return Result(self.returned)

    @property
    def manifest(self) -> dict:
        return self.staged if self.staged is not None else self.store.manifest

    def _atomic(self, sql: str, params) -> int:
        word = sql.lstrip().split(None, 2)[0].upper().rstrip(";")
        if word == "BEGIN":
            if self.explicit:
                raise TransactionError("a transaction is open")
            self.store.refresh()
            self.staged, self.explicit = copy.deepcopy(self.store.manifest), True
            return 0
        if word in ("COMMIT", "END", "ROLLBACK"):
            if not self.explicit:
                raise TransactionError("no transaction is open")
            done, self.staged, self.explicit = self.staged, None, False
            if word == "ROLLBACK":
                self.store.abandon()
            elif not self.store.commit(done):
                self.store.abandon()
                self.store.refresh()
                raise TransactionError("another writer changed the database; the transaction was rolled back")
            return 0
        if word in ("SELECT", "WITH", "VALUES", "PRAGMA", "EXPLAIN"):
            self.query(sql, params).rows()
            return 0
        for _ in range(self.MOST_TRIES):
            outer = self.staged
            if outer is None:
                self.store.refresh()
            self.staged = copy.deepcopy(self.manifest)
            try:
                n = self._change(sql, params)
            except Exception as e:
                self.staged = outer
                if outer is None:
                    self.store.abandon()
                if isinstance(e, BrindleError):
                    raise
                raise ConstraintError(_reason(e)) from e
            if outer is not None:
                return n
            done, self.staged = self.staged, None
            if self.store.commit(done):
                if word == "VACUUM":
                    self.store.clean()
                return n
            self.store.abandon()
        raise TransactionError("other writers were faster too often")

    # reading
    def _columns(self, name: str) -> list[tuple[str, str]] | None:
        if (t := find(self.manifest["tables"], name)) is not None:
            table = self.manifest["tables"][t]
            shown = [(c["name"], c["kind"]) for c in table["columns"]]
            return shown + [("rank", "real")] if table["module"] == "fts5" else shown
        known = find(self.registered, name)
        return self.registered[known][1] if known and find(self.manifest["views"], name) is None else None

    def frame(self, name: str) -> DataFrame:
        return self.store.read(self.manifest["tables"][must_find(self.manifest["tables"], name)])

    def _view(self, df: DataFrame, name: str) -> str:
        view = f"{self.prefix}_{re.sub('[^0-9A-Za-z]', '_', name)}_{uuid.uuid4().hex[:6]}"
        df.createOrReplaceTempView(view)
        return quote(view)

    def _relation(self, name: str) -> str:
        if (t := find(self.manifest["tables"], name)) is not None:
            df = self.frame(t)
            if self.manifest["tables"][t]["module"] == "fts5":
                df = df.withColumn("rank", F.lit(0.0))
            return self._view(df, t)
        if (v := find(self.manifest["views"], name)) is not None:
            view = self.manifest["views"][v]
            df = self._select(view["sql"], ())
            return self._view(df.toDF(*view["columns"]) if view["columns"] else df, v)
        if (known := find(self.registered, name)) is not None:
            return self._view(self.registered[known][0], known)
        for schema in (*self.manifest["attached"], "main", "temp"):
            if name.lower() == schema.lower():
                raise CatalogError(f"{name} is a database")
        if self.spark.catalog.tableExists(name):
            return quote(name)
        raise CatalogError(f"no such table: {name}")

    def _full_text(self, name: str, queries: list[str], marks: list[str]) -> str:
        """The relation of a full-text table with rank, a truth value for each match, and its marked texts."""
        table = self.manifest["tables"][must_find(self.manifest["tables"], name)]
        df = self.frame(name)
        return self._view(self._with_matches(df, table, queries, marks), name)

    def _with_matches(self, df: DataFrame, table: dict, queries: list[str], marks: list[str]) -> DataFrame:
        columns, rank = [c["name"] for c in table["columns"]], F.lit(0.0)
        texts = [self._text(q) for q in queries]
        for i, q in enumerate(texts):
            hits = full_text.match(df.select("_rowid", *map(quote, columns)), "_rowid", columns, q).select(F.col("_rowid").alias("__id"), F.col("rank").alias(f"__rank{i}"))
            df = df.join(hits, df["_rowid"] == F.col("__id"), "left").drop("__id").withColumn(f"__hit{i}", F.col(f"__rank{i}").isNotNull())
            rank = F.coalesce(F.col("__rank0"), F.lit(0.0))
        for i, mark in enumerate(marks):
            kind, *args = re.findall(r"'(?:[^'\\]|\\.)*'|-?\d+L|\w+", mark)
            before, after, *more = [self._text(x) if x[0] == "'" else int(x[:-1]) for x in args[1:]]
            text = F.col(quote(columns[int(args[0][:-1])]))
            made = full_text.highlight(text, " ".join(texts), before, after) if kind == "highlight" else full_text.snippet(text, " ".join(texts), before, after, *more)
            df = df.withColumn(f"__mark{i}", made)
        return df.withColumn("rank", rank).drop(*(f"__rank{i}" for i in range(len(texts))))

    def _collations(self, name: str) -> dict[str, str]:
        t = find(self.manifest["tables"], name)
        return {c["name"]: c["collate"] for c in self.manifest["tables"][t]["columns"] if c.get("collate")} if t else {}

    def _recursion(self, name: str, columns: list[str] | None, anchor: str, step: str) -> str:
        """A recursion that drops rows found before, as a view; it runs while the statement is translated."""
        first = self.spark.sql(anchor)
        first = first.toDF(*columns) if columns else first
        types = dict(first.dtypes)

        def again(new: DataFrame) -> DataFrame:
            view = self._view(new, name)
            found = self.spark.sql(re.sub(rf"(FROM|JOIN) {re.escape(quote(name))}", rf"\1 {view}", step)).toDF(*first.columns)
            return found.select(*(F.col(quote(c)).cast(types[c]).alias(c) for c in first.columns))

        return self._view(recursive_union(first, again), name)

    def _catalog(self) -> dialect.Catalog:
        return dialect.Catalog(self._columns, self._relation, self._full_text, self._collations, lambda name: find(self.manifest["tables"], name) is not None, self._recursion)

    @staticmethod
    def _text(sql: str) -> str:
        if not re.fullmatch(r"'(?:[^'\\]|\\.)*'", sql, re.S):
            raise ParseError("a literal is needed")
        return re.sub(r"\\(.)", r"\1", sql[1:-1])

    def _select(self, sql: str, params) -> DataFrame:
        try:
            return self.spark.sql(dialect.to_spark(sql, self._catalog(), params))
        except BrindleError:
            raise
        except Exception as e:
            raise ParseError(_reason(e)) from e

    # changes
    def _change(self, sql: str, params) -> int:
        t = Translator(sql, self._catalog(), params)
        word = t.peek()
        if word in ("INSERT", "REPLACE"):
            return self._insert(t)
        if word == "UPDATE":
            return self._update(t)
        if word == "DELETE":
            return self._delete(t)
        if word == "CREATE":
            return self._create(t)
        if word == "DROP":
            return self._drop(t)
        if word == "ALTER":
            return self._alter(t)
        if word in ("ATTACH", "DETACH"):
            return self._attach(t)
        if word == "VACUUM":
            return self._vacuum()
        raise ParseError(f"unknown statement {word or sql[:20]}")

    def _fire(self, timing: str, event: str, table: str, columns: set[str] | None = None) -> bool:
        """Runs the triggers, once for each statement, in the order of their names; columns are those that UPDATE sets."""
        fired = False
        for name in sorted(self.manifest["triggers"]):
            trigger = self.manifest["triggers"][name]
            if (trigger["timing"], trigger["event"], trigger["table"].lower()) == (timing, event, table.lower()):
                fired = True
                if columns is not None and trigger.get("of") and not columns & {c.lower() for c in trigger["of"]}:
                    continue
                if trigger.get("when") and not self._select(f"SELECT 1 WHERE {trigger['when']}", ()).count():
                    continue
                if self.nested >= self.MOST_NESTED:
                    raise BrindleError("triggers are nested too deeply")
                self.nested += 1
                try:
                    for body in trigger["body"]:
                        self._change(body, ())
                finally:
                    self.nested -= 1
        return fired

    def _instead(self, name: str, event: str) -> bool:
        """Whether name is a view whose INSTEAD OF triggers took the statement's place."""
        if find(self.manifest["tables"], name) is None and (view := find(self.manifest["views"], name)) is not None:
            if not self._fire("INSTEAD OF", event, view):
                raise CatalogError(f"cannot modify {view}: it is a view without an INSTEAD OF {event} trigger")
            return True
        return False

    def _coerced(self, x: Expr, c: dict) -> str:
        """x as the column's type; a value that does not fit raises, naming the column."""
        kind, sql = c["kind"], fn.value(x)
        target = SPARK_TYPES[kind]
        fail = f"cast(raise_error('datatype mismatch in column {c['name']}') AS {target})"
        if x.kind == "null":
            return f"cast(NULL AS {target})"
        if kind == "int":
            if x.kind in ("int", "bool"):
                return sql
            number = f"try_cast({sql} AS double)"
            made = f"coalesce(try_cast({sql} AS bigint), if({number} = floor({number}), cast({number} AS bigint), NULL))" if x.kind != "real" else f"if({sql} = floor({sql}), cast({sql} AS bigint), NULL)"
        elif kind == "real":
            made = f"try_cast({sql} AS double)"
        elif kind == "text":
            return fn.text(x) if x.kind in ("int", "real", "bool", "text") else f"cast({sql} AS string)"
        else:
            return f"cast({sql} AS binary)"
        return f"if({sql} IS NULL, NULL, coalesce({made}, {fail}))"

    def _finish(self, df: DataFrame, table: dict, *more: str) -> DataFrame:
        """Adds the stored generated columns and puts all stored columns in order, more after them."""
        stored = [c for c in table["columns"] if c.get("generated") and c.get("stored")]
        df = df.drop(*(c["name"] for c in stored)).select("*", *(F.expr(c["generated"]).cast(SPARK_TYPES[c["kind"]]).alias(c["name"]) for c in stored))
        return df.select("_rowid", *(quote(c["name"]) for c in table["columns"] if not c.get("generated") or c.get("stored")), *more)

    def _keys(self, name: str) -> list[list[str]]:
        table = self.manifest["tables"][name]
        keys = [[c["name"]] for c in table["columns"] if c.get("unique") or c.get("pk")] if sum(bool(c.get("pk")) for c in table["columns"]) < 2 else [[c["name"]] for c in table["columns"] if c.get("unique")] + [[c["name"] for c in table["columns"] if c.get("pk")]]
        keys += table["keys"] + [i["columns"] for i in self.manifest["indexes"].values() if i["unique"] and i["table"] == name]
        return keys

    def _checked(self, new: DataFrame, old: DataFrame | None, name: str) -> None:
        """Constraints of new rows: one aggregate for NOT NULL, CHECK and box bounds, then a join per key."""
        table = self.manifest["tables"][name]
        tests = [(f"NOT NULL constraint failed: {name}.{c['name']}", F.col(quote(c["name"])).isNull()) for c in table["columns"] if c.get("notnull") or c.get("pk")]
        tests += [(f"CHECK constraint failed: {name}", ~F.expr(x)) for x in table["checks"]]
        if table["module"] == "rtree":
            coords = [c["name"] for c in table["columns"][1:]]
            tests += [(f"box bounds are out of order: {a} > {b}", F.col(quote(a)) > F.col(quote(b))) for a, b in zip(coords[::2], coords[1::2], strict=True)]
        if tests:
            found = new.agg(*(F.count_if(x).alias(f"t{i}") for i, (_, x) in enumerate(tests))).first()
            for i, (what, _) in enumerate(tests):
                if found[i]:
                    raise ConstraintError(what)
        for key in self._keys(name):
            some = new.select(*self._key(name, key)).dropna()
            if some.groupBy(*some.columns).count().where("count > 1").limit(1).count() or old is not None and some.join(old.select(*self._key(name, key)), some.columns, "left_semi").limit(1).count():
                raise ConstraintError(f"UNIQUE constraint failed: {name}.{', '.join(key)}")

    def _key(self, name: str, key: list[str]) -> list:
        """The columns of a key as they are compared: under their collation."""
        how = {"NOCASE": F.lower, "RTRIM": lambda x: F.rtrim(x)}
        own = {c["name"].lower(): c for c in self.manifest["tables"][name]["columns"]}
        columns = [own[k.lower()] for k in key]
        return [how.get(c.get("collate"), lambda x: x)(F.col(quote(c["name"]))).alias(f"__k{i}") for i, c in enumerate(columns)]

    def _numbered(self, df: DataFrame) -> DataFrame:
        """Rows with __n from 0 on, without gaps, in the order of the partitions: written once, then numbered by the sizes of the tasks' parts."""
        at = self.store.write(df.withColumn("__n", F.monotonically_increasing_id()), "staged")
        schema = df.schema.add("__n", "long")
        rows = self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)
        sizes = sorted((r["b"], r["n"]) for r in rows.groupBy(F.shiftright("__n", 33).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each task
        before, offsets = 0, []
        for b, n in sizes:
            offsets.append((b, before))
            before += n
        if len(offsets) < 2 and (not offsets or offsets[0] == (0, 0)):
            return rows
        known = self.spark.createDataFrame(offsets, "b long, before long")
        inside = F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))
        return rows.withColumn("b", F.shiftright("__n", 33)).join(F.broadcast(known), "b").withColumn("__n", F.col("before") + inside).drop("b", "before")

    def _insert(self, t: Translator) -> int:
        replace = t.take("REPLACE")
        if not replace:
            t.need("INSERT")
            if t.take("OR"):
                if not t.take("REPLACE"):
                    raise ParseError("only OR REPLACE is known")
                replace = True
        t.need("INTO")
        name = t.name()
        if self._instead(name, "INSERT"):
            return 0
        name = must_find(self.manifest["tables"], name)
        table = self.manifest["tables"][name]
        given = [c["name"] for c in table["columns"] if not c.get("generated")]
        if t.take("("):
            given = t.names()
            t.need(")")
        columns = []
        for g in given:
            c = next((c for c in table["columns"] if c["name"].lower() == g.lower()), None)
            if c is None:
                raise CatalogError(f"no such column: {name}.{g}")
            if c.get("generated"):
                raise ConstraintError(f"cannot insert into generated column {g}")
            columns.append(c)
        self._fire("BEFORE", "INSERT", name)
        table = self.manifest["tables"][name]
        if t.take("VALUES"):
            rows = []
            while True:
                t.need("(")
                cells = [t.expr()]
                while t.take(","):
                    cells.append(t.expr())
                t.need(")")
                if table["module"] == "fts5":
                    cells += [Expr("''", "text")] * (len(columns) - len(cells))
                    cells = [Expr(f"coalesce({fn.text(x)}, '')", "text") for x in cells]
                if len(cells) != len(columns):
                    raise ParseError(f"{len(cells)} values for {len(columns)} columns")
                named = ", ".join(f"{self._coerced(x, c)} AS {quote(c['name'])}" for x, c in zip(cells, columns, strict=True))
                rows.append(f"struct({len(rows)}L AS __n, {named})")
                if not t.take(","):
                    break
            df = self.spark.sql(f"SELECT inline(array({', '.join(rows)}))")
        elif t.take("DEFAULT", "VALUES"):
            columns, df = [], self.spark.sql("SELECT 0L AS __n")
        else:
            inner = self.spark.sql(t.query())
            if len(inner.columns) != len(columns):
                raise ParseError(f"{len(inner.columns)} columns for {len(columns)}")
            inner = inner.toDF(*(f"c{i}" for i in range(len(columns))))
            kinds = {"string": "text", "binary": "blob", "double": "real", "float": "real", "void": "null"}
            df = self._numbered(inner).select("__n", *(F.expr(self._coerced(Expr(f"c{i}", kinds.get(inner.dtypes[i][1], "int" if "int" in inner.dtypes[i][1] else "")), c)).alias(c["name"]) for i, c in enumerate(columns)))
        names = {c["name"] for c in columns}
        missing = [c for c in table["columns"] if c["name"] not in names and not c.get("generated")]
        df = df.select("*", *(F.expr(c.get("default") or "NULL").cast(SPARK_TYPES[c["kind"]]).alias(c["name"]) for c in missing))
        pk = self._rowid_column(table)
        rowid = F.lit(table["next_rowid"]) + F.col("__n")
        if pk:
            df = df.withColumn(pk, F.coalesce(F.col(quote(pk)), rowid))
            rowid = F.col(quote(pk))
        df = self._finish(df.withColumn("_rowid", rowid), table, "__n")
        files = self.store.write(self.store.fields(df, table, "__n"), name)
        new, old, kept = self.store.read(table | {"files": files}), self.frame(name), table["files"]
        if replace or table["module"] == "rtree":
            keys = self._keys(name)
            last = self._last(self.store.read(table | {"files": files}, "__n"), keys, name)
            kept = self._without(old, new, keys, name)
            files = self.store.write(self.store.fields(last, table), name)
            new, old = self.store.read(table | {"files": files}), self.store.read(table | {"files": kept})
        self._checked(new, old if kept else None, name)
        found = new.agg(F.count(F.lit(1)), F.max("_rowid")).first()
        table["files"], table["next_rowid"] = [*kept, *files], max(table["next_rowid"], (found[1] or 0) + 1)
        self._returning(t, new, name)
        self._fire("AFTER", "INSERT", name)
        return found[0]

    def _last(self, rows: DataFrame, keys: list[list[str]], name: str) -> DataFrame:
        """The rows that no later row of the statement (by __n) replaces; null keys are equal to none."""
        out = rows
        for key in keys:
            compared = self._key(name, key)
            last = rows.select(*compared, "__n").dropna().groupBy(*(f"__k{i}" for i in range(len(key)))).agg(F.max("__n").alias("__last"))
            again = out.select("*", *compared).join(last, [f"__k{i}" for i in range(len(key))], "left")
            out = again.where("__last IS NULL OR __last = __n").select(*out.columns)
        return out

    def _without(self, old: DataFrame, new: DataFrame, keys: list[list[str]], name: str) -> list[str]:
        """The files of the table without the rows whose keys the new rows take; files without such rows stay as they are."""
        table = self.manifest["tables"][name]
        taken = None
        for key in keys:
            compared, ks = self._key(name, key), [f"__k{i}" for i in range(len(key))]
            ids = old.select("_rowid", *compared).join(new.select(*compared).dropna().distinct(), ks, "left_semi").select("_rowid")
            taken = ids if taken is None else taken.union(ids)
        if taken is None or not table["files"]:
            return table["files"]
        taken = taken.distinct()
        touched, rest = self._touched(self.store.read(table, "__file").join(taken, "_rowid", "left_semi"), table)
        if not touched:
            return rest
        left = self.store.read(table | {"files": touched}).join(taken, "_rowid", "left_anti")
        return [*rest, *self.store.write(self.store.fields(left, table), name)]

    @staticmethod
    def _touched(rows: DataFrame, table: dict) -> tuple[list[str], list[str]]:
        """The files of rows (with __file), and the others of the table."""
        names = {r["__file"] for r in rows.select("__file").distinct().collect()}  # a row for each file
        return [x for x in table["files"] if x.rpartition("/")[2] in names], [x for x in table["files"] if x.rpartition("/")[2] not in names]

    @staticmethod
    def _rowid_column(table: dict) -> str | None:
        pks = [c for c in table["columns"] if c.get("pk")]
        return pks[0]["name"] if len(pks) == 1 and pks[0]["kind"] == "int" else None

    def _target(self, t: Translator, name: str) -> str:
        name = must_find(self.manifest["tables"], name)
        relation = quote(f"{self.prefix}_target_{uuid.uuid4().hex[:6]}")
        t.scopes.append(dialect.Scope([dialect.Source(name, self._columns(name), True, name, relation)]))
        return name

    def _marks_hits(self, t: Translator, name: str):
        """A function that marks a frame of the table with __hit: whether WHERE holds."""
        condition = t.condition() if t.take("WHERE") else "true"
        source, table = t.scopes[0].sources[0], self.manifest["tables"][name]
        queries = list(source.queries)
        t.full_text = [x for x in t.full_text if x is not source]

        def mark(df: DataFrame) -> DataFrame:
            if queries:
                ranked = self._with_matches(self.frame(name), table, queries, [])
                df = df.join(ranked.select("_rowid", *(f"__hit{i}" for i in range(len(queries)))), "_rowid")
            return self.spark.sql(f"SELECT *, coalesce({condition}, false) AS __hit FROM {self._view(df, name)} AS {quote(name)}")

        return mark

    def _update(self, t: Translator) -> int:
        t.need("UPDATE")
        name = t.name()
        if self._instead(name, "UPDATE"):
            return 0
        name = self._target(t, name)
        table = self.manifest["tables"][name]
        t.need("SET")
        sets: dict[str, str] = {}
        while True:
            column = t.name()
            c = next((c for c in table["columns"] if c["name"].lower() == column.lower()), None)
            if c is None:
                raise CatalogError(f"no such column: {column}")
            if c.get("generated"):
                raise ConstraintError(f"cannot update generated column {column}")
            t.need("=")
            sets[c["name"]] = self._coerced(t.expr(), c)
            if not t.take(","):
                break
        changing = {c.lower() for c in sets}
        self._fire("BEFORE", "UPDATE", name, changing)
        table = self.manifest["tables"][name]
        mark = self._marks_hits(t, name)
        touched, rest = self._touched(mark(self.store.read(table, "__file")).where("__hit"), table)
        marked = mark(self.store.read(table | {"files": touched}))
        shown = ["_rowid", "__hit"] + [f"if(__hit, {sets[c['name']]}, {quote(c['name'])}) AS {quote(c['name'])}" if c["name"] in sets else quote(c["name"]) for c in table["columns"] if not c.get("generated")]
        changed = self.spark.sql(f"SELECT {', '.join(shown)} FROM {self._view(marked, name)} AS {quote(name)}")
        pk = self._rowid_column(table)
        if pk in sets:
            changed = changed.withColumn("_rowid", F.coalesce(F.col(quote(pk)), F.col("_rowid")))
        parts = [self._finish(changed.where("__hit"), table), self._finish(changed.where("NOT __hit"), table)]
        files = [self.store.write(self.store.fields(x, table), name) if touched else [] for x in parts]
        new, others = (self.store.read(table | {"files": f}) for f in (files[0], files[1] + rest))
        self._checked(new, others, name)
        table["files"] = rest + files[1] + files[0]
        found = new.agg(F.count(F.lit(1)), F.max("_rowid")).first()
        table["next_rowid"] = max(table["next_rowid"], (found[1] or 0) + 1)
        self._returning(t, new, name)
        self._fire("AFTER", "UPDATE", name, changing)
        return found[0]

    def _delete(self, t: Translator) -> int:
        t.need("DELETE", "FROM")
        name = t.name()
        if self._instead(name, "DELETE"):
            return 0
        name = self._target(t, name)
        self._fire("BEFORE", "DELETE", name)
        table = self.manifest["tables"][name]
        mark = self._marks_hits(t, name)
        touched, rest = self._touched(mark(self.store.read(table, "__file")).where("__hit"), table)
        marked = mark(self.store.read(table | {"files": touched}))
        files = self.store.write(self.store.fields(marked.where("NOT __hit"), table), name) if touched else []
        gone = marked.where("__hit").drop("__hit")
        n = gone.count()
        self._returning(t, gone, name)
        table["files"] = rest + files
        self._fire("AFTER", "DELETE", name)
        return n

    def _returning(self, t: Translator, rows: DataFrame, name: str) -> None:
        if t.take("RETURNING"):
            start = t.tokens[t.at].at
            view = self._view(rows, name)
            tr = Translator(f"SELECT {t.sql[start:]} FROM {name}", dialect.Catalog(self._columns, lambda _: view), t.params)
            self.returned = self.spark.sql(tr.query())
            t.at = len(t.tokens)
        t.take(";")
        if not t.done():
            raise ParseError(f"unexpected {t.tokens[t.at].text}")

    # definitions
    def _free(self, name: str, exists: bool) -> bool:
        if find(self.manifest["tables"], name) or find(self.manifest["views"], name):
            if exists:
                return False
            raise CatalogError(f"{name} exists already")
        return True

    def _create(self, t: Translator) -> int:
        t.need("CREATE")
        unique = t.take("UNIQUE")
        t.take("TEMP") or t.take("TEMPORARY")
        virtual = t.take("VIRTUAL")
        what = t.peek()
        t.at += 1
        exists = t.take("IF", "NOT", "EXISTS")
        name = t.name()
        if what == "INDEX":
            t.need("ON")
            table = must_find(self.manifest["tables"], t.name())
            t.need("(")
            columns = t.names()
            t.need(")")
            if find(self.manifest["indexes"], name):
                if exists:
                    return 0
                raise CatalogError(f"index {name} exists already")
            known = {c["name"].lower(): c["name"] for c in self.manifest["tables"][table]["columns"]}
            if any(c.lower() not in known for c in columns):
                raise CatalogError(f"no such column in {table}")
            self.manifest["indexes"][name] = {"table": table, "columns": [known[c.lower()] for c in columns], "unique": unique}
            if unique:
                self._checked(self.frame(table), None, table)
            return 0
        if what == "VIEW":
            columns = None
            if t.take("("):
                columns = t.names()
                t.need(")")
            t.need("AS")
            body = t.sql[t.tokens[t.at].at :].rstrip("; \n")
            if self._free(name, exists):
                self._select(body, ())
                self.manifest["views"][name] = {"sql": body, "columns": columns}
            return 0
        if what == "TRIGGER":
            return self._create_trigger(t, name, exists)
        if what != "TABLE" or not self._free(name, exists):
            if what != "TABLE":
                raise ParseError(f"cannot create {what}")
            return 0
        if virtual:
            return self._create_virtual(t, name)
        if t.take("AS"):
            df = self.spark.sql(t.query())
            kinds = {"string": "text", "binary": "blob", "double": "real", "float": "real"}
            columns = [{"name": n, "type": k.upper(), "kind": kinds.get(k, "int" if "int" in k or k == "boolean" else "text"), "id": i} for i, (n, k) in enumerate(df.dtypes)]
            table = self.manifest["tables"][name] = new_table(columns)
            rows = self._numbered(df).select((F.col("__n") + 1).alias("_rowid"), *(F.col(quote(c["name"])).cast(SPARK_TYPES[c["kind"]]).alias(c["name"]) for c in columns))
            table["files"] = self.store.write(self.store.fields(rows, table), name)
            found = self.frame(name).agg(F.count(F.lit(1)), F.max("_rowid")).first()
            table["next_rowid"] = (found[1] or 0) + 1
            return found[0]
        t.need("(")
        columns: list[dict] = []
        table = new_table(columns)
        # kinds of the columns are needed by generated expressions and checks
        ahead = t.at
        while t.peek() != "" and t.peek() not in ("PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "CONSTRAINT"):
            c = t.name()
            t.kinds[c.lower()] = fn.affinity(self._declared(t))
            depth = 0
            while not t.done() and (depth or t.peek() not in (",", ")")):
                depth += (t.peek() == "(") - (t.peek() == ")")
                t.at += 1
            if not t.take(","):
                break
        t.at = ahead
        while True:
            if t.take("CONSTRAINT"):
                t.name()
            if t.take("PRIMARY", "KEY", "("):
                for k in t.names():
                    next(c for c in columns if c["name"].lower() == k.lower())["pk"] = True
                t.need(")")
            elif t.take("UNIQUE", "("):
                table["keys"].append(t.names())
                t.need(")")
            elif t.take("CHECK", "("):
                table["checks"].append(t.condition())
                t.need(")")
            elif t.take("FOREIGN", "KEY"):
                self._skip_reference(t)
            else:
                columns.append(self._column(t, table, len(columns)))
            if not t.take(","):
                break
        t.need(")")
        table["next_field"] = len(columns)
        self.manifest["tables"][name] = table
        return 0

    @staticmethod
    def _declared(t: Translator) -> str:
        if t.done() or t.peek() in (",", ")", "PRIMARY", "NOT", "UNIQUE", "DEFAULT", "CHECK", "REFERENCES", "GENERATED", "COLLATE", "AS", "AUTOINCREMENT", "CONSTRAINT"):
            return ""
        return t.type_name()

    @staticmethod
    def _skip_reference(t: Translator) -> None:
        depth = 0
        while not t.done() and (depth or t.peek() not in (",", ")")):
            depth += (t.peek() == "(") - (t.peek() == ")")
            t.at += 1

    def _column(self, t: Translator, table: dict, field: int) -> dict:
        name = t.name()
        declared = self._declared(t)
        c: dict = {"name": name, "type": declared.upper(), "kind": fn.affinity(declared), "id": field}
        while True:
            if t.take("PRIMARY", "KEY"):
                c["pk"] = True
                t.take("ASC") or t.take("DESC")
                c["autoincrement"] = t.take("AUTOINCREMENT")
            elif t.take("NOT", "NULL"):
                c["notnull"] = True
            elif t.take("UNIQUE"):
                c["unique"] = True
            elif t.take("DEFAULT"):
                x = t._primary() if t.peek() != "-" else t._unary()
                c["default"] = fn.value(x)
            elif t.take("CHECK", "("):
                table["checks"].append(t.condition())
                t.need(")")
            elif t.take("COLLATE"):
                c["collate"] = t.name().upper()
                if c["collate"] not in fn.COLLATIONS:
                    raise ParseError(f"no such collation: {c['collate']}")
            elif t.take("REFERENCES"):
                t.name()
                if t.peek() == "(":
                    self._skip_reference(t)
            elif t.take("GENERATED", "ALWAYS", "AS", "(") or t.take("AS", "("):
                c["generated"] = fn.value(t.expr())
                t.need(")")
                c["stored"] = t.take("STORED") or (t.take("VIRTUAL") and False)
            elif not t.take("NULL"):
                return c

    def _create_virtual(self, t: Translator, name: str) -> int:
        t.need("USING")
        module = t.name().lower()
        t.need("(")
        names = t.names()
        t.need(")")
        if module == "fts5":
            self.manifest["tables"][name] = new_table([{"name": n, "type": "TEXT", "kind": "text", "id": i} for i, n in enumerate(names)], module="fts5")
        elif module == "rtree":
            if len(names) < 3 or len(names) % 2 == 0 or len(names) > 11:
                raise ParseError("rtree takes an id and one to five pairs of bounds")
            columns = [{"name": names[0], "type": "INTEGER", "kind": "int", "id": 0, "pk": True}]
            columns += [{"name": n, "type": "REAL", "kind": "real", "id": i + 1, "notnull": True} for i, n in enumerate(names[1:])]
            self.manifest["tables"][name] = new_table(columns, module="rtree")
        else:
            raise ParseError(f"no such module: {module}")
        return 0

    def _create_trigger(self, t: Translator, name: str, exists: bool) -> int:
        timing = "BEFORE" if t.take("BEFORE") else "INSTEAD OF" if t.take("INSTEAD", "OF") else "AFTER"
        timing = "AFTER" if t.take("AFTER") else timing
        event = t.name().upper()
        of = t.names() if event == "UPDATE" and t.take("OF") else []
        t.need("ON")
        on = t.name()
        table = find(self.manifest["views"], on) if timing == "INSTEAD OF" else must_find(self.manifest["tables"], on)
        if table is None:
            raise CatalogError(f"no such view: {on}")
        t.take("FOR", "EACH", "ROW")
        start = t.at
        while t.peek() != "BEGIN":
            if t.done():
                raise ParseError("a trigger's body starts with BEGIN")
            t.at += 1
        begin = t.tokens[t.at].at
        when = t.sql[t.tokens[start].at : begin].strip()
        if when and not when.upper().startswith("WHEN"):
            raise ParseError(f"unexpected {when.split()[0]}")
        if any(a.upper in ("NEW", "OLD") and b.text == "." for a, b in zip(t.tokens, t.tokens[1:], strict=False)):
            raise ParseError("a trigger runs once for each statement; there are no NEW and OLD rows")
        body = t.sql[begin + 5 : t.tokens[-1 if t.tokens[-1].text != ";" else -2].at]
        if find(self.manifest["triggers"], name):
            if exists:
                return 0
            raise CatalogError(f"trigger {name} exists already")
        self.manifest["triggers"][name] = {"timing": timing, "event": event, "table": table, "of": of, "when": when[4:].strip(), "body": dialect.statements(body)}
        return 0

    def _drop(self, t: Translator) -> int:
        t.need("DROP")
        what = t.name().lower()
        exists = t.take("IF", "EXISTS")
        names = self.manifest.get({"index": "indexes"}.get(what, what + "s"))
        if names is None or what not in ("table", "view", "index", "trigger"):
            raise ParseError(f"cannot drop {what}")
        name = t.name()
        if (found := find(names, name)) is None:
            if exists:
                return 0
            raise CatalogError(f"no such {what}: {name}")
        del names[found]
        if what == "table":
            for kind in ("indexes", "triggers"):
                self.manifest[kind] = {k: v for k, v in self.manifest[kind].items() if v["table"] != found}
        if what == "view":
            self.manifest["triggers"] = {k: v for k, v in self.manifest["triggers"].items() if (v["timing"], v["table"]) != ("INSTEAD OF", found)}
        return 0

    def _alter(self, t: Translator) -> int:
        t.need("ALTER", "TABLE")
        name = must_find(self.manifest["tables"], t.name())
        table = self.manifest["tables"][name]
        column = lambda n: next((c for c in table["columns"] if c["name"].lower() == n.lower()), None)
        if t.take("RENAME", "TO"):
            to = t.name()
            self._free(to, False)
            self.manifest["tables"][to] = self.manifest["tables"].pop(name)
            for kind in ("indexes", "triggers"):
                for x in self.manifest[kind].values():
                    x["table"] = to if x["table"] == name else x["table"]
        elif t.take("RENAME"):
            t.take("COLUMN")
            old = t.name()
            t.need("TO")
            new = t.name()
            if (c := column(old)) is None:
                raise CatalogError(f"no such column: {old}")
            if column(new):
                raise CatalogError(f"column {new} exists already")
            for i in self.manifest["indexes"].values():
                i["columns"] = [new if i["table"] == name and x == c["name"] else x for x in i["columns"]]
            c["name"] = new
        elif t.take("ADD"):
            t.take("COLUMN")
            c = self._column(t, table, table["next_field"])
            if column(c["name"]):
                raise CatalogError(f"column {c['name']} exists already")
            if c.get("notnull") and not c.get("default"):
                raise ConstraintError("a NOT NULL column needs a default")
            if c.get("default"):
                c["filled"] = list(table["files"])
            table["columns"].append(c)
            table["next_field"] += 1
        elif t.take("DROP"):
            t.take("COLUMN")
            gone = t.name()
            if (c := column(gone)) is None:
                raise CatalogError(f"no such column: {gone}")
            if c.get("pk"):
                raise ConstraintError("a primary key cannot be dropped")
            table["columns"].remove(c)
            self.manifest["indexes"] = {k: v for k, v in self.manifest["indexes"].items() if v["table"] != name or c["name"] not in v["columns"]}
        else:
            raise ParseError("ALTER TABLE takes ADD, DROP or RENAME")
        return 0

    def _attach(self, t: Translator) -> int:
        if t.take("ATTACH"):
            t.take("DATABASE")
            path = t.expr().sql.strip("'")
            t.need("AS")
            name = t.name()
            if name.lower() in ("main", "temp") or find(self.manifest["attached"], name):
                raise CatalogError(f"database {name} is in use")
            self.manifest["attached"][name] = path
        else:
            t.need("DETACH")
            t.take("DATABASE")
            del self.manifest["attached"][must_find(self.manifest["attached"], t.name(), "database")]
        return 0

    def _vacuum(self) -> int:
        """Rewrites each table of several files in ascending _rowid; once that is committed, the files of older versions go."""
        for name, table in self.manifest["tables"].items():
            if len(table["files"]) > 1:
                rows = self.store.fields(self.frame(name), table)
                table["files"] = self.store.write(rows.repartitionByRange("_rowid").sortWithinPartitions("_rowid"), name)
                for c in table["columns"]:
                    c.pop("filled", None)
        return 0

    # introspection
    def _rows(self, schema: str, rows: list[tuple]) -> Result:
        return Result(self.spark.createDataFrame(rows, schema))

    def _pragma(self, sql: str) -> Result:
        m = re.fullmatch(r"\s*PRAGMA\s+(?:\w+\.)?(\w+)\s*(?:\(\s*['\"`\[]?(\w+)['\"`\]]?\s*\)|=\s*(\S+))?\s*;?\s*", sql, re.I)
        if not m:
            raise ParseError("malformed PRAGMA")
        name, arg = m[1].lower(), m[2]
        tables, indexes = self.manifest["tables"], self.manifest["indexes"]
        if name == "table_info":
            t = find(tables, arg or "")
            rows = [(i, c["name"], c["type"], int(bool(c.get("notnull") or c.get("pk"))), c.get("default"), int(bool(c.get("pk")))) for i, c in enumerate(tables[t]["columns"])] if t else []
            return self._rows("cid long, name string, type string, notnull long, dflt_value string, pk long", rows)
        if name == "table_list":
            rows = [("main", t, "virtual" if x["module"] else "table", len(x["columns"])) for t, x in sorted(tables.items())]
            return self._rows("schema string, name string, type string, ncol long", rows + [("main", v, "view", 0) for v in sorted(self.manifest["views"])])
        if name == "index_list":
            own = sorted(i for i, x in indexes.items() if x["table"].lower() == (arg or "").lower())
            return self._rows("seq long, name string, unique long, origin string, partial long", [(k, i, int(indexes[i]["unique"]), "c", 0) for k, i in enumerate(own)])
        if name == "index_info":
            i = find(indexes, arg or "")
            columns = [c["name"] for c in tables[indexes[i]["table"]]["columns"]] if i else []
            return self._rows("seqno long, cid long, name string", [(k, columns.index(c), c) for k, c in enumerate(indexes[i]["columns"])] if i else [])
        if name == "database_list":
            return self._rows("seq long, name string, file string", [(0, "main", str(self.store.path))] + [(k + 2, n, p) for k, (n, p) in enumerate(self.manifest["attached"].items())])
        constants = {"page_size": 4096, "page_count": sum(len(x["files"]) for x in tables.values()), "journal_mode": "wal", "encoding": "UTF-8"}
        if name in constants:
            return self._rows(f"{name} {'long' if isinstance(constants[name], int) else 'string'}", [(constants[name],)])
        return self._rows("value string", [])

    def _explain(self, sql: str) -> Result:
        body = re.sub(r"^\s*EXPLAIN\s+(QUERY\s+PLAN\s+)?", "", sql, flags=re.I)
        plan = re.match(r"\s*EXPLAIN\s+QUERY\s+PLAN", sql, re.I)
        tokens = dialect.tokenize(body)
        words = [t.upper for t in tokens]
        has = lambda *w: any(words[i : i + len(w)] == list(w) for i in range(len(words)))
        used, seen = [], set()
        for i, t in enumerate(tokens):
            if t.kind in ("word", "id") and i and words[i - 1] in ("FROM", "JOIN", ",", "INTO", "UPDATE") and (n := find(self.manifest["tables"], t.text.strip('"`[]'))):
                alias = tokens[i + 2].text if words[i + 1 : i + 2] == ["AS"] else None
                used.append((n, alias))
                seen.add(n)
        aggregated = any(w in dialect.AGGREGATES for w in words)
        if plan:
            details = [f"SCAN TABLE {n}" + (f" AS {a}" if a else "") for n, a in used]
            details += [f"USE TEMP B-TREE FOR {x}" for x, on in (("GROUP BY", has("GROUP", "BY")), ("DISTINCT", has("DISTINCT")), ("ORDER BY", has("ORDER", "BY"))) if on]
            return self._rows("selectid long, order long, `from` long, detail string", [(0, k, 0, d) for k, d in enumerate(details)])
        ops: list[tuple[str, str]] = [("Init", "")]
        first = words[0] if words else ""
        if first in ("SELECT", "WITH"):
            self._select(body, ())  # names must resolve
            ops += [x for n, _ in used for x in (("OpenRead", n), ("Rewind", n))]
            ops += [("Join", "")] * (len(used) > 1) + [("Filter", "")] * has("WHERE") + [("Column", ""), *([("AggStep", ""), ("AggFinal", "")] if aggregated or has("GROUP", "BY") else [])]
            ops += [("Distinct", "")] * has("DISTINCT") + ([("SorterOpen", ""), ("SorterSort", "")] if has("ORDER", "BY") else []) + [("Limit", "")] * has("LIMIT") + [("ResultRow", "")]
        else:
            second = words[2] if len(words) > 2 and words[1] == "UNIQUE" else words[1] if len(words) > 1 else ""
            named = {"INSERT": "Insert", "REPLACE": "Insert", "UPDATE": "Update", "DELETE": "Delete", "BEGIN": "AutoCommit", "COMMIT": "AutoCommit", "ROLLBACK": "AutoCommit"}
            ops.append((named.get(first) or f"{first.title()}{second.title()}", used[0][0] if used else ""))
        ops.append(("Halt", ""))
        return self._rows("addr long, opcode string, p1 long, p2 long, p3 long, p4 string, p5 long", [(k, op, 0, 0, 0, p4, 0) for k, (op, p4) in enumerate(ops)])
