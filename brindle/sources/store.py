"""Copy-on-write tables: immutable Parquet files behind a manifest of which each version is created once.

A statement writes new files and then the manifest of the next version; the
commit is the exclusive creation of that manifest, so of two writers one
fails and starts again from the other's version. CURRENT is a hint where to
look for the newest version. All access goes through Hadoop's file systems;
only the exclusive creation on a local disk is a hard link. Columns are
resolved by field id, so renaming and dropping columns touches the manifest
only. Every table carries a hidden _rowid, which keeps the order of insertion.
"""

from __future__ import annotations

import copy
import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.errors import CatalogError
from brindle.functions.dialect_functions import SPARK_TYPES

EMPTY = {"tables": {}, "indexes": {}, "views": {}, "triggers": {}, "attached": {}}


def new_table(columns: list[dict], **more) -> dict:
    """columns: name, type (as declared), kind, id, and pk, notnull, unique, default, generated, stored, collate where set."""
    return {"columns": columns, "next_rowid": 1, "next_field": len(columns), "files": [], "checks": [], "keys": [], "module": None} | more


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, str(path).rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/data"))
        self.version, self.manifest = 0, copy.deepcopy(EMPTY)
        self.written: list[str] = []
        self.version = int(self._read("CURRENT") or 0)
        if self.version:
            self.manifest = json.loads(self._read(f"_manifest-{self.version}.json"))
        self.refresh()

    def _read(self, name: str) -> str | None:
        at = self._path(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool) -> None:
        stream = self._fs.create(self._path(f"{self.path}/{name}"), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Creates a file with all its text, or not at all if it exists."""
        if self._fs.getScheme() != "file":
            try:
                self._write(name, text, False)
                return True
            except Exception:
                if self._fs.exists(self._path(f"{self.path}/{name}")):
                    return False
                raise
        folder = self._path(self.path).toUri().getPath()
        staged = f"{folder}/.{uuid.uuid4().hex}"
        with open(staged, "w") as f:
            f.write(text)
        try:
            os.link(staged, f"{folder}/{name}")
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(staged)

    def refresh(self) -> None:
        """Goes on to the newest version that is whole."""
        while (text := self._read(f"_manifest-{self.version + 1}.json")) is not None:
            try:
                self.manifest = json.loads(text)
            except ValueError:
                return
            self.version += 1

    def commit(self, manifest: dict) -> bool:
        """Makes manifest the next version; False if another writer was first."""
        version = self.version + 1
        if not self._create(f"_manifest-{version}.json", json.dumps(manifest)):
            return False
        self._write("CURRENT", str(version), True)
        self.version, self.manifest, self.written = version, manifest, []
        return True

    def abandon(self) -> None:
        """Deletes what was written for a version that never came to be."""
        for at in self.written:
            self.drop(at)
        self.written = []

    def drop(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def clean(self) -> None:
        """Deletes the files and manifests of older versions that the present one does not name. Frames read before fail afterwards."""
        of = lambda manifest: {x for t in manifest["tables"].values() for x in t["files"]}
        kept, gone = of(self.manifest), set()
        for version in range(self.version - 1, 0, -1):
            if (text := self._read(f"_manifest-{version}.json")) is None:
                break
            gone |= of(json.loads(text)) - kept
            self.drop(f"{self.path}/_manifest-{version}.json")
        for at in gone:
            self.drop(at)

    def write(self, df: DataFrame, table: str) -> list[str]:
        """Writes rows and returns the paths of their files; df has _rowid and a column for each field id."""
        at = f"{self.path}/data/{table}/{uuid.uuid4().hex}"
        self.written.append(at)
        df.write.parquet(at)
        return sorted(f"{at}/{x.getPath().getName()}" for x in self._fs.listStatus(self._path(at)) if x.getPath().getName().endswith(".parquet"))

    @staticmethod
    def schema(table: dict) -> T.StructType:
        """Stored fields by id: renamed columns keep their data, dropped ones are not read."""
        fields = [T.StructField("_rowid", T.LongType())]
        for c in table["columns"]:
            if not c.get("generated") or c.get("stored"):
                fields.append(T.StructField(f"f{c['id']}", T._parse_datatype_string(SPARK_TYPES[c["kind"]])))
        return T.StructType(fields)

    def read(self, table: dict, extra: str | None = None) -> DataFrame:
        """_rowid and all columns by name, virtual ones computed, added ones filled with their default.

        With extra = "__file" also the name of each row's file; with "__n" the
        field of that name.
        """
        schema = self.schema(table)
        if extra == "__n":
            schema = schema.add("__n", T.LongType())
        filled = [(c, set(c["filled"])) for c in table["columns"] if c.get("filled")]
        groups: dict[tuple[int, ...], list[str]] = {}
        for x in table["files"]:
            groups.setdefault(tuple(c["id"] for c, files in filled if x in files), []).append(x)
        out = None
        for old, files in groups.items() or [((), [])]:
            raw = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
            named = [F.col("_rowid")]
            for c in table["columns"]:
                if c["id"] in old:  # a file from before ADD COLUMN
                    named.append(F.expr(c["default"]).cast(SPARK_TYPES[c["kind"]]).alias(c["name"]))
                elif f"f{c['id']}" in schema.names:
                    named.append(F.col(f"f{c['id']}").alias(c["name"]))
            more = [file_name(F.input_file_name()).alias("__file")] if extra == "__file" else [F.col("__n")] if extra else []
            part = raw.select(*named, *more)
            out = part if out is None else out.union(part)
        virtual = [c for c in table["columns"] if c.get("generated") and not c.get("stored")]
        if virtual:
            out = out.select("*", *(F.expr(c["generated"]).cast(SPARK_TYPES[c["kind"]]).alias(c["name"]) for c in virtual))
            out = out.select("_rowid", *(f"`{c['name']}`" for c in table["columns"]), *([extra] if extra else []))
        return out

    def fields(self, df: DataFrame, table: dict, *more: str) -> DataFrame:
        """Named columns back to the stored fields."""
        return df.select("_rowid", *(F.col(f"`{c['name']}`").alias(f"f{c['id']}") for c in table["columns"] if not c.get("generated") or c.get("stored")), *more)


def find(names: dict, name: str) -> str | None:
    return next((n for n in names if n.lower() == name.lower()), None)


def must_find(names: dict, name: str, what: str = "table") -> str:
    if (found := find(names, name)) is None:
        raise CatalogError(f"no such {what}: {name}")
    return found
