"""Declared tables over plain Parquet: snapshots, a sequence of change segments, and a manifest.

Columns are stored under the names f<id>, so renaming, adding a nullable
column and dropping a constraint only change the manifest.  A manifest is a
file of its own version, published by a rename that fails if that version
exists: writers whose base is out of date lose and start again, each with a
segment folder of its own, which the manifest names.  State =
snapshot without the changed keys, plus the latest rows of changed keys.

Limits: writers must use this interface for their changes to be seen, and
the file system's rename must not replace an existing file.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtable.errors import EngineError, MigrationNeeded
from loomtable.formats import MIGRATION_KEY
from loomtable.operators.rewrite import latest, not_null, unique_violations
from loomtable.plans.diff import ColumnInfo, IndexIdentity, TableSchema, primary_key_column
from loomtable.plans.naming import index_name
from loomtable.spec import IndexSpec, TableSpec, spark_identifier
from loomtable.types import FieldType


@dataclass(frozen=True)
class StoredColumn:
    id: int
    name: str
    type: str
    nullable: bool = True
    primary_key: bool = False
    unique: bool = False
    default_sql: str | None = None

    @property
    def physical(self) -> str:
        return f"f{self.id}"

    def spark(self) -> T.DataType:
        return FieldType.of(self.type).spark()


@dataclass(frozen=True)
class StoredIndex:
    name: str
    method: str
    unique: bool
    columns: tuple[str, ...]
    predicate: str | None = None
    has_expressions: bool = False


@dataclass(frozen=True)
class Manifest:
    name: str
    version: int
    columns: tuple[StoredColumn, ...]
    snapshot: str  # folder of the snapshot
    next_id: int
    indexes: tuple[StoredIndex, ...] = ()
    seq: int = 0  # last change segment
    base_seq: int = 0  # changes up to here are in the snapshot
    backups: dict = field(default_factory=dict)  # name -> columns, snapshot, base_seq, seq
    segments: tuple[str, ...] = ()  # folders of the change segments, from number 1

    def dump(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @staticmethod
    def load(text: str) -> Manifest:
        d = json.loads(text)
        d["columns"] = tuple(StoredColumn(**c) for c in d["columns"])
        d["indexes"] = tuple(StoredIndex(**{**i, "columns": tuple(i["columns"])}) for i in d["indexes"])
        d["segments"] = tuple(d.get("segments", ()))
        return Manifest(**d)

    def key(self) -> StoredColumn | None:
        keys = [c for c in self.columns if c.primary_key]
        if len(keys) == 1:
            return keys[0]
        return next((c for c in self.columns if c.name == MIGRATION_KEY), None)

    def column(self, name: str) -> StoredColumn | None:
        return next((c for c in self.columns if c.name == name), None)


#: Times that a write is tried against writers that publish first.
MOST_TRIES = 20


class Conflict(EngineError):
    """Another writer has published first."""


class Store:
    """Tables below a root folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def list(self, path: str) -> list[str]:
        fs, p = self._fs(), self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def remove(self, path: str) -> None:
        self._fs().delete(self._path(path), True)

    def read_text(self, path: str) -> str:
        stream = self._fs().open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, m: Manifest) -> None:
        """Make a manifest the current one, unless its version is taken."""
        folder = f"{self.root}/{m.name}/manifest"
        fs, temp = self._fs(), self._path(f"{folder}/.{uuid.uuid4().hex}")
        stream = fs.create(temp, True)
        stream.write(bytearray(m.dump().encode()))
        stream.close()
        target = self._path(f"{folder}/{m.version:012d}.json")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(temp), fs.makeQualified(target), none)
        except Exception as e:
            fs.delete(temp, False)
            raise Conflict(f"version {m.version} of {m.name} has been published by another writer") from e

    def exists(self, name: str) -> bool:
        return any(x.endswith(".json") for x in self.list(f"{self.root}/{name}/manifest"))

    def manifest(self, name: str) -> Manifest:
        versions = [x for x in self.list(f"{self.root}/{name}/manifest") if x.endswith(".json")]
        if not versions:
            raise EngineError(f"no such table: {name}")
        return Manifest.load(self.read_text(f"{self.root}/{name}/manifest/{versions[-1]}"))

    def tables(self) -> list[str]:
        return [x for x in self.list(self.root) if self.exists(x)]

    def create(self, spec: TableSpec, name: str | None = None, migration_key: bool = False) -> Table:
        """A new empty table; nothing happens if it is there."""
        name = name or spec.name
        if self.exists(name):
            return Table(self, name)
        columns = [StoredColumn(k, c.name, c.type.sql(), c.nullable and not c.primary_key, c.primary_key, c.unique or c.primary_key, c.default_sql) for k, c in enumerate(spec.columns)]
        if migration_key and primary_key_column(spec) is None:
            columns.append(StoredColumn(len(columns), MIGRATION_KEY, "BIGINT", False, False, True))
        indexes = tuple(stored_index(name, i) for i in spec.indexes)
        m = Manifest(name, 1, tuple(columns), "", len(columns), indexes)
        self.publish(m)
        return Table(self, name)

    def table(self, name: str) -> Table:
        if not self.exists(name):
            raise EngineError(f"no such table: {name}")
        return Table(self, name)


def stored_index(table: str, i: IndexSpec) -> StoredIndex:
    return StoredIndex(index_name(table, i), i.method.lower(), i.unique, tuple(i.columns))


class Table:
    def __init__(self, store: Store, name: str):
        self.store, self.name, self.spark = store, name, store.spark
        self.folder = f"{store.root}/{name}"

    @property
    def manifest(self) -> Manifest:
        return self.store.manifest(self.name)

    def schema(self) -> TableSchema:
        return TableSchema(self.name, tuple(ColumnInfo(c.name, c.type, c.nullable, k, c.primary_key, c.unique) for k, c in enumerate(self.manifest.columns)))

    def index_identities(self) -> list[IndexIdentity]:
        return [IndexIdentity(i.method, i.unique, i.columns, i.predicate, i.has_expressions) for i in self.manifest.indexes]

    def _empty(self, columns: tuple[StoredColumn, ...]) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([T.StructField(c.physical, c.spark()) for c in columns]))

    def _snapshot(self, m: Manifest) -> DataFrame:
        if not m.snapshot:
            return self._empty(m.columns)
        # ids that a file doesn't have read as null
        schema = T.StructType([T.StructField(c.physical, c.spark()) for c in m.columns])
        return self.spark.read.schema(schema).parquet(m.snapshot)

    def changes(self, m: Manifest, low: int, high: int) -> DataFrame:
        """Change rows of the segments in (low, high]: seq, op (u or d) and the columns."""
        schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType())] + [T.StructField(c.physical, c.spark()) for c in m.columns])
        paths = [f"{self.folder}/changes/{x}" for x in m.segments[low:high]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _state(self, m: Manifest, upto: int | None = None) -> DataFrame:
        """Rows under physical names as of a sequence number."""
        base = self._snapshot(m)
        last = m.seq if upto is None else upto
        if last <= m.base_seq:
            return base
        log, key = self.changes(m, m.base_seq, last), m.key()
        names = [c.physical for c in m.columns]
        if key is None:
            return base.unionByName(log.select(names))
        newest = latest(log, key.physical)
        return base.join(newest.select(key.physical), key.physical, "left_anti").select(names).unionByName(newest.where("op = 'u'").select(names))

    def _logical(self, df: DataFrame, columns: tuple[StoredColumn, ...]) -> DataFrame:
        return df.select([F.col(c.physical).alias(c.name) for c in columns])

    def read(self, upto: int | None = None) -> DataFrame:
        m = self.manifest
        return self._logical(self._state(m, upto), m.columns)

    def _rows(self, m: Manifest, df: DataFrame) -> DataFrame:
        """Rows to be written: declared types, defaults for missing columns, required columns checked."""
        have, out = set(df.columns), []
        for c in m.columns:
            if c.name in have:
                x = F.col(spark_identifier(c.name))
            elif c.default_sql is not None:
                x = F.expr(c.default_sql)
            elif c.nullable or c.name == MIGRATION_KEY:
                x = F.lit(None)
            else:
                raise EngineError(f"column {c.name} is required")
            out.append(x.cast(c.spark()).alias(c.physical))
        if unknown := have - {c.name for c in m.columns}:
            raise EngineError(f"unknown columns: {sorted(unknown)}")
        return df.select(out)

    def _append_segment(self, m: Manifest, rows: DataFrame, op: str) -> None:
        """Write a segment in a folder of its own, then publish it; a writer that loses the race removes its own folder only."""
        seq = m.seq + 1
        name = f"{seq:012d}-{uuid.uuid4().hex}"
        rows.withColumn("seq", F.lit(seq).cast("long")).withColumn("op", F.lit(op)).write.parquet(f"{self.folder}/changes/{name}")
        try:
            self.store.publish(replace(m, version=m.version + 1, seq=seq, segments=(*m.segments, name)))
        except BaseException:
            self.store.remove(f"{self.folder}/changes/{name}")
            raise

    def _committed(self, write: Callable[[Manifest], None]) -> None:
        """Run a write against the newest manifest, and again, checks included, each time that another writer has published first."""
        for left in reversed(range(MOST_TRIES)):
            try:
                return write(self.manifest)
            except Conflict:
                if not left:
                    raise
                time.sleep(random.uniform(0, 0.2))

    def _check(self, m: Manifest, rows: DataFrame, existing: DataFrame | None) -> DataFrame:
        required = [c.physical for c in m.columns if not c.nullable]
        rows = not_null(rows, required)
        sets = [[c.physical] for c in m.columns if c.unique or c.primary_key] + [[m.column(x).physical for x in i.columns] for i in m.indexes if i.unique and not i.has_expressions and i.predicate is None]
        for columns in sets:
            both = rows.select(columns) if existing is None else rows.select(columns).unionByName(existing.select(columns))
            if unique_violations(both, columns).limit(1).count():
                raise EngineError(f"unique constraint violated on {[c.name for c in m.columns if c.physical in columns]}")
        return rows

    def insert(self, df: DataFrame) -> None:
        """Add rows; keys and unique columns must be new."""

        def write(m: Manifest) -> None:
            rows = self._with_migration_key(m, self._rows(m, df))
            self._append_segment(m, self._check(m, rows, self._state(m)), "u")

        self._committed(write)

    def upsert(self, df: DataFrame) -> None:
        """Add rows or replace those of equal key."""

        def write(m: Manifest) -> None:
            key = m.key()
            if key is None:
                raise EngineError("an upsert needs a single key column")
            rows = self._rows(m, df)
            rest = self._state(m).join(rows.select(key.physical), key.physical, "left_anti")
            self._append_segment(m, self._check(m, rows, rest), "u")

        self._committed(write)

    def delete(self, keys: DataFrame) -> None:
        """Delete rows by key; keys that aren't there do nothing."""

        def write(m: Manifest) -> None:
            key = m.key()
            if key is None:
                raise EngineError("a delete needs a single key column")
            only = keys.select(F.col(spark_identifier(key.name)).cast(key.spark()).alias(key.physical)).distinct()
            rows = only.select([F.col(key.physical) if c.id == key.id else F.lit(None).cast(c.spark()).alias(c.physical) for c in m.columns])
            self._append_segment(m, rows, "d")

        self._committed(write)

    def change_key(self, old, row: DataFrame) -> None:
        """Replace the row of key ``old`` by a row of another key: both keys are logged."""
        m = self.manifest
        key = m.key()
        self.delete(self.spark.createDataFrame([(old,)], T.StructType([T.StructField(key.name, key.spark())])))
        self.upsert(row)

    def _with_migration_key(self, m: Manifest, rows: DataFrame) -> DataFrame:
        c = m.column(MIGRATION_KEY)
        if c is None or any(x.primary_key for x in m.columns):
            return rows
        from loomtable.operators.rewrite import assign_migration_key  # noqa: PLC0415

        top = self._state(m).agg(F.max(c.physical)).first()[0] or 0
        rest = [x.physical for x in m.columns if x.id != c.id]
        return assign_migration_key(rows.select(rest), rest, top + 1, c.physical).select(rows.columns)

    def validate_unique(self, columns: list[str]) -> None:
        m = self.manifest
        names = [m.column(c).physical for c in columns]
        if unique_violations(self._state(m), names).limit(1).count():
            raise MigrationNeeded(f"values of {columns} aren't unique")

    def backups(self) -> list[str]:
        return list(self.manifest.backups)

    def read_backup(self, name: str) -> DataFrame:
        m = self.manifest
        b = m.backups[name]
        columns = tuple(StoredColumn(**c) for c in b["columns"])
        old = replace(m, columns=columns, snapshot=b["snapshot"], base_seq=b["base_seq"], seq=b["seq"])
        return self._logical(self._state(old), columns)
