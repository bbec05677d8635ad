"""Declared tables: columns, keys, uniqueness, defaults, renames and logical indexes."""

from __future__ import annotations

import dataclasses
import re
import typing
from dataclasses import dataclass, field

from pyspark.sql import types as T

from loomtable.errors import EngineError
from loomtable.formats import NAME_LIMIT
from loomtable.types import FieldType, python_field_type

INDEX_METHODS = ("BTREE", "HASH", "GIN", "GIST")


def quote_identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def validate_id(value: str, label: str = "id") -> str:
    """Ids of flattened columns: [a-z][a-z0-9_]*, at most 63 bytes."""
    if not value:
        raise EngineError(f"{label} must not be empty")
    if len(value.encode()) > NAME_LIMIT:
        raise EngineError(f"{label} exceeds {NAME_LIMIT} bytes")
    if not re.fullmatch(r"[a-z][a-z0-9_]*", value):
        raise EngineError(f"{label} must match [a-z][a-z0-9_]*: {value!r}")
    return value


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: FieldType
    nullable: bool = True
    primary_key: bool = False
    unique: bool = False
    default_sql: str | None = None
    rename_from: str | None = None


@dataclass(frozen=True)
class IndexSpec:
    columns: tuple[str, ...]
    unique: bool = False
    method: str = "BTREE"
    name: str = ""

    def __post_init__(self):
        if self.method not in INDEX_METHODS:
            raise EngineError(f"unknown index method: {self.method}")


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    indexes: tuple[IndexSpec, ...] = ()

    def column(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name == name), None)

    def create_table_sql(self, name: str | None = None) -> str:
        lines = []
        for c in self.columns:
            parts = [quote_identifier(c.name), c.type.sql()]
            if c.default_sql is not None:
                parts.append(f"DEFAULT {c.default_sql}")
            if c.primary_key:
                parts.append("PRIMARY KEY")
            else:
                parts += ["UNIQUE"] * c.unique + ["NOT NULL"] * (not c.nullable)
            lines.append(" ".join(parts))
        body = ",\n  ".join(lines)
        return f"CREATE TABLE IF NOT EXISTS {quote_identifier(name or self.name)} (\n  {body}\n)"

    def struct(self) -> T.StructType:
        """The same as a Spark schema, with keys, defaults and renames in the metadata."""
        out = []
        for c in self.columns:
            meta = {"type": c.type.sql(), "primary_key": c.primary_key, "unique": c.unique}
            meta |= {k: v for k, v in (("default_sql", c.default_sql), ("rename_from", c.rename_from), ("dim", c.type.dim)) if v is not None}
            out.append(T.StructField(c.name, c.type.spark(), c.nullable and not c.primary_key, meta))
        return T.StructType(out)

    @staticmethod
    def from_struct(name: str, schema: T.StructType, indexes: tuple[IndexSpec, ...] = ()) -> TableSpec:
        return TableSpec(name, tuple(_from_field(f) for f in schema), indexes)


def _from_field(f: T.StructField) -> ColumnSpec:
    m = f.metadata or {}
    if "type" in m:
        kind = FieldType.of(m["type"])
    else:
        names = {T.StringType(): "Text", T.LongType(): "BigInt", T.IntegerType(): "Integer", T.ShortType(): "SmallInt", T.DoubleType(): "DoublePrecision", T.FloatType(): "Real", T.BooleanType(): "Boolean", T.BinaryType(): "Bytea", T.TimestampType(): "TimestampTz"}
        names |= {T.ArrayType(T.IntegerType()): "IntegerArray", T.ArrayType(T.LongType()): "BigIntArray", T.ArrayType(T.DoubleType()): "DoublePrecisionArray", T.ArrayType(T.StringType()): "TextArray"}
        plain = T.ArrayType(f.dataType.elementType) if isinstance(f.dataType, T.ArrayType) else f.dataType
        if plain not in names:
            raise EngineError(f"column {f.name}: no declared type for {f.dataType.simpleString()}")
        kind = FieldType(names[plain])
    return ColumnSpec(f.name, kind, f.nullable, m.get("primary_key", False), m.get("unique", False), m.get("default_sql"), m.get("rename_from"))


def column(**options) -> typing.Any:
    """Options of a dataclass field: primary_key, unique, default_sql, rename_from, index (bool or name), index_unique, type, skip."""
    known = {"primary_key", "unique", "default_sql", "rename_from", "index", "index_unique", "index_method", "type", "skip", "prefix", "id", "family"}
    if wrong := set(options) - known:
        raise EngineError(f"unknown column options: {sorted(wrong)}")
    return field(metadata=options)


def table_spec(cls: type, name: str | None = None, indexes: tuple[IndexSpec, ...] = ()) -> TableSpec:
    """The spec of a dataclass: annotations give types and nullability, ``column`` the rest; the default name is the class's in lower case."""
    hints = typing.get_type_hints(cls)
    columns, own = [], []
    for f in dataclasses.fields(cls):
        o = dict(f.metadata)
        if o.get("skip"):
            continue
        kind, nullable = python_field_type(hints[f.name])
        columns.append(ColumnSpec(f.name, o.get("type", kind), nullable and not o.get("primary_key", False), o.get("primary_key", False), o.get("unique", False), o.get("default_sql"), o.get("rename_from")))
        if o.get("index"):
            own.append(IndexSpec((f.name,), o.get("index_unique", False), o.get("index_method", "BTREE"), o["index"] if isinstance(o["index"], str) else ""))
    return TableSpec(name or cls.__name__.lower(), tuple(columns), (*own, *indexes))
