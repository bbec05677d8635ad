"""The one strict table of types: declared, Spark, Arrow and wire types."""

from __future__ import annotations

import datetime as dt
import typing
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import types as T

from loomtable.errors import EngineError


@dataclass(frozen=True)
class FieldType:
    """A column's declared type; ``dim`` is the length of a Vector."""

    name: str
    dim: int | None = None

    def sql(self) -> str:
        return f"vector({self.dim})" if self.name == "Vector" else _SQL[self.name]

    def spark(self) -> T.DataType:
        return _SPARK[self.name]

    @staticmethod
    def of(sql: str) -> FieldType:
        known = {normalize_type(v): k for k, v in _SQL.items()}
        up = normalize_type(sql)
        if up.startswith("VECTOR("):
            return FieldType("Vector", int(up[7:-1]))
        if up not in known:
            raise EngineError(f"unsupported type: {sql}")
        return FieldType(known[up])


_SQL = {
    "Text": "TEXT", "Uuid": "UUID", "Integer": "INTEGER", "BigInt": "BIGINT", "Real": "REAL", "DoublePrecision": "DOUBLE PRECISION",
    "Boolean": "BOOLEAN", "TimestampTz": "TIMESTAMPTZ", "Bytea": "BYTEA", "Jsonb": "JSONB", "SmallInt": "SMALLINT",
    "IntegerArray": "INTEGER[]", "BigIntArray": "BIGINT[]", "DoublePrecisionArray": "DOUBLE PRECISION[]", "TextArray": "TEXT[]",
}
_SPARK: dict[str, T.DataType] = {
    "Text": T.StringType(), "Uuid": T.BinaryType(), "Integer": T.IntegerType(), "BigInt": T.LongType(), "Real": T.FloatType(),
    "DoublePrecision": T.DoubleType(), "Boolean": T.BooleanType(), "TimestampTz": T.TimestampType(), "Bytea": T.BinaryType(),
    "Jsonb": T.StringType(), "SmallInt": T.ShortType(), "Vector": T.ArrayType(T.FloatType()), "IntegerArray": T.ArrayType(T.IntegerType()),
    "BigIntArray": T.ArrayType(T.LongType()), "DoublePrecisionArray": T.ArrayType(T.DoubleType()), "TextArray": T.ArrayType(T.StringType()),
}
# Other spellings of type names.
_ALIASES = {
    "TIMESTAMP WITH TIME ZONE": "TIMESTAMPTZ", "CHARACTER VARYING": "VARCHAR", "INT": "INTEGER", "INT4": "INTEGER", "INT8": "BIGINT", "FLOAT8": "DOUBLE PRECISION", "FLOAT4": "REAL",
}


def normalize_type(sql: str) -> str:
    up = sql.upper()
    return _ALIASES.get(up, up)


class Json(str):
    """Annotation of a JSON text column."""


def python_field_type(kind) -> tuple[FieldType, bool]:
    """(type, nullable) of a Python annotation; unknown ones raise."""
    args = typing.get_args(kind)
    if type(None) in args:
        rest = [a for a in args if a is not type(None)]
        if len(rest) != 1:
            raise EngineError(f"unsupported annotation: {kind}")
        return python_field_type(rest[0])[0], True
    if typing.get_origin(kind) is list and args:
        names = {int: "BigIntArray", float: "DoublePrecisionArray", str: "TextArray"}
        if args[0] in names:
            return FieldType(names[args[0]]), False
    names = {str: "Text", int: "BigInt", float: "DoublePrecision", bool: "Boolean", bytes: "Bytea", uuid.UUID: "Uuid", dt.datetime: "TimestampTz", Json: "Jsonb"}
    if isinstance(kind, FieldType):
        return kind, False
    if kind not in names:
        raise EngineError(f"unsupported annotation: {kind}")
    return FieldType(names[kind]), False


#: Column types of batches: Spark type, Arrow type, bytes a value (None: variable).
COLUMNAR: dict[str, tuple[T.DataType, pa.DataType, int | None]] = {
    "Bool": (T.BooleanType(), pa.bool_(), 1),
    "I16": (T.ShortType(), pa.int16(), 2),
    "I32": (T.IntegerType(), pa.int32(), 4),
    "I64": (T.LongType(), pa.int64(), 8),
    "F32": (T.FloatType(), pa.float32(), 4),
    "F64": (T.DoubleType(), pa.float64(), 8),
    "Uuid": (T.BinaryType(), pa.binary(16), 16),
    "TimestampTzMicros": (T.TimestampType(), pa.timestamp("us", "UTC"), 8),
    "Utf8": (T.StringType(), pa.string(), None),
    "Bytes": (T.BinaryType(), pa.binary(), None),
    "JsonbText": (T.StringType(), pa.string(), None),
}
#: How messages name the types.
TYPE_HINTS = {
    "Bool": "BOOL", "I16": "SMALLINT", "I32": "INTEGER", "I64": "BIGINT", "F32": "REAL", "F64": "DOUBLE PRECISION", "Uuid": "UUID", "TimestampTzMicros": "TIMESTAMPTZ", "Utf8": "TEXT/VARCHAR", "Bytes": "BYTEA", "JsonbText": "JSON/JSONB",
}


def columnar_type(kind: T.DataType) -> str:
    """The batch column type of a Spark type; those without one raise."""
    for name, (spark, _, _) in COLUMNAR.items():
        if spark == kind and name != "Uuid":
            return name
    raise EngineError(f"no batch column type for {kind.simpleString()}")
