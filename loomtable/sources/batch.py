"""Bounded columnar batches: a thin builder and accessor over Arrow."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from loomtable.errors import DataFormatError
from loomtable.types import COLUMNAR


@dataclass(frozen=True)
class ColumnarField:
    name: str | None
    type: str

    def __post_init__(self):
        if self.type not in COLUMNAR:
            raise DataFormatError(f"unknown column type: {self.type}")


class ColumnarSchema:
    """Ordered fields, at least one; positions matter, names may be missing."""

    def __init__(self, fields: list[ColumnarField]):
        if not fields:
            raise DataFormatError("a columnar schema needs at least one field")
        self.fields = tuple(fields)

    @staticmethod
    def of(*fields: tuple[str | None, str]) -> ColumnarSchema:
        return ColumnarSchema([ColumnarField(*f) for f in fields])

    @staticmethod
    def from_spec(spec) -> tuple[ColumnarSchema, dict[str, int]]:
        """Schema and name -> position of a TableSpec whose types all have a batch type."""
        kinds = {"Text": "Utf8", "Uuid": "Uuid", "SmallInt": "I16", "Integer": "I32", "BigInt": "I64", "Real": "F32", "DoublePrecision": "F64", "Boolean": "Bool", "TimestampTz": "TimestampTzMicros", "Bytea": "Bytes", "Jsonb": "JsonbText"}
        for c in spec.columns:
            if c.type.name not in kinds:
                raise DataFormatError(f"column {c.name}: {c.type.name} can't be read in batches")
        return ColumnarSchema.of(*((c.name, kinds[c.type.name]) for c in spec.columns)), {c.name: k for k, c in enumerate(spec.columns)}

    def __len__(self) -> int:
        return len(self.fields)

    def __eq__(self, other) -> bool:
        return isinstance(other, ColumnarSchema) and self.fields == other.fields

    def __hash__(self) -> int:
        return hash(self.fields)

    def names(self) -> list[str]:
        return [f.name or f"c{k}" for k, f in enumerate(self.fields)]

    def arrow(self) -> pa.Schema:
        return pa.schema([pa.field(n, COLUMNAR[f.type][1]) for n, f in zip(self.names(), self.fields, strict=True)])

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(n, COLUMNAR[f.type][0]) for n, f in zip(self.names(), self.fields, strict=True)])


_NUMPY = {"Bool": np.uint8, "I16": np.int16, "I32": np.int32, "I64": np.int64, "F32": np.uint32, "F64": np.uint64, "TimestampTzMicros": np.int64}


class ColumnarBatch:
    """Rows of a schema up to a capacity, filled by pushes or taken from Arrow."""

    def __init__(self, schema: ColumnarSchema, row_capacity: int):
        if row_capacity <= 0:
            raise DataFormatError("row capacity must be positive")
        self.schema = schema
        self.prepare(row_capacity)

    def prepare(self, row_capacity: int) -> None:
        """Empty the batch, with a new capacity."""
        self.row_capacity = row_capacity
        self._rows: list[list] = [[] for _ in self.schema.fields]
        self._full: pa.RecordBatch | None = None

    @staticmethod
    def from_arrow(schema: ColumnarSchema, data: pa.RecordBatch, capacity: int | None = None) -> ColumnarBatch:
        out = ColumnarBatch(schema, capacity or max(1, data.num_rows))
        if data.num_rows > out.row_capacity:
            raise DataFormatError("more rows than the batch's capacity")
        out._full = pa.RecordBatch.from_arrays([c.cast(t) if c.type != t else c for c, t in zip(data.columns, schema.arrow().types, strict=True)], schema=schema.arrow())
        return out

    def arrow(self) -> pa.RecordBatch:
        if self._full is None:
            kinds = self.schema.arrow()
            self._full = pa.RecordBatch.from_arrays([pa.array(r[: self.row_count], t) for r, t in zip(self._rows, kinds.types, strict=True)], schema=kinds)
        return self._full

    @property
    def row_count(self) -> int:
        return self._full.num_rows if self._full is not None else min(map(len, self._rows))

    @property
    def current_row_index(self) -> int:
        return self.row_count

    def push(self, column: int, value) -> None:
        """Append a value (None: null) to a column; each column takes one a row."""
        kind = self.schema.fields[column].type
        if self._full is not None and self._full.num_rows:
            raise DataFormatError("the batch has been read already; prepare it first")
        self._full = None
        if len(self._rows[column]) >= self.row_capacity:
            raise DataFormatError("the batch is full")
        if value is not None:
            python = {"Bool": bool, "Utf8": str, "JsonbText": str, "Bytes": bytes, "Uuid": bytes, "F32": float, "F64": float}.get(kind, int)
            if not isinstance(value, python) or python is int and isinstance(value, bool):
                raise DataFormatError(f"a {kind} column takes no {type(value).__name__}")
            if kind == "Uuid" and len(value) != 16:
                raise DataFormatError("a Uuid has 16 bytes")
        self._rows[column].append(value)

    def end_row(self) -> None:
        if len({len(r) for r in self._rows}) != 1:
            raise DataFormatError("a row needs a value for each column")

    def column_type(self, column: int) -> str:
        return self.schema.fields[column].type

    def validity(self, column: int) -> bytes:
        """Bit k % 8 of byte k // 8 is 1 if row k isn't null."""
        return np.packbits(np.asarray(self.arrow().column(column).is_valid()), bitorder="little").tobytes()

    def fixed(self, column: int) -> np.ndarray:
        """Values of a fixed-width column: integers, 0 or 1, the bits of floats, microseconds, or rows of 16 bytes; null is 0."""
        kind, a = self.column_type(column), self.arrow().column(column)
        if kind == "Uuid":
            return np.frombuffer(b"".join(x or bytes(16) for x in a.to_pylist()), np.uint8).reshape(-1, 16)
        if kind not in _NUMPY:
            raise DataFormatError(f"{kind} is no fixed-width type")
        if kind == "TimestampTzMicros":
            a = a.cast(pa.int64())
        if kind in ("F32", "F64"):
            # through the buffer, so that every bit stays
            width = a.type.bit_width // 8
            raw = np.frombuffer(a.buffers()[1], _NUMPY[kind])[a.offset : a.offset + len(a)].copy() if len(a) and a.buffers()[1] else np.zeros(len(a), f"u{width}")
            raw[~np.asarray(a.is_valid())] = 0
            return raw
        return a.fill_null(False if kind == "Bool" else 0).to_numpy(zero_copy_only=False).astype(_NUMPY[kind])

    def variable(self, column: int) -> tuple[np.ndarray, bytes]:
        """(row + 1 offsets, bytes) of a variable-width column; null has no bytes."""
        if self.column_type(column) not in ("Utf8", "Bytes", "JsonbText"):
            raise DataFormatError(f"{self.column_type(column)} is no variable-width type")
        values = [x or b"" for x in self.arrow().column(column).cast(pa.binary()).to_pylist()]
        offsets = np.cumsum([0, *map(len, values)])
        if offsets[-1] >= 2**32:
            raise DataFormatError("a column's bytes in a batch must stay below 4 GiB")
        return offsets.astype("<u4"), b"".join(values)
