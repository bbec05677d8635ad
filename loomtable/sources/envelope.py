"""The batch envelope: one self-describing, length-checked binary value a batch.

Little-endian: magic, version u16, flags u16, rows u32, columns u16; then for
each column type u16, encoding u16 (0), name length u16 and name, and three
parts, each behind its length u32: validity bits, values or offsets, bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomtable.errors import DataFormatError
from loomtable.formats import BATCH_MAGIC, BATCH_VERSION, COLUMN_TYPE_IDS
from loomtable.sources.batch import ColumnarBatch, ColumnarField, ColumnarSchema
from loomtable.types import COLUMNAR, columnar_type

_NAMES = {v: k for k, v in COLUMN_TYPE_IDS.items()}


def _sized(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + data


def encode(batch: ColumnarBatch) -> bytes:
    out = [BATCH_MAGIC, struct.pack("<HHIH", BATCH_VERSION, 0, batch.row_count, len(batch.schema))]
    for k, f in enumerate(batch.schema.fields):
        name = (f.name or "").encode()
        if len(name) > 0xFFFF:
            raise DataFormatError("a column's name is too long")
        out.append(struct.pack("<HHH", COLUMN_TYPE_IDS[f.type], 0, len(name)) + name + _sized(batch.validity(k)))
        if COLUMNAR[f.type][2] is None:
            offsets, data = batch.variable(k)
            out += [_sized(offsets.tobytes()), _sized(data)]
        else:
            values = batch.fixed(k)
            out += [_sized(values.astype(values.dtype.newbyteorder("<")).tobytes()), _sized(b"")]
    return b"".join(out)


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0

    def take(self, n: int) -> memoryview:
        if self.at + n > len(self.data):
            raise DataFormatError("the envelope ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> int:
        return struct.unpack(f"<{code}", self.take(struct.calcsize(f"<{code}")))[0]

    def sized(self) -> bytes:
        return bytes(self.take(self.number("I")))


def decode(data: bytes) -> ColumnarBatch:
    c = _Cursor(data)
    if bytes(c.take(len(BATCH_MAGIC))) != BATCH_MAGIC:
        raise DataFormatError("bad magic")
    if (version := c.number("H")) != BATCH_VERSION:
        raise DataFormatError(f"unsupported version {version}")
    c.number("H")  # flags
    rows, columns = c.number("I"), c.number("H")
    fields, arrays = [], []
    for _ in range(columns):
        kind, encoding = c.number("H"), c.number("H")
        if kind not in _NAMES:
            raise DataFormatError(f"unknown column type {kind}")
        if encoding:
            raise DataFormatError(f"unknown encoding {encoding}")
        try:
            name = bytes(c.take(c.number("H"))).decode() or None
        except UnicodeDecodeError as e:
            raise DataFormatError("a column's name is no UTF-8") from e
        validity, first, second = c.sized(), c.sized(), c.sized()
        if len(validity) != -(-rows // 8):
            raise DataFormatError("validity length mismatch")
        fields.append(ColumnarField(name, _NAMES[kind]))
        arrays.append(_array(_NAMES[kind], rows, validity, first, second))
    if c.at != len(data):
        raise DataFormatError("trailing bytes")
    schema = ColumnarSchema(fields)
    return ColumnarBatch.from_arrow(schema, pa.RecordBatch.from_arrays(arrays, schema=schema.arrow()), max(1, rows))


def _array(kind: str, rows: int, validity: bytes, first: bytes, second: bytes) -> pa.Array:
    _, arrow, width = COLUMNAR[kind]
    valid = pa.py_buffer(validity)
    if width is None:
        if len(first) != 4 * (rows + 1):
            raise DataFormatError("offsets length mismatch")
        offsets = np.frombuffer(first, "<u4")
        if offsets[0] or (offsets[1:] < offsets[:-1]).any() or offsets[-1] != len(second):
            raise DataFormatError("offsets must start at 0, not descend and end at the data's length")
        large = pa.large_string() if arrow == pa.string() else pa.large_binary()
        out = pa.Array.from_buffers(large, rows, [valid, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(second)])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid as e:
            raise DataFormatError(f"invalid UTF-8: {e}") from e
        return out.cast(arrow)
    if len(first) != width * rows or second:
        raise DataFormatError("values length mismatch")
    if kind == "Bool":
        bits = np.frombuffer(first, np.uint8)
        if (bits > 1).any():
            raise DataFormatError("a Bool is 0 or 1")
        first = np.packbits(bits, bitorder="little").tobytes()
    return pa.Array.from_buffers(arrow, rows, [valid, pa.py_buffer(first)])


def decode_into(data: bytes, out: ColumnarBatch) -> int:
    """Decode into a batch of the same schema; the number of rows."""
    got = decode(data)
    if got.schema != out.schema:
        raise DataFormatError("schema mismatch between the envelope and the batch")
    out.prepare(max(out.row_capacity, got.row_count))
    out._full = got.arrow()
    return got.row_count


def schema_of(kind: T.StructType, overrides: dict[str, str] | None = None) -> ColumnarSchema:
    """Batch schema of a Spark schema; ``overrides`` names Uuid and JsonbText columns."""
    return ColumnarSchema([ColumnarField(f.name, (overrides or {}).get(f.name) or columnar_type(f.dataType)) for f in kind])


def encode_frame(df: DataFrame, schema: ColumnarSchema | None = None) -> DataFrame:
    """A row an Arrow batch: the number of rows and the envelope."""
    s = schema or schema_of(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), pa.array([encode(ColumnarBatch.from_arrow(s, b))], pa.binary())], names=["n_rows", "payload"])

    return df.mapInArrow(run, "n_rows int, payload binary")


def decode_frame(df: DataFrame, schema: ColumnarSchema, column: str = "payload") -> DataFrame:
    """The rows of envelopes, each of which must have the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                if data is None:
                    continue
                got = decode(data)
                if got.schema != schema:
                    raise DataFormatError("schema mismatch between the envelope and the declared schema")
                x = got.arrow()
                yield pa.RecordBatch.from_arrays([c.cast(pa.binary()) if f.type == "Uuid" else c for c, f in zip(x.columns, schema.fields, strict=True)], names=schema.names())

    return df.select(column).mapInArrow(run, schema.spark())
