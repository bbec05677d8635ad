"""Binary copy streams: decoding to columnar batches, encoding, and a Python data source over files of them."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomtable.errors import DataFormatError
from loomtable.formats import COPY_EPOCH_SHIFT_MICROS, COPY_SIGNATURE
from loomtable.sources.batch import ColumnarBatch, ColumnarSchema
from loomtable.types import COLUMNAR

_CODES = {"I16": ">h", "I32": ">i", "I64": ">q", "F32": ">f", "F64": ">d"}
_INFINITE = {2**63 - 1, -(2**63)}


@dataclass(frozen=True)
class CopyLimits:
    max_header_extension: int = 1 << 20
    max_field: int = 256 << 20
    validate_utf8: bool = True


class CopyReader:
    """Reads a stream of rows; fields are length-prefixed, -1 is null, and a field count of -1 ends the stream."""

    def __init__(self, stream: BinaryIO, schema: ColumnarSchema, limits: CopyLimits = CopyLimits()):
        self.stream, self.schema, self.limits, self.done = stream, schema, limits, False
        if self._take(len(COPY_SIGNATURE)) != COPY_SIGNATURE:
            raise DataFormatError("bad signature of a binary copy stream")
        flags, extension = struct.unpack(">iI", self._take(8))
        if flags:
            raise DataFormatError(f"unsupported flags {flags:#x}")
        if extension > limits.max_header_extension:
            raise DataFormatError("the header's extension is too large")
        self._take(extension)

    def _take(self, n: int) -> bytes:
        data = self.stream.read(n)
        if len(data) != n:
            raise DataFormatError("the copy stream ends too early")
        return data

    def _field(self, kind: str):
        n = struct.unpack(">i", self._take(4))[0]
        if n == -1:
            return None
        if not 0 <= n <= self.limits.max_field:
            raise DataFormatError(f"a field of {n} bytes")
        data, width = self._take(n), COLUMNAR[kind][2]
        if width is not None and n != width:
            raise DataFormatError(f"width mismatch: {kind} has {width} bytes, got {n}")
        if kind == "Bool":
            return data != b"\0"
        if kind in _CODES:
            return data if kind in ("F32", "F64") else struct.unpack(_CODES[kind], data)[0]
        if kind == "TimestampTzMicros":
            value = struct.unpack(">q", data)[0]
            if value in _INFINITE:
                raise DataFormatError("infinite timestamps aren't supported")
            if value + COPY_EPOCH_SHIFT_MICROS >= 2**63:
                raise DataFormatError("timestamp overflow")
            return value + COPY_EPOCH_SHIFT_MICROS
        if kind == "JsonbText" and data[:1] == b"\x01":
            data = data[1:]  # the binary type's version; plain JSON text has none
        if kind in ("Utf8", "JsonbText"):
            if self.limits.validate_utf8:
                try:
                    data.decode()
                except UnicodeDecodeError as e:
                    raise DataFormatError("invalid UTF-8 in a text field") from e
            return data  # the bytes as they are, valid or not checked
        return data

    def rows(self) -> Iterator[list]:
        while not self.done:
            n = struct.unpack(">h", self._take(2))[0]
            if n == -1:
                self.done = True
                return
            if n != len(self.schema):
                raise DataFormatError(f"column count mismatch: expected {len(self.schema)}, got {n}")
            yield [self._field(f.type) for f in self.schema.fields]

    def arrow(self, capacity: int) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for r in self.rows():
            held.append(r)
            if len(held) == capacity:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        kind, out = self.schema.arrow(), []
        for f, t, c in zip(self.schema.fields, kind.types, zip(*rows, strict=True), strict=True):
            if f.type in ("F32", "F64"):  # the bits as they are
                width = COLUMNAR[f.type][2]
                raw = b"".join((x or bytes(width))[::-1] for x in c)
                valid = pa.array([x is not None for x in c])
                out.append(pa.Array.from_buffers(t, len(c), [valid.buffers()[1], pa.py_buffer(raw)]))
            elif f.type in ("Utf8", "JsonbText"):
                out.append(pa.array(c, pa.binary()).cast(t, safe=False))
            else:
                out.append(pa.array(c, t))
        return pa.RecordBatch.from_arrays(out, schema=kind)

    def next_batch_into(self, out: ColumnarBatch) -> int:
        if out.schema != self.schema:
            raise DataFormatError("the batch's schema differs from the reader's")
        held: list[list] = []
        for r in self.rows():
            held.append(r)
            if len(held) == out.row_capacity:
                break
        out.prepare(out.row_capacity)
        if held:
            out._full = self._batch(held)
        return len(held)


def encode_copy(batches: Iterator[ColumnarBatch], out: BinaryIO) -> None:
    """Write batches as one binary copy stream."""
    out.write(COPY_SIGNATURE + struct.pack(">iI", 0, 0))
    for b in batches:
        columns = []
        for k, f in enumerate(b.schema.fields):
            valid = b.arrow().column(k).is_valid().to_pylist()
            if COLUMNAR[f.type][2] is None:
                offsets, data = b.variable(k)
                cells = [data[a:z] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                if f.type == "JsonbText":
                    cells = [b"\x01" + c for c in cells]
            elif f.type == "Uuid":
                cells = [bytes(x) for x in b.fixed(k)]
            else:
                x = b.fixed(k)
                if f.type == "TimestampTzMicros":
                    x = x - COPY_EPOCH_SHIFT_MICROS
                swapped = x.astype(x.dtype.newbyteorder(">")).tobytes()
                w = COLUMNAR[f.type][2]
                cells = [swapped[w * i : w * i + w] for i in range(len(x))]
            columns.append([struct.pack(">i", len(c)) + c if v else b"\xff\xff\xff\xff" for c, v in zip(cells, valid, strict=True)])
        head = struct.pack(">h", len(columns))
        for row in zip(*columns, strict=True):
            out.write(head + b"".join(row))
    out.write(struct.pack(">h", -1))


def encode_frame(df: DataFrame, schema: ColumnarSchema) -> DataFrame:
    """A row an Arrow batch: a whole copy stream (payload binary) of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = BytesIO()
                encode_copy(iter([ColumnarBatch.from_arrow(schema, b)]), out)
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["payload"])

    return df.mapInArrow(run, "payload binary")


def decode_frame(df: DataFrame, schema: ColumnarSchema, batch_rows: int = 10_000) -> DataFrame:
    """The rows of copy streams (payload binary); null payloads are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                if data is not None:
                    for x in CopyReader(BytesIO(data), schema).arrow(batch_rows):
                        yield pa.RecordBatch.from_arrays([c.cast(pa.binary()) if f.type == "Uuid" else c for c, f in zip(x.columns, schema.fields, strict=True)], names=schema.names())

    return df.select("payload").mapInArrow(run, schema.spark())


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class PgCopySource(DataSource):
    """spark.read.format("pgcopy").option("schema_json", ...).load(path): a partition a file.

    Options: path (a file or folder of any file system that pyarrow knows),
    columns ("name:Type,..."), batch_rows.
    """

    @classmethod
    def name(cls) -> str:
        return "pgcopy"

    def columnar(self) -> ColumnarSchema:
        return ColumnarSchema.of(*(tuple(x.rsplit(":", 1)) for x in self.options["columns"].split(",")))

    def schema(self):
        return self.columnar().spark()

    def reader(self, schema):
        return _CopySourceReader(self.options, self.columnar())


class _CopySourceReader(DataSourceReader):
    def __init__(self, options, schema: ColumnarSchema):
        self.path, self.rows, self.columns = options["path"], int(options.get("batch_rows", "10000")), schema

    def _fs(self):
        import pyarrow.fs as pafs

        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def partitions(self):
        import pyarrow.fs as pafs

        fs, root = self._fs()
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [_File(root)]
        files = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        return [_File(f.path) for f in sorted(files, key=lambda f: f.path) if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]

    def read(self, partition):
        fs, _ = self._fs()
        with fs.open_input_stream(partition.value) as stream:
            for b in CopyReader(stream, self.columns).arrow(self.rows):
                yield pa.RecordBatch.from_arrays([c.cast(pa.binary()) if f.type == "Uuid" else c for c, f in zip(b.columns, self.columns.fields, strict=True)], names=b.schema.names)
