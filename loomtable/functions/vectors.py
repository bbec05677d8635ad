"""Compressed numeric vectors in binary columns.

A 20-byte header (magic, version, codec, element type, reserved, count,
uncompressed length, CRC-32 of the payload; little-endian) and the payload.
The codec is this engine's own: differences of neighbouring values (floats as
their bits), bytes transposed, then zlib.  Every bit of a float is kept.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomtable.errors import DataFormatError
from loomtable.formats import ELEMENT_TYPE_IDS, VECTOR_MAGIC, VECTOR_VERSION

_HEADER = struct.Struct("<4sBBBBIII")
#: This codec's number; 1 and 2 are other writers' codecs, whose payloads can't be read here.
CODEC_DELTA_ZLIB = 16
_DTYPES = {"I32": "<i4", "I64": "<i8", "U32": "<u4", "U64": "<u8", "F32": "<f4", "F64": "<f8"}
_NAMES = {v: k for k, v in ELEMENT_TYPE_IDS.items()}


def crc32_payload(payload: bytes) -> int:
    return zlib.crc32(payload)


def compress(values, element: str) -> bytes:
    if element not in _DTYPES:
        raise DataFormatError(f"unknown element type {element}")
    x = np.ascontiguousarray(values, np.dtype(_DTYPES[element]))
    width = x.dtype.itemsize
    bits = x.view(f"<u{width}")
    delta = np.diff(bits, prepend=bits.dtype.type(0))  # wraps around
    # small differences of either sign become small numbers
    zigzag = (delta << bits.dtype.type(1)) ^ (bits.dtype.type(0) - (delta >> bits.dtype.type(8 * width - 1)))
    payload = zlib.compress(np.ascontiguousarray(zigzag.view(np.uint8).reshape(-1, width).T).tobytes(), 6)
    return _HEADER.pack(VECTOR_MAGIC, VECTOR_VERSION, CODEC_DELTA_ZLIB, ELEMENT_TYPE_IDS[element], 0, len(x), width * len(x), zlib.crc32(payload)) + payload


def parse(data: bytes) -> tuple[dict, bytes]:
    """(header, payload) after checks of length, magic, version, codec, element type and checksum."""
    if len(data) < _HEADER.size:
        raise DataFormatError("the vector envelope is too short")
    magic, version, codec, element, _, count, length, crc = _HEADER.unpack(data[: _HEADER.size])
    if magic != VECTOR_MAGIC:
        raise DataFormatError("bad magic")
    if version != VECTOR_VERSION:
        raise DataFormatError(f"unsupported version {version}")
    if codec != CODEC_DELTA_ZLIB:
        raise DataFormatError(f"unsupported codec {codec}")
    if element not in _NAMES:
        raise DataFormatError(f"unknown element type {element}")
    payload = data[_HEADER.size :]
    if zlib.crc32(payload) != crc:
        raise DataFormatError("checksum mismatch")
    return {"version": version, "codec": codec, "element": _NAMES[element], "count": count, "uncompressed_len": length, "crc32": crc}, payload


def decompress(data: bytes, element: str) -> np.ndarray:
    head, payload = parse(bytes(data))
    if head["element"] != element:
        raise DataFormatError(f"element type mismatch: stored {head['element']}, asked for {element}")
    dtype = np.dtype(_DTYPES[element])
    width = dtype.itemsize
    raw = np.frombuffer(zlib.decompress(payload), np.uint8)
    if len(raw) != width * head["count"] or head["uncompressed_len"] != len(raw):
        raise DataFormatError("element count mismatch")
    zigzag = np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(f"<u{width}")
    one = zigzag.dtype.type(1)
    delta = (zigzag >> one) ^ (zigzag.dtype.type(0) - (zigzag & one))
    return np.cumsum(delta, dtype=zigzag.dtype).view(dtype)


def compress_udf(element: str):
    """A pandas UDF array -> binary; null stays null, and U64 comes as decimals or the bits of longs."""

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else compress(np.array([int(x) for x in v], np.uint64) if element == "U64" else v, element))

    return run


def decompress_udf(element: str):
    """A pandas UDF binary -> array."""
    kind = {"I32": "int", "I64": "long", "U32": "long", "U64": "decimal(20,0)", "F32": "float", "F64": "double"}[element]

    @F.pandas_udf(f"array<{kind}>")
    def run(column: pd.Series) -> pd.Series:
        import decimal

        def one(v):
            if v is None:
                return None
            x = decompress(v, element)
            return [decimal.Decimal(int(y)) for y in x] if element == "U64" else x.astype(np.int64) if element == "U32" else x

        return column.map(one)

    return run


def register(spark) -> None:
    """SQL functions compress_vec_<type> and decompress_vec_<type> (f64, i64 ...)."""
    for element in _DTYPES:
        spark.udf.register(f"compress_vec_{element.lower()}", compress_udf(element))
        spark.udf.register(f"decompress_vec_{element.lower()}", decompress_udf(element))
