import io
import struct
import uuid

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtable.errors import DataFormatError
from loomtable.formats import BATCH_MAGIC, COPY_EPOCH_SHIFT_MICROS
from loomtable.functions import vectors
from loomtable.functions.scalars import canonical_json
from loomtable.sources import envelope
from loomtable.sources.batch import ColumnarBatch, ColumnarSchema
from loomtable.sources.pgcopy import CopyReader, encode_copy

ALL = ColumnarSchema.of(("b", "Bool"), ("s", "I16"), ("i", "I32"), ("l", "I64"), ("f", "F32"), ("d", "F64"), ("u", "Uuid"), ("t", "TimestampTzMicros"), ("x", "Utf8"), ("y", "Bytes"), ("j", "JsonbText"))
# The fixture's envelope behind the magic.
GOLDEN = (
    "01000000030000000300040000000100610100000005180000000a0000000000000000000000000000001e00000000000000000000000900000001006201000000071000000000"
    "0000000100000003000000030000000300000078797a0a0000000100630100000002100000000000000000000000020000000200000002000000aabb"
)


def filled(schema, rows, capacity=16):
    b = ColumnarBatch(schema, capacity)
    for r in rows:
        for k, v in enumerate(r):
            b.push(k, v)
        b.end_row()
    return b


ROWS = [
    (True, 1, -2, 3, 1.5, 2.5, uuid.UUID(int=5).bytes, 10, "hello", b"\1\2", '{"a": 1}'),
    (None,) * 11,
    (False, -1, 7, -7, -0.0, float("inf"), uuid.UUID(int=2**127).bytes, -1, "", b"", "[1, 2]"),
]


def test_golden_envelope():
    schema = ColumnarSchema.of(("a", "I64"), ("b", "Utf8"), ("c", "Bytes"))
    b = filled(schema, [(10, "x", None), (None, "yz", b"\xaa\xbb"), (30, "", None)])
    data = envelope.encode(b)
    assert data == BATCH_MAGIC + bytes.fromhex(GOLDEN) and len(data) == 139
    back = envelope.decode(data)
    assert back.arrow().to_pylist() == b.arrow().to_pylist()
    assert back.schema == schema


def test_all_types_round_trip_when_not_full():
    b = filled(ALL, ROWS)
    back = envelope.decode(envelope.encode(b))
    assert back.arrow().equals(b.arrow())
    out = ColumnarBatch(ALL, 1)
    assert envelope.decode_into(envelope.encode(b), out) == 3
    with pytest.raises(DataFormatError, match="mismatch"):
        envelope.decode_into(envelope.encode(b), ColumnarBatch(ColumnarSchema.of(("b", "Bool")), 1))


def test_envelope_refuses_broken_bytes():
    schema = ColumnarSchema.of(("b", "Utf8"),)
    data = bytearray(envelope.encode(filled(schema, [("a",), ("b",), ("",)])))
    at = data.index(struct.pack("<4I", 0, 1, 2, 2))
    bad = bytes(data[:at]) + struct.pack("<4I", 0, 2, 1, 2) + bytes(data[at + 16 :])
    with pytest.raises(DataFormatError, match="offsets"):
        envelope.decode(bad)
    with pytest.raises(DataFormatError, match="trailing"):
        envelope.decode(bytes(data) + b"x")
    for n in range(len(data)):
        with pytest.raises(DataFormatError):
            envelope.decode(bytes(data[:n]))


def test_float_bits_survive():
    bits = np.array([0x7FF8000000000ABC, 0x8000000000000000, 1], np.uint64)
    s = ColumnarSchema.of(("d", "F64"))
    b = ColumnarBatch.from_arrow(s, pa.RecordBatch.from_arrays([pa.array(bits.view(np.float64))], names=["d"]))
    assert (envelope.decode(envelope.encode(b)).fixed(0) == bits).all()
    out = io.BytesIO()
    encode_copy(iter([b]), out)
    out.seek(0)
    assert (ColumnarBatch.from_arrow(s, next(CopyReader(out, s).arrow(10))).fixed(0) == bits).all()


def test_batch_refuses_wrong_use():
    with pytest.raises(DataFormatError):
        ColumnarSchema([])
    with pytest.raises(DataFormatError):
        ColumnarBatch(ALL, 0)
    b = ColumnarBatch(ColumnarSchema.of(("a", "I64")), 1)
    with pytest.raises(DataFormatError):
        b.push(0, "x")
    b.push(0, 1)
    with pytest.raises(DataFormatError, match="full"):
        b.push(0, 2)


def test_copy_stream_round_trip_and_batches():
    b = filled(ALL, ROWS)
    out = io.BytesIO()
    encode_copy(iter([b]), out)
    assert [x.to_pylist() for x in CopyReader(io.BytesIO(out.getvalue()), ALL).arrow(2)] == [b.arrow().to_pylist()[:2], b.arrow().to_pylist()[2:]]
    r, batch = CopyReader(io.BytesIO(out.getvalue()), ALL), ColumnarBatch(ALL, 2)
    assert [r.next_batch_into(batch) for _ in range(4)] == [2, 1, 0, 0]


def copy_bytes(fields, flags=0):
    body = struct.pack(">h", len(fields)) + b"".join(struct.pack(">i", len(f)) + f for f in fields)
    return b"PGCOPY\n\xff\r\n\x00" + struct.pack(">iI", flags, 0) + body + struct.pack(">h", -1)


def test_copy_stream_refusals():
    one = lambda kind, raw: next(CopyReader(io.BytesIO(copy_bytes([raw])), ColumnarSchema.of(("a", kind))).arrow(5)).column(0).to_pylist()
    assert one("JsonbText", b'\x01{"a": 1}') == ['{"a": 1}'] and one("JsonbText", b"[1]") == ["[1]"]
    with pytest.raises(DataFormatError, match="width mismatch"):
        one("I64", b"1234")
    with pytest.raises(DataFormatError, match="infinite"):
        one("TimestampTzMicros", struct.pack(">q", 2**63 - 1))
    with pytest.raises(DataFormatError, match="UTF-8"):
        one("Utf8", b"\xff")
    with pytest.raises(DataFormatError, match="column count"):
        list(CopyReader(io.BytesIO(copy_bytes([b"", b""])), ColumnarSchema.of(("a", "Utf8"))).arrow(5))
    with pytest.raises(DataFormatError, match="flags"):
        CopyReader(io.BytesIO(copy_bytes([], 1)), ALL)
    with pytest.raises(DataFormatError, match="too early"):
        list(CopyReader(io.BytesIO(copy_bytes([b"ab"])[:-4]), ColumnarSchema.of(("a", "Utf8"))).arrow(5))
    got = next(CopyReader(io.BytesIO(copy_bytes([struct.pack(">q", 0)])), ColumnarSchema.of(("a", "TimestampTzMicros"))).arrow(5))
    assert got.column(0).cast(pa.int64()).to_pylist() == [COPY_EPOCH_SHIFT_MICROS]


def test_vectors():
    x = 100.0 + np.arange(10_000) * 0.01
    assert (vectors.decompress(vectors.compress(x, "F64"), "F64") == x).all()
    raw = bytearray(vectors.compress(np.arange(1000), "I64"))
    raw[-1] ^= 0xAA
    with pytest.raises(DataFormatError, match="checksum"):
        vectors.decompress(bytes(raw), "I64")
    with pytest.raises(DataFormatError, match="mismatch"):
        vectors.decompress(vectors.compress(np.arange(1000), "I32"), "I64")
    with pytest.raises(DataFormatError, match="codec"):
        vectors.parse(bytes(raw[:5]) + b"\1" + bytes(raw[6:]))
    assert vectors.crc32_payload(b"abc") == 891568578


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["I32", "I64", "U32", "U64", "F32", "F64"]), st.binary(max_size=200))
def test_vectors_keep_every_bit(element, data):
    dtype = np.dtype({"I32": "<i4", "I64": "<i8", "U32": "<u4", "U64": "<u8", "F32": "<f4", "F64": "<f8"}[element])
    x = np.frombuffer(data[: len(data) // dtype.itemsize * dtype.itemsize], dtype)
    assert vectors.decompress(vectors.compress(x, element), element).tobytes() == x.tobytes()


def test_canonical_json():
    assert canonical_json('{"bb":1.0,"a":2,"a":3}') == '{"a": 3, "bb": 1.0}'
    assert canonical_json("[1,2,3]") == "[1, 2, 3]"


def test_copy_keeps_bytes_of_unchecked_text():
    import io
    import struct

    from loomtable.formats import COPY_SIGNATURE
    from loomtable.sources.pgcopy import CopyLimits, CopyReader

    schema = ColumnarSchema.of(("t", "Utf8"))
    data = COPY_SIGNATURE + struct.pack(">iIhi", 0, 0, 1, 3) + b"a\xffb" + struct.pack(">h", -1)
    (b,) = CopyReader(io.BytesIO(data), schema, CopyLimits(validate_utf8=False)).arrow(5)
    assert ColumnarBatch.from_arrow(schema, b).variable(0)[1] == b"a\xffb"
    with pytest.raises(DataFormatError, match="UTF-8"):
        list(CopyReader(io.BytesIO(data), schema).arrow(5))
