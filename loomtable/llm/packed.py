"""Arrays of integers as compressed binary cells, so that millions of keys move as a few rows."""

from __future__ import annotations

import numpy as np
import zstandard

_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    """An array, its bytes transposed (sorted keys share their high bytes) and compressed."""
    width = x.dtype.itemsize
    return len(x).to_bytes(8, "little") + _PACK.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T).tobytes()) if len(x) else b""


def unpack(data: bytes, dtype) -> np.ndarray:
    kind = np.dtype(dtype)
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(_UNPACK.decompress(data[8:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)
