"""Scalar functions as columns of built-in expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtable.types import _ALIASES


def crc32(payload: Column) -> Column:
    return F.crc32(payload)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def normalize_type(sql: Column) -> Column:
    up = F.upper(sql)
    out = up
    for a, b in _ALIASES.items():
        out = F.when(up == a, b).otherwise(out)
    return out


def uuid_to_bytes(text: Column) -> Column:
    return F.unhex(F.replace(text, F.lit("-"), F.lit("")))


def bytes_to_uuid(raw: Column) -> Column:
    h = F.lower(F.hex(raw))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def to_micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def wall_clock_micros(ts: Column) -> Column:
    """Microseconds of a time without zone, read as UTC whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def normalize_predicate(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonical_json(text: str) -> str:
    """JSON text with a space behind colons and commas, keys by length and then bytes, and the last of equal keys; numbers keep their digits."""

    class Number(float):
        def __new__(cls, raw: str):
            out = super().__new__(cls, 0.0)
            out.raw = raw
            return out

    def write(v) -> str:
        if isinstance(v, Number):
            return v.raw
        if isinstance(v, dict):
            keys = sorted(v, key=lambda k: (len(k.encode()), k.encode()))
            return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {write(v[k])}" for k in keys) + "}"
        if isinstance(v, list):
            return "[" + ", ".join(map(write, v)) + "]"
        return json.dumps(v, ensure_ascii=False)

    return write(json.loads(text, parse_float=Number, parse_int=Number))
