"""Names of indexes and helper objects, within the limit of identifiers."""

from __future__ import annotations

import zlib

from loomtable.formats import INDEX_PREFIX, MIGRATION_KEY, NAME_LIMIT, OBJECT_PREFIX
from loomtable.spec import IndexSpec, quote_identifier


def _limited(name: str, identity: str) -> str:
    """The name, or its head and a checksum of the identity if it is too long."""
    raw = name.encode()
    if len(raw) <= NAME_LIMIT:
        return name
    tail = f"_{zlib.crc32(identity.encode()):08x}"
    return raw[: NAME_LIMIT - len(tail)].decode("utf-8", "ignore") + tail


def index_name(table: str, index: IndexSpec) -> str:
    method = index.method.lower()
    if not index.name:
        name = "_".join([INDEX_PREFIX, "uq" if index.unique else "ix", table, method, *index.columns])
    else:
        name = index.name if table in index.name else f"{index.name}_{table}"
    return _limited(name, f"table={table}|method={method}|unique={str(index.unique).lower()}|cols={','.join(index.columns)}")


def unique_column_index_name(table: str, column: str) -> str:
    return _limited(f"{INDEX_PREFIX}_uq_{table}_{column}", f"table={table}|method=btree|unique=true|cols={column}")


def derived_object_name(base: str, kind: str, ts: int) -> str:
    tail = f"__{OBJECT_PREFIX}_{kind}_{ts}"
    if len((base + tail).encode()) <= NAME_LIMIT:
        return base + tail
    tail += f"_{zlib.crc32(base.encode()):08x}"
    return base[: max(0, NAME_LIMIT - len(tail))] + tail


def migration_sequence_name(table: str) -> str:
    return f"{OBJECT_PREFIX}_migseq_{zlib.crc32(f'{OBJECT_PREFIX}_migseq|table={table}|col={MIGRATION_KEY}'.encode()):08x}"


def create_index_sql(table: str, index: IndexSpec, concurrently: bool = False) -> str:
    words = ["CREATE", *["UNIQUE"] * index.unique, "INDEX", *["CONCURRENTLY"] * concurrently, "IF NOT EXISTS", quote_identifier(index_name(table, index)), "ON", quote_identifier(table), "USING", index.method]
    return " ".join(words) + f" ({', '.join(map(quote_identifier, index.columns))})"
