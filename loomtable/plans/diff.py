"""Differences between a stored table and its spec, and what may be done about them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from loomtable.errors import MigrationNeeded
from loomtable.spec import ColumnSpec, IndexSpec, TableSpec
from loomtable.types import normalize_type


@dataclass(frozen=True)
class MigrationConfig:
    """Knobs of a migration.  ``offline_row_threshold`` and ``synchronous_commit_off`` have no effect here and are accepted."""

    online_chunk_size: int = 10_000
    online_sleep_ms: int = 0
    max_online_catchup_rounds: int = 50
    cutover_lock_budget_ms: int = 5_000
    enforce_column_order: bool = False
    enforce_exact_columns: bool = False
    allow_destructive_drops: bool = False
    allow_column_renames: bool = True
    adaptive_chunk: bool = False
    online_chunk_size_min: int = 10_000
    online_chunk_size_max: int = 200_000
    online_target_batch_ms: int = 250
    online_max_batch_ms: int = 2_000
    parallel_backfill: bool = False
    parallel_backfill_workers: int = 4
    enable_migration_key: bool = False
    offline_row_threshold: int = 1_000_000
    synchronous_commit_off: bool = False


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    sql_type: str
    nullable: bool
    position: int
    is_primary_key: bool = False
    is_unique: bool = False


@dataclass(frozen=True)
class IndexIdentity:
    method: str
    unique: bool
    columns: tuple[str, ...]
    predicate: str | None = None
    has_expressions: bool = False


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[ColumnInfo, ...] = field(default_factory=tuple)

    def get(self, name: str) -> ColumnInfo | None:
        return next((c for c in self.columns if c.name == name), None)


#: Kinds of differences, in the order in which they are dealt with.
KINDS = ("added", "nullability", "constraint", "type", "removed", "position")


@dataclass(frozen=True)
class Diff:
    kind: str
    column: str
    old: object = None
    new: object = None
    constraint: str = ""

    def sort_key(self) -> tuple[int, str]:
        return KINDS.index(self.kind), f"{self.constraint}:{self.column}" if self.constraint else self.column


def expected_schema(name: str, spec: TableSpec) -> TableSchema:
    return TableSchema(name, tuple(ColumnInfo(c.name, c.type.sql(), c.nullable and not c.primary_key, k, c.primary_key, c.unique or c.primary_key) for k, c in enumerate(spec.columns)))


def primary_key_column(spec: TableSpec) -> ColumnSpec | None:
    keys = [c for c in spec.columns if c.primary_key]
    return keys[0] if len(keys) == 1 else None


def diff_schema(current: TableSchema, expected: TableSchema) -> list[Diff]:
    """What each expected column differs in, in order, then columns that aren't expected."""
    have, want = {c.name: c for c in current.columns}, {c.name for c in expected.columns}
    out: list[Diff] = []
    for e in expected.columns:
        c = have.get(e.name)
        if c is None:
            out.append(Diff("added", e.name))
            continue
        if normalize_type(c.sql_type) != normalize_type(e.sql_type):
            out.append(Diff("type", e.name, c.sql_type, e.sql_type))
        if c.nullable != e.nullable:
            out.append(Diff("nullability", e.name, c.nullable, e.nullable))
        if c.is_primary_key != e.is_primary_key:
            out.append(Diff("constraint", e.name, c.is_primary_key, e.is_primary_key, "PRIMARY KEY"))
        if c.is_unique != e.is_unique:
            out.append(Diff("constraint", e.name, c.is_unique, e.is_unique, "UNIQUE"))
        if c.position != e.position:
            out.append(Diff("position", e.name, c.position, e.position))
    return out + [Diff("removed", c.name) for c in current.columns if c.name not in want]


def relevant(config: MigrationConfig, diffs: list[Diff]) -> list[Diff]:
    ignored: set[str] = set()
    if not config.enforce_column_order:
        ignored.add("position")
    if not config.enforce_exact_columns:
        ignored.add("removed")
    return [d for d in diffs if d.kind not in ignored]


def validate_strictness(config: MigrationConfig, diffs: list[Diff]) -> None:
    extra = [d.column for d in diffs if d.kind == "removed"]
    if extra and config.enforce_exact_columns and not config.allow_destructive_drops:
        raise MigrationNeeded(f"columns that the spec doesn't have, and drops aren't allowed: {', '.join(extra)}")


def renames(config: MigrationConfig, current: TableSchema, spec: TableSpec) -> list[tuple[str, str]]:
    """(old, new) names, sorted; none where the new name is taken or the old one missing."""
    if not config.allow_column_renames:
        return []
    pairs = sorted((c.rename_from, c.name) for c in spec.columns if c.rename_from)
    return [(a, b) for a, b in pairs if current.get(a) and not current.get(b)]


def is_safe(config: MigrationConfig, diff: Diff, spec: TableSpec) -> bool:
    """Whether a change of metadata alone makes the difference go; all others need a rewrite."""
    if diff.kind == "added":
        c = spec.column(diff.column)
        return not config.enforce_column_order and c is not None and c.nullable and not c.primary_key
    if diff.kind == "nullability":
        return bool(diff.new)
    return diff.kind == "constraint" and diff.constraint == "UNIQUE" and bool(diff.new)


def has_equivalent_index(existing: list[IndexIdentity], index: IndexSpec) -> bool:
    """Same method, uniqueness and columns in order; partial and expression indexes are never equivalent."""
    return any(e.predicate is None and not e.has_expressions and (e.method, e.unique, e.columns) == (index.method.lower(), index.unique, index.columns) for e in existing)


def index_sort_key(index: IndexSpec) -> tuple[int, str, str]:
    return int(not index.unique), index.method, ",".join(index.columns)


def normalize_predicate(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


#: Types of keys by which a rewrite can go.
KEY_TYPES = {"TEXT", "UUID", "BIGINT", "INTEGER"}


def key_cast(sql_type: str) -> str:
    kind = normalize_type(sql_type)
    if kind not in KEY_TYPES:
        raise MigrationNeeded(f"a rewrite by a key of type {sql_type} isn't supported")
    return kind.lower()


def column_expressions(current: TableSchema, spec: TableSpec) -> list[tuple[str, str | None, str | None]]:
    """(target, source column, expression) for each column: the column of that name, the renamed one, the default, or null."""
    out: list[tuple[str, str | None, str | None]] = []
    for c in spec.columns:
        if current.get(c.name):
            out.append((c.name, c.name, None))
        elif c.rename_from and current.get(c.rename_from):
            out.append((c.name, c.rename_from, None))
        elif c.default_sql is not None:
            out.append((c.name, None, c.default_sql))
        elif c.nullable and not c.primary_key:
            out.append((c.name, None, "NULL"))
        else:
            raise MigrationNeeded(f"column {c.name} is required and has no source and no default")
    return out
