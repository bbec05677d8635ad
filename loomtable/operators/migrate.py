"""Bring stored tables to their specs: metadata where that is enough, else an online rewrite."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtable.errors import MigrationNeeded
from loomtable.formats import MIGRATION_KEY
from loomtable.operators.rewrite import assign_migration_key, latest, not_null, project, unique_violations
from loomtable.operators.table import Conflict, Manifest, Store, StoredColumn, Table, stored_index
from loomtable.plans import diff as D
from loomtable.plans.naming import derived_object_name
from loomtable.spec import ColumnSpec, IndexSpec, TableSpec
from loomtable.types import FieldType

_ITERATIONS = 5


@dataclass(frozen=True)
class Telemetry:
    """What a rewrite did: rows of the backfill, changes caught up, rounds, and milliseconds."""

    backfill_rows: int
    caught_up: int
    rounds: int
    backfill_ms: int
    catch_up_ms: int
    cutover_ms: int


def init(spark: SparkSession, root: str, specs: list[TableSpec | tuple[TableSpec, str | None]], config: D.MigrationConfig = D.MigrationConfig(), on_round: Callable[[int, Table], None] | None = None) -> dict[str, Telemetry | None]:
    """Migrate tables one after the other; the telemetry of those that were rewritten."""
    store, out = Store(spark, root), {}
    for item in specs:
        spec, name = item if isinstance(item, tuple) else (item, None)
        out[name or spec.name] = migrate(store, spec, name or spec.name, config, on_round)
    return out


def migrate(store: Store, spec: TableSpec, name: str, config: D.MigrationConfig, on_round=None) -> Telemetry | None:
    table = Table(store, name)
    if not store.exists(name):
        store.create(spec, name, config.enable_migration_key)
        return None
    if config.enable_migration_key and D.primary_key_column(spec) is None:
        spec = replace(spec, columns=(*spec.columns, ColumnSpec(MIGRATION_KEY, FieldType("BigInt"), nullable=False, unique=True)))
        if table.manifest.column(MIGRATION_KEY) is None:
            _add_migration_key(table)
    expected = D.expected_schema(name, spec)
    for _ in range(_ITERATIONS):
        moved = D.renames(config, table.schema(), spec)
        if moved:
            _rename(table, moved)
        diffs = D.relevant(config, D.diff_schema(table.schema(), expected))
        D.validate_strictness(config, diffs)
        safe = sorted((d for d in diffs if D.is_safe(config, d, spec)), key=D.Diff.sort_key)
        if not safe:
            break
        _alter(table, spec, safe)
    telemetry = None
    if D.relevant(config, D.diff_schema(table.schema(), expected)):
        telemetry = rewrite(table, spec, config, on_round)
        rest = D.relevant(config, D.diff_schema(table.schema(), expected))
        if rest:
            raise MigrationNeeded(f"differences remain after a rewrite: {rest}")
    _ensure_indexes(table, spec)
    return telemetry


def _rename(table: Table, moved: list[tuple[str, str]]) -> None:
    names, m = dict(moved), table.manifest
    columns = tuple(replace(c, name=names.get(c.name, c.name)) for c in m.columns)
    indexes = tuple(replace(i, columns=tuple(names.get(c, c) for c in i.columns)) for i in m.indexes)
    table.store.publish(replace(m, version=m.version + 1, columns=columns, indexes=indexes))


def _alter(table: Table, spec: TableSpec, diffs: list[D.Diff]) -> None:
    """Changes of metadata: nullable columns, dropped not-null, added uniqueness (validated)."""
    m = table.manifest
    columns, next_id = list(m.columns), m.next_id
    for d in diffs:
        if d.kind == "added":
            c = spec.column(d.column)
            columns.append(StoredColumn(next_id, c.name, c.type.sql(), True, False, c.unique, c.default_sql))
            next_id += 1
            continue
        k = next(k for k, c in enumerate(columns) if c.name == d.column)
        if d.kind == "nullability":
            columns[k] = replace(columns[k], nullable=True)
        else:
            table.validate_unique([d.column])
            columns[k] = replace(columns[k], unique=True)
    table.store.publish(replace(m, version=m.version + 1, columns=tuple(columns), next_id=next_id))


def _ensure_indexes(table: Table, spec: TableSpec) -> None:
    m = table.manifest
    have = table.index_identities()
    fresh: list[IndexSpec] = [i for i in sorted(spec.indexes, key=D.index_sort_key) if not D.has_equivalent_index(have, i)]
    for i in fresh:
        if i.unique:
            table.validate_unique(list(i.columns))
    if fresh:
        table.store.publish(replace(m, version=m.version + 1, indexes=(*m.indexes, *(stored_index(table.name, i) for i in fresh))))


def _add_migration_key(table: Table) -> None:
    """A real column of unique numbers over a total order of the rows; rows that are equal are interchangeable."""
    m = table.manifest
    names = [c.physical for c in m.columns]
    key = StoredColumn(m.next_id, MIGRATION_KEY, "BIGINT", False, False, True)
    path = f"{table.folder}/data/{uuid.uuid4().hex}"
    assign_migration_key(table._state(m).select(names), names, 1, key.physical).write.parquet(path)
    table.store.publish(replace(m, version=m.version + 1, columns=(*m.columns, key), next_id=m.next_id + 1, snapshot=path, base_seq=m.seq))


def rewrite(table: Table, spec: TableSpec, config: D.MigrationConfig = D.MigrationConfig(), on_round: Callable[[int, Table], None] | None = None) -> Telemetry:
    """Rewrite a table into the spec's shape while writers go on.

    Backfill: the state as of now, projected and range-partitioned by key.
    Rounds: changed keys of new segments are replaced by their latest state.
    Cutover: the manifest is published if no segment came meanwhile, else
    another round follows.  Columns that the spec doesn't name are carried
    along unless destructive drops are allowed with exact columns.  The old
    snapshot stays as a backup.  A failure removes the new folders only.
    """
    start = table.manifest
    key = start.key()
    if key is None:
        raise MigrationNeeded(f"table {table.name} has no single-column primary key; enable_migration_key allows a rewrite")
    D.key_cast(key.type)
    expressions = D.column_expressions(table.schema(), spec)
    named = {s for _, s, _ in expressions} | {t for t, _, _ in expressions}
    drop = config.enforce_exact_columns and config.allow_destructive_drops
    extra = [c for c in start.columns if c.name not in named] if not drop else []
    specs = (*spec.columns, *(ColumnSpec(c.name, FieldType.of(c.type), c.nullable, False, c.unique, c.default_sql) for c in extra))
    shape = TableSpec(spec.name, specs, spec.indexes)
    expressions = [*expressions, *((c.name, c.name, None) for c in extra)]
    columns = tuple(StoredColumn(start.next_id + k, c.name, c.type.sql(), c.nullable and not c.primary_key, c.primary_key, c.unique or c.primary_key, c.default_sql) for k, c in enumerate(specs))
    target_key = next((t for t, s, _ in expressions if s == key.name), None)
    if target_key is None:
        raise MigrationNeeded(f"the spec doesn't keep the key column {key.name}")
    new_key = next(c for c in columns if c.name == target_key)
    folders: list[str] = []

    def shaped(df: DataFrame, m: Manifest) -> DataFrame:
        logical = table._logical(df, m.columns)
        return project(logical, expressions, shape).select([F.col(f"`{c.name}`").alias(c.physical) for c in columns])

    def store(df: DataFrame) -> DataFrame:
        path = f"{table.folder}/data/{uuid.uuid4().hex}"
        folders.append(path)
        required = [c.physical for c in columns if not c.nullable]
        parts = config.parallel_backfill_workers if config.parallel_backfill else None
        ranged = df.repartitionByRange(parts, new_key.physical) if parts else df.repartitionByRange(new_key.physical)
        not_null(ranged, required).sortWithinPartitions(new_key.physical).write.parquet(path)
        return table.spark.read.parquet(path)

    try:
        began = time.monotonic()
        at = start.seq
        shadow = store(shaped(table._state(start), start))
        rows = shadow.count()
        backfilled, caught, rounds = time.monotonic(), 0, 0
        while True:
            if on_round:
                on_round(rounds, table)
            m = table.manifest
            if [c for c in m.columns] != [c for c in start.columns]:
                raise MigrationNeeded("the table was altered during its rewrite")
            if m.seq > at:
                if rounds >= config.max_online_catchup_rounds:
                    raise MigrationNeeded("changes kept coming; the rewrite did not catch up")
                newest = latest(table.changes(m, at, m.seq), key.physical)
                caught += newest.count()
                fresh = shaped(newest.where("op = 'u'").select([c.physical for c in m.columns]), m)
                keys = newest.select(F.col(key.physical).cast(new_key.spark()).alias(new_key.physical))
                shadow = store(shadow.join(keys, new_key.physical, "left_anti").select(shadow.columns).unionByName(fresh))
                at, rounds = m.seq, rounds + 1
                if config.online_sleep_ms:
                    time.sleep(config.online_sleep_ms / 1000)
                continue
            locked = time.monotonic()  # from here on a change by another writer makes the swap start again
            for c in columns:
                if c.unique and unique_violations(shadow, [c.physical]).limit(1).count():
                    raise MigrationNeeded(f"values of {c.name} aren't unique")
            backup = derived_object_name(table.name, "backup", int(time.time()))
            while backup in m.backups:
                backup += "_1"
            old = {"columns": [c.__dict__ for c in m.columns], "snapshot": m.snapshot, "base_seq": m.base_seq, "seq": m.seq}
            indexes = tuple(i for i in m.indexes if set(i.columns) <= {c.name for c in columns})
            new = replace(m, version=m.version + 1, columns=columns, next_id=start.next_id + len(columns), snapshot=folders[-1], base_seq=m.seq, indexes=indexes, backups={**m.backups, backup: old})
            took = (time.monotonic() - locked) * 1000
            if took > config.cutover_lock_budget_ms:  # before it is published, not after
                raise MigrationNeeded(f"cutover took {took:.0f} ms, more than {config.cutover_lock_budget_ms} ms")
            try:
                table.store.publish(new)
            except Conflict:
                continue
            done = time.monotonic()
            for path in folders[:-1]:
                table.store.remove(path)
            return Telemetry(rows, caught, rounds, int((backfilled - began) * 1000), int((locked - backfilled) * 1000), int((done - locked) * 1000))
    except BaseException:
        for path in folders:
            table.store.remove(path)
        raise
