import dataclasses
import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomtable.errors import EngineError, MigrationNeeded
from loomtable.formats import INDEX_PREFIX, OBJECT_PREFIX
from loomtable.plans import diff as D
from loomtable.plans.chunks import AdaptiveChunk, split_range
from loomtable.plans.naming import create_index_sql, derived_object_name, index_name, migration_sequence_name, unique_column_index_name
from loomtable.spec import ColumnSpec, IndexSpec, TableSpec, column, quote_identifier, table_spec, validate_id
from loomtable.types import FieldType, normalize_type


def col(name, kind="Text", **more):
    return ColumnSpec(name, FieldType(kind), **more)


def test_names():
    pair = IndexSpec(("tenant_id", "email"), unique=True)
    assert index_name("users", pair) == f"{INDEX_PREFIX}_uq_users_btree_tenant_id_email"
    long = index_name(f"{OBJECT_PREFIX}_comp_uq_existing_" + "0" * 32, pair)
    assert long == f"{INDEX_PREFIX}_uq_{OBJECT_PREFIX}_comp_uq_existing_00000000000000000000000_cb17555a" and len(long) == 63
    assert index_name("t_a", IndexSpec(("email",), name="idx_email")) == "idx_email_t_a"
    assert unique_column_index_name("t", "c") == f"{INDEX_PREFIX}_uq_t_c"
    assert migration_sequence_name(f"{OBJECT_PREFIX}_no_pk") == f"{OBJECT_PREFIX}_migseq_9b739988"
    assert derived_object_name("orders", "shadow", 1700000000) == f"orders__{OBJECT_PREFIX}_shadow_1700000000"
    assert derived_object_name(f"{OBJECT_PREFIX}_strict_exact_" + "0" * 32, "changelog", 1700000000).endswith("_changelog_1700000000_d79e295d")
    assert create_index_sql("t", IndexSpec(("a",)), True).startswith('CREATE INDEX CONCURRENTLY IF NOT EXISTS "')
    assert quote_identifier('a"b') == '"a""b"'


def test_adaptive_chunk():
    a = AdaptiveChunk(True)
    want = {100: 30000, 211: 23696, 212: 20000, 250: 20000, 287: 20000, 288: 17361, 1000: 13333, 1999: 13333, 2000: 10000, 5000: 10000}
    assert {ms: a.next(20000, ms) for ms in want} == want
    assert AdaptiveChunk(False).next(5, 10**6) == 5


@given(st.integers(-1000, 1000), st.integers(0, 5000), st.integers(-3, 100))
def test_ranges_cover(low, span, workers):
    parts = split_range(low, low + span, workers)
    assert [x for a, b in parts for x in range(a, b + 1)] == list(range(low, low + span + 1)) and len(parts) <= 64


def test_range_goldens():
    assert split_range(1, 50000, 4) == [(1, 12500), (12501, 25000), (25001, 37500), (37501, 50000)]
    assert split_range(0, 14999, 4) == [(0, 3749), (3750, 7499), (7500, 11249), (11250, 14999)]


def test_dataclass_spec_and_sql():
    @dataclasses.dataclass
    class Users:
        id: uuid.UUID = column(primary_key=True)
        email: str | None = column(unique=True, index=True, index_unique=True)
        age: int = column(default_sql="0")
        tags: list[str] = column()
        junk: str = column(skip=True)

    s = table_spec(Users)
    assert s.name == "users" and [c.name for c in s.columns] == ["id", "email", "age", "tags"]
    sql = s.create_table_sql()
    assert '"id" UUID PRIMARY KEY' in sql and '"email" TEXT UNIQUE,' in sql and '"age" BIGINT DEFAULT 0 NOT NULL' in sql and '"tags" TEXT[] NOT NULL' in sql
    assert TableSpec.from_struct("users", s.struct()).columns == s.columns
    with pytest.raises(EngineError):
        table_spec(dataclasses.make_dataclass("X", [("a", complex)]))
    with pytest.raises(EngineError):
        column(uniqe=True)


def test_type_names():
    assert normalize_type("int8") == "BIGINT" and normalize_type("vector(3)") == "VECTOR(3)"
    assert FieldType.of("vector(3)") == FieldType("Vector", 3)
    for bad in ("", "Bad-", "1a", "a" * 64):
        with pytest.raises(EngineError):
            validate_id(bad)


def test_diff_and_strictness():
    now = D.expected_schema("t", TableSpec("t", (col("id", primary_key=True), col("b"), col("extra"))))
    want = D.expected_schema("t", TableSpec("t", (col("id", primary_key=True), col("new", "Integer"), col("b", "BigInt", nullable=False, unique=True))))
    kinds = [(d.kind, d.column) for d in D.diff_schema(now, want)]
    assert kinds == [("added", "new"), ("type", "b"), ("nullability", "b"), ("constraint", "b"), ("position", "b"), ("removed", "extra")]
    assert {d.kind for d in D.relevant(D.MigrationConfig(), D.diff_schema(now, want))} == {"added", "type", "nullability", "constraint"}
    strict = D.MigrationConfig(enforce_exact_columns=True)
    with pytest.raises(MigrationNeeded):
        D.validate_strictness(strict, D.diff_schema(now, want))
    assert D.diff_schema(want, want) == []


def test_index_equivalence():
    i = IndexSpec(("email",), unique=True)
    plain = D.IndexIdentity("btree", True, ("email",))
    assert D.has_equivalent_index([plain], i)
    assert not D.has_equivalent_index([dataclasses.replace(plain, predicate="id <> ''"), dataclasses.replace(plain, has_expressions=True)], i)
    assert D.normalize_predicate("  a  <>\n b ") == "a <> b"


def test_column_expressions():
    now = D.expected_schema("t", TableSpec("t", (col("id", primary_key=True), col("old"))))
    spec = TableSpec("t", (col("id", primary_key=True), col("new", rename_from="old"), col("d", "Integer", nullable=False, default_sql="1"), col("n")))
    assert D.column_expressions(now, spec) == [("id", "id", None), ("new", "old", None), ("d", None, "1"), ("n", None, "NULL")]
    with pytest.raises(MigrationNeeded):
        D.column_expressions(now, TableSpec("t", (col("id", primary_key=True), col("x", nullable=False))))
    with pytest.raises(MigrationNeeded):
        D.key_cast("DOUBLE PRECISION")
