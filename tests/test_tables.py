import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import types as T

from loomtable.errors import EngineError, MigrationNeeded
from loomtable.formats import MIGRATION_KEY
from loomtable.operators import flatten as fl
from loomtable.operators.migrate import init, migrate
from loomtable.operators.table import Conflict, Store, StoredIndex
from loomtable.plans.diff import MigrationConfig
from loomtable.spec import ColumnSpec, IndexSpec, TableSpec
from loomtable.types import FieldType


def col(name, kind="Text", **more):
    return ColumnSpec(name, FieldType(kind), **more)


ID = col("id", primary_key=True)


def rows(t):
    return sorted(map(tuple, t.read().collect()), key=str)


def test_create_and_safe_alter(spark, root):
    spec = TableSpec("users", (ID, col("name")), (IndexSpec(("name",), unique=True),))
    init(spark, root, [spec])
    t = Store(spark, root).table("users")
    t.insert(spark.createDataFrame([("a", "x")], "id string, name string"))
    assert len(t.manifest.indexes) == 1
    before = t.manifest.snapshot
    out = init(spark, root, [TableSpec("users", (ID, col("name"), col("email", unique=True), col("n", "Integer")), spec.indexes)])
    assert out == {"users": None} and t.manifest.snapshot == before
    t.insert(spark.createDataFrame([("b", "y", None, 3)], "id string, name string, email string, n int"))
    assert rows(t) == [("a", "x", None, None), ("b", "y", None, 3)]
    with pytest.raises(EngineError, match="unique"):
        t.insert(spark.createDataFrame([("a", "z")], "id string, name string"))
    with pytest.raises(EngineError, match="unique"):
        t.insert(spark.createDataFrame([("c", "y")], "id string, name string"))
    assert Store(spark, root).tables() == ["users"]


def test_rename_reorder_and_drop(spark, root):
    store = Store(spark, root)
    t = store.create(TableSpec("t", (ID, col("old_name"), col("extra"))))
    t.insert(spark.createDataFrame([("r1", "v1", "keep")], "id string, old_name string, extra string"))
    spec = TableSpec("t", (ID, col("new_name", rename_from="old_name")))
    migrate(store, spec, "t", MigrationConfig())
    assert t.read().columns == ["id", "new_name", "extra"] and rows(t) == [("r1", "v1", "keep")]
    with pytest.raises(MigrationNeeded):
        migrate(store, spec, "t", MigrationConfig(enforce_exact_columns=True))
    migrate(store, spec, "t", MigrationConfig(enforce_exact_columns=True, allow_destructive_drops=True))
    assert rows(t) == [("r1", "v1")]
    assert t.read_backup(t.backups()[0]).first()["extra"] == "keep"
    turned = TableSpec("t", (col("new_name"), ID))
    migrate(store, turned, "t", MigrationConfig(enforce_column_order=True))
    assert t.read().columns == ["new_name", "id"]


def test_no_key_needs_migration_key(spark, root):
    store = Store(spark, root)
    t = store.create(TableSpec("t", (col("id"), col("b", "Integer"), col("a", "Integer"))))
    t.insert(spark.createDataFrame([("r1", 20, 10), ("r1", 20, 10)], "id string, b int, a int"))
    spec = TableSpec("t", (col("id"), col("a", "Integer"), col("b", "Integer")))
    with pytest.raises(MigrationNeeded):
        migrate(store, spec, "t", MigrationConfig(enforce_column_order=True))
    migrate(store, spec, "t", MigrationConfig(enforce_column_order=True, enable_migration_key=True))
    assert t.read().columns == ["id", "a", "b", MIGRATION_KEY]
    t.insert(spark.createDataFrame([("r2", 1, 2)], "id string, a int, b int"))
    assert rows(t) == [("r1", 10, 20, 1), ("r1", 10, 20, 2), ("r2", 1, 2, 3)]


def test_indexes_are_made_once(spark, root):
    store = Store(spark, root)
    t = store.create(TableSpec("t", (ID, col("email"))))
    spec = TableSpec("t", (ID, col("email")), (IndexSpec(("email",), unique=True),))
    m = t.manifest
    store.publish(type(m)(**{**m.__dict__, "version": 2, "indexes": (StoredIndex("p", "btree", True, ("email",), "id <> ''"), StoredIndex("e", "btree", True, (), None, True))}))
    for _ in range(2):
        migrate(store, spec, "t", MigrationConfig())
    assert sum(i.columns == ("email",) and i.predicate is None for i in t.manifest.indexes) == 1
    other = store.create(spec, "u")
    assert {i.name for i in t.manifest.indexes}.isdisjoint({i.name for i in other.manifest.indexes})


def test_conflict_and_required(spark, root):
    store = Store(spark, root)
    t = store.create(TableSpec("t", (ID, col("n", "Integer", nullable=False))))
    m = t.manifest
    t.insert(spark.createDataFrame([("a", 1)], "id string, n int"))
    with pytest.raises(Conflict):
        store.publish(type(m)(**{**m.__dict__, "version": 2}))
    with pytest.raises(Exception, match="not-null"):
        t.insert(spark.createDataFrame([("b", None)], "id string, n int"))
    with pytest.raises(EngineError, match="required"):
        t.insert(spark.createDataFrame([("b",)], "id string"))


@pytest.mark.parametrize("seed", range(2))
def test_rewrite_under_random_writes(spark, root, seed):
    """After a rewrite during which rows are added, changed, deleted and moved to other keys, the table is what the writers left."""
    r = random.Random(seed)
    store = Store(spark, root)
    t = store.create(TableSpec("t", (col("id", "BigInt", primary_key=True), col("v", "Integer"))))
    want = {k: k * 10 for k in range(30)}
    t.insert(spark.createDataFrame(list(want.items()), "id long, v int"))

    def writer(number, table):
        if number > 1:
            return
        kind = r.choice(["upsert", "delete", "move"])
        if kind == "upsert":
            new = {r.randrange(40): r.randrange(1000) for _ in range(4)}
            table.upsert(spark.createDataFrame(list(new.items()), "id long, v int"))
            want.update(new)
        elif kind == "delete":
            gone = [r.randrange(40) for _ in range(3)]
            table.delete(spark.createDataFrame([(x,) for x in gone], "id long"))
            for x in gone:
                want.pop(x, None)
        else:
            old = r.choice(list(want))
            value = want.pop(old)
            table.change_key(old, spark.createDataFrame([(old + 100, value)], "id long, v int"))
            want[old + 100] = value

    spec = TableSpec("t", (col("id", "BigInt", primary_key=True), col("v", "BigInt"), col("age", "Integer", nullable=False, default_sql="0")))
    told = migrate(store, spec, "t", MigrationConfig(parallel_backfill=True), writer)
    assert told.backfill_rows == 30 and told.rounds >= 1
    assert rows(t) == sorted(((k, v, 0) for k, v in want.items()), key=str)
    assert migrate(store, spec, "t", MigrationConfig()) is None  # nothing left to do


def test_failed_rewrite_leaves_no_trace(spark, root):
    store = Store(spark, root)
    t = store.create(TableSpec("t", (ID, col("v"))))
    t.insert(spark.createDataFrame([("a", "1"), ("b", "1")], "id string, v string"))
    before = t.manifest
    spec = TableSpec("t", (ID, col("v", "Text", nullable=False, unique=True)))
    with pytest.raises(MigrationNeeded):
        migrate(store, spec, "t", MigrationConfig())
    assert t.manifest == before and store.list(f"{root}/t/data") == []


FLAT = T.StructType(
    [
        T.StructField("pair", T.StringType(), False),
        T.StructField("e_ms", T.LongType(), False),
        T.StructField("fam", T.StructType([T.StructField("a", T.DoubleType(), False), T.StructField("b", T.LongType(), True), T.StructField("nested", T.StructType([T.StructField("x", T.DoubleType(), False)]), False)]), False, {"prefix": "ma_"}),
        T.StructField("osc", T.StructType([T.StructField("rsi", T.DoubleType(), False)]), False, {"prefix": "osc_"}),
    ]
)


def test_flatten(spark):
    p = fl.flatten(FLAT, "proc_a", (IndexSpec(("pair",)),))
    assert p.columns == ["pair", "e_ms", "ma_a", "ma_b", "ma_nested_x", "osc_rsi"]
    assert p.schema_hash == "a3fff125d5a047660a01eec57b58841843934da68ef047d3b54da44fbc0ff65c"
    df = spark.createDataFrame([("BTCUSDT", 123, (1.0, 7, (2.0,)), (55.0,))], FLAT)
    assert tuple(p.project(df).first()) == ("BTCUSDT", 123, 1.0, 7, 2.0, 55.0)
    v = fl.ArgumentsVisitor()
    p.visit(df.first(), v)
    assert v.arguments == ["BTCUSDT", 123, 1.0, 7, 2.0, 55.0]
    assert [c.name for c in p.table_spec("t").columns] == p.columns
    with pytest.raises(EngineError, match="indexed"):
        fl.flatten(FLAT, "proc_a", (IndexSpec(("ma_a",)),)).table_spec("t")


def test_flatten_refusals():
    leaf = T.StructType([T.StructField("a", T.DoubleType(), False)])
    family = lambda name, kind, prefix, null=False: T.StructField(name, kind, null, {"prefix": prefix})
    bad = [
        [family("f", leaf, "Bad-")],
        [family("f", leaf, "ma_"), family("g", leaf, "ma_")],
        [T.StructField("ma_a", T.LongType()), family("f", leaf, "ma_")],
        [family("f", leaf, "ma_", True)],
        [family("f", T.StructType([T.StructField("v", T.ArrayType(T.DoubleType()))]), "ma_")],
        [T.StructField("f", leaf, False)],
        [],
    ]
    for fields in bad:
        with pytest.raises(EngineError):
            fl.flatten(T.StructType(fields), "proc_a")
    with pytest.raises(EngineError):
        fl.flatten(FLAT, "Bad-Id")


def test_writers_that_interleave_lose_nothing(spark, root):
    """A writer whose manifest is out of date doesn't touch the segment of the one that was first, and tries again."""
    store = Store(spark, root)
    t = store.create(TableSpec("t", (col("id", "BigInt", primary_key=True), col("v", "Integer"))))
    late = t.manifest
    t.insert(spark.createDataFrame([(1, 10)], "id long, v int"))
    with pytest.raises(Conflict):
        t._append_segment(late, t._rows(late, spark.createDataFrame([(2, 20)], "id long, v int")), "u")
    assert rows(t) == [(1, 10)] and len(store.list(f"{t.folder}/changes")) == 1
    t.insert(spark.createDataFrame([(2, 20)], "id long, v int"))
    assert rows(t) == [(1, 10), (2, 20)]


def test_concurrent_writers(spark, root):
    store = Store(spark, root)
    t = store.create(TableSpec("t", (col("id", "BigInt", primary_key=True), col("v", "Integer"))))
    with ThreadPoolExecutor(3) as pool:
        for done in [pool.submit(t.insert, spark.createDataFrame([(k, k)], "id long, v int")) for k in range(6)]:
            done.result()
    assert rows(t) == [(k, k) for k in range(6)] and t.manifest.seq == 6
    with pytest.raises(EngineError, match="unique"):
        t.insert(spark.createDataFrame([(3, 0)], "id long, v int"))
