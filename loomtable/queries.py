"""Queries over the driver's tables, one an operator, each with its SQL for an independent engine."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtable.functions import scalars, vectors
from loomtable.operators import flatten as fl
from loomtable.operators import migrate, rewrite
from loomtable.operators.table import Store
from loomtable.operators.workspace import work_dir
from loomtable.plans.diff import MigrationConfig
from loomtable.sources import columnar, envelope, pgcopy
from loomtable.sources.batch import ColumnarSchema
from loomtable.spec import ColumnSpec, IndexSpec, TableSpec
from loomtable.streaming.cdc import stream_catch_up
from loomtable.types import FieldType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def passed(sql: str, *tables: str):
    """A SELECT that is passed through as it is."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables)
        return columnar.select(spark, sql)

    return run


# SELECTs that run as they are: the SQL is the same for both engines.
PASSED = {
    "select_passthrough": ("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R'", "lineitem"),
    "select_join_agg": (
        "SELECT o_orderpriority, c_mktsegment, count(*) AS n_lines, CAST(round(sum(l_extendedprice * (1 - l_discount))) AS BIGINT) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority, c_mktsegment",
        "customer", "orders", "lineitem",
    ),
    "select_window": (
        "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rn, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS prev_event FROM events",
        "events",
    ),
    "select_rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem"),
    "select_setops": (
        "SELECT 'intersect' AS op, n_key FROM (SELECT c_nationkey AS n_key FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier)",
        "customer", "supplier",
    ),
    "select_topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", "orders"),
    "select_semi_anti": (
        "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
        "customer", "orders", "nation",
    ),
}
for _name, (_sql, *_tables) in PASSED.items():
    QUERIES[_name] = passed(_sql, *_tables)
    ORACLE_SQL[_name] = _sql

_LINE = ColumnarSchema.of(("l_orderkey", "I64"), ("l_linenumber", "I32"), ("l_quantity", "F64"), ("l_returnflag", "Utf8"))
_LINE_SQL = "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem"


@query(_LINE_SQL)
def preflight_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SELECT checked against a declared schema before it runs."""
    views(spark, sf_dir, "lineitem")
    return columnar.select(spark, _LINE_SQL, _LINE)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, count(*) AS n_source, count(*) AS n_row, count(*) AS n_arrow FROM lineitem GROUP BY ALL")
def row_vs_arrow_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table through the row and the Arrow transfer: each row and how often the source and both transfers have it."""
    views(spark, sf_dir, "lineitem")
    schema = _LINE
    a = columnar.select(spark, _LINE_SQL, schema)
    return columnar.compare(a, row=columnar.by_rows(a, schema), arrow=envelope.decode_frame(envelope.encode_frame(a, schema), schema))


_ORDER = ColumnarSchema.of(("o_orderkey", "I64"), ("o_totalprice", "F64"), ("o_orderstatus", "Utf8"))
_ORDER_SQL = "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders"
_BATCH_ROWS = 5000


def _batch_digests(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """A row a batch that the reader gives; the batches themselves pass the driver one at a time."""
    views(spark, sf_dir, "orders")
    out = []
    for k, b in enumerate(columnar.BatchReader(spark, f"{_ORDER_SQL} ORDER BY o_orderkey", _ORDER, mode, 10**6).batches(_BATCH_ROWS)):
        keys, prices = b.fixed(0), b.fixed(1).view("f8")  # floats come as their bits
        out.append((k, b.row_count, int(keys[0]), int(keys[-1]), int(keys.sum()), int((prices * 100).round().sum()), len(b.variable(2)[1])))
    return spark.createDataFrame(out, "batch long, n_rows long, first_key long, last_key long, key_sum long, cents long, status_bytes long")


_BATCH_ORACLE = f"SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(sum(length(o_orderstatus)) AS BIGINT) AS status_bytes FROM (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // {_BATCH_ROWS} AS batch FROM orders) GROUP BY batch"


@query(_BATCH_ORACLE)
def read_batches_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a sorted table through the batch reader, in full batches."""
    return _batch_digests(spark, sf_dir, "arrow")


@query(_BATCH_ORACLE)
def read_batches_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the mode chosen by the rule."""
    return _batch_digests(spark, sf_dir, "auto")


_COPIED = ColumnarSchema.of(("l_orderkey", "I64"), ("l_linenumber", "I32"), ("l_quantity", "F64"), ("l_returnflag", "Utf8"), ("micros", "TimestampTzMicros"), ("flag", "Bool"), ("small", "I16"), ("raw", "Bytes"), ("half", "F32"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, epoch_us(CAST(l_shipdate AS TIMESTAMP)) AS micros, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity > 25 END AS flag, CAST(l_linenumber AS SMALLINT) AS small, length(l_returnflag) + 1 AS raw_bytes, CAST(l_quantity / 2 AS DOUBLE) AS half FROM lineitem")
def copy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as binary copy streams and back."""
    source = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag",
        F.timestamp_micros(scalars.wall_clock_micros(F.col("l_shipdate"))).alias("micros"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity") > 25).alias("flag"),
        F.col("l_linenumber").cast("short").alias("small"),
        F.concat(F.col("l_returnflag").cast("binary"), F.lit(b"\0")).alias("raw"),
        (F.col("l_quantity") / 2).cast("float").alias("half"),
    )
    back = pgcopy.decode_frame(pgcopy.encode_frame(source, _COPIED), _COPIED)
    return back.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", F.unix_micros("micros").alias("micros"), "flag", "small", F.octet_length("raw").cast("long").alias("raw_bytes"), F.col("half").cast("double").alias("half"))


@query("SELECT count(*) AS n_rows, count(x) AS n_present, CAST(sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null FROM (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS x FROM events)")
def null_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls through the envelope stay nulls."""
    e = table(spark, sf_dir, "events").select(F.expr("CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END").alias("x"))
    schema = ColumnarSchema.of(("x", "F64"))
    r = envelope.decode_frame(envelope.encode_frame(e, schema), schema)
    return r.agg(F.count("*").alias("n_rows"), F.count("x").alias("n_present"), F.sum(F.when(F.col("x").isNull(), 1).otherwise(0)).cast("long").alias("n_null"))


@query("SELECT event_id, props AS props_text, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON as stored text, and a field of it."""
    return table(spark, sf_dir, "events").select("event_id", F.col("props").alias("props_text"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, epoch_us(ts) AS micros FROM events")
def ts_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times without zone as microseconds since 1970, whatever the session's zone."""
    return table(spark, sf_dir, "events").select("event_id", scalars.wall_clock_micros(F.col("ts")).alias("micros"))


@query("SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum, CAST(sum(length(l_returnflag)) AS BIGINT) AS text_len, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem")
def perf_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of a wide read."""
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"), F.sum(F.length("l_returnflag")).cast("long").alias("text_len"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch FROM orders) GROUP BY batch")
def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and ends of batches of 1000 rows in the order of the key."""
    pages = rewrite.keyset_pages(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1000)
    return rewrite.page_bounds(pages, "o_orderkey").select(F.col("page").alias("batch"), "n_rows", F.col("first_key"), F.col("last_key"))


@query("SELECT CAST(page AS BIGINT) AS page, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS n_rows FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 700 AS page FROM orders WHERE o_orderkey > 500) GROUP BY page")
def keyset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 700 rows behind a key."""
    o = table(spark, sf_dir, "orders").where("o_orderkey > 500").select("o_orderkey")
    return rewrite.page_bounds(rewrite.keyset_pages(o, "o_orderkey", 700), "o_orderkey")


@query("SELECT CAST((o_orderkey - lo) // step AS BIGINT) AS range_id, min(o_orderkey) AS lo_key, max(o_orderkey) AS hi_key, count(*) AS n_rows FROM orders, (SELECT min(o_orderkey) AS lo, CAST(ceil((max(o_orderkey) - min(o_orderkey) + 1) / 4.0) AS BIGINT) AS step FROM orders) GROUP BY 1")
def parallel_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key range in four equal parts."""
    r = rewrite.parallel_ranges(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 4)
    return r.groupBy("range_id").agg(F.min("o_orderkey").alias("lo_key"), F.max("o_orderkey").alias("hi_key"), F.count("*").alias("n_rows"))


@query("SELECT DISTINCT user_id FROM events")
def changelog_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed keys, each once."""
    return rewrite.deduplicated_changes(table(spark, sf_dir, "events"), "user_id")


_SHADOW = "(SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0)"
_SOURCE = "(SELECT o_orderkey, 'N' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0)"
_CHANGED = "(SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)"


def _catch_up_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    shadow = o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus", "o_totalprice")
    source = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return shadow, source, o.where("o_orderkey % 3 = 0").select("o_orderkey")


_CATCH_UP = f"SELECT * FROM {_SHADOW} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_CHANGED} WHERE %s) UNION ALL SELECT * FROM {_SOURCE} WHERE o_orderkey IN (SELECT o_orderkey FROM {_CHANGED} WHERE %s)"


@query(_CATCH_UP.replace("%s", "true"))
def catchup_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed keys of a shadow brought to the source's state."""
    shadow, source, changed = _catch_up_parts(spark, sf_dir)
    return rewrite.catch_up(shadow, changed, source, "o_orderkey")


@query(_CATCH_UP.replace("%s", "o_orderkey BETWEEN 1000 AND 4000"))
def catchup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for changed keys of a range."""
    shadow, source, changed = _catch_up_parts(spark, sf_dir)
    return rewrite.catch_up(shadow, changed, source, "o_orderkey", 1000, 4000)


@query(f"SELECT * FROM {_SHADOW} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_CHANGED} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_SOURCE}))")
def delete_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shadow without changed keys that the source no longer has."""
    shadow, source, changed = _catch_up_parts(spark, sf_dir)
    return rewrite.delete_missing(shadow, changed, source, "o_orderkey")


@query(f"SELECT * FROM {_SHADOW} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_SOURCE}) UNION ALL SELECT * FROM {_SOURCE}")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows replaced or added by key."""
    shadow, source, _ = _catch_up_parts(spark, sf_dir)
    return rewrite.upsert(shadow, source, "o_orderkey")


def _col(name: str, kind: str, **more) -> ColumnSpec:
    return ColumnSpec(name, FieldType(kind), **more)


_CUSTOMER = (_col("c_custkey", "BigInt", primary_key=True), _col("c_name", "Text"), _col("c_nationkey", "Integer"), _col("c_acctbal", "DoublePrecision"))
_PART = (_col("p_partkey", "BigInt", primary_key=True), _col("p_name", "Text"), _col("p_size", "Integer"))
_SUPPLIER = (_col("s_suppkey", "BigInt", primary_key=True), _col("s_name", "Text"), _col("s_nationkey", "Integer"), _col("s_acctbal", "DoublePrecision"))
_NATION = (_col("n_nationkey", "Integer", primary_key=True), _col("n_name", "Text"), _col("n_regionkey", "Integer"))


def _migrated(spark: SparkSession, sf_dir: str, source: str, before: tuple, after: tuple, config: MigrationConfig = MigrationConfig(), on_round=None, indexes: tuple = ()):
    """A table filled from a driver table in its first shape and migrated to its second."""
    store = Store(spark, work_dir(spark, "tables"))
    t = store.create(TableSpec(source, before))
    t.insert(table(spark, sf_dir, source).select([c.name for c in before]))
    migrate.migrate(store, TableSpec(source, after, indexes), source, config, on_round)
    return t


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, 7 AS age FROM customer")
def rewrite_add_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A required column with a default: a rewrite."""
    return _migrated(spark, sf_dir, "customer", _CUSTOMER, (*_CUSTOMER, _col("age", "Integer", nullable=False, default_sql="7"))).read()


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, CAST(NULL AS VARCHAR) AS email FROM customer")
def rewrite_add_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nullable column: metadata alone."""
    return _migrated(spark, sf_dir, "customer", _CUSTOMER, (*_CUSTOMER, _col("email", "Text", unique=True))).read()


@query("SELECT p_partkey, p_size, p_name FROM part")
def rewrite_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in the declared order."""
    a, b, c = _PART
    return _migrated(spark, sf_dir, "part", _PART, (a, c, b), MigrationConfig(enforce_column_order=True)).read()


@query("SELECT p_partkey, p_name AS title, p_size FROM part")
def rewrite_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A renamed column: metadata alone."""
    return _migrated(spark, sf_dir, "part", _PART, (_PART[0], _col("title", "Text", rename_from="p_name"), _PART[2])).read()


_EXACT = MigrationConfig(enforce_exact_columns=True, allow_destructive_drops=True)


@query("SELECT s_suppkey, s_name FROM supplier")
def rewrite_drop_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that the spec doesn't have, dropped when that is allowed."""
    return _migrated(spark, sf_dir, "supplier", _SUPPLIER, _SUPPLIER[:2], _EXACT).read()


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def backup_keeps_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backup of that rewrite still has them."""
    t = _migrated(spark, sf_dir, "supplier", _SUPPLIER, _SUPPLIER[:2], _EXACT)
    return t.read_backup(t.backups()[0])


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def rewrite_type_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wider type, by a strict cast."""
    return _migrated(spark, sf_dir, "nation", _NATION, (*_NATION[:2], _col("n_regionkey", "BigInt"))).read()


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'changed' ELSE c_name END AS c_name, c_nationkey, c_acctbal, 0 AS age FROM customer WHERE c_custkey % 10 <> 7 UNION ALL SELECT -1, 'new', 0, 1.5, 0")
def rewrite_under_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewrite during which rows are changed, deleted and added: none is lost."""

    def writer(number: int, t) -> None:
        rows = table(spark, sf_dir, "customer").select([c.name for c in _CUSTOMER])
        if number == 0:
            t.upsert(rows.where("c_custkey % 10 = 3").withColumn("c_name", F.lit("changed")))
            t.delete(rows.where("c_custkey % 10 = 7"))
        elif number == 1:
            t.upsert(spark.createDataFrame([(-1, "new", 0, 1.5)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double"))

    after = (*_CUSTOMER, _col("age", "Integer", nullable=False, default_sql="0"))
    return _migrated(spark, sf_dir, "customer", _CUSTOMER, after, MigrationConfig(parallel_backfill=True), writer).read()


_LINE_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT CAST(row_number() OVER (ORDER BY {_LINE_KEY}) AS BIGINT) AS mig_id, l_orderkey, l_linenumber FROM lineitem")
def migration_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense key over a total order, for a table without one."""
    line = table(spark, sf_dir, "lineitem").select(*_LINE_KEY.split(", "))
    return rewrite.assign_migration_key(line, column="mig_id").select("mig_id", "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur more than once."""
    return rewrite.unique_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_NOW = [("id", "BIGINT", False, 0), ("name", "TEXT", True, 1), ("old", "TEXT", True, 2), ("age", "INTEGER", True, 3)]
_WANT = [("id", "BIGINT", False, 0), ("name", "TEXT", False, 1), ("age", "BIGINT", True, 2), ("email", "TEXT", True, 3)]


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"('{a}', '{b}', {str(c).lower()}, {d})" for a, b, c, d in rows)


@query(
    f"""SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN a.sql_type <> b.sql_type THEN 'type'
    WHEN a.nullable <> b.nullable THEN 'nullability' ELSE 'position' END AS kind FROM (VALUES {_values(_NOW)}) a(name, sql_type, nullable, position)
    FULL JOIN (VALUES {_values(_WANT)}) b(name, sql_type, nullable, position) ON a.name = b.name
    WHERE a.name IS NULL OR b.name IS NULL OR a.sql_type <> b.sql_type OR a.nullable <> b.nullable OR a.position <> b.position"""
)
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two tables' column metadata."""
    kind = "name string, sql_type string, nullable boolean, position int"
    return rewrite.schema_diff_frame(spark.createDataFrame(_NOW, kind), spark.createDataFrame(_WANT, kind))


@query(
    """SELECT index_id, method, is_unique, predicate, coalesce(string_agg(col, ',' ORDER BY ord) FILTER (WHERE col IS NOT NULL), '') AS columns, bool_or(col IS NULL) AS has_expressions
    FROM (SELECT index_id, method, is_unique, predicate, unnest(cols) AS col, generate_subscripts(cols, 1) AS ord
    FROM (VALUES (1, 'btree', true, NULL, ['b', 'a']), (2, 'btree', true, 'id <> ''''', ['email']), (3, 'btree', true, NULL, [NULL]), (4, 'hash', false, NULL, ['x', NULL, 'y'])) t(index_id, method, is_unique, predicate, cols))
    GROUP BY index_id, method, is_unique, predicate"""
)
def index_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of indexes: columns in order, and whether expressions are among them."""
    rows = [(1, "btree", True, None, ["b", "a"]), (2, "btree", True, "id <> ''", ["email"]), (3, "btree", True, None, [None]), (4, "hash", False, None, ["x", None, "y"])]
    return rewrite.index_identities(spark.createDataFrame(rows, "index_id int, method string, is_unique boolean, predicate string, column_names array<string>"))


@query("SELECT event_id AS pair_id, user_id, value AS ma_a, CAST(event_id % 7 AS BIGINT) AS ma_b, value * 2 AS ma_nested_x, value / 2 AS osc_rsi FROM events")
def flatten_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested families as a wide table: own columns, then metrics by id."""
    e = table(spark, sf_dir, "events")
    osc = F.struct((F.col("value") / 2).alias("rsi"))
    fam = F.struct(F.struct((F.col("value") * 2).alias("x")).alias("nested"), F.col("value").alias("a"), (F.col("event_id") % 7).alias("b"))
    nested = e.select(F.col("event_id").alias("pair_id"), "user_id", osc.alias("osc", metadata={"prefix": "osc_"}), fam.alias("fam", metadata={"prefix": "ma_"}))
    return fl.flatten(_required(nested.schema), "proc_a").project(nested)


def _required(schema: T.StructType) -> T.StructType:
    """Structs that expressions make are never null."""
    return T.StructType([T.StructField(f.name, _required(f.dataType), False, f.metadata) if isinstance(f.dataType, T.StructType) else f for f in schema])


_FLAT = T.StructType([
    T.StructField("pair", T.StringType(), False), T.StructField("e_ms", T.LongType(), False),
    T.StructField("fam", T.StructType([T.StructField("a", T.DoubleType(), False), T.StructField("b", T.LongType(), True), T.StructField("nested", T.StructType([T.StructField("x", T.DoubleType(), False)]), False)]), False, {"prefix": "ma_"}),
    T.StructField("osc", T.StructType([T.StructField("rsi", T.DoubleType(), False)]), False, {"prefix": "osc_"}),
])
_FLAT_PLAN = fl.flatten(_FLAT, "proc_a")
_FLAT_TEXT = f"{_FLAT_PLAN.generation}\nproc_a\n" + "ma_a:DoublePrecision:0\nma_b:BigInt:1\nma_nested_x:DoublePrecision:0\nosc_rsi:DoublePrecision:0\n"
_FLAT_SQL = " || chr(10) || ".join(f"'{x}'" for x in _FLAT_TEXT.rstrip("\n").split("\n")) + " || chr(10)"


@query(f"SELECT sha256({_FLAT_SQL}) AS schema_hash, {len(_FLAT_TEXT)} AS n_chars")
def flatten_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of a flattened schema."""
    assert hashlib.sha256(_FLAT_TEXT.encode()).hexdigest() == _FLAT_PLAN.schema_hash
    return spark.createDataFrame([(_FLAT_PLAN.schema_hash, len(_FLAT_TEXT))], "schema_hash string, n_chars int")


@query("SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings")
def vector_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors compressed into binary cells and read back."""
    e = table(spark, sf_dir, "embeddings")
    packed = e.select("vec_id", vectors.compress_udf("F32")("embedding").alias("cell"))
    back = packed.select("vec_id", vectors.decompress_udf("F32")("cell").alias("embedding"))
    return back.select("vec_id", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount, l_returnflag, epoch_us(l_shipdate) AS ship_micros FROM lineitem")
def envelope_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches as binary envelopes and back."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", scalars.wall_clock_micros(F.col("l_shipdate")).alias("ship_micros"))
    schema = envelope.schema_of(line.schema)
    return envelope.decode_frame(envelope.encode_frame(line, schema), schema)


@query("SELECT c_custkey, upper(md5(c_name)) AS raw_hex, substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21) AS uuid_text FROM customer")
def uuid_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UUID texts as 16 bytes and back."""
    m = F.md5("c_name")
    text = F.concat_ws("-", *(F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    raw = table(spark, sf_dir, "customer").select("c_custkey", scalars.uuid_to_bytes(text).alias("raw"))
    return raw.select("c_custkey", F.hex("raw").alias("raw_hex"), scalars.bytes_to_uuid(F.col("raw")).alias("uuid_text"))


@query("SELECT t AS given, CASE upper(t) WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'TIMESTAMPTZ' WHEN 'CHARACTER VARYING' THEN 'VARCHAR' WHEN 'INT4' THEN 'INTEGER' WHEN 'INT8' THEN 'BIGINT' WHEN 'FLOAT8' THEN 'DOUBLE PRECISION' ELSE upper(t) END AS normal, trim(regexp_replace('  id   <>  ''''  ', '\\s+', ' ', 'g')) AS predicate FROM (VALUES ('int4'), ('Int8'), ('text'), ('float8'), ('character varying'), ('timestamp with time zone'), ('vector(3)')) v(t)")
def type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type names and index predicates in their normal form."""
    names = spark.createDataFrame([(x,) for x in ("int4", "Int8", "text", "float8", "character varying", "timestamp with time zone", "vector(3)")], "given string")
    return names.select("given", scalars.normalize_type(F.col("given")).alias("normal"), scalars.normalize_predicate(F.lit("  id   <>  ''  ")).alias("predicate"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 5")
def stream_catchup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log applied as a stream, one file a micro-batch."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = work_dir(spark, "changes")
    log = [o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("?")), o.where("o_orderkey % 10 = 5"), o.where("o_orderkey % 3 = 0 AND o_orderkey % 10 <> 5").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE o_orderstatus END"))]
    full = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    log[2] = log[2].join(full, "o_orderkey").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE s END")).drop("s")
    for k, rows in enumerate(log):
        rows.withColumn("op", F.lit("d" if k == 1 else "u")).withColumn("seq", F.lit(k).cast("long")).coalesce(1).write.mode("append").parquet(path)
    schema = T.StructType([*o.schema.fields, T.StructField("op", T.StringType()), T.StructField("seq", T.LongType())])
    return stream_catch_up(spark, o, path, schema, "o_orderkey")


INDEXED = (IndexSpec(("c_nationkey",)), IndexSpec(("c_custkey", "c_nationkey"), unique=True))


@query("SELECT 'btree' AS method, c AS columns, u AS is_unique FROM (VALUES ('c_custkey,c_nationkey', true), ('c_nationkey', false)) v(c, u)")
def index_ensure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of a spec, made once however often it is applied."""
    t = _migrated(spark, sf_dir, "customer", _CUSTOMER, _CUSTOMER, indexes=INDEXED)
    migrate.migrate(t.store, TableSpec("customer", _CUSTOMER, INDEXED), "customer", MigrationConfig())
    return spark.createDataFrame([(i.method, ",".join(i.columns), i.unique) for i in t.manifest.indexes], "method string, columns string, is_unique boolean")
