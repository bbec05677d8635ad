"""The steps of a rewrite as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtable.errors import EngineError
from loomtable.formats import MIGRATION_KEY
from loomtable.operators.workspace import numbered
from loomtable.plans.chunks import split_range
from loomtable.spec import TableSpec, spark_identifier


def project(df: DataFrame, expressions: list[tuple[str, str | None, str | None]], spec: TableSpec) -> DataFrame:
    """The target columns of a rewrite: sources, defaults or nulls, cast strictly to the declared types."""
    out: list[Column] = []
    for target, source, expression in expressions:
        kind = spec.column(target).type.spark()
        c = F.col(spark_identifier(source)) if source is not None else F.expr(expression)
        out.append(c.cast(kind).alias(target))
    return df.select(out)


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows; a null in one of the columns fails the job that reads it."""
    out = []
    for c in df.columns:
        x = F.col(spark_identifier(c))
        if c in columns:
            x = F.when(x.isNull(), F.raise_error(F.lit(f"null value in column {c} violates its not-null constraint"))).otherwise(x)
        out.append(x.alias(c))
    return df.select(out)


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts; a key with a null never violates."""
    full = df
    for c in columns:
        full = full.where(F.col(spark_identifier(c)).isNotNull())
    return full.groupBy(*[F.col(spark_identifier(c)) for c in columns]).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def deduplicated_changes(changes: DataFrame, key: str) -> DataFrame:
    """Each changed key once."""
    return changes.select(key).distinct()


def latest(changes: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The last change of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in changes.columns if c != key]
    row = F.max_by(F.struct(*[F.col(spark_identifier(c)) for c in rest]), F.col(seq)).alias("_row")
    return changes.groupBy(key).agg(row).select(key, "_row.*")


def upsert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of ``rows`` replace those of equal key, or are added."""
    return target.join(rows.select(key), key, "left_anti").select(target.columns).unionByName(rows.select(target.columns))


def delete_missing(shadow: DataFrame, changed: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The shadow without changed keys that the source no longer has."""
    gone = changed.select(key).join(source.select(key), key, "left_anti")
    return shadow.join(gone, key, "left_anti")


def catch_up(shadow: DataFrame, changed: DataFrame, source: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """The shadow with changed keys (of a closed range, if given) brought to the source's state: updated, added or deleted."""
    keys = deduplicated_changes(changed, key)
    if low is not None:
        keys = keys.where(F.col(key) >= F.lit(low))
    if high is not None:
        keys = keys.where(F.col(key) <= F.lit(high))
    fresh = source.join(keys, key, "left_semi").select(shadow.columns)
    return shadow.join(keys, key, "left_anti").select(shadow.columns).unionByName(fresh)


def keyset_pages(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with the number of their page: ``size`` rows each in the key's order, as paging by key would cut them."""
    if size < 1:
        raise EngineError("a page needs at least a row")
    return numbered(df, [key], "_n").withColumn("page", F.floor(F.col("_n") / size).cast("long")).drop("_n")


def key_bounds(df: DataFrame, key: str) -> tuple[int | None, int | None]:
    r = df.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    return r["a"], r["b"]


def parallel_ranges(df: DataFrame, key: str, workers: int) -> DataFrame:
    """Rows with the number of their key range out of ``workers`` equal ones."""
    low, high = key_bounds(df, key)
    if low is None:
        return df.withColumn("range_id", F.lit(0).cast("long"))
    ranges = split_range(low, high, workers)
    step = ranges[0][1] - ranges[0][0] + 1
    return df.withColumn("range_id", F.expr(f"(CAST({spark_identifier(key)} AS DECIMAL(20, 0)) - CAST({low} AS DECIMAL(20, 0))) div CAST({step} AS DECIMAL(20, 0))"))


def assign_migration_key(df: DataFrame, order: list[str] | None = None, first: int = 1, column: str = MIGRATION_KEY) -> DataFrame:
    """Rows with a dense unique key in the order of columns (all, if none are named); rows equal in all of them are interchangeable."""
    out = numbered(df, order or df.columns, column)
    return out.withColumn(column, F.col(column) + F.lit(first))


def schema_diff_frame(current: DataFrame, expected: DataFrame) -> DataFrame:
    """Differences of two tables of column metadata (name, sql_type, nullable, position), by a full outer join on the name."""
    a, b = current.alias("a"), expected.alias("b")
    j = a.join(b, F.col("a.name") == F.col("b.name"), "full")
    kind = (
        F.when(F.col("a.name").isNull(), "added")
        .when(F.col("b.name").isNull(), "removed")
        .when(F.col("a.sql_type") != F.col("b.sql_type"), "type")
        .when(F.col("a.nullable") != F.col("b.nullable"), "nullability")
        .when(F.col("a.position") != F.col("b.position"), "position")
    )
    return j.select(F.coalesce("a.name", "b.name").alias("name"), kind.alias("kind")).where("kind IS NOT NULL")


def index_identities(indexes: DataFrame) -> DataFrame:
    """Indexes with their columns in order, from rows (index_id, method, is_unique, predicate, column_names): expressions have null names."""
    each = indexes.select("index_id", "method", "is_unique", "predicate", F.posexplode("column_names").alias("ord", "col"))
    cols = F.transform(F.sort_array(F.expr("collect_list(struct(ord, col)) FILTER (WHERE col IS NOT NULL)")), lambda x: x["col"])
    return each.groupBy("index_id", "method", "is_unique", "predicate").agg(F.array_join(cols, ",").alias("columns"), F.bool_or(F.col("col").isNull()).alias("has_expressions"))


def page_bounds(pages: DataFrame, key: str) -> DataFrame:
    """First and last key and size of each page."""
    return pages.groupBy("page").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("n_rows"))


def running(df: DataFrame, partition: str, order: list[str], value: str, name: str) -> DataFrame:
    """A running sum within a partition column, as user SQL would window it."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
