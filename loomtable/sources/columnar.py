"""Any SELECT as bounded columnar batches, checked against a declared schema before it runs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.rdd import _load_from_socket
from pyspark.serializers import NoOpSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomtable.errors import DataFormatError
from loomtable.sources.batch import ColumnarBatch, ColumnarSchema
from loomtable.types import COLUMNAR, TYPE_HINTS

# The rule by which "auto" chooses.
WIDE_COLUMNS, NARROW_COLUMNS, MANY_ROWS = 128, 64, 500_000

#: Bytes of a result that the driver fetches at once.
WINDOW_BYTES = 512 << 20


@dataclass(frozen=True)
class Preflight:
    """What is checked of a result's schema."""

    count: bool = True
    names: bool = True
    types: bool = True


def choose_reader(mode: str, columns: int, expected_rows: int | None = None) -> str:
    """"arrow" (columnar transfer) or "row"; auto: arrow from 128 columns, row for at most 64 columns and at least 500,000 rows, else arrow."""
    if mode in ("arrow", "row"):
        return mode
    if mode != "auto":
        raise DataFormatError(f"unknown reader mode: {mode}")
    return "row" if columns <= NARROW_COLUMNS and (expected_rows or 0) >= MANY_ROWS and columns < WIDE_COLUMNS else "arrow"


def _compatible(kind: str, got: T.DataType) -> bool:
    want = COLUMNAR[kind][0]
    if kind == "TimestampTzMicros":
        return isinstance(got, T.TimestampType | T.TimestampNTZType)
    if isinstance(want, T.StringType):
        return isinstance(got, T.StringType | T.VarcharType | T.CharType)
    return got == want


def preflight(got: T.StructType, schema: ColumnarSchema, checks: Preflight = Preflight()) -> None:
    """Compare a result's schema with the declared one; works before a row is made, so for empty results too."""
    if checks.count and len(got) != len(schema):
        raise DataFormatError(f"preflight failed: column count mismatch: expected {len(schema)}, got {len(got)}")
    for k, (f, g) in enumerate(zip(schema.fields, got, strict=False)):
        if checks.names and f.name is not None and f.name != g.name:
            raise DataFormatError(f"preflight failed: column name mismatch at {k}: expected {f.name}, got {g.name}")
        if checks.types and not _compatible(f.type, g.dataType):
            raise DataFormatError(f"preflight failed: type mismatch at {k} ({g.name}): expected {TYPE_HINTS[f.type]}, got {g.dataType.simpleString()}")


def select(spark: SparkSession, sql: str, schema: ColumnarSchema | None = None, checks: Preflight = Preflight(), source: dict | None = None) -> DataFrame:
    """The DataFrame of a SELECT, passed through as it is; with a schema, preflighted and its wall-clock times read as UTC.

    ``source`` holds JDBC options for a SELECT that another database runs.
    """
    df = spark.read.format("jdbc").options(**source, query=sql).load() if source else spark.sql(sql)
    if schema is None:
        return df
    preflight(df.schema, schema, checks)
    out = []
    for g, f, name in zip(df.schema, schema.fields, schema.names(), strict=True):
        c = F.col(f"`{g.name.replace('`', '``')}`")
        if f.type == "TimestampTzMicros" and isinstance(g.dataType, T.TimestampNTZType):
            # microseconds between wall-clock times don't depend on the session's zone
            c = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c))
        out.append(c.alias(name))
    return df.select(out)


def _micros(frame: DataFrame, schema: ColumnarSchema) -> DataFrame:
    """Times as microseconds: Python's datetimes would pass through the local zone."""
    return frame.select([F.unix_micros(F.col(f"`{n}`")).alias(n) if f.type == "TimestampTzMicros" else F.col(f"`{n}`") for n, f in zip(schema.names(), schema.fields, strict=True)])


def _of_rows(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bytes(x) if isinstance(x, bytearray) else x for x in c], t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)


def by_rows(frame: DataFrame, schema: ColumnarSchema) -> DataFrame:
    """A preflighted frame through the row transfer: rows pickled one by one to where the reader's own step makes batches of them, and rows again."""
    kind = schema.arrow()
    plain = T.StructType([T.StructField(n, T.LongType() if f.type == "TimestampTzMicros" else COLUMNAR[f.type][0]) for n, f in zip(schema.names(), schema.fields, strict=True)])

    def run(rows: Iterator[T.Row]) -> Iterator[tuple]:
        while held := [tuple(r) for r in islice(rows, 4096)]:
            columns = [c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c for c in _of_rows(held, kind).columns]
            yield from zip(*(c.to_pylist() for c in columns), strict=True)

    out = frame.sparkSession.createDataFrame(_micros(frame, schema).rdd.mapPartitions(run), plain, verifySchema=False)
    return out.select([F.timestamp_micros(F.col(f"`{n}`")).alias(n) if f.type == "TimestampTzMicros" else F.col(f"`{n}`") for n, f in zip(schema.names(), schema.fields, strict=True)])


def compare(source: DataFrame, **sides: DataFrame) -> DataFrame:
    """Each distinct row of a frame or of its transfers, and how often each has it: n_source and n_ with the side's name, 0 where it is missing."""
    named = {"source": source, **sides}
    tagged = [d.withColumn("_side", F.lit(k)) for k, d in named.items()]
    return reduce(DataFrame.unionAll, tagged).groupBy(*[f"`{n}`" for n in source.columns]).agg(*[F.count_if(F.col("_side") == k).alias(f"n_{k}") for k in named])


def transfer(frame: DataFrame) -> Iterator[pa.RecordBatch]:
    """Arrow batches of a frame, in its order, straight from the JVM and without a Python worker.

    Partitions are fetched several at a time, as many as are expected to stay
    within WINDOW_BYTES (and half of spark.driver.maxResultSize): by four times
    the plan's estimate at first, then by the largest one seen; at least one.
    """
    spark = frame.sparkSession
    sc = spark.sparkContext
    result = sc._jsc.sc().conf().getSizeAsBytes("spark.driver.maxResultSize", "1g") or WINDOW_BYTES * 2
    room = min(WINDOW_BYTES, result // 2)
    kind = to_arrow_schema(frame.schema, prefers_large_types=spark._jconf.arrowUseLargeVarTypes())
    rdd = frame._jdf.toArrowBatchRdd().toJavaRDD()
    parts, at = rdd.getNumPartitions(), 0
    largest = 4 * int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // max(1, parts)
    seen = 0
    while at < parts:
        width = min(parts - at, max(1, room // max(1, largest)))
        window = sc._jvm.java.util.ArrayList()
        for k in range(at, at + width):
            window.append(k)
        size = 0
        for data in _load_from_socket(sc._jvm.PythonRDD.runJob(sc._jsc.sc(), rdd, window), NoOpSerializer()):
            size += len(data)
            yield pa.ipc.read_record_batch(pa.py_buffer(data), kind)
        # sizes within a window aren't known apart: its mean, doubled, but for a single partition
        seen = max(seen, size if width == 1 else 2 * size // width)
        largest, at = seen, at + width


class BatchReader:
    """Batches of exactly the capacity, but for the last, in the result's order.

    Arrow data comes from the JVM, a bounded window of partitions at a time,
    whatever the mode: the rule of "auto" chooses "row" or "arrow" as it is
    fixed, but cells that cross as Python rows would only be slower.
    ``by_rows`` is the transfer of single rows.
    """

    def __init__(self, spark: SparkSession, sql: str, schema: ColumnarSchema, mode: str = "auto", expected_rows: int | None = None, checks: Preflight = Preflight(), source: dict | None = None):
        self.schema = schema
        self.mode = choose_reader(mode, len(schema), expected_rows)
        self.frame = select(spark, sql, schema, checks, source)
        self._parts: Iterator[pa.RecordBatch] | None = None
        self._rest: pa.RecordBatch | None = None

    def _arrow(self) -> Iterator[pa.RecordBatch]:
        kind = self.schema.arrow()
        for b in transfer(self.frame):
            yield pa.RecordBatch.from_arrays([c if c.type == t else c.cast(t) for c, t in zip(b.columns, kind.types, strict=True)], schema=kind)

    def next_batch_into(self, out: ColumnarBatch) -> int:
        """Fill a batch up to its capacity; 0 rows when the result is exhausted, then and ever after."""
        if out.schema != self.schema:
            raise DataFormatError("the batch's schema differs from the reader's")
        if self._parts is None:
            self._parts = self._arrow()
        need, taken = out.row_capacity, []
        while need and (b := self._rest if self._rest is not None else next(self._parts, None)) is not None:
            n = min(need, b.num_rows)
            taken.append(b.slice(0, n))
            self._rest = b.slice(n) if n < b.num_rows else None
            need -= n
        n = out.row_capacity - need
        out.prepare(out.row_capacity)
        if n:
            taken = [b for b in taken if b.num_rows]
            out._full = taken[0] if len(taken) == 1 else pa.Table.from_batches(taken).combine_chunks().to_batches()[0]
        return n

    def batches(self, capacity: int) -> Iterator[ColumnarBatch]:
        while True:
            out = ColumnarBatch(self.schema, capacity)
            if not self.next_batch_into(out):
                return
            yield out
