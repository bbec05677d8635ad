"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; texts of up to 1 MB keep a batch far below an executor's memory.
BATCH_ROWS = 1000
_OWN_FOLDER: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _OWN_FOLDER:
            _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="loomtable-"))
        base = _OWN_FOLDER[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Lower Arrow's batch size to BATCH_ROWS, for columns of whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def trim() -> None:
    """Give this process's free memory back."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if give:
        give(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step of ``mapInArrow`` whose worker, which other tasks use again, gives free memory back at the end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return wrapped


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table in the shared folder and read it back: the lineage ends here."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Ask for a garbage collection, after which Spark removes shuffle files of finished steps.

    A second one is needed for what the first has only made unreachable.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    trim()


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id's decimal text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salt: Column, salts: int = 16, how: str = "inner") -> DataFrame:
    """Join a large side with one that has a row or few a key, so that a hot key is dealt over ``salts`` tasks.

    ``salt`` is any well spread column of ``left``.  Keys compare null-safe
    when they are wrapped by the caller; rows with null keys don't match.
    """
    a = left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null reads as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], text: int, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches so that no piece has much more than ``limit`` bytes of text (but whole texts)."""
    for b in batches:
        if not b.num_rows:
            continue
        texts = bytes_of(b.column(text))
        size = np.cumsum([len(x) for x in texts])
        start = 0
        while start < len(texts):
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + limit, "right")))
            yield b.slice(start, end - start), texts[start:end]
            start = end


def file_system(uri: str):
    """pyarrow's file system and path for a URI of the shared folder (file, hdfs, s3, gs ...)."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), os.path.abspath(uri.removeprefix("file:")))
