"""Folders for intermediate tables, and numbering without a global window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a temporary folder of this machine only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="loomtable-"))
        base = _OWN[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], column: str, path: str | None = None, parts: int | None = None) -> DataFrame:
    """Number rows from 0 in the order of columns: ranges are numbered apart and shifted by the sizes of those before.

    The ranged rows are written once, since numbering reads them twice.  The
    driver sees a count a range.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, path or work_dir(spark, "numbered"))
    sizes = sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect())
    base, at = [], 0
    for k, size in sizes:
        base.append((k, at))
        at += size
    offset = spark.createDataFrame(base, "_range int, _base long")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long") - 1
    return ranged.join(F.broadcast(offset), "_range").withColumn(column, rank + F.col("_base")).drop("_range", "_base")
