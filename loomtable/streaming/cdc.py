"""Catch-up as a stream: change files are applied to a snapshot, a micro-batch at a time.

The stream keeps no state: each micro-batch reduces its own changes to the
last of each key and writes the next snapshot under the batch's number, so a
batch that is run again replaces its own result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtable.operators.rewrite import latest
from loomtable.operators.workspace import work_dir, written


def apply_changes(snapshot: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The snapshot with changes (seq, op, columns) applied: the last change of a key wins, op d deletes."""
    newest = latest(changes, key)
    kept = snapshot.join(newest.select(key), key, "left_anti").select(snapshot.columns)
    return kept.unionByName(newest.where("op = 'u'").select(snapshot.columns))


def stream_catch_up(spark: SparkSession, snapshot: DataFrame, changes_path: str, schema: T.StructType, key: str, files_per_batch: int = 1) -> DataFrame:
    """Apply all change files that are there (availableNow), in batches; the resulting table."""
    path = work_dir(spark, "catch-up")
    first = f"{path}/base"
    written(snapshot, first)
    current = {"path": first}

    def step(batch: DataFrame, number: int) -> None:
        now = f"{path}/batch-{number:08d}"
        base = batch.sparkSession.read.schema(snapshot.schema).parquet(current["path"])
        apply_changes(base, batch, key).write.mode("overwrite").parquet(now)
        current["path"] = now

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(changes_path)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(snapshot.schema).parquet(current["path"])


def deduplicated_stream(changes: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """A stream of changed keys, each once within the watermark."""
    return changes.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]).select(F.col(key), F.col(time))
