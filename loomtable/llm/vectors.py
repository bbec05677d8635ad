"""Vectors from Arrow columns, and blocks of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of one block of query vectors, which is all that is ever broadcast.
QUERY_BLOCK_BYTES = 8 << 20


def usable(ids: pa.Array, column: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Ids and vectors of the rows whose id isn't null and whose vector has finite components only."""
    flat = column.flatten()
    values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)  # null reads as NaN
    good = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    length = np.asarray(column.value_lengths().fill_null(0))
    end = np.cumsum(length)
    keep = (good[end] == good[end - length]) & np.asarray(column.is_valid()) & np.asarray(ids.is_valid())
    where = np.flatnonzero(keep)
    names = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return [int(names[k]) for k in where], [values[end[k] - length[k] : end[k]] for k in where]


def matrix(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    """Rows of ``dims`` components; shorter vectors end in zeros."""
    if vectors and all(len(v) == dims for v in vectors):
        return np.vstack(vectors)
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def parsed(batches: Iterator[pa.RecordBatch], dims: int, rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) in chunks of at most ``rows`` usable rows."""
    for b in batches:
        ids, vs = usable(b.column(0), b.column(1))
        for at in range(0, len(ids), rows):
            yield np.array(ids[at : at + rows], np.int64), matrix(vs[at : at + rows], dims)


def narrow(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def query_blocks(base: DataFrame, every: int, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (ids, matrix) of the rows whose id is divisible by ``every``; the driver holds one block at a time."""
    most = max(1, QUERY_BLOCK_BYTES // (8 * max(1, dims)))
    ids: list[int] = []
    vs: list[np.ndarray] = []
    for r in base.where(F.col("vec_id") % every == 0).toLocalIterator():
        if r["embedding"] is None or any(x is None for x in r["embedding"]):
            continue
        v = np.array(r["embedding"], np.float64)
        if not np.isfinite(v).all():
            continue
        ids.append(r["vec_id"])
        vs.append(v)
        if len(ids) == most:
            yield np.array(ids, np.int64), matrix(vs, dims)
            ids, vs = [], []
    if ids:
        yield np.array(ids, np.int64), matrix(vs, dims)
