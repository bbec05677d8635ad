"""Exact top-k search by distributed histogram selection.

Every pass scores all candidates against a block of queries.  A pass counts,
for each query, the scores in equal bins of the interval that still holds the
k-th highest one, and the next pass refines that bin; when a bin is one score
wide, that score is the k-th value.  A last pass keeps what isn't below it
and breaks ties by the smaller id.  A task sends only the bins from its own
k-th score upwards, and at most k rows a query in the last pass, so neither
grows with ties or groups of equal vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtable.llm.common import work_dir, written
from loomtable.llm.vectors import narrow, parsed, query_blocks, usable

#: Bytes of a task's counts and of its scores of one chunk.
_COUNT_BYTES, _SCORE_BYTES = 16 << 20, 32 << 20
_HITS = "q long, score long, vec_id long"


def quantised(m: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * m)


def _extent(base: DataFrame, scale: float) -> tuple[int, float]:
    """Most components and largest norm of the quantised vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, norm = 0, 0.0
        for b in batches:
            for v in usable(b.column(0), b.column(1))[1]:
                dims = max(dims, len(v))
                norm = max(norm, float(np.linalg.norm(quantised(v, scale))))
        yield pa.RecordBatch.from_pydict({"dims": pa.array([dims], pa.int64()), "norm": pa.array([norm], pa.float64())})

    r = base.mapInArrow(run, "dims long, norm double").agg(F.max("dims"), F.max("norm")).first()
    return r[0] or 0, r[1] or 0.0


def _scores(base: DataFrame, q_ids: np.ndarray, q: np.ndarray, dims: int, scale: float, schema: str, use):
    """mapInArrow with use(iterator of (ids, scores, own)) -> record batches; own marks a query's own row."""
    spark = base.sparkSession
    shared = spark.sparkContext.broadcast((q_ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        rows = max(1, _SCORE_BYTES // (8 * len(names)))

        def each() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for ids, m in parsed(batches, dims, rows):
                s = quantised(m, scale).astype(queries.dtype) @ queries.T
                yield ids, s.astype(np.int64), ids[:, None] == names[None, :]

        yield from use(each())

    return base.mapInArrow(run, schema)


def _refine(base: DataFrame, ids: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, dims: int, scale: float) -> np.ndarray:
    """The k-th highest score of each query (or ``low``, if fewer); scores lie in [low, high]."""
    n = len(ids)
    bins = int(min(4096, max(16, _COUNT_BYTES // (8 * n))))
    low, high, need = low.copy(), high.copy(), np.full(n, k, np.int64)
    while True:
        width = (high - low) // bins + 1

        def count(chunks, low=low, high=high, width=width, need=need):
            total = np.zeros(n * bins, np.int64)
            at = np.arange(n)[None, :] * bins
            for _, s, own in chunks:
                inside = (s >= low) & (s <= high) & ~own
                total += np.bincount((at + (s - low) // width)[inside], minlength=n * bins)
            total = total.reshape(n, bins)
            above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
            q_at, bin_at = np.nonzero((total > 0) & (above < need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(q_at), pa.array(bin_at), pa.array(total[q_at, bin_at])], names=["q", "bin", "n"])

        counts = _scores(base, ids, q, dims, scale, "q long, bin long, n long", count).groupBy("q", "bin").agg(F.sum("n").alias("n"))
        above = F.coalesce(F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        wanted = base.sparkSession.createDataFrame(list(enumerate(need.tolist())), "q long, need long")
        # a row a query of the block: the bin that holds its k-th score
        found = counts.withColumn("above", above).join(wanted, "q").where("above < need AND above + n >= need").select("q", "bin", "above").collect()
        hit = np.zeros(n, bool)
        for r in found:
            a = r["q"]
            hit[a] = True
            low[a] += r["bin"] * width[a]
            high[a] = min(high[a], low[a] + width[a] - 1)
            need[a] -= r["above"]
        high[~hit] = low[~hit]  # fewer than k candidates: all of them
        if (high == low).all():
            return low


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """The k highest integer inner products of floor(scale * component) for each query row.

    Queries are rows of ``vectors`` (vec_id, embedding) whose id is divisible
    by ``every``; candidates are all rows with another id.  Returns query_id,
    rank (int from 1), vec_id, score; ties go to the smaller vec_id.  Rows
    with a null id or vector, or null or non-finite components, take no part;
    a shorter vector counts as ending in zeros; a repeated query row gets
    rows of its own; an empty table gives an empty result; other columns are
    not read.  Products beyond 64 bits raise OverflowError.
    """
    spark: SparkSession = vectors.sparkSession
    base = narrow(vectors)
    dims, norm = _extent(base, scale)
    bound = norm * norm
    if bound >= 2.0**62:
        raise OverflowError("inner products may exceed 64 bits")
    # doubles hold every product and partial sum below 2 ** 53 exactly
    kind = np.float64 if bound < 2.0**52 else np.int64
    path = work_dir(spark, "topk")
    out = None
    for number, (ids, m) in enumerate(query_blocks(base, every, dims)):
        q = quantised(m, scale).astype(kind)
        reach = np.ceil(np.linalg.norm(q.astype(np.float64), axis=1) * norm * (1 + 1e-9)).astype(np.int64) + 1
        least = -reach
        kth = _refine(base, ids, q, least, reach, k, dims, scale)

        def keep(chunks, kth=kth, n=len(ids)):
            held: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 3
            for names, s, own in chunks:
                row, col = np.nonzero((s >= kth) & ~own)
                held = tuple(np.concatenate(x) for x in zip(held, (col, s[row, col], names[row]), strict=True))
                order = np.lexsort((held[2], -held[1], held[0]))
                held = tuple(x[order] for x in held)
                # place within the query's rows: at most k stay
                first = np.searchsorted(held[0], held[0], "left")
                few = np.arange(len(held[0])) - first < k
                held = tuple(x[few] for x in held)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["q", "score", "vec_id"])

        hits = _scores(base, ids, q, dims, scale, _HITS, keep)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        names = spark.createDataFrame(list(enumerate(ids.tolist())), "q long, query_id long")
        best = written(hits.withColumn("rank", rank).where(F.col("rank") <= k).join(names, "q").select("query_id", "rank", "vec_id", "score"), f"{path}/block{number}")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
