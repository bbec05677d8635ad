"""Approximate nearest neighbours by collision counting over query-aware windows.

The index is cut into shards of bounded size.  A shard keeps, for each random
projection, its rows in the order of their projections; the sorted array of
the projections themselves follows from the vectors.  A query opens a window around its own projection in every array, found
by two binary searches; a row collides where its place lies inside.  Virtual
rehashing widens all windows of a query by a factor until enough rows collide
in ``collide`` of the arrays.  Only those rows are verified by their true
inner product.

Largest inner products become nearest neighbours by one more component,
sqrt(largest norm ** 2 - norm ** 2), with queries scaled to the largest norm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtable.llm.common import partitions, work_dir, written
from loomtable.llm.vectors import narrow, parsed, query_blocks, usable

#: Projections; share of arrays in which a row must collide; share of a shard's rows to verify, and how many besides;
#: first half-width (in units of the largest norm) and the factor of widening; rows of a shard.
PROJECTIONS, COLLIDE, VERIFY, VERIFY_MORE, HALF_WIDTH, WIDEN, SHARD_ROWS = 160, 0.7, 0.1, 100, 1.1, 1.05, 8192
#: One row in so many tells the first width of the windows.
PILOT = 16
#: Queries whose windows are counted at once.
TOGETHER = 64
_INDEX = "n int, ids binary, vectors binary, places binary"


def _extent(base: DataFrame) -> tuple[int, float]:
    """Most components and largest norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, norm = 0, 0.0
        for b in batches:
            for v in usable(b.column(0), b.column(1))[1]:
                dims, norm = max(dims, len(v)), max(norm, float(np.linalg.norm(v)))
        yield pa.RecordBatch.from_pydict({"dims": pa.array([dims], pa.int64()), "norm": pa.array([norm], pa.float64())})

    r = base.mapInArrow(run, "dims long, norm double").agg(F.max("dims"), F.max("norm")).first()
    return r[0] or 0, r[1] or 0.0


def directions(dims: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((PROJECTIONS, dims + 1))


def projections(m: np.ndarray, norm: float) -> np.ndarray:
    """A row a direction: the keys of all vectors, lifted to one norm."""
    a = directions(m.shape[1])
    more = np.sqrt(np.maximum(0.0, 1.0 - ((m / norm) ** 2).sum(axis=1)))
    return a[:, :-1] @ (m / norm).T + a[:, -1:] * more[None, :]


def _exact(m: np.ndarray) -> bytes:
    """Components in single precision where that loses nothing, else in double."""
    single = m.astype("<f4")
    return single.tobytes() if (single == m).all() else m.astype("<f8").tobytes()


def build_index(base: DataFrame, dims: int, norm: float) -> DataFrame:
    """A row a shard: ids, vectors, and for each projection the places of rows in ascending order of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            ids, m = np.concatenate([p[0] for p in parts]), np.vstack([p[1] for p in parts])
            order = np.argsort(projections(m, norm), axis=1, kind="stable").astype("<u2")
            data = (ids.astype("<i8").tobytes(), _exact(m), order.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], names=["n", "ids", "vectors", "places"])

        held, size = [], 0
        for ids, m in parsed(batches, dims, SHARD_ROWS):
            some = (m != 0).any(axis=1)
            ids, m = ids[some], m[some]
            while len(ids):
                room = SHARD_ROWS - size
                held.append((ids[:room], m[:room]))
                size += len(ids[:room])
                ids, m = ids[room:], m[room:]
                if size == SHARD_ROWS:
                    yield shard(held)
                    held, size = [], 0
        if size:
            yield shard(held)

    return base.mapInArrow(run, _INDEX)


def _collide(keys: np.ndarray, ranks: np.ndarray, centres: np.ndarray, half: np.ndarray, least: int) -> np.ndarray:
    """For each query whether each row of ``ranks`` lies in at least ``least`` of its windows."""
    seen = np.zeros((len(half), ranks.shape[1]), np.uint8)
    for key, rank, centre in zip(keys, ranks, centres, strict=True):
        left, right = np.searchsorted(key, centre - half, "left"), np.searchsorted(key, centre + half, "right")
        # a rank before the window's start wraps around and is too large
        seen += (rank[None, :] - left.astype(np.uint16)[:, None]) < (right - left).astype(np.uint16)[:, None]
    return seen >= least


def collisions(keys: np.ndarray, ranks: np.ndarray, centres: np.ndarray, collide: int, want: int) -> list[np.ndarray]:
    """For each query (column of ``centres``) the rows in at least ``collide`` windows, at the first width at which ``want`` of them do.

    Every PILOT-th row tells the width from which all rows are counted; from
    there the windows are widened, or narrowed, to the first width that will do.
    """
    n, queries = keys.shape[1], centres.shape[1]
    want, centres = min(want, n), centres.astype(np.float32)
    widths = [np.float32(HALF_WIDTH)]
    at = np.zeros(queries, np.int64)

    def half(of: np.ndarray) -> np.ndarray:
        while len(widths) <= at[of].max():
            widths.append(widths[-1] * np.float32(WIDEN))
        return np.array(widths, np.float32)[at[of]]

    some, todo = np.ascontiguousarray(ranks[:, ::PILOT]), np.arange(queries)
    while len(todo):
        hits = np.count_nonzero(_collide(keys, some, centres[:, todo], half(todo), collide), axis=1)
        todo = todo[hits * n < want * some.shape[1]]
        at[todo] += 1
    out: list = [None] * queries
    short, todo = np.zeros(queries, bool), np.arange(queries)
    while len(todo):
        hits = _collide(keys, ranks, centres[:, todo], half(todo), collide)
        enough = np.count_nonzero(hits, axis=1) >= want
        for j, ok, row in zip(todo, enough, hits, strict=True):
            if ok:
                out[j] = np.flatnonzero(row)
        short[todo[~enough]] = True
        # narrower while no narrower width has been too narrow, wider while none was wide enough
        more = np.array([not short[j] and at[j] > 0 if ok else out[j] is None for j, ok in zip(todo, enough, strict=True)], bool)
        at[todo] += np.where(enough, -1, 1)
        todo = todo[more]
    return out


def search(index: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int, dims: int, norm: float) -> DataFrame:
    """Each shard's k best verified rows for every query of a block: q, vec_id, score."""
    shared = index.sparkSession.sparkContext.broadcast((q_ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        centres = directions(dims)[:, :-1] @ (queries / np.linalg.norm(queries, axis=1, keepdims=True)).T
        single = queries.astype(np.float32)
        for b in batches:
            for n, ids, m, order in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, m = np.frombuffer(ids, "<i8"), np.frombuffer(m, "<f4" if len(m) == 4 * n * dims else "<f8").astype(float).reshape(n, dims)
                order = np.frombuffer(order, "<u2").reshape(-1, n)
                keys = np.take_along_axis(projections(m, norm), order, 1).astype(np.float32)
                ranks = np.empty_like(order)
                np.put_along_axis(ranks, order, np.arange(n, dtype=np.uint16)[None, :], 1)
                rough, length = m.astype(np.float32), np.linalg.norm(m, axis=1).max()
                want, collide = min(n, k + VERIFY_MORE + int(VERIFY * n)), int(np.ceil(COLLIDE * len(keys)))
                out: list[list[np.ndarray]] = [[], [], []]
                for j, (name, query) in enumerate(zip(names, queries, strict=True)):
                    if j % TOGETHER == 0:
                        near = collisions(keys, ranks, centres[:, j : j + TOGETHER], collide, want)
                    found = near[j % TOGETHER]
                    found = found[ids[found] != name]
                    if len(found) > k:
                        # single precision sets aside what cannot be among the k best; double decides
                        s = rough[found] @ single[j]
                        slack = 1e-5 * length * np.linalg.norm(query) + 1e-30
                        found = found[s >= np.partition(s, len(s) - k)[len(s) - k] - slack]
                    score = (m[found] * query).sum(axis=1)
                    best = np.lexsort((ids[found], -score))[:k]
                    for x, v in zip(out, (np.full(len(best), j), ids[found][best], score[best]), strict=True):
                        x.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["q", "vec_id", "score"])

    return index.mapInArrow(run, "q long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest found (largest inner product) for each query row: query_id, rank, vec_id, score.

    Queries are rows of ``vectors`` (vec_id, embedding) whose id is divisible
    by ``every``; candidates are all rows with another id, each in the index.
    Ties go to the smaller vec_id.  Rows with a null id, and vectors that are
    null, zero, empty or hold null or non-finite components, take no part; a
    shorter vector counts as ending in zeros; a repeated query row gets rows
    of its own; an empty table gives an empty result; other columns are not
    read.
    """
    spark = vectors.sparkSession
    base = narrow(vectors)
    dims, norm = _extent(base)
    out = None
    if norm > 0:
        path = work_dir(spark, "ann")
        index = written(build_index(base, dims, norm), f"{path}/index")
        spread = index.repartition(partitions(spark))
        for number, (ids, m) in enumerate(query_blocks(base, every, dims)):
            some = (m != 0).any(axis=1)
            ids, m = ids[some], m[some]
            if not len(ids):
                continue
            found = search(spread, ids, m, k, dims, norm)
            names = spark.createDataFrame(list(enumerate(ids.tolist())), "q long, query_id long")
            rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
            best = written(found.withColumn("rank", rank).where(F.col("rank") <= k).join(names, "q").select("query_id", "rank", "vec_id", "score"), f"{path}/block{number}")
            out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
