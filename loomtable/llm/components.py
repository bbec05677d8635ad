"""Connected components of a table of links.

Links are first joined within their partitions, which leaves a tree of depth
one for each part of a component.  Up to ONE_TASK links these are joined in a
task, of more by alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtable.llm.common import dropped, salted_join, trimmed, written
from loomtable.llm.packed import pack, unpack

#: Links that one task may join.
ONE_TASK = 1 << 20


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links (u, v), ascending, and the least node of each one's component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars around least nodes (u, v), in a packed row."""
    u = v = np.zeros(0, np.int64)
    held: list[pa.RecordBatch] = []

    def joined() -> tuple[np.ndarray, np.ndarray]:
        node, root = least_nodes(*(np.concatenate([x, *(b.column(k).to_numpy() for b in held)]) for k, x in ((0, u), (1, v))))
        return node[node != root], root[node != root]

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= ONE_TASK:
            u, v = joined()
            held.clear()
    u, v = joined()
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *(pa.array([pack(x.astype("<i8"))], pa.binary()) for x in (u, v))], names=["part", "u", "v"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(unpack(x, "<i8")) for x in (u, v)], names=["u", "v"])


def _joined(group):
    import pandas as pd

    node, root = least_nodes(*(np.concatenate([unpack(x, "<i8") for x in group[c]]) for c in ("u", "v")))
    return pd.DataFrame({"node": node, "root": root})


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v): neighbours are linked to the least node of their star."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    joined = salted_join(both, least, ["u"], F.col("v"), 4)  # a star may hold a third of all nodes
    if large:  # neighbours above the node
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # neighbours below it, and the node itself
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u, v), u > v, are stars around their least nodes: no node has two parents, or a parent and a child."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")), F.struct(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent"))))
    nodes = edges.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.sum("child").alias("parents"), F.max("parent").alias("has_child"))
    return not nodes.where("parents > 1 OR parents = 1 AND has_child = 1").limit(1).count()


def components(links: DataFrame, path: str) -> DataFrame:
    """(node, root) of all nodes of links (u, v); root is the least node of a component."""
    edges = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{path}/links")
    forest = edges.mapInArrow(trimmed(_forest), "part int, u binary, v binary")
    if edges.count() <= ONE_TASK:
        found = written(forest.groupBy("part").applyInPandas(_joined, "node long, root long"), f"{path}/found")
        dropped(edges.sparkSession, f"{path}/links")
        return found
    edges = written(forest.select("u", "v").mapInArrow(_unpacked, "u long, v long").distinct(), f"{path}/round0")
    dropped(edges.sparkSession, f"{path}/links")
    for k in count(1):
        if _settled(edges):
            break
        edges = written(_stars(_stars(edges, True), False), f"{path}/round{k}")
        dropped(edges.sparkSession, f"{path}/round{k - 1}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
