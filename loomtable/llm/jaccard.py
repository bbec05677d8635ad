"""N-gram Jaccard join by rare-first prefix filtering.

A document's set is its distinct shingles of five words.  Documents with
equal sets form a class, and only classes are joined.  Shingles are ordered
rare-first, by a sketch of their document frequency over all documents; two
sets that are similar enough share a shingle among the first of each.  Such
prefixes are exchanged as packed arrays, and shingles that a single class has
in its prefix are dropped there.  What is left passes the length and the
positional filter, then once a pair the suffix filter and the verification.

Groups of near copies don't make all their pairs: a shingle that few classes
have gives its pairs; a class of others is first tied to the nearest of some
leaders of its shingles, for a few rounds.  Only classes of components that
are still apart are compared further, so no link between different components
is lost.  A pair is verified only if signatures of both sets allow the
similarity: a signature counts, modulo 4, the shingles in each of BINS ranges
of the hash, in a code whose Hamming distance is the distance modulo 4, so that
the bits in which two signatures differ are a lower bound of the shingles
that one set has and the other has not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtable.llm.common import bounded_batches, dropped, partitions, pieces, released, salted_join, trimmed, work_dir, written
from loomtable.llm.components import components
from loomtable.llm.packed import pack, unpack
from loomtable.llm.words import mix, shingle_sets

#: Counters of the document-frequency sketch (a counter for some bytes of text, within bounds), and the parts in which it is summed.
LEAST_SKETCH, MOST_SKETCH, SKETCH_BYTES, PARTS = 1 << 20, 1 << 25, 64, 64
#: Sketches that one step of their sum adds up.
SUMMED = 64
#: A shingle whose counter passes HOT, and HOT_MEANS times the mean counter, is dealt over SALTS buckets.
HOT, HOT_MEANS, SALTS = 4096, 8, 64
#: Bits, for each document that needs a set, of the filter by which others are passed over, and their bounds.
FILTER_SHARE, LEAST_FILTER, MOST_FILTER = 16, 1 << 20, 1 << 30
CHUNK_BYTES = 32 << 20
#: Text whose prefixes a bucket holds, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 1 << 16
#: All pairs are made of a token that at most this many classes have; classes of other tokens are tied to leaders.
FEW = 8
#: Rounds in which classes are tied to leaders before the pairs that are left are compared.
ROUNDS = 3
#: Another round follows one that found at least the first one's links by this number.
WORTH = 16
#: A token gives a pair in the last comparison only if the classes have none in common among so many tokens before it.
BEFORE = 8
#: Classes whose texts are found by a list of them; of more, by a filter of bits and a join.
LISTED = 1 << 21
#: Ranges of the hash that signatures count, and the 64-bit words that hold their two bits each.
BINS = 256
WORDS = BINS // 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _node(s: np.ndarray) -> int:
    """A set's fingerprint: sums of its spread shingles, and its size."""
    if not len(s):
        return 0
    a = int(np.sum(mix(s ^ _GOLD))) & (2**64 - 1)
    return int(mix(np.array([a ^ (len(s) * 0x9E3779B97F4A7C15) & (2**64 - 1)], np.uint64)).view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of n of which any set similar to at least ``percent`` has one among its own first ones."""
    return n - (percent * n + 99) // 100 + 1


def signature(s: np.ndarray) -> np.ndarray:
    """Shingles in each of BINS ranges of the hash, modulo 4, in a cyclic two-bit code: WORDS words."""
    count = np.bincount((s >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=BINS) & 3
    code = (count ^ (count >> 1)).astype(np.uint64).reshape(WORDS, 32)
    return np.bitwise_or.reduce(code << np.arange(0, 64, 2, dtype=np.uint64), axis=1)


def sketch_size(text_bytes: int) -> int:
    """Counters of the sketch for a corpus of some bytes: a power of two that grows with it, within bounds."""
    return min(MOST_SKETCH, max(LEAST_SKETCH, 1 << (max(1, text_bytes // SKETCH_BYTES) - 1).bit_length()))


def _measure(width: int, counters: int):
    """Sketch counts of a task in PARTS rows, and (doc_id, text_hash, node, n, signature) of its documents as packed rows."""
    schema = pa.schema([("part", pa.int32()), ("task", pa.int64()), ("docs", pa.binary()), ("hashes", pa.binary()), ("nodes", pa.binary()), ("n", pa.binary()), ("signs", pa.binary()), ("counts", pa.binary())])
    none = {"docs": None, "hashes": None, "nodes": None, "n": None, "signs": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(counters, np.uint32)
        for batch, texts in pieces(batches, 1):
            sets = shingle_sets(texts, width)
            seen: set[int] = set()
            nodes = [_node(s) for s in sets]
            fresh = [s for s, x in zip(sets, nodes, strict=True) if not (x in seen or seen.add(x))]
            np.add.at(sketch, (np.concatenate(fresh) & np.uint64(counters - 1)).astype(np.int64), np.uint32(1))
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            signs = np.concatenate([signature(s) for s in sets])
            yield pa.RecordBatch.from_pylist([{"part": -1, "task": 0, "docs": pack(ids.astype("<i8")), "hashes": pack(batch.column(2).to_numpy(zero_copy_only=False).astype("<i8")), "nodes": pack(np.array(nodes, "<i8")), "n": pack(np.array([len(s) for s in sets], "<u4")), "signs": pack(signs.astype("<u8")), "counts": np.asarray(batch.column(0).is_valid()).tobytes()}], schema=schema)
        step = counters // PARTS
        yield pa.RecordBatch.from_pylist([{"part": k, "task": TaskContext.get().partitionId(), "counts": pack(sketch[k * step : (k + 1) * step])} | none for k in range(PARTS)], schema=schema)

    return run


def _sum_sketch(group):
    import pandas as pd

    total = np.zeros(len(unpack(group["counts"].iloc[0], "<u4")), np.int64)
    for x in group["counts"]:
        total += unpack(x, "<u4")
    return pd.DataFrame({"part": [int(group["part"].iloc[0])], "task": [int(group["task"].iloc[0])], "counts": [pack(np.minimum(total, 2**32 - 1).astype("<u4"))]})


def counter_code(x: np.ndarray) -> np.ndarray:
    """A counter in one byte that keeps its order: exact below 128, then eight steps for each doubling."""
    x = np.asarray(x, np.int64)
    return np.where(x < 128, x, np.minimum(128 + 8 * (np.log2(np.maximum(x, 128)) - 7), 255)).astype(np.uint8)


def _coded(group):
    import pandas as pd

    counts = unpack(group["counts"].iloc[0], "<u4")
    return pd.DataFrame({"part": [int(group["part"].iloc[0])], "total": [int(counts.astype(np.int64).sum())], "codes": [counter_code(counts).tobytes()]})


def _sketch(counts: DataFrame, path: str) -> tuple[np.ndarray, int]:
    """Codes of the sum of the tasks' sketches (part, task, counts), SUMMED of them a step, and of the least hot counter."""
    steps = 0
    last = counts.agg(F.max("task")).first()[0]
    if last is None:
        return np.zeros(LEAST_SKETCH, np.uint8), int(counter_code(HOT))
    while True:
        last //= SUMMED
        counts = written(counts.withColumn("task", F.floor(F.col("task") / SUMMED)).groupBy("part", "task").applyInPandas(_sum_sketch, "part int, task long, counts binary"), f"{path}/sketch{steps}")
        steps += 1
        if not last:
            break
    parts = sorted(counts.groupBy("part").applyInPandas(_coded, "part int, total long, codes binary").collect(), key=lambda r: r["part"])
    for k in range(steps):
        dropped(counts.sparkSession, f"{path}/sketch{k}")
    codes = np.frombuffer(b"".join(r["codes"] for r in parts), np.uint8)
    return codes, int(counter_code(max(HOT, HOT_MEANS * (sum(r["total"] for r in parts) // len(codes)))))


def _unpack_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for docs, hashes, nodes, n, signs, valid in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ids = pa.array(unpack(docs, "<i8"), mask=~np.frombuffer(valid, bool))
            words = unpack(signs, "<i8").reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(unpack(x, "<i8")) for x in (hashes, nodes)), pa.array(unpack(n, "<u4").astype(np.int64)), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(WORDS))], names=["doc_id", "text_hash", "node", "n", *SIGN])


SIGN = [f"s{k}" for k in range(WORDS)]


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _prefixes(texts: DataFrame, shared, hot: int, percent: int, width: int, buckets: int) -> DataFrame:
    """Packed prefixes: a row a bucket and chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = shared.value
        low = np.uint64(len(df) - 1)
        held: list[tuple[np.ndarray, ...]] = []
        names: dict[int, int] = {}  # node -> number in this chunk
        sizes: list[int] = []
        room = CHUNK_BYTES

        def close() -> pa.RecordBatch:
            token, node, at = (np.concatenate(x) for x in zip(*held, strict=True))
            key = np.fromiter(names, np.int64, len(names))
            spread = np.where(df[(token & low).astype(np.int64)] > hot, mix(key.view(np.uint64))[node] % np.uint64(SALTS), np.uint64(0))
            bucket = (mix(token + spread * _GOLD) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((token, bucket))
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [[], [], [], [], [], []]
            for k in range(buckets):
                o = order[cut[k] : cut[k + 1]]
                if len(o):
                    own, number = np.unique(node[o], return_inverse=True)
                    for c, v in zip(rows, (k, pack(token[o].astype("<u8")), pack(number.astype("<u4")), pack(at[o].astype("<u4")), pack(key[own].astype("<i8")), pack(np.array(sizes, "<u4")[own])), strict=True):
                        c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], names=["bucket", "token", "node", "at", "nodes", "n"])

        for _, batch_texts in pieces(batches, 1):
            for s in shingle_sets(batch_texts, width):
                if not len(s):
                    continue
                name = _node(s)
                if name in names:
                    continue
                p = prefix_length(len(s), percent)
                order = np.lexsort((s, df[(s & low).astype(np.int64)]))[:p]
                held.append((s[order], np.full(p, len(names), np.int64), np.arange(p)))
                names[name] = len(names)
                sizes.append(len(s))
            room -= sum(map(len, batch_texts))
            if room <= 0 and held:
                yield close()
                held, names, sizes, room = [], {}, [], CHUNK_BYTES
        if held:
            yield close()

    return texts.mapInArrow(trimmed(run), "bucket int, token binary, node binary, at binary, nodes binary, n binary")


def _pairs_within(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of all pairs within groups that lie one after the other; for small groups."""
    count = size * (size - 1) // 2
    group = np.repeat(np.arange(len(size)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    j = ((1 + np.sqrt(1 + 8 * k.astype(float))) / 2).astype(np.int64)  # k = j(j-1)/2 + i
    return start[group] + k - j * (j - 1) // 2, start[group] + j


def _shared(sketch_value, hot: int, percent: int):
    """Of a bucket: pairs (node, other) of tokens that at most FEW classes have, and postings (token, node, n, at) of all other tokens.

    A pair is kept, once a bucket, if length and positions allow the
    similarity; a posting if another class of the token is near enough in
    size.  A hot token, dealt over several buckets, gives all its postings.
    """

    def run(group):
        import pandas as pd

        df = sketch_value.value
        token, node, at, n = [], [], [], []
        for t, k, a, names, sizes in zip(group["token"], group["node"], group["at"], group["nodes"], group["n"], strict=True):
            number = unpack(k, "<u4").astype(np.int64)
            token.append(unpack(t, "<u8"))
            at.append(unpack(a, "<u4").astype(np.int32))
            node.append(unpack(names, "<i8")[number])
            n.append(unpack(sizes, "<u4")[number].astype(np.int32))
        token, node, at, n = map(np.concatenate, (token, node, at, n))
        order = np.lexsort((node, n, token))
        token, node, at, n = token[order], node[order], at[order], n[order]
        first = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
        token, node, at, n = token[first], node[first], at[first], n[first].astype(np.int64)
        is_hot = df[(token & np.uint64(len(df) - 1)).astype(np.int64)] > hot
        # sizes ascend within a token: if neither neighbour is near enough, no class is
        same = (token[1:] == token[:-1]) & (percent * n[1:] <= 100 * n[:-1])
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | is_hot
        token, node, at, n, is_hot = token[keep], node[keep], at[keep], n[keep], is_hot[keep]
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([edge, [len(token)]]))
        few = (size <= FEW) & ~is_hot[edge]
        i, j = _pairs_within(edge[few], size[few])
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        fits = (percent * n[j] <= 100 * n[i]) & (np.minimum(at[i], at[j]) + 1 + np.minimum(n[i] - 1 - at[i], n[j] - 1 - at[j]) >= need)
        u, v = np.minimum(node[i], node[j])[fits], np.maximum(node[i], node[j])[fits]
        u, v = np.unique(np.stack([u, v]), axis=1)
        rest = np.repeat(~few, size)
        pairs = pd.DataFrame({"token": pd.array([pd.NA] * len(u), "Int64"), "node": u, "other": pd.array(v, "Int64"), "n": np.zeros(len(u), np.int64), "at": np.zeros(len(u), np.int32)})
        left = pd.DataFrame({"token": pd.array(token[rest].view(np.int64), "Int64"), "node": node[rest], "other": pd.array([pd.NA] * int(rest.sum()), "Int64"), "n": n[rest], "at": at[rest]})
        return pd.concat([pairs, left], ignore_index=True)

    return run


def _possible(percent: int) -> Column:
    """Length and positional filter for pairs with sizes n, m, whose first common shingle stands at a, b."""
    need = f"ceil({percent}L * (n + m) / {100 + percent}D - 1e-9)"
    return F.expr(f"{percent}L * greatest(n, m) <= 100L * least(n, m) AND 1 + least(n - 1 - a, m - 1 - b) >= {need}")


def _differ(x: str, y: str) -> str:
    """SQL of the bits in which the signatures of two aliases differ: no more than the shingles that only one set has."""
    return " + ".join(f"bit_count({x}.{w} ^ {y}.{w})" for w in SIGN)


def _allowed(x: str, y: str, n: str, m: str, percent: int) -> str:
    """SQL: signatures allow sets of n and m shingles a similarity of ``percent``: at most (100 - percent) / (100 + percent) of n + m differ."""
    return f"{100 + percent}L * ({_differ(x, y)}) <= {100 - percent}L * ({n} + {m})"


def _near(pairs: DataFrame, signs: DataFrame, percent: int, salts: int = 8) -> DataFrame:
    """(u, v, far) of pairs (u, v) whose signatures allow the similarity; far is the part of both sets that must differ.

    The signature of a v that many pairs have, as a leader, is dealt over ``salts`` tasks.
    """
    near = salted_join(pairs, signs.withColumnRenamed("node", "v").withColumnRenamed("n", "m"), ["v"], F.col("u"), salts).alias("p").join(signs.alias("q"), F.col("p.u") == F.col("q.node"))
    return near.where(_allowed("p", "q", "q.n", "p.m", percent)).select("u", "v", F.expr(f"({_differ('p', 'q')}) / double(q.n + p.m)").alias("far"))


def _leaders(placed: DataFrame, signs: DataFrame, number: int, percent: int) -> DataFrame:
    """Pairs (u, v): each class with the leader of another component whose signature is nearest to its own and allows the similarity.

    A token has up to four leaders in each band of sizes, the ends of two
    orders of its classes that differ from round to round.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.25)))).cast("int")
    banded = placed.withColumn("band", band)
    # the more classes of a token a component has, the likelier it gives leaders
    orders = [F.struct(F.xxhash64("node", F.lit(2 * number + k)).alias("order"), "root", "node", "n", "at") for k in range(2)]
    ends = banded.groupBy("token", "band").agg(F.array(*(f(o) for o in orders for f in (F.min, F.max))).alias("ls"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    ends = ends.select("token", "band", F.explode(F.array_distinct(F.transform("ls", lambda x: x.dropFields("order")))).alias("l")).select("token", "band", F.col("l.node").alias("v"), F.col("l.root").alias("rv"), F.col("l.n").alias("m"), F.col("l.at").alias("b"))
    pairs = banded.join(ends, ["token", "band"]).where("root != rv").groupBy(F.col("node").alias("u"), "v").agg(F.min(F.struct(F.col("at").alias("a"), "b", "n", "m")).alias("f"))
    pairs = pairs.select("u", "v", "f.*").where(_possible(percent)).select("u", "v")
    near = _near(pairs, signs, percent)
    best = near.groupBy("u").agg(F.min(F.struct("far", "v")).alias("x"))
    return best.select("u", F.col("x.v").alias("v"))


def _apart(placed: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of classes of different components that share a token of ``placed`` and whose signatures allow the similarity.

    The largest component of a token is never compared within itself.  A pair
    is made of few of its tokens: of none with another common one among the
    BEFORE tokens before it in either class.  The first common token (all
    classes have their tokens in one order) has none, so no pair is lost.
    """
    major = placed.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "root")).alias("big")).select("token", F.col("big.root").alias("major"))
    before = F.collect_list("token").over(Window.partitionBy("node").orderBy("at").rowsBetween(-BEFORE, -1))
    within = placed.withColumn("before", before).join(major, "token").join(signs.drop("n"), "node")
    left = within.where("root != major").select("token", F.col("node").alias("u"), "n", F.col("at").alias("a"), F.col("root").alias("ru"), "before", *SIGN)
    right = within.select("token", F.col("node").alias("v"), F.col("n").alias("m"), F.col("at").alias("b"), F.col("root").alias("rv"), (F.col("root") == F.col("major")).alias("rest"), "before", *SIGN)
    need = f"ceil({percent}L * (x.n + y.m) / {100 + percent}D - 1e-9)"
    fits = f"x.token = y.token AND x.ru != y.rv AND (y.rest OR x.u < y.v) AND {percent}L * greatest(x.n, y.m) <= 100L * least(x.n, y.m) AND least(x.a, y.b) + 1 + least(x.n - 1 - x.a, y.m - 1 - y.b) >= {need} AND {_allowed('x', 'y', 'x.n', 'y.m', percent)} AND NOT arrays_overlap(x.before, y.before)"
    return left.alias("x").join(right.alias("y"), F.expr(fits)).select("u", "v")


def _listed_sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """As ``_sets``, by a sorted list of (rep, node): no set moves."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pack(c.to_numpy().astype("<i8"))], pa.binary()) for c in b.columns], names=["reps", "nodes"])

    found = wanted.select("rep", "node").mapInArrow(listed, "reps binary, nodes binary").collect()
    reps, nodes = (np.concatenate([np.zeros(0, "<i8"), *(unpack(r[k], "<i8") for r in found)]) for k in range(2))
    order = np.argsort(reps, kind="stable")
    shared = texts.sparkSession.sparkContext.broadcast((reps[order], nodes[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, nodes = shared.value
        for batch, xs in pieces(batches, 1):
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            low, high = np.searchsorted(reps, ids, "left"), np.searchsorted(reps, ids, "right")
            some = np.flatnonzero((low < high) & np.asarray(batch.column(0).is_valid()))
            if len(some):
                sets = shingle_sets([xs[k] for k in some], width)
                made = [(x, s) for k, x, s in zip(some, map(_node, sets), sets, strict=True) if x in nodes[low[k] : high[k]]]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.int64()), pa.array([_set_cell(s) for _, s in made], pa.binary())], names=["node", "cell"])

    return texts.mapInArrow(trimmed(run), "node long, cell binary")


def _sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, cell): the set of each class of ``wanted`` (node, rep).

    Texts are scanned once.  Up to LISTED classes every task has a list of
    them; of more, a filter of bits, sized by the classes, passes over most of
    the other texts, and the rest of them is dropped by a join.
    """
    spark = texts.sparkSession
    number = wanted.count()
    if number <= LISTED:
        return _listed_sets(texts, wanted, width)
    size = min(MOST_FILTER, max(LEAST_FILTER, 1 << (FILTER_SHARE * number).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for b in batches:
            h = (mix(b.column(0).to_numpy().view(np.uint64)) % np.uint64(size)).astype(np.int64)
            np.bitwise_or.at(bits, h >> 3, (1 << (h & 7)).astype(np.uint8))
        step = len(bits) // PARTS
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([pack(bits[k * step : (k + 1) * step]) for k in range(PARTS)], pa.binary())], names=["part", "bits"])

    def either(group):
        import pandas as pd

        return pd.DataFrame({"part": [int(group["part"].iloc[0])], "bits": [pack(np.bitwise_or.reduce([unpack(x, np.uint8) for x in group["bits"]]))]})

    parts = wanted.select("rep").mapInArrow(fill, "part int, bits binary").groupBy("part").applyInPandas(either, "part int, bits binary").collect()
    if not parts:
        return spark.createDataFrame([], "node long, cell binary")
    shared = spark.sparkContext.broadcast(np.concatenate([unpack(r["bits"], np.uint8) for r in sorted(parts, key=lambda r: r["part"])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch, xs in pieces(batches, 1):
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            h = (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(size)).astype(np.int64)
            some = np.flatnonzero((bits[h >> 3] >> (h & 7)) & 1 & np.asarray(batch.column(0).is_valid()))
            if len(some):
                sets = shingle_sets([xs[k] for k in some], width)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some].astype(np.int64)), pa.array([_node(s) for s in sets], pa.int64()), pa.array([_set_cell(s) for s in sets], pa.binary())], names=["rep", "node", "cell"])

    made = texts.mapInArrow(trimmed(run), "rep long, node long, cell binary")
    return made.join(wanted, ["rep", "node"], "left_semi").select("node", "cell")


def _set_cell(s: np.ndarray) -> bytes:
    return s.astype("<u8").tobytes()


def similar(x: bytes, y: bytes, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches ``percent``."""
    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    at = np.searchsorted(y, x)
    common = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of pairs (u, v) whose sets are similar.

    Pairs go by v; those of a hot v are dealt over copies of its set.  Sets
    are dealt out once, each to all places that need it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own = None, b""
        for b in batches:
            us, vs = [], []
            for v, s, is_u, node, cell in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not is_u:
                    place, own = (v, s), cell
                elif place != (v, s):
                    raise ValueError(f"no set of class {v}")
                elif similar(cell, own, percent):
                    us.append(node)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    share = 128
    degree = pairs.groupBy("v").agg(F.count("*").alias("d"))
    dealt = pairs.join(degree, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.floor(F.col("d") / share) + 1).cast("int").alias("s"))
    copies = degree.select("v", F.explode(F.sequence(F.lit(0), F.floor(F.col("d") / share).cast("int"))).alias("s"))
    ends = dealt.select(F.col("u").alias("node"), "v", "s", F.lit(True).alias("is_u")).unionByName(copies.select(F.col("v").alias("node"), "v", "s", F.lit(False).alias("is_u")))
    cells = sets.join(ends, "node").select("v", "s", "is_u", "node", "cell")
    return cells.repartition("v", "s").sortWithinPartitions("v", "s", "is_u").mapInArrow(trimmed(run), "u long, v long")


def _grouped(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Of each row doc_id, text_hash, n, node (the set's fingerprint), root (equal within a component) and component_id."""
    spark = docs.sparkSession
    path = work_dir(spark, "jaccard")
    bounded_batches(spark)
    texts = _texts(docs)
    size = texts.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    packed = ", ".join(f"{c} binary" for c in ("docs", "hashes", "nodes", "n", "signs", "counts"))
    measured = written(texts.mapInArrow(trimmed(_measure(width, sketch_size(size))), f"part int, task long, {packed}"), f"{path}/measured")
    sketch, hot = _sketch(measured.where("part >= 0").select("part", "task", "counts"), path)
    # the tasks' sketches have done their part
    named = written(measured.where("part < 0").drop("part", "task"), f"{path}/documents")
    dropped(spark, f"{path}/measured")
    released(spark)
    rows = named.select("docs", "hashes", "nodes", "n", "signs", "counts").mapInArrow(_unpack_docs, "doc_id long, text_hash long, node long, n long, " + ", ".join(f"{w} long" for w in SIGN))
    signed = rows.where("doc_id IS NOT NULL AND n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), *(F.first(w).alias(w) for w in SIGN))
    classes = written(signed, f"{path}/classes")

    buckets = min(MOST_BUCKETS, max(64, 2 * partitions(spark), size // BUCKET_BYTES))
    shared = spark.sparkContext.broadcast(sketch)
    del sketch
    found = _prefixes(texts.where("doc_id IS NOT NULL"), shared, hot, percent, width, buckets).groupBy("bucket").applyInPandas(_shared(shared, hot, percent), "token long, node long, other long, n long, at int")
    found = written(found, f"{path}/postings")
    released(spark)

    everyone = classes.select("node", "n", *SIGN)
    few = written(_near(found.where("token IS NULL").select(F.col("node").alias("u"), F.col("other").alias("v")).distinct(), everyone, percent, 1).select("u", "v"), f"{path}/few")
    postings = found.where("token IS NOT NULL").select("token", "node", "n", "at")
    several = postings.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("token")
    placed = written(postings.join(several, "token", "left_semi").withColumn("root", F.col("node")), f"{path}/placed")
    dropped(spark, f"{path}/postings")
    # only classes of these pairs and postings take part from here on
    nodes = few.select(F.explode(F.array("u", "v")).alias("node")).unionByName(placed.select("node")).distinct()
    wanted = written(classes.join(nodes, "node", "left_semi"), f"{path}/wanted")
    signs = wanted.select("node", "n", *SIGN)
    total = rows.agg(F.count("doc_id").alias("all"), F.countDistinct("doc_id").alias("ids")).first()
    sets = _sets(texts.where("doc_id IS NOT NULL"), wanted.select("rep", "node"), width)
    sets = written(sets.dropDuplicates(["node"]) if total["all"] > total["ids"] else sets, f"{path}/sets")
    released(spark)
    links = spark.createDataFrame([], "u long, v long")
    for k in range(ROUNDS):
        tried = _leaders(placed, signs, k, percent)
        tried = written(tried if k else tried.unionByName(few).distinct(), f"{path}/tried{k}")
        found = written(_verified(tried, sets, percent).distinct(), f"{path}/links{k}")
        number = found.count()
        first = number if not k else first
        if not number:
            break
        links = links.unionByName(found)
        root = components(links, f"{path}/components{k}")
        whole = placed.select("token", "node", "n", "at").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # tokens within one component have done their part
        split = whole.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token")
        placed = written(whole.join(split, "token", "left_semi"), f"{path}/placed{k}")
        dropped(spark, f"{path}/placed{k - 1}" if k else f"{path}/placed")
        released(spark)
        if number * WORTH < first:
            break

    more = written(_apart(placed, signs, percent).distinct(), f"{path}/pairs")
    released(spark)
    links = links.unionByName(written(_verified(more, sets, percent).distinct(), f"{path}/links"))
    root = components(links, f"{path}/components")

    members = root.join(classes.select("node", "rep"), "node")
    least = members.groupBy("root").agg(F.min("rep").alias("component_id"))
    grouped = members.join(least, "root").select("node", "root", "component_id")
    of = classes.select("node", "rep").join(grouped, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "rep").alias("component_id"))
    alone = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return salted_join(rows.drop(*SIGN), of, ["node"], F.coalesce("doc_id", F.rand(1)), 8, "left").select("doc_id", "text_hash", "n", "node", "root", alone.alias("component_id"))


def join(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """Near-duplicate components: doc_id, n_shingles, node (the set's fingerprint), component_id.

    Documents are linked when 100 * common >= percent * united shingles, and
    a component's id is its smallest doc_id.  A null text and one without
    words have no shingles and are linked with nothing; a text shorter than
    ``width`` words is one shingle.  A row with a null id takes no part and
    has a null component_id; repeated rows have a result each; an empty table
    gives an empty result; other columns are not read.
    """
    return _grouped(docs, percent, width).select("doc_id", F.col("n").alias("n_shingles"), "node", "component_id")


def deduplicated(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """One row of each component: of its smallest doc_id, and there of the smallest hash of the text.

    Rows with a null id stay.  Rows without shingles are linked with nothing,
    so of them only those of one id and text count as repeated.  Of rows that
    repeat id and text the one with the smallest hash of all columns stays.
    Columns keep their names, whatever these are.
    """
    spark = docs.sparkSession
    found = _grouped(docs, percent, width).where("doc_id IS NOT NULL")
    found = written(found.select("doc_id", "text_hash", "root").where("root IS NOT NULL"), work_dir(spark, "grouped"))
    stays = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    gone = salted_join(found, stays, ["root"], F.col("doc_id"), 8).where("k != struct(doc_id, text_hash)").select("doc_id", "text_hash").distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    kept = keyed.join(gone, ["doc_id", "text_hash"], "left_anti")
    repeated = written(keyed.where("doc_id IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.count("*").alias("c")).where("c > 1").drop("c"), work_dir(spark, "repeated"))
    if not repeated.limit(1).count():
        return kept.select("row.*")
    one = kept.join(repeated, ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.join(repeated, ["doc_id", "text_hash"], "left_anti").select("row").unionByName(one.select("row")).select("row.*")
