"""LM scoring by a probabilistic suffix tree over words.

A state is a context of up to ``depth`` words.  Level d holds the contexts of
d words; a context is a candidate if it occurs often enough, and is retained
if the divergence of its next words from those of its longest retained suffix
is large enough (``divergence`` nats over its occurrences).  A state's
distribution is its counts, smoothed by that suffix's distribution, which
takes the weight of next words seen once; at the root it is the smoothed
distribution of words.  A token is scored in the longest retained suffix
state of the words before it.

Counting never moves texts or single tokens.  Documents are cut into blocks
of bounded size, written once as arrays of word numbers.  In a round, each
block sends the distinct hashes of its n-grams as sorted packed arrays, a
bucket of the hash range each; a bucket sums them over blocks and answers
each block with the totals in the same order.  A frequent n-gram therefore
appears once a block at most, and no table of the vocabulary is ever
collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtable.llm.common import bounded_batches, file_system, id_crc, partitions, pieces, released, work_dir, written
from loomtable.llm.packed import pack, unpack
from loomtable.llm.words import mix, word_hashes

#: Folders over which the answers of a round are dealt; bytes of text of a block.
#: A block's arrays take about 50 times its bytes in a task; where executors have more memory, larger blocks send fewer keys.
GROUPS, BLOCK_BYTES = 1024, 2 << 20
_END = 0x5851F42D4C957F2D
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """depth: longest context; least: occurrences of a candidate context; strength: weight of the suffix's distribution; add: count added to every word at the root."""

    depth: int = 2
    least: int = 4
    divergence: float = 3.0
    strength: float = 1.0
    add: float = 0.1


_BLOCKS = T.StructType([T.StructField("block", T.LongType())] + [T.StructField(x, T.BinaryType()) for x in ("ids", "valid", "train", "counts", "vocabulary", "tokens")])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents (doc_id, text, train): words as numbers in the block's sorted vocabulary of hashes."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 24
    held: list[tuple] = []
    size = number = 0

    def close() -> pa.RecordBatch:
        ids, valid, train, counts, words = (np.concatenate(x) for x in zip(*held, strict=True))
        # the end of a text is a token of its own
        at = np.cumsum(counts)
        words = np.insert(words, at, np.uint64(_END))
        vocabulary, tokens = np.unique(words, return_inverse=True)
        cells = (pack(ids.astype("<i8")), pack(valid.astype(np.uint8)), pack(train.astype(np.uint8)), pack((counts + 1).astype("<u4")), pack(vocabulary), pack(tokens.astype("<u4")))
        return pa.RecordBatch.from_arrays([pa.array([base + number], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], names=_BLOCKS.names)

    for batch, texts in pieces(batches, 1, BLOCK_BYTES // 2):
        words, counts = word_hashes(texts)
        ids = batch.column(0)
        held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_valid()), np.asarray(batch.column(2).fill_null(False)), counts, words))
        size += sum(map(len, texts))
        if size >= BLOCK_BYTES:
            yield close()
            held, size, number = [], 0, number + 1
    if held:
        yield close()


class Block:
    """A block's tokens, and what rounds have answered about their n-grams.

    ``grams[d]`` is the hash of the d words up to each token, ``count[d]``
    its training count (0 where it wasn't asked or is below 2).  For contexts
    of d words, ``sums[d]`` has the counts of their retained next words and
    ``kept[d]`` whether they are states.
    """

    def __init__(self, row: dict, settings: Settings, corpus: tuple[int, int]):
        self.s, (self.n, self.v) = settings, corpus
        self.ids, self.valid = unpack(row["ids"], "<i8"), unpack(row["valid"], np.uint8).astype(bool)
        self.sizes = unpack(row["counts"], "<u4").astype(np.int64)
        self.vocabulary = unpack(row["vocabulary"], "<u8")
        self.tokens = unpack(row["tokens"], "<u4").view("<i4")
        self.train = np.repeat(unpack(row["train"], np.uint8).astype(bool), self.sizes)
        start = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.tokens), dtype=np.int32) - np.repeat(start.astype(np.int32), self.sizes)
        self.grams: dict[int, np.ndarray] = {1: self.vocabulary[self.tokens]}
        self.count: dict[int, np.ndarray] = {}
        self.owned: dict[int, np.ndarray] = {}
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.sums: dict[int, np.ndarray] = {}
        self.kept: dict[int, np.ndarray] = {}

    def before(self, x: np.ndarray) -> np.ndarray:
        """Each token's value of its predecessor (any value at a text's first token)."""
        return np.concatenate([x[:1], x[:-1]])

    def asked(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where n-grams of d words are asked for, their distinct hashes, and the number of each place's hash."""
        if d not in self.keys:
            if d == 1:
                self.keys[1] = (np.arange(len(self.tokens), dtype=np.int32), self.vocabulary, self.tokens)
            else:
                less = self.count[d - 1]
                where = np.flatnonzero((self.place >= d - 1) & (self.before(less) >= self.s.least) & (less >= 2)).astype(np.int32)
                gram = mix(self.grams[d - 1][where - 1] * _STEP + self.grams[1][where] + np.uint64(d))
                self.grams[d] = np.zeros(len(self.tokens), np.uint64)
                self.grams[d][where] = gram
                unique, number = np.unique(gram, return_inverse=True)
                self.keys[d] = (where, unique, number.astype(np.int32))
        return self.keys[d]

    def local(self, d: int) -> np.ndarray:
        where, unique, number = self.asked(d)
        return np.bincount(number[self.train[where]], minlength=len(unique))

    def told(self, d: int, answer: np.ndarray) -> None:
        where, _, number = self.asked(d)
        self.count[d] = np.zeros(len(self.tokens), np.int32)
        self.count[d][where] = (answer >> 1)[number]
        self.owned[d] = np.zeros(len(self.tokens), bool)
        # the place that stands for an n-gram: its first in the block that owns it
        first = np.full(len(answer), -1, np.int32)
        first[number[::-1]] = where[::-1]
        self.owned[d][first[(answer & 1).astype(bool)]] = True
        if d > 1:  # what follows needs the places' counts alone
            self.keys[d] = (where[:0], self.keys[d][1], number[:0])

    def contexts(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens behind a candidate context of d words, the contexts' distinct hashes, and the number of each."""
        where = np.flatnonzero((self.place >= d) & (self.before(self.count[d]) >= self.s.least))
        unique, number = np.unique(self.grams[d][where - 1], return_inverse=True)
        return where, unique, number.astype(np.int32)

    def gains(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of candidate contexts: hashes, counts of next words seen more than once, and their gain; each n-gram counts in the block that owns it."""
        where, unique, number = self.contexts(d)
        c, total = self.count[d + 1][where], self.count[d][where - 1]
        mine = (c >= 2) & self.owned[d + 1][where]
        gain = np.zeros(len(where))
        p = self.probability(d - 1)[where[mine]]
        gain[mine] = c[mine] * np.log((c[mine] - 0.5) / (total[mine] + self.s.strength) / p)
        return unique, np.bincount(number, np.where(mine, c, 0), len(unique)), np.bincount(number, gain, len(unique))

    def judged(self, d: int, sums: np.ndarray, gain: np.ndarray) -> None:
        where, _, number = self.contexts(d)
        total, s = self.count[d][where - 1].astype(float), sums[number]
        rest = self.s.strength + total - s
        good = gain[number] + (total - s) * np.log(rest / (total + self.s.strength)) >= self.s.divergence
        self.sums[d], self.kept[d] = np.zeros(len(self.tokens)), np.zeros(len(self.tokens), bool)
        self.sums[d][where], self.kept[d][where] = s, good

    def probability(self, depth: int) -> np.ndarray:
        """Each token's probability in its longest state of at most ``depth`` words."""
        p = (self.count[1] + self.s.add) / (self.n + self.s.add * (self.v + 1))
        for d in range(1, depth + 1):
            k = np.flatnonzero(self.kept[d])
            total = self.count[d][k - 1]
            p[k] = (self.count[d + 1][k] + (self.s.strength + total - self.sums[d][k]) * p[k]) / (total + self.s.strength)
        return p


def _chunks(block: int, kind: int, keys: np.ndarray, values: list[np.ndarray], buckets: int) -> Iterator[dict]:
    """Sorted keys cut into buckets of the hash range."""
    cut = np.searchsorted(keys, (np.arange(buckets + 1, dtype=object) * 2**64 // buckets)[:-1].astype(np.uint64))
    cut = np.append(cut, len(keys))
    for b in range(buckets):
        x = slice(cut[b], cut[b + 1])
        if cut[b + 1] > cut[b]:
            yield {"kind": kind, "bucket": b, "block": block, "keys": pack(keys[x]), "one": pack(values[0][x]), "two": pack(values[1][x]) if len(values) > 1 else b""}


_CHUNKS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("one", pa.binary()), ("two", pa.binary())])
_ANSWERS = "kind int, bucket int, block long, one binary, two binary, known long, total long"
COUNT, GAIN = 0, 1


def _sum_bucket(group):
    """Totals of a bucket's keys over blocks, sent back to each block in the order of its keys."""
    import pandas as pd

    group = group.sort_values("block")
    kind = int(group["kind"].iloc[0])
    keys = [unpack(x, "<u8") for x in group["keys"]]
    size = np.cumsum([0, *map(len, keys)])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    fresh = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    start, which = np.flatnonzero(fresh), np.cumsum(fresh) - 1

    def back(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[order] = x
        return out

    known = total = 0
    if kind % 2 == COUNT:
        n = np.concatenate([unpack(x, "<u8") for x in group["one"]]).astype(np.int64)[order]
        sums = np.add.reduceat(n, start)
        known, total = int((sums > 0).sum()), int(sums.sum())
        has = n > 0
        seen = np.cumsum(has)
        first = has & (seen - (seen[start] - has[start])[which] == 1)
        # beyond single words, one occurrence tells nothing
        least = 1 if kind == COUNT else 2
        totals = sums[which]
        one = back(np.where(totals >= least, totals << 1 | first, 0)).astype("<u8")
        two = None
    else:
        sums = np.add.reduceat(np.concatenate([unpack(x, "<u8") for x in group["one"]]).astype(np.int64)[order], start)[which]
        gains = np.add.reduceat(np.concatenate([unpack(x, "<f4") for x in group["two"]]).astype(float)[order], start)[which]
        one, two = back(sums).astype("<u8"), back(gains).astype("<f4")
    rows = list(zip(size[:-1], size[1:], strict=True))
    return pd.DataFrame(
        {
            "kind": kind, "bucket": int(group["bucket"].iloc[0]), "block": group["block"].to_numpy(), "one": [pack(one[a:b]) for a, b in rows],
            "two": [pack(two[a:b]) if two is not None else b"" for a, b in rows], "known": [known] + [0] * (len(rows) - 1), "total": [total] + [0] * (len(rows) - 1),
        }
    )


def _answers(path: str, kind: int, block: int, column: str, dtype: str) -> np.ndarray:
    """What a round has answered to a block, in the order of its keys."""
    import pyarrow.dataset as ds

    fs, root = file_system(f"{path}/kind={kind}/group={block_group(block)}")
    if fs.get_file_info(root).type.name != "Directory":
        return np.zeros(0, dtype)
    found = ds.dataset(root, format="parquet", filesystem=fs).to_table(columns=["bucket", column], filter=ds.field("block") == block).sort_by("bucket")
    parts = [unpack(x, dtype) for x in found.column(column).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def block_group(block: int) -> int:
    """The folder of a block's answers; ``_round`` has the same in SQL."""
    return ((block >> 24) * 31 + (block & (1 << 24) - 1)) % GROUPS


class _Reader:
    """Rebuilds a block with what rounds have answered so far; paths: kind -> folder."""

    def __init__(self, settings: Settings, corpus: tuple[int, int], paths: dict[int, str]):
        self.settings, self.corpus, self.paths = settings, corpus, paths

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
        for b in batches:
            for row in b.to_pylist():
                block, name = Block(row, self.settings, self.corpus), row["block"]
                for d in range(1, self.settings.depth + 2):
                    if 2 * d - 2 in self.paths:
                        block.told(d, _answers(self.paths[2 * d - 2], 2 * d - 2, name, "one", "<u8").astype(np.int64))
                for d in range(1, self.settings.depth + 1):
                    kind = 2 * d - 1
                    if kind in self.paths:
                        block.judged(d, *(_answers(self.paths[kind], kind, name, c, t).astype(float) for c, t in (("one", "<u8"), ("two", "<f4"))))
                yield name, block


def _round(blocks: DataFrame, send: Callable[[int, Block], Iterator[dict]], reader: _Reader, path: str, buckets: int) -> None:
    """Chunks that blocks send, summed a bucket, and the answers written by groups of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in reader.blocks(batches):
            for rows in send(name, block):
                yield pa.RecordBatch.from_pylist([rows], schema=_CHUNKS)

    chunks = blocks.mapInArrow(run, "kind int, bucket int, block long, keys binary, one binary, two binary")
    answers = chunks.groupBy("kind", "bucket").applyInPandas(_sum_bucket, _ANSWERS)
    group = F.expr(f"cast((shiftright(block, 24) * 31 + (block & {(1 << 24) - 1})) % {GROUPS} AS int)")
    spread = answers.withColumn("group", group)
    spread.repartition(partitions(blocks.sparkSession), "group").sortWithinPartitions("kind", "group", "block").write.partitionBy("kind", "group").parquet(path)


def score(docs: DataFrame, settings: Settings | None = None, every: int = 10) -> DataFrame:
    """Score whole texts: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_state_tokens.

    Rows whose crc32 of the id isn't divisible by ``every`` are learned from.
    Words are runs of anything but 0x20 and 0x09-0x0D, A-Z lowered; a text's
    end is a token.  Scores are sums of log10 probabilities; n_state_tokens
    counts the tokens scored in a state below the root.  A null text is empty
    (one token, its end); a row with a null id isn't learned from and has a
    null held_out; repeated rows count as often as they occur; an empty table
    gives an empty result; other columns are not read.
    """
    s = settings or Settings()
    spark: SparkSession = docs.sparkSession
    path = work_dir(spark, "suffix-tree")
    bounded_batches(spark)
    held = id_crc(F.col("doc_id")) % every == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(~held, F.lit(False)).alias("train"))
    blocks = written(rows.mapInArrow(_blocks, _BLOCKS), f"{path}/blocks")
    buckets = max(64, 2 * partitions(spark))
    paths: dict[int, str] = {}

    def words(name: int, block: Block) -> Iterator[dict]:
        yield from _chunks(name, 0, block.vocabulary, [block.local(1).astype("<u8")], buckets)

    _round(blocks, words, _Reader(s, (0, 0), {}), f"{path}/words", buckets)
    released(spark)
    r = spark.read.schema(f"{_ANSWERS}, group int").parquet(f"{path}/words").agg(F.sum("known"), F.sum("total")).first()
    corpus = (int(r[1] or 0), int(r[0] or 0))
    paths[0] = f"{path}/words"

    for level in range(1, s.depth + 2):

        def send(name: int, block: Block, level=level) -> Iterator[dict]:
            # counts of n-grams of level + 1 words, and gains of contexts of level - 1
            if level <= s.depth:
                yield from _chunks(name, 2 * level, block.asked(level + 1)[1], [block.local(level + 1).astype("<u8")], buckets)
            if level > 1:
                keys, sums, gains = block.gains(level - 1)
                yield from _chunks(name, 2 * level - 3, keys, [sums.astype("<u8"), gains.astype("<f4")], buckets)

        _round(blocks, send, _Reader(s, corpus, dict(paths)), f"{path}/level{level}", buckets)
        released(spark)  # the round's shuffles have no use any more
        if level <= s.depth:
            paths[2 * level] = f"{path}/level{level}"
        if level > 1:
            paths[2 * level - 3] = f"{path}/level{level}"

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _Reader(s, corpus, paths).blocks(batches):
            at = np.cumsum(b.sizes) - b.sizes
            add = lambda x: np.add.reduceat(x, at)
            state = np.any([b.kept[d] for d in range(1, s.depth + 1)], axis=0)
            values = (b.sizes, add((b.count[1] > 0).astype(np.int64)), add(np.log10(b.probability(0))), add(np.log10(b.probability(s.depth))), add(state.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(b.ids, pa.int64(), mask=~b.valid), *map(pa.array, values)], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "n_state_tokens"])

    scored = blocks.mapInArrow(final, "doc_id long, n_tokens long, n_known long, base_score double, score double, n_state_tokens long")
    return scored.select("doc_id", (id_crc(F.col("doc_id")) % every == 0).alias("held_out"), "n_tokens", "n_known", F.lit(corpus[0]).cast("long").alias("train_tokens"), "base_score", "score", "n_state_tokens")
