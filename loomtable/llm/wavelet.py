"""Token-id output as one wavelet matrix a shard.

A shard file holds the ids of consecutive documents.  Level l of the matrix
keeps bit (levels - 1 - l) of every id in the order that the levels above
have sorted them to: zeros first, both sides stable.  Each bit-plane is cut
into blocks of BLOCK bits, compressed on their own, with the count of ones
before every block, so that access, rank (counting) and select (occurrence
look-up) read a few blocks of one file.

Layout: MAGIC, length of the header as unsigned 32-bit integer, header
(JSON), then the sections that the header places: doc_ids and their validity,
starts (one more than documents), and for each level the block offsets,
block ranks and blocks.  All integers are little-endian.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtable.llm.bpe import default_vocabulary, encoder
from loomtable.llm.common import bounded_batches, file_system, partitions, pieces, work_dir, written

MAGIC = b"WAVMTX01"
BLOCK = 1 << 19
END = b"\0\0\0\0"
_SHARDS = T.StructType([T.StructField("partition", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])
_DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def encode_shard(ids: np.ndarray, starts: np.ndarray, doc_ids: list[int | None], bits: int) -> bytes:
    """The file of one shard; ``starts`` has a last entry with the number of ids."""
    pack = zstandard.ZstdCompressor(level=1).compress
    level_of: list[dict] = []
    body: list[bytes] = []
    place = 0

    def add(data: bytes) -> list[int]:
        nonlocal place
        body.append(data)
        place += len(data)
        return [place - len(data), len(data)]

    head = {
        "n_docs": len(doc_ids), "n_tokens": len(ids), "block": BLOCK, "bits": bits,
        "doc_ids": add(pack(np.array([x or 0 for x in doc_ids], "<i8").tobytes())),
        "valid": add(np.packbits([x is not None for x in doc_ids]).tobytes()),
        "starts": add(pack(starts.astype("<u8").tobytes())),
    }
    now = ids
    for level in range(bits):
        bit = (now >> (bits - 1 - level)).astype(np.uint8) & 1
        ones = bit.view(bool)
        blocks, ranks, before = [], [], 0
        for at in range(0, len(bit), BLOCK):
            part = bit[at : at + BLOCK]
            ranks.append(before)
            before += int(np.count_nonzero(part))
            blocks.append(pack(np.packbits(part).tobytes()))
        offsets = np.cumsum([0, *map(len, blocks)])
        level_of.append({"zeros": len(bit) - before, "offsets": add(offsets.astype("<u8").tobytes()), "ranks": add(np.array(ranks, "<u8").tobytes()), "blocks": add(b"".join(blocks))})
        now = np.concatenate([now[~ones], now[ones]])
    text = json.dumps(head | {"levels": level_of}).encode()
    return b"".join([MAGIC, len(text).to_bytes(4, "little"), text, *body])


class WaveletShard:
    """Reads a shard file; point queries fetch only the blocks that they need."""

    def __init__(self, source):
        self.source = source  # a file object with seek and read
        magic, size = self._read(0, 8), int.from_bytes(self._read(8, 4), "little")
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix shard")
        self.head = json.loads(self._read(12, size))
        self.base = 12 + size
        self.n_docs, self.n_tokens, self.bits = self.head["n_docs"], self.head["n_tokens"], self.head["bits"]
        self.levels = [x | {"at": np.frombuffer(self._part(x["offsets"]), "<u8"), "before": np.frombuffer(self._part(x["ranks"]), "<u8")} for x in self.head["levels"]]
        self._kept: dict[tuple[int, int], np.ndarray] = {}

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _part(self, place: list[int]) -> bytes:
        return self._read(self.base + place[0], place[1])

    def doc_ids(self) -> list[int | None]:
        valid = np.unpackbits(np.frombuffer(self._part(self.head["valid"]), np.uint8), count=self.n_docs) if self.n_docs else []
        ids = np.frombuffer(zstandard.decompress(self._part(self.head["doc_ids"])), "<i8")
        return [int(x) if v else None for x, v in zip(ids, valid, strict=True)]

    def starts(self) -> np.ndarray:
        return np.frombuffer(zstandard.decompress(self._part(self.head["starts"])), "<u8").astype(np.int64)

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._kept:
            if len(self._kept) >= 4 * self.bits:
                self._kept.pop(next(iter(self._kept)))
            x = self.levels[level]
            raw = self._read(self.base + x["blocks"][0] + int(x["at"][k]), int(x["at"][k + 1] - x["at"][k]))
            self._kept[level, k] = np.unpackbits(np.frombuffer(zstandard.decompress(raw), np.uint8), count=min(BLOCK, self.n_tokens - k * BLOCK))
        return self._kept[level, k]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        x = self.levels[level]
        if i >= self.n_tokens:
            return self.n_tokens - x["zeros"]
        k = i // BLOCK
        return int(x["before"][k]) + int(np.count_nonzero(self._block(level, k)[: i - k * BLOCK]))

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for level, x in enumerate(self.levels):
            bit = int(self._block(level, i // BLOCK)[i % BLOCK])
            value, ones = value << 1 | bit, self._ones(level, i)
            i = x["zeros"] + ones if bit else i - ones
        return value

    def _range(self, symbol: int, start: int, end: int) -> tuple[int, int]:
        for level, x in enumerate(self.levels):
            a, b = self._ones(level, start), self._ones(level, end)
            start, end = (x["zeros"] + a, x["zeros"] + b) if symbol >> (self.bits - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def count(self, symbol: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs in [start, end)."""
        if symbol >> self.bits:
            return 0
        a, b = self._range(symbol, start, self.n_tokens if end is None else end)
        return b - a

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(symbol):
            raise IndexError("no such occurrence")
        at = self._range(symbol, 0, 0)[0] + k
        for level in range(self.bits - 1, -1, -1):
            x = self.levels[level]
            one = symbol >> (self.bits - 1 - level) & 1
            at = self._find(level, at - x["zeros"] if one else at, one)
        return at

    def _find(self, level: int, k: int, one: int) -> int:
        """Position of the k-th (from 0) one or zero of a level."""
        x = self.levels[level]
        before = x["before"].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * BLOCK - before
        b = int(np.searchsorted(before, k, "right")) - 1
        return b * BLOCK + int(np.flatnonzero(self._block(level, b) == one)[k - int(before[b])])

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def all_ids(self) -> np.ndarray:
        """Every id, in order: the lowest plane's order is undone level by level."""
        values = np.zeros(self.n_tokens, np.uint32 if self.bits > 16 else np.uint16)
        unpack = zstandard.ZstdDecompressor().decompress
        for level in range(self.bits - 1, -1, -1):
            x = self.levels[level]
            raw = self._part(x["blocks"])
            planes = [np.frombuffer(unpack(raw[int(a) : int(b)]), np.uint8) for a, b in zip(x["at"][:-1], x["at"][1:], strict=True)]
            ones = np.unpackbits(np.concatenate(planes), count=self.n_tokens).view(bool) if planes else np.zeros(0, bool)
            up = np.empty_like(values)
            up[~ones] = values[: x["zeros"]]
            up[ones] = values[x["zeros"] :] | values.dtype.type(1 << (self.bits - 1 - level))
            values = up
        return values


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None, shard_tokens: int = 1 << 20) -> DataFrame:
    """Encode documents and write them in ascending doc_id order; returns the manifest of shards.

    A task writes the files of its range of ids, each of about
    ``shard_tokens`` ids, under a name of its own and renames them when they
    are whole: an attempt that is lost leaves no partial shard.
    """
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        number, attempt = task.partitionId(), task.taskAttemptId()
        enc, (fs, root) = encoder(vocabulary), file_system(path)
        bits = max(1, (enc.tokenizer.get_vocab_size() - 1).bit_length())
        ids: list[bytes] = []
        names: list[int | None] = []
        part = size = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, names, part, size
            starts = np.cumsum([0, *(len(x) // 4 for x in ids)])
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.uint16 if bits <= 16 else np.uint32)
            name = f"{root}/shard-{number:06d}-{part:06d}.wm"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{name}.{attempt}") as out:
                out.write(encode_shard(flat, starts, names, bits))
            fs.move(f"{name}.{attempt}", name)
            row = pa.RecordBatch.from_pylist([{"partition": number, "part": part, "path": name, "n_docs": len(names), "n_tokens": int(starts[-1])}], schema=pa.schema([("partition", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
            ids, names, part, size = [], [], part + 1, 0
            return row

        for batch, texts in pieces(batches, 1, 4 << 20):
            for doc_id, x in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True):
                ids.append(x + END)
                names.append(doc_id)
                size += len(x) // 4 + 1
                if size >= shard_tokens:
                    yield close()
        if ids:
            yield close()

    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(write, _SHARDS), f"{path}/manifest")


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """A row a document, read back from the shard files: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    # a row a partition: as few as the writing job had tasks
    sums = sorted((r["partition"], r["n"]) for r in manifest.groupBy("partition").agg(F.sum("n_tokens").alias("n")).collect())
    bases, at = [], 0
    for k, n in sums:
        bases.append((k, at))
        at += n
    base = spark.createDataFrame(bases, "partition int, base long")
    within = F.expr("coalesce(sum(n_tokens) OVER (PARTITION BY partition ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    shards = manifest.withColumn("within", within).join(F.broadcast(base), "partition").select("path", (F.col("base") + F.col("within")).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(path)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(name) as f:
                    shard = WaveletShard(f)
                    starts, ids = shard.starts(), memoryview(shard.all_ids().astype("<u4").tobytes())
                    doc_ids = shard.doc_ids()
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts[:-1] + first), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], names=_DOCS.names)

    return shards.repartition(partitions(spark), "path").mapInArrow(read, _DOCS)


def token_output(docs: DataFrame, vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """Write the shards of a table of documents (doc_id, text) and read them back.

    A null text is empty: its only id is the end id 0.  Null ids come first;
    repeated ids stand in the order of their texts; an empty table gives no
    shard and an empty result; other columns are not read.
    """
    path = path or work_dir(docs.sparkSession, "wavelet")
    return read_shards(write_shards(docs, path, vocabulary), path)
