"""Packing: shortest-pack-first over the length histogram.

Documents become pieces of at most ``size`` tokens.  Only the histogram of
piece lengths (at most ``size`` rows) reaches the driver, where lengths are
placed longest first: each goes to the pack with the most room left, and the
counts of packing patterns are updated.  Patterns are joined back to pieces
by their rank within a length.  Ranks are counted in two levels (salted), as
one length may hold a third of all pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtable.llm.bpe import default_vocabulary, encoder
from loomtable.llm.common import bounded_batches, bytes_of, partitions, pieces, trimmed, work_dir, written

END = b"\0\0\0\0"
_PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType())])


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(how often, lengths) of each packing pattern; lengths stand in the order of placement.

    Each piece goes to the pack with the most room left, and a new pack is
    begun only when no open one has room for it.  A step uses up a length's
    count or a pattern's, so there are at most two patterns a length.
    """
    # a heap of (-room, serial): the shortest pack has the most room; full packs are in no heap
    packs: dict[int, list] = {}
    heap: list[tuple[int, int]] = []
    serial = 0

    def put(count: int, lengths: list[int], room: int) -> None:
        nonlocal serial
        packs[serial] = [count, lengths]
        if room:
            heappush(heap, (-room, serial))
        serial += 1

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if heap and -heap[0][0] >= length:
                room, key = heappop(heap)
                count, lengths = packs.pop(key)
                used = min(left, count)
                if count > used:
                    put(count - used, lengths, -room)
                put(used, [*lengths, length], -room - length)
                left -= used
            else:
                # as many of this length in a pack as fit
                many = size // length
                whole, rest = divmod(left, many)
                if whole:
                    put(whole, [length] * many, size - length * many)
                if rest:
                    put(1, [length] * rest, size - length * rest)
                left = 0
    return [(count, lengths) for count, lengths in packs.values()]


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, past the last rank, first sequence, offset) of each place in each pattern."""
    out, ranks, sequence = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            first = ranks.get(length, 0)
            out.append((length, first, first + count, sequence, offset))
            ranks[length] = first + count
            offset += length
        sequence += count
    return out


def cut_pieces(docs: DataFrame, vocabulary: str, size: int) -> DataFrame:
    """A row a piece: every ``size`` tokens of a document, then the rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, step = encoder(vocabulary), 4 * size
        for batch, texts in pieces(batches, 1, 2 << 20):
            cols: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True):
                ids += END
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    for c, v in zip(cols, (doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_PIECES.names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(cut), _PIECES)


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = 1024) -> DataFrame:
    """Pack documents into sequences of at most ``size`` tokens.

    A document's tokens are its BPE ids and the end id 0.  Returns a row a
    piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and sequence_tokens, sequence_padding: a sequence is filled up to
    ``size`` unless its length is a power of two.

    A null text is empty and packs its end id; repeated rows and null ids are
    packed like others; an empty table gives an empty result; other columns
    are not read.  Ties in rank are between equal pieces only.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "packing")
    cut = written(cut_pieces(docs, vocabulary or default_vocabulary(), size), f"{path}/pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = shortest_pack_first(histogram, size)
    salts = max(16, partitions(spark))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    w = "sum(n) OVER (PARTITION BY length ORDER BY salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    bases = by_salt.select("length", "salt", F.coalesce(F.expr(w), F.lit(0)).alias("base"))
    rank = F.expr("row_number() OVER (PARTITION BY length, salt ORDER BY doc_id, start, ids_crc32, doc_tokens)")
    ranked = salted.withColumn("rank", rank).join(bases, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("base"))
    totals = {}
    places = []
    sequence = 0
    for count, lengths in patterns:
        totals[sequence] = sum(lengths)
        sequence += count
    for length, first, end, seq, offset in slots(patterns):
        places.append((length, first, end, seq, offset, totals[seq]))
    schema = "length long, first long, end long, sequence long, offset long, sequence_tokens long"
    # at most two patterns a length with `size` lengths each: a bounded table
    place = spark.createDataFrame(places, schema)
    joined = ranked.join(F.broadcast(place), "length").where("rank >= first AND rank < end")
    full = F.col("sequence_tokens")
    padding = F.when(F.expr("bit_count(sequence_tokens) = 1"), 0).otherwise(F.lit(size) - full)
    return joined.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset", "sequence_tokens", padding.alias("sequence_padding"))
