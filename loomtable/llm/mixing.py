"""Mixing sources to target weights by hash-threshold histograms, with DataFrame operations only.

Each row has a uniform 60-bit hash.  Sizes are summed by source and hash
bucket; the bucket in which a source's running sum passes its budget is
refined, BITS more bits of the hash at a time, until it holds a single hash.
Rows below the threshold are taken: a filter, never a sort.  Budgets above a
source's size take every row as often as it fits, and the rest by threshold,
so the rows of a smaller budget are always among those of a larger one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtable.llm.common import salted_join, work_dir, written

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 5  # 60 bits of hash


def sized(docs: DataFrame) -> DataFrame:
    """_row (all columns), _key (source as text with null kept apart), _size, _hash."""
    source = F.col("source").cast("string")
    # null sorts behind every text: a flag, then the text
    key = F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"))
    hash_ = F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id", "text"), 64 - BITS * LEVELS)
    return docs.select(F.struct("*").alias("_row"), key.alias("_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"), hash_.alias("_hash"))


def numbered(sources: DataFrame, parts: int, path: str) -> DataFrame:
    """Sources by code point, null last, with their number from 0: ranges of them, counted apart."""
    ranged = sources.repartitionByRange(parts, "_key").withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, path)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # a row a partition
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(base.select("_part", "_base"), "_part").withColumn("_number", F.row_number().over(Window.partitionBy("_part").orderBy("_key")) - 1 + F.col("_base")).drop("_part", "_base")


def targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """Add _target: shares by _weight of all sizes, each at most ``most`` times its source's size.

    What sources at their limit leave is shared among the others by weight
    until none is above: a loop over a few sums, each over a row a source.
    """
    total, level = None, 0.0
    stopped = F.lit(False)
    while True:
        r = sources.agg(F.sum("_size").alias("t"), F.sum(F.when(~stopped, F.col("_weight"))).alias("w"), F.sum(F.when(stopped, F.col("_size") * most)).alias("c"), F.count(F.when(stopped, 1)).alias("n")).first()
        total = r["t"] or 0
        if not r["w"]:
            return sources.withColumn("_target", F.lit(float(most)) * F.col("_size"))
        level = (total - (r["c"] or 0)) / r["w"]
        over = F.col("_weight") * F.lit(level) > F.col("_size") * most
        more = sources.where(stopped | over).count()
        if more == r["n"]:
            return sources.withColumn("_target", F.when(stopped, (F.col("_size") * most).cast("double")).otherwise(F.col("_weight") * F.lit(level)))
        stopped = stopped | over


def thresholds(rows: DataFrame, sources: DataFrame, path: str) -> DataFrame:
    """Add _times and _limit: a row is taken _times, and once more if its hash is below _limit."""
    ratio = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    state = sources.withColumn("_times", F.floor(ratio + F.lit(1e-12)).cast("long"))
    state = state.withColumn("_left", F.greatest(F.lit(0.0), F.col("_target") - F.col("_times") * F.col("_source_size")))
    state = state.withColumn("_prefix", F.lit(0).cast("long")).withColumn("_open", F.col("_left") > 0)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        asked = state.where("_open").select("_key", "_prefix")
        inside = salted_join(rows.select("_key", "_hash", "_size"), asked, ["_key"], F.col("_hash")) if level else rows.select("_key", "_hash", "_size").withColumn("_prefix", F.lit(0).cast("long"))
        bucket = F.shiftrightunsigned("_hash", shift)
        inside = inside.where(F.shiftrightunsigned("_hash", shift + BITS) == F.col("_prefix")) if level else inside
        sums = inside.groupBy("_key", bucket.alias("_bucket")).agg(F.sum("_size").alias("_sum"), F.min("_hash").alias("_low"), F.max("_hash").alias("_high"))
        before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # the first bucket by which the budget is reached; its own part of the budget stays open
        reached = sums.withColumn("_before", before).join(state.select("_key", "_left"), "_key").where("_before + _sum >= _left AND _before < _left")
        edge = reached.groupBy("_key").agg(F.min(F.struct("_bucket", "_before", "_sum", "_low", "_high")).alias("_e"))
        state = state.join(edge, "_key", "left")
        hit = F.col("_open") & F.col("_e").isNotNull()
        one = F.col("_e._low") == F.col("_e._high")
        rest = F.col("_left") - F.col("_e._before")
        # a single hash left: take it if that comes nearer; else go on inside the bucket
        limit = F.when(F.lit(2.0) * rest >= F.col("_e._sum"), F.col("_e._high") + 1).otherwise(F.col("_e._low"))
        done = one if level < LEVELS - 1 else F.lit(True)
        state = state.select(
            "_key", "_number", "_weight", "_source_size", "_target", "_times",
            F.when(hit & done, limit).otherwise(F.col("_limit") if level else F.lit(None).cast("long")).alias("_limit"),
            F.when(hit & ~done, F.col("_e._bucket")).otherwise(F.col("_prefix")).alias("_prefix"),
            F.when(hit, rest).otherwise(F.col("_left")).alias("_left"),
            (hit & ~done).alias("_open"),
            # an open source whose budget no bucket reaches takes all of its rows
            (F.col("_open") & F.col("_e").isNull() | (F.col("_all") if level else F.lit(False))).alias("_all"),
        )
        state = written(state, f"{path}/level{level}")
        if state.where("_open").limit(1).count() == 0:
            break
    whole = F.lit(1 << (BITS * LEVELS)).cast("long")
    return state.withColumn("_limit", F.when(F.col("_all"), whole).otherwise(F.coalesce("_limit", F.lit(0).cast("long"))))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """How often each document is taken so that sources come to their target shares of all words.

    Returns _row (the document), _size, _source_size, _target and _taken
    (times).  Sources by code point, null last, weigh ``weights`` in turn;
    no document is taken more than ``most`` times.  A null text has size 0;
    rows that are repeated whole share a hash and are taken or left together;
    an empty table gives an empty result; other columns may have any names,
    as they stay inside _row.  A result is within half of the size of the
    rows at the threshold's hash.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "mixing")
    rows = sized(docs)
    narrow = written(rows.select("_key", "_hash", "_size"), f"{path}/sizes")
    sources = numbered(narrow.groupBy("_key").agg(F.sum("_size").alias("_size")), 8, f"{path}/sources")
    of = F.array(*[F.lit(float(w)) for w in weights])
    sources = written(sources.withColumn("_weight", F.element_at(of, (F.col("_number") % len(weights) + 1).cast("int"))), f"{path}/weights")
    aimed = written(targets(sources, most), f"{path}/targets").withColumnRenamed("_size", "_source_size")
    state = thresholds(narrow, aimed, path).select("_key", "_source_size", "_target", "_times", "_limit")
    taken = (F.col("_times") + F.when(F.col("_hash") < F.col("_limit"), 1).otherwise(0)).alias("_taken")
    return salted_join(rows, state, ["_key"], F.col("_hash")).select("_row", "_size", "_source_size", "_target", taken)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: documents with their columns, each as often as it is taken."""
    times = mix(docs, weights, most).where("_taken > 0")
    return times.select("_row", F.explode(F.sequence(F.lit(1), F.col("_taken").cast("int")))).select("_row.*")
