"""Proportional stratified interleaving into shards.

Rows of a source are shuffled by a seeded hash and ranked; a row's fractional
rank is (rank + 1/2) / rows of the source. Sorted by it, all sources run
through the corpus at the same pace, so any contiguous cut has the corpus'
mixture. Cuts at k * rows / shards give shards whose row counts differ by one
at most (law ``rows``).

No source and no shard is ever gathered in one task: both orders are total
sorts over ranges of rows, where a row's own number comes last in the sort key,
so that neither a source, nor a fraction that many sources share, nor rows that
repeat each other are a hot key. A row's place is its range's first place, by
running counts of the ranges, and its place in the range.

Defined results: a null source is a source of its own; a null text has size 1
and the checksum of no bytes (0); null and repeated ids are placed like others
(rows equal in every used column are interchangeable); an empty table gives no
rows; more shards than rows leave shards empty. Equal texts are not kept
together: law ``rows`` has no groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

def _numbered(rows: DataFrame, *order) -> DataFrame:
    """``rows`` sorted by ranges, with ``range`` and ``place``, the row's number in its range."""
    at = F.monotonically_increasing_id()  # range << 33 | number
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at).select(
        *rows.columns, F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")
    )


def _running(counts: DataFrame, *stratum: str) -> DataFrame:
    """``counts`` (range, n) with ``base``, the rows of the ranges before."""
    ahead = Window.partitionBy(*stratum).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0)))


def interleave_shards(docs: DataFrame, shards: int = 16, seed: int = 20_240_229) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    thin = common.materialise(
        docs.select(
            "doc_id",
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("stratum"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
        ).select("*", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size").alias("mix"), F.monotonically_increasing_id().alias("row")),
        "shard-rows",
    )
    total = thin.count()
    # The hash is ordered as an unsigned number.
    shuffled = (F.shiftrightunsigned("mix", 1), F.col("mix").bitwiseAND(F.lit(1)), F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("row"))

    # 1. Rank within a stratum: sorted by it, a row's rank is its stratum's rows in the ranges before, and those ahead in
    # its own range.
    sorted_rows = common.materialise(_numbered(thin, F.col("stratum"), *shuffled), "shard-order")
    per_range = sorted_rows.groupBy("stratum", "range").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    offsets = _running(per_range.repartition("stratum"), "stratum").withColumn("stratum_rows", F.sum("n").over(Window.partitionBy("stratum")))
    # A (stratum, range) is no larger than a range.
    rank = F.col("base") + F.col("place") - F.col("first")
    ranked = sorted_rows.join(offsets.drop("n"), ["stratum", "range"]).select(
        "doc_id", "size", "text_crc32", "mix", "row", ((rank + 0.5) / F.col("stratum_rows")).alias("fraction")
    )

    # 2. Position in the order of fractional ranks. There are few ranges, so their bases are broadcast.
    placed = common.materialise(_numbered(ranked, F.col("fraction"), *shuffled), "shard-ranks")
    bases = _running(placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))).drop("n")
    position = placed.join(F.broadcast(bases), "range").withColumn("position", F.col("base") + F.col("place"))

    # 3. Cut: shard s has the positions with floor(position * shards / total) = s.
    common.free(thin, sorted_rows)
    return position.withColumn("shard", F.expr(f"cast(position * {shards}L div {max(total, 1)}L as int)")).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("position") - F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")).cast("long").alias("slot"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave_shards(common.documents(spark, sf_dir))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
