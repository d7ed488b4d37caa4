"""Verification of logs: committed prefix, counters, dangling references, relation of two logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def committed_prefix(log: DataFrame) -> DataFrame:
    """Rows up to the last checkpoint; what stands behind it was never committed."""
    last = log.filter("kind = 'checkpoint'").agg(F.max("log_pos")).scalar()
    return log.filter(F.col("log_pos") <= last)


def verify_report(log: DataFrame) -> DataFrame:
    """Counters of a log (kind, offset, length, error) up to the first error, and the bytes behind that stop.

    Rows behind the stop don't count; ``length`` of the row with the error is what is left of the file.
    """
    stop = log.filter("error is not null").agg(F.min("offset")).scalar()
    read = F.col("error").isNull() & F.coalesce(F.col("offset") < stop, F.lit(True))
    size = F.coalesce(F.max(F.col("offset") + F.col("length")), F.lit(0))
    good = F.coalesce(F.max(F.when(read, F.col("offset") + F.col("length"))), F.lit(0))
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("offset")))
    out = log.agg(
        F.count_if(read).alias("records"), F.count_if(read & (F.col("kind") == "checkpoint")).alias("checkpoints"),
        F.count_if(read & F.col("kind").isin("sem", "epi", "pro", "inf")).alias("memories"),
        F.count_if(read & F.col("kind").isin("symbol_alloc", "symbol_alias", "symbol_rename", "symbol_retire")).alias("symbol_events"),
        (size - good).alias("trailing"), first.alias("error"),
    )
    return out.select("records", "checkpoints", "memories", "symbol_events", "trailing", tail_status(F.col("error"), F.col("trailing")).alias("tail"))


def batch_tally(log: DataFrame) -> DataFrame:
    """Memories and edges of each committed batch of a log (log_pos, kind): what stands between two checkpoints."""
    ends = log.filter("kind = 'checkpoint'").select("log_pos")
    last = ends.agg(F.max("log_pos")).scalar()
    before = Window.partitionBy("block").orderBy(F.desc("log_pos")).rowsBetween(Window.unboundedPreceding, 0)
    # The checkpoint that ends a row's batch: the next one in its block of positions, or the first of a later block.
    block = F.floor(F.col("log_pos") / 65_536)
    firsts = ends.groupBy(block.alias("block")).agg(F.min("log_pos").alias("first"))
    span = log.filter(F.col("log_pos") <= last).agg(F.max(block).alias("top")).select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("block"))
    later = span.join(firsts, "block", "left").select("block", F.min("first").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    own = F.last(F.when(F.col("kind") == "checkpoint", F.col("log_pos")), ignorenulls=True).over(before)
    rows = log.filter(F.col("log_pos") <= last).withColumn("block", block).withColumn("own", own).join(F.broadcast(later), "block", "left")
    rows = rows.withColumn("batch", F.coalesce("own", "later"))
    return rows.groupBy("batch").agg(F.count_if(F.col("kind").isin("sem", "epi", "pro", "inf")).alias("memories"), F.count_if(F.col("kind") == "edge").alias("edges"))


def restore_drill(log: DataFrame, dangling: DataFrame, sanity: DataFrame) -> DataFrame:
    """A restored log passes if its tail isn't corrupt, nothing dangles, and a sanity query finds rows."""
    report = verify_report(log).select("records", (F.col("tail") != "corrupt").alias("tail_ok"))
    out = report.crossJoin(dangling.agg((F.count("*") == 0).alias("no_dangling"))).crossJoin(sanity.limit(1).agg((F.count("*") > 0).alias("sanity")))
    return out.select("sanity", "no_dangling", "tail_ok", (F.col("sanity") & F.col("no_dangling") & F.col("tail_ok")).alias("passed"))


def tail_status(error, trailing):
    """clean, orphan (a write was cut short) or corrupt, from the first decode error and the bytes left."""
    return (
        F.when(error.isNull() & (trailing == 0), "clean").when(error.isNull(), "orphan")
        .when(error.isin("truncated", "length_mismatch"), "orphan").otherwise("corrupt")
    )


def dangling_references(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """References (memory_id, symbol_id) without a symbol; each reference counts."""
    return references.join(symbols, "symbol_id", "left_anti")


def log_relation(local: DataFrame | None, remote: DataFrame | None, spark: SparkSession | None = None) -> DataFrame:
    """One row on how two logs of (position, digest) stand: one is a prefix of the other, they diverge, or one isn't there."""
    if local is None or remote is None:
        there = local if local is not None else remote
        relation = "missing" if there is None else "remote_only" if local is None else "local_only"
        n = there.agg(F.count("*").alias("n")) if there is not None else spark.range(1).select(F.lit(None).cast("long").alias("n"))
        count = lambda df: F.col("n") if df is not None else F.lit(None).cast("long")
        return n.select(count(local).alias("local_rows"), count(remote).alias("remote_rows"), F.lit(None).cast("long").alias("different"), F.lit(relation).alias("relation"))
    both = local.withColumnRenamed("digest", "mine").join(remote.withColumnRenamed("digest", "theirs"), "position", "full_outer")
    n = both.agg(
        F.count("mine").alias("local_rows"), F.count("theirs").alias("remote_rows"),
        F.count_if(F.col("mine").isNotNull() & F.col("theirs").isNotNull() & (F.col("mine") != F.col("theirs"))).alias("different"),
    )
    return n.withColumn(
        "relation",
        F.when(F.col("different") > 0, "diverged").when(F.col("local_rows") == F.col("remote_rows"), "synced")
        .when(F.col("local_rows") > F.col("remote_rows"), "local_ahead").otherwise("remote_ahead"),
    )
