"""Binding of names: the first batch that mentions a name gives it its kind, and later ones must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed


def audit(mentions: DataFrame) -> DataFrame:
    """(batch, rejected) of every batch of ``mentions`` (batch, name, kind); batches are in log order by their number.

    A batch that is rejected leaves nothing behind, so a later one may be the
    first to give the name a kind. Whether a batch stands depends on earlier
    ones alone: rounds of "who disagrees with the first batch that stands" end
    at that one solution, after as many rounds as rejections hang on each other.
    """
    mentions = mentions.distinct()
    both = mentions.groupBy("batch", "name").agg(F.count("*").alias("n")).filter("n > 1").select("batch").distinct()
    rejected = both = checkpointed(both)
    while True:
        first = mentions.join(rejected, "batch", "left_anti").groupBy("name").agg(F.min(F.struct("batch", "kind")).alias("first"))
        hit = mentions.join(first, "name").filter((F.col("first.batch") < F.col("batch")) & (F.col("first.kind") != F.col("kind"))).select("batch")
        after = checkpointed(both.unionByName(hit).distinct())
        if after.exceptAll(rejected).isEmpty() and rejected.exceptAll(after).isEmpty():
            marked = after.withColumn("rejected", F.lit(True))
            return mentions.select("batch").distinct().join(marked, "batch", "left").withColumn("rejected", F.coalesce("rejected", F.lit(False)))
        rejected = after
