"""Sequence numbers in the order of a whole log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpointed


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with a gapless number from 0 in the given order.

    A sort by ranges numbers rows within each range; the ranges' sizes, one row
    each, are summed up and broadcast. No window runs over the log.
    """
    at = F.monotonically_increasing_id()  # range << 33 | place in it
    placed = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at))
    block = F.shiftright("__at", 33)
    sizes = placed.groupBy(block.alias("__range")).agg(F.count("*").alias("__n"))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__base"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.withColumn("__range", block).join(F.broadcast(bases), "__range").withColumn(name, (F.col("__base") + place).cast("long"))
    return out.drop("__at", "__range", "__base")
