"""Connected components of an edge table by alternating large-star and small-star.

Every step is an aggregation and a join on node ids, so a node with very many
links is an ordinary hot key: its minimum is pre-aggregated before the shuffle
and the join is split by adaptive execution. Nothing is collected but a row
count and a checksum for each iteration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    moved = down.join(least, "a").filter("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.unionByName(least.select("a", F.col("root").alias("b"))).distinct()


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, root) for every node that is not the smallest of its component.

    ``edges`` has long columns a and b; order, repeats and loops don't matter.
    """
    state = common.materialise(_small_star(edges.filter("a <> b").select("a", "b")), label)
    mark = _mark(state)
    while True:
        before, state = state, common.materialise(_small_star(_large_star(state)), label)
        old, mark = mark, _mark(state)
        common.free(before)
        if mark == old:
            return state.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return tuple(row)
