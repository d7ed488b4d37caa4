"""Supersession derived from immutable rows.

Semantic and inferential rows: along a key's history in log order, the head is
the row with the largest valid time so far. A later valid time replaces it
(``forward``), an earlier one is ``retro`` and ends where the head begins, an
equal one is a ``conflict`` and is rejected. Since a rejected row equals the
head, a running maximum gives the head in one pass.

Procedural rows: a row is superseded by the first later row that shares its
rule or its (trigger, scope), the lesser of two leads.

A key's history is ordered in one task. Keys with more than ``hot_rows`` rows
are told by an exact count first; their histories are cut into ranges of rows,
and what a range needs of the others (the head before it, the first link after
it) is one row for each key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpointed

ORDER = ("committed_at", "log_pos")
#: Rows of a key that one task still orders.
HOT_ROWS = 1 << 20


def _kind() -> Column:
    return (
        F.when(F.col("head").isNull(), "first")
        .when(F.col("valid_at") > F.col("head"), "forward")
        .when(F.col("valid_at") < F.col("head"), "retro")
        .otherwise("conflict")
    )


def _on_chain() -> Column:
    return F.col("kind").isin("first", "forward")


def split_hot(rows: DataFrame, key: tuple[str, ...], hot_rows: int | None, plain, in_ranges) -> DataFrame:
    """``plain(rows)``, with the rows of hot keys by ``in_ranges`` instead. Null keys are keys."""
    if hot_rows is None:
        return plain(rows)
    hot = rows.groupBy(*key).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_rows).select(*(F.col(c).alias(f"__{c}") for c in key))
    if hot.isEmpty():
        return plain(rows)
    # So many rows a key: there are few such keys, whatever the log.
    hot = checkpointed(hot)
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return plain(rows.join(F.broadcast(hot), same, "left_anti")).unionByName(in_ranges(rows.join(F.broadcast(hot), same, "left_semi")))


def _in_ranges(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``__range``: sorted by key and log order, each range of rows has a number."""
    order = (*key, *ORDER)
    at = F.shiftright(F.monotonically_increasing_id(), 33)
    return checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", at))


def _join_ranges(rows: DataFrame, of_ranges: DataFrame, key: tuple[str, ...]) -> DataFrame:
    there = of_ranges.select(*(F.col(c).alias(f"__{c}") for c in (*key, "__range")), *(c for c in of_ranges.columns if c not in (*key, "__range")))
    same = F.col("__range") == F.col("____range")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(there, same, "left").drop(*(f"__{c}" for c in (*key, "__range")))


def key_history(rows: DataFrame, *key: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``rows`` with head, head_id, kind, closed_by, close_at and close_committed."""
    out = split_hot(rows, key, hot_rows, lambda part: _history(part, key), lambda part: _history_in_ranges(part, key))
    return out.select(
        *rows.columns, "head", "kind", "head_id", F.col("next.memory_id").alias("closed_by"), F.col("next.valid_at").alias("close_at"), F.col("next.committed_at").alias("close_committed")
    )


_ME = ("memory_id", "valid_at", "committed_at")


def _history(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One shuffle on the key: both sort orders of the history use it."""
    by_key = Window.partitionBy(*key)
    past = by_key.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    future = by_key.orderBy(*(F.desc(c) for c in ORDER)).rowsBetween(Window.unboundedPreceding, -1)
    me = F.when(_on_chain(), F.struct(*_ME))
    # Read backwards, the last chain row seen is the next one of the history.
    return (
        rows.withColumn("head", F.max("valid_at").over(past)).withColumn("kind", _kind())
        .withColumn("head_id", F.last(F.when(_on_chain(), F.col("memory_id")), ignorenulls=True).over(past))
        .withColumn("next", F.when(_on_chain(), F.last(me, ignorenulls=True).over(future)))
    )


def _history_in_ranges(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    placed = _in_ranges(rows, key)
    # The head before a range: the largest valid time of the ranges ahead, and the row that reached it first.
    first_top = F.struct(F.col("valid_at").alias("top"), (-F.col("committed_at")).alias("c"), (-F.col("log_pos")).alias("l"), F.col("memory_id").alias("id"))
    tops = placed.groupBy(*key, "__range").agg(F.max(first_top).alias("__top"))
    ahead = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    heads = tops.select(*key, "__range", F.max("__top").over(ahead).alias("__before"))
    inside = Window.partitionBy(*key, "__range")
    past = inside.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    future = inside.orderBy(*(F.desc(c) for c in ORDER)).rowsBetween(Window.unboundedPreceding, -1)
    me = F.when(_on_chain(), F.struct(*_ME))
    known = (
        _join_ranges(placed, heads, key)
        .withColumn("head", F.greatest(F.max("valid_at").over(past), "__before.top")).withColumn("kind", _kind())
        .withColumn("head_id", F.coalesce(F.last(F.when(_on_chain(), F.col("memory_id")), ignorenulls=True).over(past), "__before.id"))
        .withColumn("next", F.when(_on_chain(), F.last(me, ignorenulls=True).over(future)))
    )
    known = checkpointed(known)
    # The first link of the ranges behind.
    opens = known.groupBy(*key, "__range").agg(F.min_by(me, F.when(_on_chain(), F.struct(*ORDER))).alias("__opens"))
    behind = Window.partitionBy(*key).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    opens = opens.select(*key, "__range", F.last("__opens", ignorenulls=True).over(behind).alias("__later"))
    out = _join_ranges(known, opens, key)
    return out.withColumn("next", F.when(_on_chain(), F.coalesce("next", "__later"))).drop("__before", "__later", "__range")


def semantic_history(rows: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    return key_history(rows, "s", "p", hot_rows=hot_rows)


def supersession_edges(history: DataFrame) -> DataFrame:
    """(from_id, to_id, at) of every Supersedes edge, forward and retroactive."""
    return history.filter(F.col("kind").isin("forward", "retro")).select(
        F.col("memory_id").alias("from_id"), F.col("head_id").alias("to_id"), F.col("committed_at").alias("at"), F.col("valid_at").alias("from_valid_at"), "kind", F.col("log_pos").alias("at_pos")
    )


def following(rows: DataFrame, *key: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``rows`` with ``next``: (committed_at, log_pos, memory_id) of the row that follows within the key."""
    me = F.struct("committed_at", "log_pos", "memory_id")

    def plain(part):
        return part.withColumn("next", F.lead(me).over(Window.partitionBy(*key).orderBy(*ORDER)))

    def in_ranges(part):
        placed = _in_ranges(part, key)
        opens = placed.groupBy(*key, "__range").agg(F.min(me).alias("__opens"))
        opens = opens.select(*key, "__range", F.lead("__opens").over(Window.partitionBy(*key).orderBy("__range")).alias("__later"))
        inside = F.lead(me).over(Window.partitionBy(*key, "__range").orderBy(*ORDER))
        return _join_ranges(placed, opens, key).withColumn("next", F.coalesce(inside, "__later")).drop("__later", "__range")

    return split_hot(rows, key, hot_rows, plain, in_ranges)


def procedural_history(rows: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``rows`` with closed_by and close_committed: the first later row on either key."""
    out = following(rows, "rule_id", hot_rows=hot_rows).withColumnRenamed("next", "by_rule")
    out = following(out, "trigger", "scope", hot_rows=hot_rows).withColumn("next", F.least("by_rule", "next"))
    return out.select(*rows.columns, F.col("next.memory_id").alias("closed_by"), F.col("next.committed_at").alias("close_committed"))


def monotonic_clock(walls: DataFrame, wall: str, n: str) -> DataFrame:
    """Commit clock max(wall, previous + 1) in order of the gapless position ``n``: a running maximum of wall - n.

    Positions are cut into blocks; block maxima are summed up first, so the
    order of a whole log never meets in one task.
    """
    block = F.floor(F.col(n) / 65_536)
    ahead = F.col(wall) - F.col(n)
    tops = walls.groupBy(block.alias("block")).agg(F.max(ahead).alias("top"))
    before = tops.select("block", F.max("top").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = Window.partitionBy("block").orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
    return (
        walls.withColumn("block", block).join(before, "block", "left")
        .withColumn("clock", F.greatest(F.max(ahead).over(inside), "carried") + F.col(n)).drop("block", "carried")
    )
