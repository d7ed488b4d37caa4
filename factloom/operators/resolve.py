"""Bi-temporal resolution: what was the case at T, as known at Tc.

A row counts if it was committed by Tc, is valid at T, and hasn't ended: its
own end or an edge into it, visible at Tc, ends it at the earliest superseding
valid time. Of the rows of a key that count, the one committed last stands,
ties going to the earliest log position. The temporal test is written ahead of
the ranking window, where filters on the key can still pass it.

``retro_edges="spec"`` lets an edge close its target only if it comes from a
later valid time; ``"reference"`` lets retroactive edges close it as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPEC, REFERENCE = "spec", "reference"


def _known(column, known_at):
    return column if known_at is None else F.when(F.col("close_committed") <= known_at, column)


def authoritative_rows(history: DataFrame, as_of=None, as_committed=None, retro_edges: str = SPEC) -> DataFrame:
    """Rows of a key history that count at (as_of, as_committed), with ``ends_at``."""
    if retro_edges not in (SPEC, REFERENCE):
        raise ValueError(f"retro_edges is spec or reference, not {retro_edges!r}")
    closure = _known(F.col("close_at"), as_committed)
    own = F.when(F.col("kind") == "retro", F.col("head"))
    out = history
    if retro_edges == REFERENCE:
        late = history.filter("kind = 'retro'")
        if as_committed is not None:
            late = late.filter(F.col("committed_at") <= as_committed)
        pulled = late.groupBy(F.col("head_id").alias("memory_id")).agg(F.min("valid_at").alias("pulled_to"))
        out = out.join(pulled, "memory_id", "left")
        closure = F.least(closure, "pulled_to")
    out = out.filter("kind <> 'conflict'").withColumn("ends_at", F.least(own, closure))
    if as_committed is not None:
        out = out.filter(F.col("committed_at") <= as_committed)
    if as_of is not None:
        out = out.filter((F.col("valid_at") <= as_of) & (F.col("ends_at").isNull() | (F.col("ends_at") > as_of)))
    return out.drop("pulled_to")


def latest(rows: DataFrame, *key: str) -> DataFrame:
    """The row of each key that was committed last; ties keep the earliest log position."""
    best = Window.partitionBy(*key).orderBy(F.desc("committed_at"), "log_pos")
    return rows.withColumn("turn", F.row_number().over(best)).filter("turn = 1").drop("turn")


def resolve(history: DataFrame, as_of=None, as_committed=None, retro_edges: str = SPEC, key: tuple[str, ...] = ("s", "p")) -> DataFrame:
    return latest(authoritative_rows(history, as_of, as_committed, retro_edges), *key)


def resolve_procedural(history: DataFrame, as_of=None, as_committed=None) -> DataFrame:
    """The standing row of each rule at (as_of, as_committed).

    A procedural row is valid from its commit, and ends at the commit of the
    first row that supersedes it, if that is known by ``as_committed``.
    """
    out = history if as_committed is None else history.filter(F.col("committed_at") <= as_committed)
    ends = F.col("close_committed")
    closed = ends.isNotNull() if as_committed is None else ends <= as_committed
    if as_of is not None:
        out = out.filter(F.col("committed_at") <= as_of)
        closed = closed & (ends <= as_of)
    return latest(out.filter(~F.coalesce(closed, F.lit(False))), "rule_id")
