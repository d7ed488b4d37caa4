"""Edges among records: staleness, episode chains, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed


def stale_parent_edges(inferred: DataFrame, edges: DataFrame) -> DataFrame:
    """(inf_id, parent_id, at): a superseded parent reaches each earlier row that lists it, once for each listing."""
    listed = inferred.select(F.col("memory_id").alias("inf_id"), F.col("log_pos").alias("inf_pos"), F.explode("derived_from").alias("parent_id"))
    hit = listed.join(edges.select(F.col("to_id").alias("parent_id"), "at", "at_pos"), "parent_id")
    return hit.filter("inf_pos < at_pos").select("inf_id", "parent_id", "at")


def born_stale(inferred: DataFrame, edges: DataFrame) -> DataFrame:
    """(inf_id, stale): whether a parent had been superseded before the row was written."""
    first = edges.groupBy(F.col("to_id").alias("parent_id")).agg(F.min("at_pos").alias("first_pos"))
    listed = inferred.select("memory_id", "log_pos", F.explode("derived_from").alias("parent_id"))
    hit = listed.join(first, "parent_id", "left")
    return hit.groupBy(F.col("memory_id").alias("inf_id")).agg(F.coalesce(F.bool_or(F.col("first_pos") < F.col("log_pos")), F.lit(False)).alias("stale"))


def edges_of(edges: DataFrame) -> DataFrame:
    """(direction, of_id, other_id): each edge as its source and as its target sees it."""
    both = F.array(
        F.struct(F.lit("out").alias("direction"), F.col("from_id").alias("of_id"), F.col("to_id").alias("other_id")),
        F.struct(F.lit("in").alias("direction"), F.col("to_id").alias("of_id"), F.col("from_id").alias("other_id")),
    )
    return edges.select(F.inline(both))


def walk(links: DataFrame, start: DataFrame, most: int = 1024) -> DataFrame:
    """(root, id, depth): everything that each start (root, id) reaches over single links (id, to).

    Pointer doubling: jump tables of 1, 2, 4, ... steps are joined to the set
    found so far, so a chain of 1,024 takes ten joins, not 1,024 levels; the
    doubling ends when no jump is left. ``links`` has one row for an id.
    """
    jump = checkpointed(links.select("id", "to"))
    found = checkpointed(start.select("root", "id", F.lit(0).cast("long").alias("depth")))
    step = 1
    while step < most and not jump.isEmpty():
        further = found.join(jump, "id").select("root", F.col("to").alias("id"), (F.col("depth") + step).alias("depth"))
        found = checkpointed(found.unionByName(further))
        step *= 2
        if step < most:
            jump = checkpointed(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")))
    return found.filter(F.col("depth") < most)


def ancestors(parents: DataFrame, start: DataFrame, most: int = 1024) -> DataFrame:
    """(id, depth) of the ``start`` ids and all their ancestors; ``parents`` has id, parent.

    For few starts: the frontier grows level by level, and each level reads
    the links of the ids reached and no others.
    """
    links = parents.filter("parent is not null")
    return start.sparkSession.sql(
        f"""WITH RECURSIVE up(id, depth) AS (
            SELECT id, 0L FROM {{start}} UNION ALL SELECT l.parent, u.depth + 1 FROM up u JOIN {{links}} l ON l.id = u.id WHERE u.depth + 1 < {int(most)})
        SELECT id, min(depth) AS depth FROM up GROUP BY id""",
        start=start.select("id"), links=links.select("id", "parent"),
    )


def suspect_edges(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Edges (from_id, to_id) that don't lead to an earlier log position.

    Every cycle contains such an edge, so an empty result proves the graph
    acyclic in two joins, however deep it is. A self-edge is suspect as well.
    """
    where = lambda end: positions.select(F.col("memory_id").alias(end), F.struct("committed_at", "log_pos").alias(f"{end}_at"))
    placed = edges.join(where("from_id"), "from_id").join(where("to_id"), "to_id", "left")
    return placed.filter(F.col("to_id_at").isNull() | (F.col("to_id_at") >= F.col("from_id_at"))).select("from_id", "to_id")
