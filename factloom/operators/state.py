"""States folded from event logs: symbols, flags, watermark, and what they say about rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def watermark(*tables: DataFrame) -> DataFrame:
    """One row, ``wm``: the last commit over every kind of record."""
    tops = [t.agg(F.max("committed_at").alias("c")) for t in tables]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out.agg(F.max("c").alias("wm"))


def last_event(events: DataFrame, id_column: str, kinds: tuple[str, ...]) -> DataFrame:
    """(id, event): the last of ``kinds`` for each id, by log position."""
    return events.filter(F.col("event").isin(*kinds)).groupBy(id_column).agg(F.max_by("event", "log_pos").alias("event"))


def retired_symbols(symbol_events: DataFrame) -> DataFrame:
    return last_event(symbol_events, "symbol_id", ("retire", "unretire")).filter("event = 'retire'").select("symbol_id")


# The fields of each kind of record that refer to symbols. Objects, triggers, actions and preconditions do so
# only where their value is a symbol.
REFERENCE_FIELDS = {
    "sem": ("s", "p", "source", "o"), "epi": ("event_id", "kind", "location", "source", "participants"),
    "pro": ("rule_id", "scope", "source", "trigger", "action", "precondition"), "inf": ("s", "p", "method", "o", "derived_from"),
}
_MANY = ("participants", "derived_from")


def references(kind: str, **fields: Column) -> Column:
    """The symbols that a record refers to, from its fields: arrays for participants and parents, one symbol for others."""
    unknown = set(fields) - set(REFERENCE_FIELDS[kind])
    if unknown:
        raise ValueError(f"records of kind {kind} have no symbols in {sorted(unknown)}")
    single = F.array(*(c for name, c in fields.items() if name not in _MANY))
    return F.array_compact(F.concat(single, *(c for name, c in fields.items() if name in _MANY)))


def refers_to(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """memory_id of the ``rows`` (with refs) that refer to any of ``symbols``."""
    named = rows.select("memory_id", F.explode("refs").alias("ref"))
    return named.join(symbols.select(F.col(symbols.columns[0]).alias("ref")), "ref", "left_semi").select("memory_id").distinct()


def record_states(flag_events: DataFrame, retired: DataFrame) -> DataFrame:
    """memory_id, pinned, authoritative and retired of each memory that has any of them: one table for one join."""
    last = lambda *kinds: F.max_by("event", F.when(F.col("event").isin(*kinds), F.col("log_pos")))
    flags = flag_events.groupBy("memory_id").agg(
        F.coalesce(last("pin", "unpin") == "pin", F.lit(False)).alias("pinned"),
        F.coalesce(last("authoritative_set", "authoritative_clear") == "authoritative_set", F.lit(False)).alias("authoritative"), F.lit(False).alias("retired"),
    )
    gone = retired.select("memory_id", F.lit(False).alias("pinned"), F.lit(False).alias("authoritative"), F.lit(True).alias("retired"))
    return flags.unionByName(gone).groupBy("memory_id").agg(*(F.bool_or(c).alias(c) for c in ("pinned", "authoritative", "retired")))


def pinned(flag_events: DataFrame) -> DataFrame:
    return last_event(flag_events, "memory_id", ("pin", "unpin")).filter("event = 'pin'").select("memory_id")


def authoritative(flag_events: DataFrame) -> DataFrame:
    return last_event(flag_events, "memory_id", ("authoritative_set", "authoritative_clear")).filter("event = 'authoritative_set'").select("memory_id")


def symbol_table(symbol_events: DataFrame) -> DataFrame:
    """symbol_id, canonical_name (last rename, else the allocation), aliases, retired."""
    name = F.when(F.col("event").isin("alloc", "rename"), F.struct("log_pos", "name"))
    # A renamed symbol's earlier names stay known as aliases.
    out = symbol_events.groupBy("symbol_id").agg(
        F.max(name).alias("last"),
        F.max_by("event", F.when(F.col("event").isin("retire", "unretire"), F.col("log_pos"))).alias("life"),
        F.collect_set(F.when(F.col("event").isin("alloc", "rename", "alias"), F.col("name"))).alias("names"),
    )
    canonical = F.col("last.name")
    return out.select(
        "symbol_id", canonical.alias("canonical_name"), F.sort_array(F.array_except("names", F.array(canonical))).alias("aliases"),
        F.coalesce(F.col("life") == "retire", F.lit(False)).alias("retired"),
    )


def resolve_names(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, symbol_id) for names that are canonical or an alias; unknown names give no row."""
    names = symbols.select("symbol_id", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("name"))
    return wanted.join(names, "name")


def mark(rows: DataFrame, ids: DataFrame, on: str, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: whether ``on`` is among ``ids``."""
    ids = ids.select(F.col(ids.columns[0]).alias(on), F.lit(True).alias(flag)).distinct()
    return rows.join(ids, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def framing(as_of: int | None = None, wm: Column | None = None) -> Column:
    """Class of a row with columns projected, pinned, authoritative."""
    past = F.lit(False) if as_of is None else F.lit(as_of) < wm
    return (
        F.when(F.col("projected"), "projected").when(F.col("pinned"), "authoritative_agent_pinned")
        .when(F.col("authoritative"), "authoritative_operator").when(past, "historical").otherwise("advisory")
    )


# Bits of the read flags.
STALE_SYMBOL, LOW_CONFIDENCE, PROJECTED_PRESENT, TRUNCATED, EXPLAIN_ACTIVE = 1, 4, 8, 16, 128
FLAG_NAMES = {STALE_SYMBOL: "stale_symbol", LOW_CONFIDENCE: "low_confidence", PROJECTED_PRESENT: "projected_present", TRUNCATED: "truncated", EXPLAIN_ACTIVE: "explain_filtered_active"}


def read_flags(kept: DataFrame, threshold: int, limit: int | None = None, explain: bool = False) -> DataFrame:
    """One row, ``flags`` and ``rows``, over all kept rows: flags are taken ahead of the limit."""

    def bit(column, value):
        return F.when(F.coalesce(F.bool_or(column), F.lit(False)), value).otherwise(0)

    n = F.count(F.lit(1))
    total = bit("retired", STALE_SYMBOL) + bit("projected", PROJECTED_PRESENT) + bit(F.col("effective") < threshold, LOW_CONFIDENCE)
    if limit is not None:
        total = total + F.when(n > limit, TRUNCATED).otherwise(0)
    return kept.agg((total + F.lit(EXPLAIN_ACTIVE if explain else 0)).cast("int").alias("flags"), n.alias("rows"))


def flag_names(flags: Column) -> Column:
    return F.array_compact(F.array(*(F.when(flags.bitwiseAND(F.lit(b)) != 0, name) for b, name in FLAG_NAMES.items())))


# Clamps of pages.
LIST_MOST, VIEW_MOST, VIEW_DEFAULT = 1000, 64, 32


def memory_list(tables: dict[str, DataFrame], kind: str | None = None, limit: int = LIST_MOST) -> DataFrame:
    """A page of memories of one kind or of all, first committed first; its size is clamped to 1 to 1,000."""
    parts = [t.select(F.lit(k).alias("kind"), "memory_id", "committed_at") for k, t in tables.items() if kind in (None, k)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("committed_at", "kind", "memory_id").limit(max(1, min(limit, LIST_MOST)))


def context_view(records: DataFrame, limit: int = VIEW_DEFAULT) -> DataFrame:
    """The latest of the records of a read, its size clamped to 1 to 64."""
    return records.orderBy(F.desc("committed_at"), F.desc("memory_id")).limit(max(1, min(limit, VIEW_MOST)))


def exactly_one(records: DataFrame) -> DataFrame:
    """The one record of a read; none gives no row, and more than one is an error when the rows are asked for."""
    two = records.limit(2)
    n = two.agg(F.count("*")).scalar()
    return two.filter(F.when(n > 1, F.raise_error(F.lit("more than one record matches"))).otherwise(F.lit(True)))
