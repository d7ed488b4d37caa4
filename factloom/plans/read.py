"""Reads: a typed specification, checked on the driver, planned as one DataFrame.

Stages: resolve by key at (as_of, as_committed), prune by episode, sort, drop
retired and projected rows, flag, limit, frame. Nothing runs until the caller
asks for rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decay
from ..operators import graph, resolve, state, supersession

KINDS = ("sem", "pro", "inf", "epi")
DEFAULT_LIMIT = 1000


class ReadError(ValueError):
    """A read that cannot be planned."""


@dataclass(frozen=True)
class ReadSpec:
    kind: str | None = None
    s: str | int | None = None
    p: str | None = None
    o: float | str | None = None
    as_of: int | None = None
    as_committed: int | None = None
    in_episode: int | None = None
    after_episode: int | None = None
    before_episode: int | None = None
    episode_chain: int | None = None
    include_retired: bool = False
    include_projected: bool = False
    explain_filtered: bool = False
    show_framing: bool = False
    debug_mode: bool = False
    confidence_threshold: float = 0.5
    limit: int | None = DEFAULT_LIMIT  # None: all rows
    retro_edges: str = resolve.SPEC
    half_life_days: tuple[tuple[tuple[str, str], int], ...] = ()  # overrides by (kind, source); 0 for no decay

    def checked(self) -> ReadSpec:
        if self.kind is not None and self.kind not in KINDS:
            raise ReadError(f"unknown kind {self.kind!r}")
        if self.kind in ("pro", "epi") and (self.s is not None or self.p is not None):
            raise ReadError(f"kind {self.kind} has no subject or predicate")
        if sum(x is not None for x in (self.in_episode, self.after_episode, self.before_episode, self.episode_chain)) > 1:
            raise ReadError("at most one episode predicate")
        if not 0 <= self.confidence_threshold <= 1:
            raise ReadError("confidence_threshold is not within 0 to 1")
        if self.limit is not None and self.limit < 0:
            raise ReadError("limit is negative")
        both = {"explain_filtered": True, "show_framing": True} if self.debug_mode else {}
        return replace(self, **both)

    @property
    def threshold_units(self) -> int:
        return round(self.confidence_threshold * decay.FULL)  # Python rounds ties to even


@dataclass
class Store:
    """The record tables of one workspace."""

    sem: DataFrame
    inf: DataFrame
    pro: DataFrame
    episodes: DataFrame
    symbol_events: DataFrame
    flag_events: DataFrame
    extra: dict = field(default_factory=dict)


@dataclass
class ReadResult:
    records: DataFrame
    filtered: DataFrame
    flags: DataFrame
    clocks: DataFrame


_COLUMNS = ("kind", "kind_rank", "memory_id", "s", "p", "o", "source", "confidence", "valid_at", "committed_at", "log_pos", "projected", "refs")


def _shape(rows: DataFrame, kind: str, rank: int) -> DataFrame:
    given = set(rows.columns)
    absent = {"s": "long", "p": "string", "o": "double", "source": "string", "confidence": "long", "projected": "boolean", "valid_at": "long"}
    fixed = {"kind": F.lit(kind), "kind_rank": F.lit(rank)}

    def column(c):
        if c in fixed:
            return fixed[c].alias(c)
        if c == "projected":
            return (F.col(c) if c in given else F.lit(False)).alias(c)
        if c == "refs":
            return (F.col(c) if c in given else F.array().cast("array<string>")).alias(c)
        if kind == "pro" and c == "valid_at":
            return F.col("committed_at").alias(c)
        if kind == "pro" and c == "o":
            return F.col("action").cast("double").alias(c)
        return (F.col(c) if c in given else F.lit(None).cast(absent[c])).alias(c)

    return rows.select(*(column(c) for c in _COLUMNS))


def _keyed(rows: DataFrame, spec: ReadSpec, names: DataFrame) -> DataFrame:
    """Filters on subject and predicate; they pass below the ranking window, whose key they are."""
    if isinstance(spec.s, str):
        known = names.filter((F.col("canonical_name") == spec.s) | F.array_contains("aliases", spec.s)).select(F.col("symbol_id").alias("s_ref"))
        rows = rows.join(known, "s_ref", "left_semi")
    elif spec.s is not None:
        rows = rows.filter(F.col("s") == spec.s)
    return rows if spec.p is None else rows.filter(F.col("p") == spec.p)


def _episode(rows: DataFrame, spec: ReadSpec, episodes: DataFrame) -> DataFrame:
    def at_of(ids):
        return episodes.filter(F.col("episode_id") == ids).select("at")

    if spec.in_episode is not None:
        return rows.join(at_of(spec.in_episode), F.col("committed_at") == F.col("at"), "left_semi")
    if spec.after_episode is not None:  # an unknown episode makes the comparison null: no row
        return rows.filter(F.col("committed_at") > at_of(spec.after_episode).agg(F.max("at")).scalar())
    if spec.before_episode is not None:
        return rows.filter(F.col("committed_at") < at_of(spec.before_episode).agg(F.max("at")).scalar())
    if spec.episode_chain is not None:
        start = episodes.filter(F.col("episode_id") == spec.episode_chain).select(F.col("episode_id").alias("id"))
        chain = graph.ancestors(episodes.select(F.col("episode_id").alias("id"), "parent"), start)
        at = episodes.join(chain.select(F.col("id").alias("episode_id")), "episode_id", "left_semi").select("at")
        return rows.join(at, F.col("committed_at") == F.col("at"), "left_semi")
    return rows


def candidates(store: Store, spec: ReadSpec) -> DataFrame:
    """The standing rows of every kind that the specification asks for."""
    names = state.symbol_table(store.symbol_events)
    now = state.watermark(store.sem, store.inf, store.pro)
    as_of = F.lit(spec.as_of) if spec.as_of is not None else now.scalar()
    histories = [("sem", 0, store.sem), ("inf", 2, store.inf)]
    parts = []
    for kind, rank, rows in histories:
        if spec.kind in (None, kind):
            history = supersession.semantic_history(_keyed(rows, spec, names))
            parts.append(_shape(resolve.resolve(history, as_of, spec.as_committed, spec.retro_edges), kind, rank))
    if spec.kind in (None, "pro") and spec.s is None and spec.p is None:
        parts.append(_shape(resolve.resolve_procedural(supersession.procedural_history(store.pro), as_of, spec.as_committed), "pro", 1))
    if spec.kind == "epi" or not parts:
        return _shape(store.sem.limit(0), "epi", 4)
    out = _union(parts)
    if spec.include_projected:
        # Projected rows bypass the resolver; those that stand anyway aren't repeated.
        more = [_shape(_keyed(rows.filter("projected"), spec, names), kind, 3) for kind, _, rows in histories if spec.kind in (None, kind)]
        if more:
            out = out.unionByName(_union(more).join(out.select("memory_id"), "memory_id", "left_anti").select(*_COLUMNS))
    if spec.o is not None:
        out = out.filter(F.col("o").eqNullSafe(F.lit(spec.o)))
    return _episode(out, spec, store.episodes)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def in_order(records: DataFrame) -> DataFrame:
    """Records in result order: by commit, then kind, then log position."""
    return records.orderBy("committed_at", "kind_rank", "log_pos")


def execute(store: Store, spec: ReadSpec) -> ReadResult:
    """A read. With a limit its records are the first in result order; a whole result is left unsorted, see ``in_order``."""
    spec = spec.checked()
    wm = state.watermark(store.sem, store.inf, store.pro)
    rows = candidates(store, spec)
    known = state.record_states(store.flag_events, state.refers_to(rows, state.retired_symbols(store.symbol_events)))
    rows = rows.join(known, "memory_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("pinned", "authoritative", "retired")})
    now = wm.scalar()
    life = F.when(F.col("kind") == "sem", decay.half_life_ms("sem", F.col("source"), spec.half_life_days)).otherwise(F.lit(0))
    factor = decay.decay_factor(F.greatest(F.lit(0), now - F.col("valid_at")), life)
    # Procedural rows don't decay; inferential ones keep what they were stored with.
    exempt = F.col("pinned") | F.col("authoritative") | (F.col("kind") != "sem")
    rows = rows.withColumn("effective", decay.effective_confidence(F.coalesce("confidence", F.lit(decay.FULL)), factor, exempt))
    # A row has one reason: the retired test comes first.
    reason = F.lit(None).cast("string")
    if not spec.include_projected:
        reason = F.when(F.col("projected"), "projected").otherwise(reason)
    if not spec.include_retired:
        reason = F.when(F.col("retired"), "retired_symbol").otherwise(reason)
    rows = rows.withColumn("filter_reason", reason)
    kept = rows.filter("filter_reason is null")
    flags = state.read_flags(kept, spec.threshold_units, spec.limit, spec.explain_filtered)
    out = kept.withColumn("framing", state.framing(spec.as_of, now)) if spec.show_framing else kept
    clocks = wm.select(
        F.coalesce(F.lit(spec.as_of).cast("long"), "wm", F.lit(0)).alias("as_of"), F.coalesce(F.lit(spec.as_committed).cast("long"), "wm", F.lit(0)).alias("as_committed"),
        F.coalesce("wm", F.lit(0)).alias("query_committed_at"),
    )
    filtered = rows.filter("filter_reason is not null")
    out = out if spec.limit is None else in_order(out).limit(spec.limit)
    return ReadResult(out, filtered if spec.explain_filtered else filtered.limit(0), flags, clocks)
