"""Reads over the current state: predicates, episodes, flags, framing, decay."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import decay
from ..operators import graph, sequence, state, supersession
from ..plans.lisp import read_spec
from ..plans.read import ReadSpec, Store, execute
from ..registry import query
from .temporal import CURRENT_ROWS, PRO, TC, T, current


def store(spark, sf) -> Store:
    return Store(fx.sem(spark, sf), fx.inf(spark, sf), fx.pro(spark, sf), fx.episodes(spark, sf), fx.symbol_events(spark, sf), fx.flag_events(spark, sf))


_COLUMNS = ("kind", "memory_id", "s", "p", "o", "valid_at", "committed_at")
_LIST = "kind, memory_id, s, p, o, valid_at, committed_at"
_SELECT = f"SELECT {_LIST} FROM c"
_NOT_RETIRED = "NOT retired AND NOT projected"
_ALL = None
_WM = "(SELECT wm FROM watermark)"
#: A point in valid and commit time at which all kinds have rows.
_T2, _TC2 = 1_710_000_000_900, 1_710_000_001_200

_PAIRS = "SELECT '{kind}' AS kind, {rank} AS kind_rank, memory_id, s, p, o, {source} AS source, confidence, valid_at, committed_at, log_pos, projected, refs FROM ({rows}) {after}"
_LATEST = "QUALIFY row_number() OVER (PARTITION BY s, p ORDER BY committed_at DESC, log_pos) = 1"
_RULES = """SELECT 'pro' AS kind, 1 AS kind_rank, memory_id, NULL AS s, NULL AS p, action AS o, source, confidence, committed_at AS valid_at, committed_at, log_pos, false AS projected, refs
    FROM pro_state WHERE committed_at <= {tc} AND committed_at <= {t} AND NOT coalesce(next.c <= {tc} AND next.c <= {t}, false)
    QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY committed_at DESC, log_pos) = 1"""


def _rows(kind=None, t=_WM, tc=_WM, rules=True, projected=False) -> str:
    """SQL of the candidates of a read: standing rows at (t, tc) of each kind, and projected ones whatever their time."""
    tables = [("sem", 0, "source", "sem_state", "sem"), ("inf", 2, "NULL", "inf_state", "inf")]
    parts = []
    for name, rank, source, state_table, _ in tables:
        if kind in (None, name):
            ends = f"least(CASE WHEN x.kind = 'retro' THEN x.head END, CASE WHEN x.close_committed <= {tc} THEN x.close_at END)"
            where = f"SELECT x.* FROM {state_table} x WHERE x.kind <> 'conflict' AND x.committed_at <= {tc} AND x.valid_at <= {t} AND coalesce({ends} > {t}, true)"
            parts.append(_PAIRS.format(kind=name, rank=rank, source=source, rows=where, after=_LATEST))
    if kind in (None, "pro") and rules:
        parts.append(_RULES.format(t=t, tc=tc))
    standing = " UNION ALL ".join(parts)
    if projected:
        more = [_PAIRS.format(kind=n, rank=3, source=source, rows=f"SELECT * FROM {table} WHERE projected", after="") for n, _, source, _, table in tables if kind in (None, n)]
        standing = f"SELECT * FROM ({standing}) UNION ALL SELECT * FROM ({' UNION ALL '.join(more)}) WHERE memory_id NOT IN (SELECT memory_id FROM ({standing}))"
    return f"SELECT *, coalesce(list_has_any(refs, (SELECT list(symbol_id) FROM retired)), false) AS retired FROM ({standing})"


def _read_sql(body: str, *tables: str, c: str | None = None, **more: str) -> str:
    return fx.with_tables(body, "sem_state", "inf_state", "pro", "watermark", "retired", *tables, pro_state=PRO, c=c or _rows(), **more)


def _read(name: str, spec: ReadSpec, where: str, *tables: str, c: str | None = None) -> None:
    query(name, _read_sql(f"{_SELECT} WHERE {where}", *tables, c=c))(lambda spark, sf: execute(store(spark, sf), spec).records.select(*_COLUMNS))


_EP = 'committed_at {} (SELECT "at" FROM episodes WHERE episode_id = {})'
_KEYED = _rows(rules=False)
_read("filter_subject", ReadSpec(s="user_12", limit=_ALL), f"s = 12 AND {_NOT_RETIRED}", c=_KEYED)
_read("filter_predicate", replace(read_spec("(query :kind sem :p @click)"), limit=_ALL), f"p = 'click' AND {_NOT_RETIRED}", c=_rows("sem"))
_read("filter_both", ReadSpec(s=12, p="click", limit=_ALL, include_retired=True), "s = 12 AND p = 'click' AND NOT projected", c=_KEYED)
_read("filter_alias", ReadSpec(s="alias_25", limit=_ALL), f"s = 25 AND {_NOT_RETIRED}", c=_KEYED)
_read("unknown_symbol_empty", ReadSpec(s="nobody", limit=_ALL), "false")
_read("kind_epi_empty", ReadSpec(kind="epi", limit=_ALL), "false")
_read("kind_inf", ReadSpec(kind="inf", limit=_ALL), _NOT_RETIRED, c=_rows("inf"))
_read("kind_pro", ReadSpec(kind="pro", limit=_ALL), _NOT_RETIRED, c=_rows("pro"))
_read("inf_projected", ReadSpec(kind="inf", include_projected=True, include_retired=True, limit=_ALL), "true", c=_rows("inf", projected=True))
_read("inf_as_of", ReadSpec(kind="inf", as_of=T, as_committed=TC, include_retired=True, limit=_ALL), "NOT projected", c=_rows("inf", str(T), str(TC)))
_read("pro_as_of", ReadSpec(kind="pro", as_of=_T2, include_retired=True, limit=_ALL), "true", c=_rows("pro", str(_T2)))
_read("pro_bitemporal", ReadSpec(kind="pro", as_of=_TC2, as_committed=_T2, limit=_ALL), _NOT_RETIRED, c=_rows("pro", str(_TC2), str(_T2)))
_read("mixed_read", ReadSpec(as_of=_T2, as_committed=_TC2, limit=_ALL), _NOT_RETIRED, c=_rows(None, str(_T2), str(_TC2)))
_read("in_episode", ReadSpec(in_episode=970, include_retired=True, include_projected=True, limit=_ALL), _EP.format("=", 970), "episodes", c=_rows(projected=True))
_read("after_episode", ReadSpec(after_episode=500, limit=_ALL), f"{_EP.format('>', 500)} AND {_NOT_RETIRED}", "episodes")
_LAST = "(SELECT max(episode_id) FROM episodes)"
_read("unknown_episode_empty", ReadSpec(after_episode=-7, limit=_ALL), "false")
_read("retired_filtered", ReadSpec(limit=_ALL), _NOT_RETIRED)
_read("retired_included", ReadSpec(include_retired=True, limit=_ALL), "NOT projected")


@query("filter_object", _read_sql("SELECT kind, memory_id, s, p, committed_at FROM c WHERE o = 4", c=_rows("sem", projected=True).replace("p, o, source", "p, round(o) AS o, source")))
def filter_object(spark, sf):
    """Rows by object; objects are whole numbers here, so that some are equal."""
    own = store(spark, sf)
    own.sem = own.sem.withColumn("o", F.round("o"))
    spec = ReadSpec(kind="sem", o=4.0, include_retired=True, include_projected=True, limit=_ALL)
    return execute(own, spec).records.select("kind", "memory_id", "s", "p", "committed_at")


@query(
    "before_episode",
    _read_sql(f'{_SELECT} WHERE committed_at < (SELECT "at" FROM episodes WHERE episode_id = {_LAST}) AND {_NOT_RETIRED}', "episodes"),
)
def before_episode(spark, sf):
    """What was committed before the latest episode by id."""
    last = fx.table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    return execute(store(spark, sf), ReadSpec(before_episode=last, limit=_ALL)).records.select(*_COLUMNS)


_CHAIN = f"SELECT episode_id, parent FROM episodes WHERE episode_id = {_LAST} UNION ALL SELECT e.episode_id, e.parent FROM episodes e JOIN chain c ON e.episode_id = c.parent"


@query(
    "episode_chain",
    _read_sql(
        f'{_SELECT} WHERE committed_at IN (SELECT e."at" FROM episodes e JOIN chain USING (episode_id))',
        "episodes", c=_rows(projected=True), chain=_CHAIN,
    ),
)
def episode_chain(spark, sf):
    """What the latest episode and its ancestors committed."""
    last = fx.table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    return execute(store(spark, sf), ReadSpec(episode_chain=last, include_retired=True, include_projected=True, limit=_ALL)).records.select(*_COLUMNS)


_REASON = "CASE WHEN retired THEN 'retired_symbol' WHEN projected THEN 'projected' END"


@query("explain_filtered", _read_sql(f"SELECT kind, memory_id, {_REASON} AS filter_reason FROM c WHERE retired OR projected"))
def explain_filtered(spark, sf):
    return execute(store(spark, sf), ReadSpec(explain_filtered=True)).filtered.select("kind", "memory_id", "filter_reason")


@query("retired_by_kind", _read_sql(f"SELECT kind, {_REASON} AS filter_reason, count(*) AS n FROM c WHERE retired OR projected GROUP BY ALL"))
def retired_by_kind(spark, sf):
    """Why rows of each kind are left out: their subject, predicate, source, method, rule, scope or a parent is retired."""
    return execute(store(spark, sf), ReadSpec(explain_filtered=True)).filtered.groupBy("kind", "filter_reason").agg(F.count("*").alias("n"))


_read("projected_included", ReadSpec(include_projected=True, limit=_ALL), "NOT retired", c=_rows(projected=True))


_FRAMES = """CASE WHEN projected THEN 'projected' WHEN memory_id IN (SELECT memory_id FROM pinned) THEN 'authoritative_agent_pinned'
    WHEN memory_id IN (SELECT memory_id FROM authoritative) THEN 'authoritative_operator' ELSE '{rest}' END"""


@query("framing", _read_sql(f"{_SELECT.replace(' FROM c', '')}, {_FRAMES.format(rest='advisory')} AS framing FROM c WHERE NOT retired", "pinned", "authoritative", c=_rows(projected=True)))
def framing(spark, sf):
    """The flagship: the current state of all kinds, projected rows included, with the class of each row."""
    return execute(store(spark, sf), ReadSpec(include_projected=True, show_framing=True, limit=_ALL)).records.select(*_COLUMNS, "framing")


_LIVES = " ".join(f"WHEN source = '{s}' THEN {(d or 0) * decay.DAY_MS}" for (k, s), d in decay.HALF_LIFE_DAYS.items() if k == "sem")
_ELAPSED = "greatest(0, (SELECT max(committed_at) FROM sem) - valid_at)"
_FACTOR = "CASE WHEN hl = 0 THEN 65535 WHEN (el*256//hl) >> 8 >= 16 THEN 0 ELSE (SELECT v FROM halves WHERE i = (el*256//hl) & 255) >> ((el*256//hl) >> 8) END"
_HALVES = "SELECT i, CAST(round(pow(2.0, -i/256.0)*65535) AS BIGINT) AS v FROM range(256) t(i)"
_DECAYED = f"SELECT *, CASE WHEN hl = 0 THEN 65535 WHEN (el*256//hl)//256 >= 16 THEN 0 ELSE h.v >> CAST((el*256//hl)//256 AS INT) END AS factor FROM (SELECT *, {_ELAPSED} AS el, CASE {_LIVES} END AS hl FROM {{src}}) x LEFT JOIN halves h ON h.i = CASE WHEN hl = 0 THEN 0 ELSE (el*256//hl) % 256 END"


def _decayed(rows, wm):
    life = decay.half_life_ms("sem", F.col("source"))
    return rows.withColumn("factor", decay.decay_factor(F.greatest(F.lit(0), wm - F.col("valid_at")), life))


@query(
    "decay_factor",
    fx.with_tables("SELECT memory_id, source, el AS elapsed, CAST(factor AS BIGINT) AS factor FROM d", "sem", halves=_HALVES, d=_DECAYED.format(src="sem")),
)
def decay_factor(spark, sf):
    sem = fx.sem(spark, sf)
    wm = sem.agg(F.max("committed_at")).scalar()
    return _decayed(sem, wm).select("memory_id", "source", F.greatest(F.lit(0), wm - F.col("valid_at")).alias("elapsed"), "factor")


@query(
    "effective_confidence",
    fx.with_tables(
        "SELECT memory_id, confidence, CAST(CASE WHEN memory_id IN (SELECT memory_id FROM pinned UNION ALL SELECT memory_id FROM authoritative) THEN confidence ELSE (confidence*factor+32767)//65535 END AS BIGINT) AS effective FROM d",
        "sem", "pinned", "authoritative", halves=_HALVES, d=_DECAYED.format(src="sem"),
    ),
)
def effective_confidence(spark, sf):
    sem, flags = fx.sem(spark, sf), fx.flag_events(spark, sf)
    rows = state.mark(_decayed(sem, sem.agg(F.max("committed_at")).scalar()), state.pinned(flags).unionByName(state.authoritative(flags)), "memory_id", "exempt")
    return rows.select("memory_id", "confidence", decay.effective_confidence(F.col("confidence"), F.col("factor"), F.col("exempt")).alias("effective"))


@query(
    "half_life_dim",
    "SELECT kind, source, CAST(half_life_ms AS BIGINT) AS half_life_ms FROM (VALUES " + ", ".join(f"('{k}', '{s}', {(d or 0) * decay.DAY_MS})" for (k, s), d in decay.HALF_LIFE_DAYS.items()) + ") t(kind, source, half_life_ms)",
)
def half_life_dim(spark, sf):
    return decay.half_lives(spark)


@query("decay_table", f"SELECT CAST(i AS BIGINT) AS i, v FROM ({_HALVES})")
def decay_table(spark, sf):
    return spark.range(256).select(F.col("id").alias("i"), decay.decay_factor(F.col("id"), F.lit(256)).alias("v"))


_READ_DECAYED = f"SELECT *, CASE WHEN hl = 0 THEN 65535 WHEN (el*256//hl)//256 >= 16 THEN 0 ELSE h.v >> CAST((el*256//hl)//256 AS INT) END AS factor FROM (SELECT *, greatest(0, {_WM} - valid_at) AS el, CASE WHEN kind = 'sem' THEN CASE {_LIVES} END ELSE 0 END AS hl FROM c) x LEFT JOIN halves h ON h.i = CASE WHEN hl = 0 THEN 0 ELSE (el*256//hl) % 256 END"


def _flags_sql(rows: str, limit: str, explain: int) -> str:
    return f"""SELECT CAST(CASE WHEN coalesce(bool_or(retired), false) THEN 1 ELSE 0 END
        + CASE WHEN coalesce(bool_or(CASE WHEN memory_id IN (SELECT memory_id FROM pinned UNION ALL SELECT memory_id FROM authoritative) THEN confidence ELSE (confidence*factor+32767)//65535 END < 32768), false) THEN 4 ELSE 0 END
        + CASE WHEN coalesce(bool_or(projected), false) THEN 8 ELSE 0 END + {limit} + {explain} AS INT) AS flags, count(*) AS rows FROM d WHERE {rows}"""


def _register_flags(name, spec, rows, limit, explain=0, c=None):
    sql = _read_sql(_flags_sql(rows, limit, explain), "pinned", "authoritative", c=c, halves=_HALVES, d=_READ_DECAYED)
    query(name, sql)(lambda spark, sf: execute(store(spark, sf), spec).flags)


_register_flags("read_flags", ReadSpec(include_retired=True, include_projected=False, explain_filtered=True, limit=_ALL), "NOT projected", "0", 128)
_register_flags("limit_truncated", ReadSpec(limit=25), _NOT_RETIRED, "CASE WHEN count(*) > 25 THEN 16 ELSE 0 END")
_register_flags("low_confidence_flag", ReadSpec(s=12, limit=_ALL), f"s = 12 AND {_NOT_RETIRED}", "0", c=_KEYED)
_register_flags("pro_flags", ReadSpec(kind="pro", include_retired=True, limit=_ALL), "true", "0", c=_rows("pro"))


@query(
    "flag_names",
    _read_sql("SELECT s, list_filter([CASE WHEN bool_or(retired) THEN 'stale_symbol' END, CASE WHEN bool_or(projected) THEN 'projected_present' END], lambda x: x IS NOT NULL)::VARCHAR AS names FROM c GROUP BY s", c=_rows("sem", projected=True)),
)
def names_of_flags(spark, sf):
    rows = execute(store(spark, sf), ReadSpec(kind="sem", include_retired=True, include_projected=True, limit=_ALL)).records
    bits = rows.groupBy("s").agg((F.when(F.bool_or("retired"), state.STALE_SYMBOL).otherwise(0) + F.when(F.bool_or("projected"), state.PROJECTED_PRESENT).otherwise(0)).alias("flags"))
    return bits.select("s", F.concat(F.lit("["), F.array_join(state.flag_names(F.col("flags")), ", "), F.lit("]")).alias("names"))


@query("limited_read", _read_sql(f"{_SELECT} WHERE {_NOT_RETIRED} ORDER BY committed_at, kind_rank, log_pos LIMIT 25"))
def limited_read(spark, sf):
    """A limit is the feature here: the first rows in result order."""
    return execute(store(spark, sf), ReadSpec(limit=25)).records.select(*_COLUMNS)


@query("historical_framing", _read_sql(f"SELECT memory_id, {_FRAMES.format(rest='historical')} AS framing FROM c WHERE {_NOT_RETIRED}", "pinned", "authoritative", c=_rows(t=str(_T2))))
def historical_framing(spark, sf):
    return execute(store(spark, sf), ReadSpec(as_of=_T2, show_framing=True, limit=_ALL)).records.select("memory_id", "framing")


@query("effective_clocks", fx.with_tables(f"SELECT CAST({T} AS BIGINT) AS as_of, {_WM} AS as_committed, {_WM} AS query_committed_at", "watermark"))
def effective_clocks(spark, sf):
    return execute(store(spark, sf), ReadSpec(as_of=T)).clocks


_LISTED = " UNION ALL ".join(f"SELECT '{k}' AS kind, memory_id, committed_at FROM {k}" for k in ("sem", "inf", "pro", "epi"))


@query("memory_list", fx.with_tables(f"SELECT * FROM ({_LISTED}) ORDER BY committed_at, kind, memory_id LIMIT 1000", "sem", "inf", "pro", "epi"))
def memory_list(spark, sf):
    """A page of at most 1,000 memories of all kinds is the feature."""
    return state.memory_list({k: getattr(fx, k)(spark, sf) for k in ("sem", "inf", "pro", "epi")}, limit=5000)


@query("memory_list_inf", fx.with_tables("SELECT 'inf' AS kind, memory_id, committed_at FROM inf ORDER BY committed_at, memory_id LIMIT 100", "inf"))
def memory_list_inf(spark, sf):
    return state.memory_list({k: getattr(fx, k)(spark, sf) for k in ("sem", "inf")}, "inf", 100)


@query(
    "memory_show",
    fx.with_tables("SELECT memory_id, s, p, o FROM sem WHERE memory_id = 321 OR '__mem_' || memory_id = '@__mem_321'", "sem"),
)
def memory_show(spark, sf):
    wanted = F.lit("@__mem_321")
    name = F.concat(F.lit("__mem_"), F.col("memory_id").cast("string"))
    return fx.sem(spark, sf).filter((name == F.ltrim(wanted, F.lit("@"))) | (F.col("memory_id").cast("string") == F.regexp_replace(wanted, "^@?(__mem_)?", ""))).select("memory_id", "s", "p", "o")


@query(
    "memory_explain",
    fx.with_tables(
        "SELECT 'out' AS direction, memory_id AS of_id, head_id AS other_id FROM sem_state WHERE kind IN ('forward', 'retro') UNION ALL SELECT 'in', head_id, memory_id FROM sem_state WHERE kind IN ('forward', 'retro')",
        "sem_state",
    ),
)
def memory_explain(spark, sf):
    """Edges in both directions of every memory."""
    return graph.edges_of(supersession.supersession_edges(supersession.semantic_history(fx.sem(spark, sf))))


@query(
    "episode_page",
    fx.with_tables('SELECT e.episode_id, e."at", e.label, q.label AS parent_label FROM episodes e LEFT JOIN episodes q ON q.episode_id = e.parent ORDER BY e."at", e.episode_id LIMIT 50 OFFSET 100', "episodes"),
)
def episode_page(spark, sf):
    """A page of episodes is the feature: offset and limit in commit order."""
    e = fx.episodes(spark, sf)
    parent = e.select(F.col("episode_id").alias("parent"), F.col("label").alias("parent_label"))
    page = e.orderBy("at", "episode_id").offset(100).limit(50)
    return page.join(parent, "parent", "left").select("episode_id", "at", "label", "parent_label")


@query("episode_members", fx.with_tables('SELECT e.episode_id, count(s.memory_id) AS members FROM episodes e LEFT JOIN sem s ON s.committed_at = e."at" GROUP BY e.episode_id', "sem", "episodes"))
def episode_members(spark, sf):
    n = fx.sem(spark, sf).groupBy(F.col("committed_at").alias("at")).agg(F.count("*").alias("members"))
    return fx.episodes(spark, sf).join(n, "at", "left").select("episode_id", F.coalesce("members", F.lit(0)).alias("members"))


@query("retraction_labels", fx.with_tables("SELECT e.episode_id, e.x AS retracted, r.label AS retracted_label FROM (SELECT episode_id, unnest(retracts) AS x FROM episodes) e LEFT JOIN episodes r ON r.episode_id = e.x", "episodes"))
def retraction_labels(spark, sf):
    """Retraction is a label: it is reported and ends nothing."""
    e = fx.episodes(spark, sf)
    named = e.select(F.col("episode_id").alias("retracted"), F.col("label").alias("retracted_label"))
    return e.select("episode_id", F.explode("retracts").alias("retracted")).join(named, "retracted", "left").select("episode_id", "retracted", "retracted_label")


@query(
    "symbol_table_fold",
    fx.with_tables(
        "SELECT symbol_id, arg_max(name, CASE WHEN event IN ('alloc', 'rename') THEN log_pos END) AS canonical_name, coalesce(arg_max(event, CASE WHEN event IN ('retire', 'unretire') THEN log_pos END) = 'retire', false) AS retired FROM symbol_events GROUP BY symbol_id",
        "symbol_events",
    ),
)
def symbol_table_fold(spark, sf):
    return state.symbol_table(fx.symbol_events(spark, sf)).select("symbol_id", "canonical_name", "retired")


@query(
    "alias_lookup",
    fx.with_tables("SELECT DISTINCT name, symbol_id FROM symbol_events WHERE event IN ('alloc', 'rename', 'alias')", "symbol_events"),
)
def alias_lookup(spark, sf):
    events = fx.symbol_events(spark, sf)
    return state.resolve_names(events.select("name").distinct(), state.symbol_table(events)).select("name", "symbol_id")


@query("dense_ids", fx.with_tables("SELECT memory_id, row_number() OVER (ORDER BY committed_at, log_pos) - 1 AS n FROM sem", "sem"))
def dense_ids(spark, sf):
    """Counter-made names: one sequence over the whole log, numbered without bringing it to one task."""
    return sequence.numbered(fx.sem(spark, sf), "n", "committed_at", "log_pos").select("memory_id", "n")
