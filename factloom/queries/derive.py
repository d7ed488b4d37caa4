"""Validation, episodic rows, graph audits, verification, rendering, idle gaps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import decay, text
from ..operators import bind, graph, logs, render, replay
from ..operators import supersession as sp
from ..operators import validation as va
from ..registry import query
from .temporal import T

_ADMITTED = ", ".join(f"'{s}'" for s, k in decay.SOURCE_ADMITS.items() if "sem" in k)
_BOUNDS = "CASE source " + " ".join(f"WHEN '{s}' THEN {b}" for s, b in decay.SOURCE_BOUNDS.items()) + " END"
_WALL = 1_706_000_000_000
_REASON = f"CASE WHEN source NOT IN ({_ADMITTED}) THEN 'source_not_admitted' WHEN confidence > {_BOUNDS} THEN 'confidence_bound' WHEN valid_at > {_WALL} AND NOT projected THEN 'future_validity' END"


@query("validation_rejects", fx.with_tables(f"SELECT * FROM (SELECT memory_id, {_REASON} AS reject_reason FROM sem_candidates) WHERE reject_reason IS NOT NULL", "sem_candidates"))
def validation_rejects(spark, sf):
    return fx.sem_candidates(spark, sf).select("memory_id", va.semantic_reason(F.lit(_WALL)).alias("reject_reason")).filter("reject_reason is not null")


@query(
    "atomic_batches",
    fx.with_tables(f"SELECT memory_id, batch FROM (SELECT memory_id, memory_id//3 AS batch, bool_and({_REASON} IS NULL) OVER (PARTITION BY memory_id//3) AS good FROM sem_candidates) WHERE good", "sem_candidates"),
)
def atomic_batches(spark, sf):
    """Three rows a batch: any failure leaves no trace of its batch."""
    rows = fx.sem_candidates(spark, sf).withColumn("batch", F.expr("memory_id div 3"))
    return va.accept(rows, va.semantic_reason(F.lit(_WALL)), "batch").select("memory_id", "batch")


_PRO_BOUND = "CASE source WHEN 'pending_verification' THEN 39321 WHEN 'agent_instruction' THEN 62258 ELSE 65535 END"
_KINDS = ", ".join(f"'{m}'" for m in fx.METHODS)


@query(
    "validation_pro",
    fx.with_tables(
        f"SELECT memory_id, CASE WHEN log_pos%13 = 0 THEN 'missing_scope' WHEN log_pos%11 = 0 THEN 'source_not_admitted' WHEN confidence > {_PRO_BOUND} THEN 'confidence_bound' END AS reject_reason FROM pro",
        "pro",
    ),
)
def validation_pro(spark, sf):
    """Rules, of which some lack a scope and some have a source that may state none."""
    rows = fx.pro(spark, sf).withColumns({"scope": F.when(F.col("log_pos") % 13 != 0, F.col("scope")), "source": F.when(F.col("log_pos") % 11 == 0, "document").otherwise(F.col("source"))})
    return rows.select("memory_id", va.procedural_reason().alias("reject_reason"))


@query(
    "validation_inf",
    fx.with_tables(
        f"SELECT memory_id, CASE WHEN log_pos%25 = 0 THEN 'unregistered_method' WHEN log_pos%35 = 0 THEN 'empty_derived_from' WHEN valid_at > {_WALL} AND NOT projected THEN 'future_validity' END AS reject_reason FROM inf",
        "inf",
    ),
)
def validation_inf(spark, sf):
    """Inferred rows, of which some name no method and some no parent."""
    pos = F.col("log_pos")
    rows = fx.inf(spark, sf).withColumns({"method": F.when(pos % 25 == 0, "guess").otherwise(F.col("method")), "derived_from": F.when(pos % 35 != 0, F.col("derived_from"))})
    return rows.select("memory_id", va.inferential_reason(F.lit(_WALL)).alias("reject_reason"))


@query(
    "episode_forms",
    fx.with_tables("SELECT episode_id, CASE WHEN octet_length(encode(repeat('é', CAST(100+episode_id%60 AS INT)))) > 256 THEN 'label_too_long' WHEN episode_id%7 = 0 THEN 'multiple_episode_directives' END AS reject_reason FROM episodes", "episodes"),
)
def episode_forms(spark, sf):
    """Labels of 200 to 318 bytes; each seventh batch has two episode forms."""
    rows = fx.episodes(spark, sf).withColumn("label", F.expr("repeat('é', cast(100 + episode_id % 60 as int))"))
    return rows.select("episode_id", va.episode_reason(F.when(F.col("episode_id") % 7 == 0, 2).otherwise(1)).alias("reject_reason"))


@query(
    "episode_metadata",
    fx.with_tables(
        """SELECT episode_id, CASE WHEN episode_id%3 = 0 THEN 'form' ELSE label END AS label, CASE WHEN episode_id%4 = 0 THEN 77 ELSE parent END AS parent, len(CASE WHEN episode_id%5 = 0 THEN [5, 6] ELSE retracts END) AS retracted FROM episodes""",
        "episodes",
    ),
)
def episode_metadata(spark, sf):
    """What a batch's form says wins over what its caller gave."""
    given, i = fx.episodes(spark, sf), F.col("episode_id")
    form = given.select(
        i.alias("episode_id"), F.when(i % 3 == 0, "form").alias("label"), F.when(i % 4 == 0, F.lit(77).cast("long")).alias("parent"),
        F.when(i % 5 == 0, F.array(F.lit(5), F.lit(6)).cast("array<long>")).alias("retracts"),
    )
    return va.merged_metadata(form, given).select("episode_id", "label", "parent", F.size("retracts").cast("long").alias("retracted"))


#: Two names a batch, each with the kind that its place asks for.
_MENTIONS = """SELECT batch, name, kind FROM (SELECT event_id AS batch, 'n' || user_id AS name, CASE WHEN event_id%23 = 0 THEN 'memory' ELSE 'agent' END AS kind FROM events
    UNION ALL SELECT event_id, 'x' || (event_id*7)%400, (['literal', 'agent', 'literal'])[1+event_id%3] FROM events UNION ALL SELECT event_id, 'n' || user_id, 'predicate' FROM events WHERE event_id%101 = 0)"""
_ROUNDS = 12


def _bind_sql() -> str:
    steps = {"m": _MENTIONS, "inner_bad": "SELECT DISTINCT batch FROM m GROUP BY batch, name HAVING count(DISTINCT kind) > 1", "r0": "SELECT batch FROM inner_bad"}
    for k in range(_ROUNDS):
        steps[f"f{k}"] = f"SELECT name, min(batch) AS first, arg_min(kind, batch) AS lock FROM m WHERE batch NOT IN (SELECT batch FROM r{k}) GROUP BY name"
        steps[f"r{k + 1}"] = f"SELECT batch FROM inner_bad UNION SELECT m.batch FROM m JOIN f{k} f ON f.name = m.name WHERE f.first < m.batch AND f.lock <> m.kind"
    return fx.with_tables(f"SELECT DISTINCT batch, batch IN (SELECT batch FROM r{_ROUNDS}) AS rejected FROM m", **steps)


@query("bind_audit", _bind_sql())
def bind_audit(spark, sf):
    """Batches rejected by the kind that an earlier batch gave one of their names."""
    e, i = fx.table(spark, sf, "events"), F.col("event_id")
    user = F.concat(F.lit("n"), F.col("user_id").cast("string"))
    one = lambda name, kind: F.struct(name.alias("name"), kind.alias("kind"))
    listed = F.array_compact(
        F.array(
            one(user, F.when(i % 23 == 0, "memory").otherwise("agent")), one(F.concat(F.lit("x"), ((i * 7) % 400).cast("string")), fx.pick(("literal", "agent", "literal"), i % 3)),
            F.when(i % 101 == 0, one(user, F.lit("predicate"))),
        )
    )
    return bind.audit(e.select(i.alias("batch"), F.inline(listed)))


@query(
    "replay_state",
    fx.with_tables(
        """SELECT 'sem' AS kind, s, p, arg_min(memory_id, (-valid_at, committed_at, log_pos)) AS head_id, max(valid_at) AS valid_at, count(*) AS history FROM sem GROUP BY s, p
        UNION ALL SELECT 'inf', s, p, arg_min(memory_id, (-valid_at, committed_at, log_pos)), max(valid_at), count(*) FROM inf GROUP BY s, p""",
        "sem", "inf",
    ),
)
def replay_state(spark, sf):
    """Heads and lengths of all histories, as a replay of the log leaves them."""
    out = None
    for kind, rows in (("sem", fx.sem(spark, sf)), ("inf", fx.inf(spark, sf))):
        heads = replay.heads(rows, "s", "p").select(F.lit(kind).alias("kind"), "s", "p", "head_id", "valid_at", "history")
        out = heads if out is None else out.unionByName(heads)
    return out


@query("replay_counters", fx.with_tables("SELECT '__mem' AS prefix, max(memory_id)+1 AS next FROM sem UNION ALL SELECT '__ep', max(episode_id)+1 FROM episodes", "sem", "episodes"))
def replay_counters(spark, sf):
    """The numbers that names made by counters go on from."""
    named = lambda rows, prefix, c: rows.select(F.concat(F.lit(f"__{prefix}_"), F.col(c).cast("string")).alias("name"))
    names = named(fx.sem(spark, sf), "mem", "memory_id").unionByName(named(fx.episodes(spark, sf), "ep", "episode_id")).unionByName(fx.symbol_events(spark, sf).select("name"))
    return replay.counters(names)


@query("source_kind_names", "SELECT page_id, CASE WHEN n IN (" + ", ".join(f"'{s}'" for s in decay.SOURCE_BOUNDS) + ") THEN n ELSE 'observation' END AS kind FROM (SELECT page_id, " + str(list(fx.ALL_SOURCES) + ["mira", "Policy"]) + "[1+page_id%13] AS n FROM pages)")
def source_kind_names(spark, sf):
    name = fx.pick((*fx.ALL_SOURCES, "mira", "Policy"), F.col("page_id") % 13)
    return fx.table(spark, sf, "pages").select("page_id", decay.source_kind(name).alias("kind"))


@query("source_kinds", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', CAST({b} AS BIGINT), {'sem' in decay.SOURCE_ADMITS[s]}, {'epi' in decay.SOURCE_ADMITS[s]}, {'pro' in decay.SOURCE_ADMITS[s]})" for s, b in decay.SOURCE_BOUNDS.items()) + ") t(source, bound, admits_sem, admits_epi, admits_pro)")
def source_kinds(spark, sf):
    rows = [(s, b, *(k in decay.SOURCE_ADMITS[s] for k in ("sem", "epi", "pro"))) for s, b in decay.SOURCE_BOUNDS.items()]
    return spark.createDataFrame(rows, "source string, bound long, admits_sem boolean, admits_epi boolean, admits_pro boolean")


@query("epi_scan", fx.with_tables(f"SELECT memory_id, kind, participants[1] AS first_participant, at_time, observed_at FROM epi WHERE at_time <= {T} AND list_contains(participants, 12)", "epi"))
def epi_scan(spark, sf):
    rows = fx.epi(spark, sf).filter((F.col("at_time") <= T) & F.array_contains("participants", 12))
    return rows.select("memory_id", "kind", F.element_at("participants", 1).alias("first_participant"), "at_time", "observed_at")


_EPI_BOUND = "CASE source WHEN 'participant_report' THEN 55705 WHEN 'self_report' THEN 58982 ELSE 65535 END"


@query("epi_clock_order", fx.with_tables(f"SELECT memory_id, CASE WHEN confidence > {_EPI_BOUND} THEN 'confidence_bound' WHEN observed_at < at_time THEN 'clock_order' END AS reject_reason FROM epi", "epi"))
def epi_clock_order(spark, sf):
    return fx.epi(spark, sf).select("memory_id", va.episodic_reason().alias("reject_reason"))


@query(
    "episodic_decay",
    fx.with_tables(
        """SELECT memory_id, CAST(CASE WHEN x//256 >= 16 THEN 0 ELSE v >> CAST(x//256 AS INT) END AS BIGINT) AS factor FROM (
            SELECT memory_id, greatest(0, (SELECT max(committed_at) FROM epi) - at_time)*256 // (CASE source WHEN 'observation' THEN 90 WHEN 'self_report' THEN 30 ELSE 60 END * 86400000::BIGINT) AS x FROM epi)
        JOIN (SELECT i, CAST(round(pow(2.0, -i/256.0)*65535) AS BIGINT) AS v FROM range(256) t(i)) ON i = x % 256""",
        "epi",
    ),
)
def episodic_decay(spark, sf):
    epi = fx.epi(spark, sf)
    elapsed = F.greatest(F.lit(0), epi.agg(F.max("committed_at")).scalar() - F.col("at_time"))
    return epi.select("memory_id", decay.decay_factor(elapsed, decay.half_life_ms("epi", F.col("source"))).alias("factor"))


def _edges(spark, sf):
    return sp.supersession_edges(sp.semantic_history(fx.sem(spark, sf)))


_EDGES = "SELECT memory_id AS a, head_id AS b FROM sem_state WHERE kind IN ('forward', 'retro')"
#: Some edges that were never derived: a self-edge, one forward in the log, and one to nothing, for every 500th row.
_PLANTED = "SELECT memory_id AS a, memory_id AS b FROM sem WHERE memory_id%500 = 1 UNION ALL SELECT memory_id, memory_id+1 FROM sem WHERE memory_id%500 = 2 UNION ALL SELECT memory_id, -7 FROM sem WHERE memory_id%500 = 3"


@query(
    "cycle_audit",
    fx.with_tables(
        """SELECT a AS from_id, b AS to_id FROM (SELECT a, b FROM e UNION ALL SELECT a, b FROM planted) JOIN sem x ON x.memory_id = a
        WHERE NOT EXISTS (SELECT 1 FROM sem y WHERE y.memory_id = b AND (y.committed_at, y.log_pos) < (x.committed_at, x.log_pos))""",
        "sem_state", e=_EDGES, planted=_PLANTED,
    ),
)
def cycle_audit(spark, sf):
    """Edges that don't go back in the log, planted ones among them; without one no cycle can close."""
    sem = fx.sem(spark, sf)
    i = F.col("memory_id")
    to = F.when(i % 500 == 1, i).when(i % 500 == 2, i + 1).when(i % 500 == 3, F.lit(-7).cast("long"))
    planted = sem.select(i.alias("from_id"), to.alias("to_id")).filter("to_id is not null")
    return graph.suspect_edges(_edges(spark, sf).select("from_id", "to_id").unionByName(planted), sem.select("memory_id", "committed_at", "log_pos"))


@query(
    "edge_in_out",
    fx.with_tables("SELECT id, sum(o) AS out_edges, sum(i) AS in_edges FROM (SELECT a AS id, 1::BIGINT AS o, 0::BIGINT AS i FROM e UNION ALL SELECT b, 0, 1 FROM e) GROUP BY id".replace("sum(o)", "CAST(sum(o) AS BIGINT)").replace("sum(i)", "CAST(sum(i) AS BIGINT)"), "sem_state", e=_EDGES),
)
def edge_in_out(spark, sf):
    e = _edges(spark, sf)
    ends = e.select(F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.lit(1).alias("o")), F.struct(F.col("to_id").alias("id"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.o").alias("out_edges"), F.sum(1 - F.col("x.o")).alias("in_edges"))


@query(
    "supersession_chain",
    fx.with_tables(
        "SELECT root, depth, memory_id FROM walk",
        "sem_state",
        walk="SELECT memory_id AS root, 0::BIGINT AS depth, memory_id, head_id FROM sem_state UNION ALL SELECT w.root, w.depth+1, s.memory_id, s.head_id FROM walk w JOIN sem_state s ON s.memory_id = w.head_id",
    ),
)
def supersession_chain(spark, sf):
    """The chain behind every memory."""
    links = sp.semantic_history(fx.sem(spark, sf)).filter("head_id is not null and kind <> 'conflict'").select(F.col("memory_id").alias("id"), F.col("head_id").alias("to"))
    start = fx.sem(spark, sf).select(F.col("memory_id").alias("root"), F.col("memory_id").alias("id"))
    return graph.walk(links, start).select("root", "depth", F.col("id").alias("memory_id"))


#: Events as a log of several record kinds, with a checkpoint for ten rows but in the last of each thousand; the last row is cut short.
#: Symbols that a tenth of the log allocates; references are to users, and to one who has no symbol.
_LOG = """SELECT event_id AS log_pos, event_id*24 AS "offset", 24::BIGINT AS length, CASE WHEN event_id%10 = 9 AND event_id%1000 < 980 THEN 'checkpoint' WHEN event_id%10 = 0 THEN 'symbol_alloc' WHEN event_id%10 = 5 THEN 'inf'
    WHEN event_id%10 = 6 THEN 'edge' WHEN event_id%10 = 7 THEN 'epi' WHEN event_id%10 = 4 THEN 'pro' ELSE 'sem' END AS kind, CASE WHEN event_id = (SELECT max(event_id) FROM events) THEN 'truncated' END AS error,
    user_id AS symbol_id, CASE event_id%10 WHEN 5 THEN [user_id, -2] WHEN 7 THEN [user_id, user_id+1, user_id+100000] WHEN 4 THEN [user_id] ELSE CASE WHEN event_id%50 = 1 THEN [user_id, -1] ELSE [user_id] END END AS refs FROM events"""


def _log(spark, sf):
    i, u = F.col("event_id"), F.col("user_id")
    kind = (
        F.when((i % 10 == 9) & (i % 1000 < 980), "checkpoint").when(i % 10 == 0, "symbol_alloc").when(i % 10 == 5, "inf")
        .when(i % 10 == 6, "edge").when(i % 10 == 7, "epi").when(i % 10 == 4, "pro").otherwise("sem")
    )
    nobody = lambda n: F.lit(n).cast("long")
    refs = (
        F.when(i % 10 == 5, F.array(u, nobody(-2))).when(i % 10 == 7, F.array(u, u + 1, u + 100_000)).when(i % 10 == 4, F.array(u))
        .when(i % 50 == 1, F.array(u, nobody(-1))).otherwise(F.array(u))
    )
    events = fx.table(spark, sf, "events")
    last = events.agg(F.max("event_id")).scalar()
    return events.select(
        i.alias("log_pos"), (i * 24).alias("offset"), nobody(24).alias("length"), kind.alias("kind"), F.when(i == last, "truncated").alias("error"), u.alias("symbol_id"), refs.alias("refs")
    )


@query(
    "verify_report",
    fx.with_tables(
        """SELECT count(*) FILTER (error IS NULL) AS records, count(*) FILTER (kind = 'checkpoint' AND error IS NULL) AS checkpoints, count(*) FILTER (kind IN ('sem', 'epi', 'pro', 'inf') AND error IS NULL) AS memories,
        count(*) FILTER (kind LIKE 'symbol%' AND error IS NULL) AS symbol_events, CAST(sum(length) FILTER (error IS NOT NULL) AS BIGINT) AS trailing, 'orphan' AS tail FROM l""",
        l=_LOG,
    ),
)
def verify_report(spark, sf):
    return logs.verify_report(_log(spark, sf))


@query("committed_prefix", fx.with_tables("SELECT log_pos, kind FROM l WHERE log_pos <= (SELECT max(log_pos) FROM l WHERE kind = 'checkpoint')", l=_LOG))
def committed_prefix(spark, sf):
    return logs.committed_prefix(_log(spark, sf)).select("log_pos", "kind")


@query(
    "batch_tally",
    fx.with_tables(
        """SELECT batch, count(*) FILTER (kind IN ('sem', 'epi', 'pro', 'inf')) AS memories, count(*) FILTER (kind = 'edge') AS edges FROM (
            SELECT kind, min(CASE WHEN kind = 'checkpoint' THEN log_pos END) OVER (ORDER BY log_pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS batch FROM l) WHERE batch IS NOT NULL GROUP BY batch""",
        l=_LOG,
    ),
)
def batch_tally(spark, sf):
    return logs.batch_tally(_log(spark, sf))


@query(
    "dangling_symbols",
    fx.with_tables("SELECT memory_id, symbol_id FROM (SELECT log_pos AS memory_id, unnest(refs) AS symbol_id FROM l WHERE kind IN ('sem', 'epi', 'pro', 'inf')) WHERE symbol_id NOT IN (SELECT symbol_id FROM l WHERE kind = 'symbol_alloc')", l=_LOG),
)
def dangling_symbols(spark, sf):
    """References of every kind of record without a symbol; each reference counts."""
    log = _log(spark, sf)
    refs = log.filter("kind in ('sem', 'epi', 'pro', 'inf')").select(F.col("log_pos").alias("memory_id"), F.explode("refs").alias("symbol_id"))
    return logs.dangling_references(refs, log.filter("kind = 'symbol_alloc'").select("symbol_id")).select("memory_id", "symbol_id")


@query(
    "restore_drill",
    fx.with_tables("SELECT count(*) > 0 AS sanity, count(*) FILTER (len(list_filter(refs, lambda x: x < 0)) > 0) = 0 AS no_dangling, true AS tail_ok, false AS passed FROM l", l=_LOG),
)
def restore_drill(spark, sf):
    """The log above, restored: its tail is cut short but not corrupt, references to symbols below 0 dangle."""
    log = _log(spark, sf)
    refs = log.select(F.explode("refs").alias("symbol_id"))
    return logs.restore_drill(log, refs.filter("symbol_id < 0"), log.filter("kind = 'sem'"))


@query(
    "tail_status",
    "SELECT event_id, CASE WHEN event_id%5 = 0 THEN CASE WHEN event_id%3 = 0 THEN 'clean' ELSE 'orphan' END WHEN event_id%5 IN (1, 2) THEN 'orphan' ELSE 'corrupt' END AS status FROM events",
)
def tail_status(spark, sf):
    i = F.col("event_id")
    error = F.when(i % 5 == 1, "truncated").when(i % 5 == 2, "length_mismatch").when(i % 5 == 3, "unknown_opcode").when(i % 5 == 4, "varint_overflow")
    return fx.table(spark, sf, "events").select("event_id", logs.tail_status(error, i % 3).alias("status"))


_COPIES = "SELECT count(*) AS n, count(*) FILTER (event_id <= (SELECT max(event_id) FROM events)-20) AS m, count(*) FILTER (event_id%97 = 5) AS a FROM events"


@query(
    "log_relation",
    fx.with_tables(
        """SELECT 'remote shorter' AS "case", n AS local_rows, m AS remote_rows, 0::BIGINT AS different, 'local_ahead' AS relation FROM c UNION ALL SELECT 'remote longer', m, n, 0, 'remote_ahead' FROM c
        UNION ALL SELECT 'same', n, n, 0, 'synced' FROM c UNION ALL SELECT 'rows altered', n, n, a, 'diverged' FROM c UNION ALL SELECT 'no remote', n, NULL, NULL, 'local_only' FROM c
        UNION ALL SELECT 'no local', NULL, n, NULL, 'remote_only' FROM c UNION ALL SELECT 'neither', NULL, NULL, NULL, 'missing' FROM c""",
        c=_COPIES,
    ),
)
def log_relation(spark, sf):
    """Two copies of the whole log, one a prefix of the other, or with altered rows, or not there."""
    events = fx.table(spark, sf, "events")
    log = events.select(F.col("event_id").alias("position"), F.sha2(F.concat_ws("|", "event_id", "user_id", "event_type"), 256).alias("digest"))
    shorter = log.filter(F.col("position") <= events.agg(F.max("event_id")).scalar() - 20)
    altered = log.withColumn("digest", F.when(F.col("position") % 97 == 5, "x").otherwise(F.col("digest")))
    cases = [("remote shorter", log, shorter), ("remote longer", shorter, log), ("same", log, log), ("rows altered", log, altered), ("no remote", log, None), ("no local", None, log), ("neither", None, None)]
    out = None
    for name, a, b in cases:
        row = logs.log_relation(a, b, spark).select(F.lit(name).alias("case"), "local_rows", "remote_rows", "different", "relation")
        out = row if out is None else out.unionByName(row)
    return out


_GAP = 300_000


@query(
    "idle_episodes",
    f"""SELECT user_id, session, count(*) AS events, min(ms) AS starts_at, max(ms) AS ends_at FROM (
        SELECT user_id, ms, CAST(sum(CASE WHEN before IS NULL OR ms - before >= {_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS BIGINT) AS session FROM (
            SELECT user_id, event_id, epoch_us(ts)//1000 AS ms, lag(epoch_us(ts)//1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)//1000, event_id) AS before FROM events)) GROUP BY user_id, session""",
)
def idle_episodes(spark, sf):
    """Runs of a user's events without a gap of five minutes."""
    w = Window.partitionBy("user_id").orderBy("ms", "event_id")
    e = fx.table(spark, sf, "events").select("user_id", "event_id", fx.millis("ts").alias("ms"))
    new = F.when(F.lag("ms").over(w).isNull() | (F.col("ms") - F.lag("ms").over(w) >= _GAP), 1).otherwise(0)
    runs = e.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return runs.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ms").alias("starts_at"), F.max("ms").alias("ends_at"))


_ISO = "strftime(make_timestamp((valid_at//1000)*1000000), '%Y-%m-%dT%H:%M:%SZ')"


@query(
    "render_sem",
    fx.with_tables(f"SELECT memory_id, '(sem @user_' || s || ' @' || p || ' ' || memory_id || ' :src @' || source || ' :c ' || printf('%.5f', confidence/65535.0) || ' :v ' || {_ISO} || ')' AS lisp FROM sem", "sem"),
)
def render_sem(spark, sf):
    name = F.concat(F.lit("user_"), F.col("s").cast("string"))
    return fx.sem(spark, sf).select("memory_id", render.render_sem(name, F.col("p"), F.col("memory_id").cast("string"), F.col("source"), F.col("confidence"), F.col("valid_at")).alias("lisp"))


@query(
    "render_epi",
    fx.with_tables(
        f"SELECT memory_id, '(epi @ev_' || event_id || ' @' || kind || ' (@u' || participants[1] || ' @u' || participants[2] || ') @here :at ' || {_ISO.replace('valid_at', 'at_time')} || ' :obs ' || {_ISO.replace('valid_at', 'observed_at')} || ' :src @' || source || ' :c ' || printf('%.5f', confidence/65535.0) || ')' AS lisp FROM epi",
        "epi",
    ),
)
def render_epi(spark, sf):
    people = F.transform("participants", lambda x: F.concat(F.lit("u"), x.cast("string")))
    return fx.epi(spark, sf).select("memory_id", render.render_epi(F.concat(F.lit("ev_"), F.col("event_id").cast("string")), F.col("kind"), people, F.col("at_time"), F.col("observed_at"), F.col("source"), F.col("confidence"), F.lit("here")).alias("lisp"))


@query(
    "iso_round_trip",
    fx.with_tables("SELECT memory_id, valid_at//1000*1000 AS parsed, valid_at//86400000*86400000 AS parsed_date FROM sem", "sem"),
)
def iso_round_trip(spark, sf):
    """Rendered times parse back to the whole second, dates to midnight."""
    iso = text.iso_seconds(F.col("valid_at"))
    return fx.sem(spark, sf).select("memory_id", text.parse_iso(iso).alias("parsed"), text.parse_iso(F.substring(iso, 1, 10)).alias("parsed_date"))


@query("confidence_units", "SELECT event_id, CAST(CASE WHEN x BETWEEN 0 AND 1 THEN round_even(x*65535, 0) END AS BIGINT) AS units FROM (SELECT event_id, (event_id%1100)/1000.0::DOUBLE AS x FROM events)")
def confidence_units(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", text.confidence_units((F.col("event_id") % 1100) / 1000.0).alias("units"))
