"""Record tables derived from the driver's tables.

Each derivation exists twice, as a DataFrame and as a SQL common table
expression, and uses integer arithmetic only. One row is one batch. Order in a
log is always (committed_at, log_pos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import state

#: Sources that may state a semantic record, in the order in which rows get them.
SEMANTIC_SOURCES = (
    "profile", "observation", "self_report", "document", "registry", "external_authority",
    "agent_instruction", "librarian_assignment", "pending_verification",
)
ALL_SOURCES = (*SEMANTIC_SOURCES, "participant_report", "policy")
PROCEDURAL_SOURCES = ("policy", "agent_instruction", "pending_verification")
#: A predicate, a source and a method whose symbols are retired.
RETIRED_NAMES = ("error", "registry", "entity_count")
METHODS = (
    "direct_lookup", "majority_vote", "citation_link", "analogy_inference", "pattern_summarize", "architectural_chain",
    "dominance_analysis", "entity_count", "interval_calc", "feedback_consolidation", "qualitative_inference",
    "provenance_chain", "multi_source_consensus", "conflict_reconciliation",
)
#: Parents of an inferential row, by its method.
PARENTS = (1, 3, 2, 2, 3, 2, 2, 1, 2, 1, 1, 2, 3, 2)
SURFACES = ("cli", "mcp", "claude_memory", "codex_memory", "repo_handoff", "directory", "agent_export", "consensus_quorum", "copilot_session_store")
STATES = ("pending", "processing", "accepted", "skipped", "failed", "quarantined")
DAY_MS = 86_400_000


def millis(column):
    """Floor of a timestamp to milliseconds since the epoch, session zone UTC."""
    return F.unix_millis(F.col(column).cast("timestamp"))


def pick(values, index):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sem_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ms, i = millis("ts"), F.col("event_id")
    return e.select(
        i.alias("memory_id"), F.col("user_id").alias("s"), F.col("event_type").alias("p"), F.col("value").alias("o"),
        ms.alias("valid_at"), (ms + ((i * 7919) % 97) * 3_600_000).alias("committed_at"), i.alias("log_pos"),
        ((i * 31337) % 65536).alias("confidence"), (i % 97 == 0).alias("projected"),
    )


def symbol(prefix: str, column) -> Column:
    """The symbol that a number stands for: users are u1, rules r1, memories m1."""
    return F.concat(F.lit(prefix), F.col(column).cast("string") if isinstance(column, str) else column.cast("string"))


def sem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sem_base(spark, sf_dir).withColumn("source", pick(SEMANTIC_SOURCES, F.col("memory_id") % 9)).withColumn("s_ref", symbol("u", "s"))
    return rows.withColumn("refs", state.references("sem", s=F.col("s_ref"), p=F.col("p"), source=F.col("source")))


def sem_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid times cut to 6 hours, which makes equal ones."""
    return sem(spark, sf_dir).withColumn("valid_at", F.expr("valid_at div 21600000 * 21600000"))


def sem_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eleven sources, so that some rows must be rejected."""
    return _sem_base(spark, sf_dir).withColumn("source", pick(ALL_SOURCES, F.col("memory_id") % 11))


def pro(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(
        (key + 20_000_000).alias("memory_id"), F.col("o_custkey").alias("rule_id"), F.col("o_orderpriority").alias("trigger"),
        F.concat_ws("_", "o_orderstatus", (F.col("o_custkey") % 50).cast("string")).alias("scope"), F.col("o_totalprice").alias("action"),
        pick(PROCEDURAL_SOURCES, key % 3).alias("source"), ((key * 31337) % 65536).alias("confidence"),
        (key + 1_710_000_000_000).alias("committed_at"), key.alias("log_pos"),
    )
    return rows.withColumn("refs", state.references("pro", rule_id=symbol("r", "rule_id"), scope=F.col("scope"), source=F.col("source")))


def inf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event infers from the events just before it."""
    base = _sem_base(spark, sf_dir).filter("memory_id % 5 = 0 and memory_id >= 15")
    i = F.col("memory_id")
    # In a column of its own first: in one select, the lambda would see the new memory_id.
    parents = F.transform(F.sequence(F.lit(1), pick(PARENTS, i % 14)), lambda k: i - k.cast("long"))
    rows = base.withColumn("derived_from", parents).select(
        (i + 10_000_000).alias("memory_id"), "s", "p", "o", pick(METHODS, i % 14).alias("method"), "derived_from",
        "valid_at", (F.col("committed_at") + 1).alias("committed_at"), i.alias("log_pos"), "confidence", (i % 35 == 0).alias("projected"), symbol("u", "s").alias("s_ref"),
    )
    listed = F.transform("derived_from", lambda m: symbol("m", m))
    return rows.withColumn("refs", state.references("inf", s=F.col("s_ref"), p=F.col("p"), method=F.col("method"), derived_from=listed))


def epi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i, ms = table(spark, sf_dir, "events"), F.col("event_id"), millis("ts")
    return e.select(
        i.alias("memory_id"), i.alias("event_id"), F.col("event_type").alias("kind"),
        F.array("user_id", F.col("user_id") + 1).alias("participants"), ms.alias("at_time"),
        (ms + ((i % 7) - 1) * 1000).alias("observed_at"), pick(("observation", "self_report", "participant_report"), i % 3).alias("source"),
        ((i * 31337) % 65536).alias("confidence"), (ms + ((i * 7919) % 97) * 3_600_000).alias("committed_at"), i.alias("log_pos"),
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One episode for each semantic row; parents form a tree."""
    i = F.col("memory_id")
    return _sem_base(spark, sf_dir).select(
        i.alias("episode_id"), F.col("committed_at").alias("at"),
        F.when(i > 0, F.expr("memory_id div 2")).alias("parent"), F.concat(F.lit("ep_"), i.cast("string")).alias("label"),
        F.when(i % 50 == 0, F.array(i - 1)).otherwise(F.array().cast("array<long>")).alias("retracts"),
    )


def symbol_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allocations, renames, aliases and retirements of the symbols that records refer to."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    i = F.col("id")
    name = F.concat(F.lit("user_"), i.cast("string"))

    def one(rank, event, name):
        return F.struct(F.lit(rank).alias("rank"), F.lit(event).alias("event"), name.alias("name"))

    own = F.array_compact(
        F.array(
            one(0, "alloc", name),
            F.when(i % 10 == 3, one(1, "rename", F.concat(F.lit("renamed_"), i.cast("string")))),
            F.when(i % 10 == 5, one(2, "alias", F.concat(F.lit("alias_"), i.cast("string")))),
            F.when(i % 10 == 7, one(3, "retire", name)),
            F.when(i % 20 == 7, one(4, "unretire", name)),
        )
    )
    people = users.select(symbol("u", "id").alias("symbol_id"), i.alias("n"), F.explode(own).alias("e"))
    # Symbols of other kinds are named as they are written; some are retired.
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    fixed = spark.createDataFrame([(x, x in RETIRED_NAMES) for x in dict.fromkeys((*ALL_SOURCES, *METHODS))], "symbol_id string, gone boolean")
    others = (
        fixed.unionByName(events.select(F.col("event_type").alias("symbol_id"), F.col("event_type").isin(*RETIRED_NAMES).alias("gone")))
        .unionByName(orders.select(symbol("r", "o_custkey").alias("symbol_id"), (F.col("o_custkey") % 37 == 5).alias("gone")))
        .unionByName(orders.select(F.concat_ws("_", "o_orderstatus", (F.col("o_custkey") % 50).cast("string")).alias("symbol_id"), (F.col("o_custkey") % 50 == 13).alias("gone")))
        .unionByName(events.filter("event_id % 211 = 0").select(symbol("m", "event_id").alias("symbol_id"), F.lit(True).alias("gone")))
    ).distinct()
    named = F.array_compact(F.array(one(0, "alloc", F.col("symbol_id")), F.when(F.col("gone"), one(3, "retire", F.col("symbol_id")))))
    rest = others.select("symbol_id", F.lit(50_000_000).cast("long").alias("n"), F.explode(named).alias("e"))
    return people.unionByName(rest).select("symbol_id", "e.event", "e.name", (F.col("e.rank") * 100_000_000 + F.col("n")).cast("long").alias("log_pos"))


def flag_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins, unpins, authoritative marks and their removal."""
    i = F.col("memory_id")

    def one(every, event, rank):
        return F.when(i % every == 0, F.struct(F.lit(event).alias("event"), F.lit(rank).alias("rank")))

    events = F.filter(F.array(one(41, "pin", 0), one(82, "unpin", 1), one(53, "authoritative_set", 0), one(106, "authoritative_clear", 1)), lambda x: x.isNotNull())
    rows = _sem_base(spark, sf_dir).select("memory_id", "committed_at", F.explode(events).alias("e"))
    return rows.select("memory_id", F.col("e.event").alias("event"), (F.col("committed_at") + F.col("e.rank")).alias("at"), (i * 4 + F.col("e.rank")).alias("log_pos"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        i.alias("doc_id"), F.coalesce("text", F.lit("")).alias("raw_text"), pick(SURFACES, i % 9).alias("surface"), pick(STATES, i % 6).alias("state"),
        F.col("lang").alias("agent"), F.col("source").alias("project"), F.lit(None).cast("string").alias("operator"),
        F.when(i % 8 == 7, F.concat(F.lit("quorum://episode/"), i.cast("string"))).alias("provenance_uri"), (i * 60_000).alias("submitted_at"),
    )


# The same tables as SQL. A name's expression may use the names before it.
CTES: dict[str, str] = {
    "sem_base": """SELECT event_id AS memory_id, user_id AS s, event_type AS p, value AS o, epoch_us(ts)//1000 AS valid_at,
        epoch_us(ts)//1000 + ((event_id*7919)%97)*3600000 AS committed_at, event_id AS log_pos,
        (event_id*31337)%65536 AS confidence, event_id%97=0 AS projected FROM events""",
    "sem": f"SELECT *, [s_ref, p, source] AS refs FROM (SELECT *, ({_list(SEMANTIC_SOURCES)})[1+memory_id%9] AS source, 'u' || s AS s_ref FROM sem_base)",
    "sem_coarse": "SELECT * REPLACE (valid_at//21600000*21600000 AS valid_at) FROM sem",
    "sem_candidates": f"SELECT *, ({_list(ALL_SOURCES)})[1+memory_id%11] AS source FROM sem_base",
    "pro": f"""SELECT *, ['r' || rule_id, scope, source] AS refs FROM (SELECT o_orderkey+20000000 AS memory_id, o_custkey AS rule_id, o_orderpriority AS "trigger",
        o_orderstatus || '_' || (o_custkey%50) AS scope, o_totalprice AS action, ({_list(PROCEDURAL_SOURCES)})[1+o_orderkey%3] AS source,
        (o_orderkey*31337)%65536 AS confidence, o_orderkey+1710000000000 AS committed_at, o_orderkey AS log_pos FROM orders)""",
    "inf": f"""SELECT *, list_concat(['u' || s, p, method], list_transform(derived_from, lambda x: 'm' || x)) AS refs FROM (
        SELECT memory_id+10000000 AS memory_id, s, p, o, ({_list(METHODS)})[1+memory_id%14] AS method,
        [memory_id-k FOR k IN range(1, 1+({_list(PARENTS)})[1+memory_id%14])] AS derived_from, valid_at, committed_at+1 AS committed_at,
        memory_id AS log_pos, confidence, memory_id%35=0 AS projected FROM sem_base WHERE memory_id%5=0 AND memory_id>=15)""",
    "epi": """SELECT event_id AS memory_id, event_id, event_type AS kind, [user_id, user_id+1] AS participants, epoch_us(ts)//1000 AS at_time,
        epoch_us(ts)//1000+((event_id%7)-1)*1000 AS observed_at, (['observation', 'self_report', 'participant_report'])[1+event_id%3] AS source,
        (event_id*31337)%65536 AS confidence, epoch_us(ts)//1000 + ((event_id*7919)%97)*3600000 AS committed_at, event_id AS log_pos FROM events""",
    "episodes": """SELECT memory_id AS episode_id, committed_at AS "at", CASE WHEN memory_id>0 THEN memory_id//2 END AS parent,
        'ep_' || memory_id AS label, CASE WHEN memory_id%50=0 THEN [memory_id-1] ELSE CAST([] AS BIGINT[]) END AS retracts FROM sem_base""",
    "symbol_events": f"""SELECT symbol_id, event, name, CAST(rank*100000000+n AS BIGINT) AS log_pos FROM (
        SELECT DISTINCT 'u' || user_id AS symbol_id, user_id AS n, 0 AS rank, 'alloc' AS event, 'user_' || user_id AS name FROM events
        UNION ALL SELECT DISTINCT 'u' || user_id, user_id, 1, 'rename', 'renamed_' || user_id FROM events WHERE user_id%10=3
        UNION ALL SELECT DISTINCT 'u' || user_id, user_id, 2, 'alias', 'alias_' || user_id FROM events WHERE user_id%10=5
        UNION ALL SELECT DISTINCT 'u' || user_id, user_id, 3, 'retire', 'user_' || user_id FROM events WHERE user_id%10=7
        UNION ALL SELECT DISTINCT 'u' || user_id, user_id, 4, 'unretire', 'user_' || user_id FROM events WHERE user_id%20=7
        UNION ALL SELECT x, 50000000, 0, 'alloc', x FROM other_symbols UNION ALL SELECT x, 50000000, 3, 'retire', x FROM other_symbols WHERE gone)""",
    "other_symbols": f"""SELECT DISTINCT x, gone FROM (SELECT x, list_contains({_list(RETIRED_NAMES)}, x) AS gone FROM (
            SELECT unnest({_list(tuple(dict.fromkeys((*ALL_SOURCES, *METHODS))))}) AS x UNION ALL SELECT event_type FROM events)
        UNION ALL SELECT 'r' || o_custkey, o_custkey%37=5 FROM orders UNION ALL SELECT o_orderstatus || '_' || (o_custkey%50), o_custkey%50=13 FROM orders
        UNION ALL SELECT 'm' || event_id, true FROM events WHERE event_id%211=0)""",
    "flag_events": """SELECT memory_id, event, committed_at+rank AS "at", memory_id*4+rank AS log_pos FROM (
        SELECT memory_id, committed_at, 'pin' AS event, 0 AS rank FROM sem_base WHERE memory_id%41=0
        UNION ALL SELECT memory_id, committed_at, 'unpin', 1 FROM sem_base WHERE memory_id%82=0
        UNION ALL SELECT memory_id, committed_at, 'authoritative_set', 0 FROM sem_base WHERE memory_id%53=0
        UNION ALL SELECT memory_id, committed_at, 'authoritative_clear', 1 FROM sem_base WHERE memory_id%106=0)""",
    "drafts": f"""SELECT doc_id, coalesce(text, '') AS raw_text, ({_list(SURFACES)})[1+doc_id%9] AS surface, ({_list(STATES)})[1+doc_id%6] AS state,
        lang AS agent, source AS project, CAST(NULL AS VARCHAR) AS operator,
        CASE WHEN doc_id%8=7 THEN 'quorum://episode/' || doc_id END AS provenance_uri, doc_id*60000 AS submitted_at FROM documents""",
    # -- derived states, used by many oracles
    "ranked": """SELECT *, max(valid_at) OVER w AS head FROM sem
        WINDOW w AS (PARTITION BY s, p ORDER BY committed_at, log_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "kinded": """SELECT *, CASE WHEN head IS NULL THEN 'first' WHEN valid_at > head THEN 'forward' WHEN valid_at < head THEN 'retro' ELSE 'conflict' END AS kind FROM ranked""",
    "followed": """SELECT memory_id, lead(memory_id) OVER v AS closed_by, lead(valid_at) OVER v AS close_at, lead(committed_at) OVER v AS close_committed
        FROM kinded WHERE kind IN ('first', 'forward') WINDOW v AS (PARTITION BY s, p ORDER BY committed_at, log_pos)""",
    "sem_state": """SELECT k.*, f.closed_by, f.close_at, f.close_committed,
        CASE WHEN k.kind <> 'first' THEN (last_value(CASE WHEN k.kind IN ('first', 'forward') THEN k.memory_id END IGNORE NULLS) OVER h) END AS head_id
        FROM kinded k LEFT JOIN followed f USING (memory_id)
        WINDOW h AS (PARTITION BY k.s, k.p ORDER BY k.committed_at, k.log_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "watermark": "SELECT max(c) AS wm FROM (SELECT max(committed_at) AS c FROM sem UNION ALL SELECT max(committed_at) FROM inf UNION ALL SELECT max(committed_at) FROM pro)",
    "retired": "SELECT symbol_id FROM symbol_events GROUP BY symbol_id HAVING arg_max(event, CASE WHEN event IN ('retire', 'unretire') THEN log_pos END) = 'retire'",
    "pinned": "SELECT memory_id FROM flag_events WHERE event IN ('pin', 'unpin') GROUP BY memory_id HAVING arg_max(event, log_pos) = 'pin'",
    "authoritative": "SELECT memory_id FROM flag_events WHERE event LIKE 'authoritative%' GROUP BY memory_id HAVING arg_max(event, log_pos) = 'authoritative_set'",
}
for _kind in ("ranked", "kinded", "followed", "sem_state"):
    # The same history of the inferential rows.
    _sql = CTES[_kind].replace("FROM sem\n", "FROM inf\n")
    for _name in ("ranked", "kinded", "followed"):
        _sql = _sql.replace(f"FROM {_name}", f"FROM inf_{_name}").replace(f"JOIN {_name}", f"JOIN inf_{_name}")
    CTES[f"inf_{_kind.removeprefix('sem_')}"] = _sql
_NEEDS = {
    "symbol_events": ("other_symbols",), "inf_ranked": ("inf",), "inf_kinded": ("inf_ranked",), "inf_followed": ("inf_kinded",), "inf_state": ("inf_kinded", "inf_followed"),
    "sem": ("sem_base",), "sem_coarse": ("sem",), "sem_candidates": ("sem_base",), "inf": ("sem_base",), "episodes": ("sem_base",),
    "flag_events": ("sem_base",), "ranked": ("sem",), "kinded": ("ranked",), "followed": ("kinded",), "sem_state": ("kinded", "followed"),
    "watermark": ("sem", "inf", "pro"), "retired": ("symbol_events",), "pinned": ("flag_events",), "authoritative": ("flag_events",),
}


def with_tables(body: str, *names: str, **more: str) -> str:
    """``body`` behind a WITH clause that defines ``names``, what they need, and ``more``."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, ()):
            need(x)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
