"""Codec round trip, rendering of other kinds, adapters, counters, policies and extensions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import decay, inference
from ..operators import drafts as dr
from ..operators import native, render, state
from ..operators import quorum as qo
from ..plans.read import ReadSpec, execute
from ..registry import query
from ..sources import record_log
from . import governance
from .reads import _read_sql, _rows, store


@query(
    "log_codec_round_trip",
    fx.with_tables("SELECT memory_id, s, confidence, valid_at, committed_at, projected FROM sem", "sem"),
)
def log_codec_round_trip(spark, sf):
    """Rows are framed as log records, decoded again, and read from what was decoded."""
    import pyarrow as pa

    names = ["memory_id", "s", "confidence", "valid_at", "committed_at", "projected"]

    def run(batches):
        for batch in batches:
            raw = b"".join(
                record_log.encode_record(
                    "sem",
                    dict(zip(names, row), p=1, o=("integer", -row[0]), source=2, observed_at=row[3], invalid_at=None),
                )
                for row in zip(*(batch.column(k).to_pylist() for k in range(6)))
            )
            rows = [json.dumps(f) for _, _, _, f, error in record_log.decode_all(record_log.HEADER + raw) if error is None]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["fields"])

    decoded = fx.sem(spark, sf).select(*names).mapInArrow(run, "fields string")
    shape = "memory_id long, s long, confidence long, valid_at long, committed_at long, projected boolean"
    return decoded.select(F.from_json("fields", shape).alias("f")).select("f.*")


_ISO = "strftime(make_timestamp(({c}//1000)*1000000), '%Y-%m-%dT%H:%M:%SZ')"


@query(
    "render_pro",
    fx.with_tables("SELECT memory_id, '(pro @rule_' || rule_id || ' \"' || \"trigger\" || '\" \"act\" :scp @' || scope || ' :src @policy :c 1.00000)' AS lisp FROM pro", "pro"),
)
def render_pro(spark, sf):
    rule = F.concat(F.lit("rule_"), F.col("rule_id").cast("string"))
    return fx.pro(spark, sf).select("memory_id", render.render_pro(rule, F.col("trigger"), F.lit("act"), F.col("scope"), F.lit("policy"), F.lit(65_535)).alias("lisp"))


@query(
    "render_inf",
    fx.with_tables(
        f"SELECT memory_id, '(inf @user_' || s || ' @' || p || ' ' || log_pos || ' (' || array_to_string(list_transform(derived_from, lambda x: '@__mem_' || x), ' ') || ') @' || method || ' :c ' || printf('%.5f', confidence/65535.0) || ' :v ' || {_ISO.format(c='valid_at')} || ')' AS lisp FROM inf",
        "inf",
    ),
)
def render_inf(spark, sf):
    parents = F.transform("derived_from", lambda x: F.concat(F.lit("__mem_"), x.cast("string")))
    return fx.inf(spark, sf).select("memory_id", render.render_inf(F.concat(F.lit("user_"), F.col("s").cast("string")), F.col("p"), F.col("log_pos").cast("string"), parents, F.col("method"), F.col("confidence"), F.col("valid_at")).alias("lisp"))


# Each surface of drafts is a source of memory files; some are missing, single files, or of another type.
_TYPES = ("directory", "directory", "file", "directory", "missing", "file", "unreadable", "directory", "socket")
_PATHS = ("a", "b", "c.md", "d", "e", "f.bin", "g", "h", "i")
_SOURCES = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{t}', '{p}')" for s, t, p in zip(fx.SURFACES, _TYPES, _PATHS)) + ") t(source, type, path)"
_FILES = "SELECT surface AS source, doc_id || (['.md', '.txt', '.json', ''])[1+doc_id%4] AS path, raw_text AS text FROM drafts WHERE doc_id%9 NOT IN (1, 3) OR doc_id%9 = 3 AND doc_id%4 > 1"
_HEALTH = """SELECT source, files, readable, reason, CASE reason WHEN 'source_missing' THEN 'missing' WHEN 'file_supported' THEN 'supported' WHEN 'directory_contains_supported_files' THEN 'supported' WHEN 'directory_empty' THEN 'supported' ELSE 'drifted' END AS status
    FROM (SELECT s.source, count(f.path) AS files, count(f.path) FILTER (f.path LIKE '%.md' OR f.path LIKE '%.txt') AS readable, CASE WHEN type = 'missing' THEN 'source_missing' WHEN type = 'file' AND s.path LIKE '%.md' THEN 'file_supported' WHEN type = 'file' THEN 'unsupported_file_extension'
    WHEN type = 'unreadable' THEN 'source_unreadable' WHEN type <> 'directory' THEN 'unsupported_path_type' WHEN count(f.path) FILTER (f.path LIKE '%.md' OR f.path LIKE '%.txt') > 0 THEN 'directory_contains_supported_files'
    WHEN count(f.path) > 0 THEN 'directory_has_no_supported_files' ELSE 'directory_empty' END AS reason FROM so s LEFT JOIN fi f ON f.source = s.source GROUP BY s.source, s.type, s.path)"""
_NATIVE = dict(so=_SOURCES, fi=_FILES, he=_HEALTH)


def _native(spark, sf):
    sources = spark.createDataFrame(list(zip(fx.SURFACES, _TYPES, _PATHS)), "source string, type string, path string")
    d, i = fx.drafts(spark, sf), F.col("doc_id")
    files = d.filter(~(i % 9).isin(1, 3) | ((i % 9 == 3) & (i % 4 > 1)))
    return sources, files.select(F.col("surface").alias("source"), F.concat(i.cast("string"), fx.pick((".md", ".txt", ".json", ""), i % 4)).alias("path"), F.col("raw_text").alias("text"))


@query("native_source_health", fx.with_tables("SELECT source, files, readable, status, reason FROM he", "drafts", **_NATIVE))
def native_source_health(spark, sf):
    """Each source of memory files: missing, drifted or supported, and why."""
    return native.health(*_native(spark, sf))


@query("native_source_capture", fx.with_tables("SELECT source, path FROM fi JOIN he USING (source) WHERE status = 'supported' AND (path LIKE '%.md' OR path LIKE '%.txt') AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''", "drafts", **_NATIVE))
def native_source_capture(spark, sf):
    """Readable files of the supported sources become drafts."""
    return native.capture(*_native(spark, sf)).select("source", "path")


@query("quorum_draft_counts", fx.with_tables("SELECT state, count(*) AS n FROM drafts WHERE provenance_uri LIKE 'quorum://%' GROUP BY state", "drafts"))
def quorum_draft_counts(spark, sf):
    return fx.drafts(spark, sf).filter(F.col("provenance_uri").startswith("quorum://")).groupBy("state").agg(F.count("*").alias("n"))


@query("symbol_event_counts", fx.with_tables("SELECT event, count(*) AS n FROM symbol_events GROUP BY event", "symbol_events"))
def symbol_event_counts(spark, sf):
    return fx.symbol_events(spark, sf).groupBy("event").agg(F.count("*").alias("n"))


@query(
    "conflict_policy",
    fx.with_tables(
        "SELECT memory_id, 'skip' AS policy, 'skipped' AS state FROM r WHERE valid_at = head UNION ALL SELECT memory_id, 'review', 'quarantined' FROM r WHERE valid_at = head",
        "sem_coarse", r=fx.CTES["ranked"].replace("FROM sem", "FROM sem_coarse"),
    ),
)
def conflict_policy(spark, sf):
    """What either policy makes of a conflicting record."""
    from ..operators.supersession import semantic_history

    bad = semantic_history(fx.sem_coarse(spark, sf)).filter("kind = 'conflict'")
    pairs = F.inline(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(s).alias("state")) for p, s in (("skip", "skipped"), ("review", "quarantined")))))
    return bad.select("memory_id", pairs)


@query(
    "operator_triage",
    fx.with_tables("SELECT doc_id, CASE WHEN state NOT IN ('pending', 'processing') THEN 'state' WHEN doc_id%7 = 0 THEN 'reason' END AS refused, CASE WHEN state IN ('pending', 'processing') AND doc_id%7 > 0 THEN CASE WHEN doc_id%2 = 0 THEN 'skipped' ELSE 'quarantined' END ELSE state END AS state FROM drafts", "drafts"),
)
def operator_triage(spark, sf):
    """An operator sets open drafts aside with a reason; blank reasons and closed drafts are refused."""
    i, open_ = F.col("doc_id"), F.col("state").isin("pending", "processing")
    reason = F.when(i % 7 == 0, " ").otherwise("seen")
    refused = F.when(~open_, "state").when(F.trim(reason) == "", "reason")
    target = F.when(i % 2 == 0, "skipped").otherwise("quarantined")
    return fx.drafts(spark, sf).select("doc_id", refused.alias("refused"), F.when(refused.isNull(), target).otherwise(F.col("state")).alias("state"))


@query("context_view", _read_sql("SELECT kind, memory_id, committed_at FROM c WHERE NOT retired ORDER BY committed_at DESC, memory_id DESC LIMIT 32", c=_rows(projected=True)))
def context_view(spark, sf):
    """The capsule of the 32 latest records of the current state, projected ones included, is the feature."""
    records = execute(store(spark, sf), ReadSpec(include_projected=True, limit=None)).records
    return state.context_view(records).select("kind", "memory_id", "committed_at")


@query("render_one", _read_sql("SELECT kind, memory_id, s, p FROM c WHERE s = 12 AND p = 'click'", c=_rows("sem", rules=False)))
def render_one(spark, sf):
    """The one record that a read of a subject and a predicate finds."""
    records = execute(store(spark, sf), ReadSpec(kind="sem", s=12, p="click", include_retired=True, limit=None)).records.filter("not projected")
    return state.exactly_one(records).select("kind", "memory_id", "s", "p")


_SYNTHESES = """SELECT doc_id//5 AS wanted, doc_id, CASE WHEN doc_id%11 = 0 THEN 2 ELSE 1 END AS schema_version, CASE WHEN doc_id%13 = 0 THEN -1 ELSE doc_id//5 END AS episode_id,
    CASE WHEN doc_id%7 = 0 THEN '  ' ELSE 'do it' END AS recommendation, CASE WHEN doc_id%17 = 0 THEN 1.5::DOUBLE ELSE 0.5 END AS confidence, doc_id%19 = 0 AS blank_point FROM documents WHERE doc_id%5 = 1"""


@query(
    "synthesis_audit",
    fx.with_tables(
        """SELECT doc_id, CASE WHEN schema_version <> 1 THEN 'schema_version' WHEN episode_id <> wanted THEN 'other_episode' WHEN trim(recommendation) = '' THEN 'recommendation' WHEN confidence > 1 THEN 'confidence'
            WHEN blank_point THEN 'dissenting_points' WHEN wanted IN (SELECT episode_id FROM problems) THEN 'participant_votes' END AS reject_reason FROM sy""",
        sy=_SYNTHESES, **governance._Q, problems=f"SELECT DISTINCT episode_id FROM ({governance._VOTE_AUDIT}) WHERE problem IS NOT NULL",
    ),
)
def synthesis_audit(spark, sf):
    """Proposed syntheses of episodes, most of them with something wrong."""
    i = F.col("doc_id")
    none = F.array().cast("array<string>")
    proposed = fx.table(spark, sf, "documents").filter("doc_id % 5 = 1").select(
        i.alias("doc_id"), F.expr("doc_id div 5").alias("wanted_episode_id"), F.when(i % 11 == 0, 2).otherwise(1).alias("schema_version"),
        F.when(i % 13 == 0, F.lit(-1).cast("long")).otherwise(F.expr("doc_id div 5")).cast("string").alias("episode_id"),
        F.when(i % 7 == 0, "  ").otherwise("do it").alias("recommendation"), F.when(i % 17 == 0, 1.5).otherwise(0.5).alias("confidence"),
        F.array(F.lit("one")).alias("supporting_points"), F.when(i % 19 == 0, F.array(F.lit("x"), F.lit(" "))).otherwise(none).alias("dissenting_points"),
        none.alias("unresolved_questions"), none.alias("evidence_used"), F.lit(None).cast("array<string>").alias("proposed_memory_drafts"),
    )
    return qo.audit_synthesis(proposed, governance._votes(spark, sf), governance._participants(spark, sf)).select("doc_id", "reject_reason")


# Extension: confidence of inferred rows from their parents' decayed confidences.
_HALVES = "SELECT i, CAST(round(pow(2.0, -i/256.0)*65535) AS BIGINT) AS v FROM range(256) t(i)"
_LIVES = " ".join(f"WHEN source = '{s}' THEN {(d or 0) * decay.DAY_MS}" for (k, s), d in decay.HALF_LIFE_DAYS.items() if k == "sem")
_EFFECTIVE = f"""SELECT memory_id, (confidence*CASE WHEN hl = 0 THEN 65535 WHEN k//256 >= 16 THEN 0 ELSE v >> CAST(k//256 AS INT) END+32767)//65535 AS c FROM (
    SELECT memory_id, confidence, hl, CASE WHEN hl = 0 THEN 0 ELSE greatest(0, (SELECT max(committed_at) FROM sem)-valid_at)*256//hl END AS k FROM (SELECT *, CASE {_LIVES} END AS hl FROM sem)) JOIN halves ON i = k%256"""


_SCALED = " ".join(f"WHEN '{m}' THEN CAST((min(e.c)*{a}+{b // 2})//{b} AS BIGINT)" for m, (a, b) in inference.MIN_SCALES.items())


@query(
    "inferred_effective_confidence",
    fx.with_tables(
        f"""SELECT memory_id, method, CASE method {_SCALED} WHEN 'direct_lookup' THEN arg_min(e.c, k) WHEN 'conflict_reconciliation' THEN CAST((max(e.c)*4+2)//5 AS BIGINT) END AS effective
        FROM (SELECT memory_id, method, unnest(derived_from) AS p, generate_subscripts(derived_from, 1) AS k FROM inf) l JOIN eff e ON e.memory_id = l.p GROUP BY l.memory_id, method""".replace("SELECT memory_id, method, CASE", "SELECT l.memory_id AS memory_id, method, CASE").replace(
            "GROUP BY l.memory_id, method", "WHERE method NOT IN (" + ", ".join(f"'{m}'" for m in (*inference.PRODUCT_SCALES, "multi_source_consensus", "pattern_summarize")) + ") GROUP BY l.memory_id, method"
        ),
        "sem", "inf", halves=_HALVES, eff=_EFFECTIVE,
    ),
)
def inferred_effective_confidence(spark, sf):
    """Confidence of inferred rows from their parents' decayed confidences, for the methods that take a minimum, a maximum or the first."""
    sem = fx.sem(spark, sf)
    wm = sem.agg(F.max("committed_at")).scalar()
    factor = decay.decay_factor(F.greatest(F.lit(0), wm - F.col("valid_at")), decay.half_life_ms("sem", F.col("source")))
    parents = sem.select(F.col("memory_id").alias("p"), decay.effective_confidence(F.col("confidence"), factor).alias("c"))
    folded = (*inference.PRODUCT_SCALES, "multi_source_consensus", "pattern_summarize")
    listed = fx.inf(spark, sf).filter(~F.col("method").isin(*folded)).select("memory_id", "method", F.posexplode("derived_from").alias("k", "p"))
    ordered = listed.join(parents, "p").groupBy("memory_id", "method").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("all"))
    return ordered.select("memory_id", "method", inference.inferred_confidence(F.col("method"), F.transform("all", lambda x: x["c"])).alias("effective"))


# Extension: how lately a rule has fired, from the episodes that name it.
@query(
    "rule_firings",
    fx.with_tables("SELECT who AS rule_id, max(observed_at) AS last_fired, count(*) AS firings FROM (SELECT unnest(participants) AS who, observed_at FROM epi WHERE kind = 'click') GROUP BY who", "epi"),
)
def rule_firings(spark, sf):
    fired = fx.epi(spark, sf).filter("kind = 'click'").select(F.explode("participants").alias("rule_id"), "observed_at")
    return fired.groupBy("rule_id").agg(F.max("observed_at").alias("last_fired"), F.count("*").alias("firings"))


_NOW = 1_720_000_000_000


@query(
    "rule_activity",
    fx.with_tables(
        f"""SELECT r.rule_id, CAST(round(greatest(0.3, least(1.0, exp(-(({_NOW} - coalesce(f.last_fired, r.created)) / 86400000.0::DOUBLE) / 180))) * 1000000) AS BIGINT) AS weight
        FROM (SELECT rule_id, min(committed_at) AS created FROM pro GROUP BY rule_id) r LEFT JOIN (SELECT who, max(observed_at) AS last_fired FROM (SELECT unnest(participants) AS who, observed_at FROM epi WHERE kind = 'click') GROUP BY who) f ON f.who = r.rule_id""",
        "pro", "epi",
    ),
)
def rule_activity(spark, sf):
    """Weights of rules in millionths; users stand for rules that fire."""
    rules = fx.pro(spark, sf).groupBy("rule_id").agg(F.min("committed_at").alias("created"))
    weight = decay.activity_factor(F.col("last_fired"), F.col("created"), F.lit(_NOW))
    return rules.join(rule_firings(spark, sf), "rule_id", "left").select("rule_id", F.round(weight * 1_000_000).cast("long").alias("weight"))


@query(
    "round_order",
    fx.with_tables("SELECT output_id, row_number() OVER (PARTITION BY episode_id ORDER BY CASE round WHEN 'independent' THEN 1 WHEN 'critique' THEN 2 ELSE 3 END, participant_id, output_id) AS place FROM outputs", **governance._Q),
)
def round_order(spark, sf):
    """Outputs of an episode in order of round, participant and output id."""
    return qo.in_round_order(governance._outputs(spark, sf)).select("output_id", "place")


@query(
    "lease_state",
    "SELECT user_id, event_id, epoch_us(ts)//1000 + least(CASE WHEN event_id%3 = 0 THEN 1800000 ELSE event_id*100000 END, 86400000) > 1705320000000 AS holds FROM events",
)
def lease_state(spark, sf):
    from ..streaming.supersede import expire_leases

    ttl = F.when(F.col("event_id") % 3 != 0, F.col("event_id") * 100_000)
    leases = fx.table(spark, sf, "events").select("user_id", "event_id", fx.millis("ts").alias("granted_at"), ttl.alias("ttl_ms"))
    return expire_leases(leases, F.lit(1_705_320_000_000)).select("user_id", "event_id", "holds")
