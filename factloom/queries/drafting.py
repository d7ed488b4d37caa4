"""Drafts, duplicates, sessions, text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text
from ..operators import drafts as dr
from ..operators import runner as rn
from ..operators import sessions as se
from ..operators import validation as va
from ..registry import query


@query(
    "draft_counts",
    fx.with_tables("SELECT st AS state, count(d.doc_id) AS n FROM (SELECT unnest(['pending', 'processing', 'accepted', 'skipped', 'failed', 'quarantined']) AS st) x LEFT JOIN drafts d ON d.state = st GROUP BY st", "drafts"),
)
def draft_counts(spark, sf):
    return dr.counts_by_state(fx.drafts(spark, sf))


@query("oldest_pending", fx.with_tables("SELECT greatest(0, 90000000 - min(submitted_at)) AS age_ms FROM drafts WHERE state = 'pending'", "drafts"))
def oldest_pending(spark, sf):
    return fx.drafts(spark, sf).filter("state = 'pending'").agg(F.greatest(F.lit(0).cast("long"), F.lit(90_000_000) - F.min("submitted_at")).alias("age_ms"))


_ID = "substr(sha256(raw_text || chr(0) || surface || chr(0) || coalesce(agent, '') || chr(0) || coalesce(project, '') || chr(0) || coalesce(operator, '') || chr(0) || coalesce(provenance_uri, '') || chr(0)), 1, 16)"


@query("draft_id_hash", fx.with_tables(f"SELECT doc_id, {_ID} AS id FROM drafts", "drafts"))
def draft_id_hash(spark, sf):
    return dr.with_ids(fx.drafts(spark, sf)).select("doc_id", "id")


@query(
    "draft_submit",
    fx.with_tables(f"SELECT DISTINCT id FROM (SELECT *, {_ID} AS id FROM drafts) WHERE id NOT IN (SELECT {_ID} FROM drafts WHERE state = 'pending' AND doc_id%12 = 0)", "drafts"),
)
def draft_submit(spark, sf):
    """All drafts are handed in; half of the pending ones are there already."""
    new = dr.with_ids(fx.drafts(spark, sf))
    return dr.submit(new, new.filter("doc_id % 12 = 0 and state = 'pending'")).select("id")


_CLEAN = r"regexp_replace(raw_text, '(?s)\x1b\[[^@-~]*[@-~]?|\x1b\].*?(?:\x07|\x1b\\|\z)|\x1b.?|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g')"
_LINE = f"trim(regexp_replace({_CLEAN}, '[\\t-\\r\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


@query("draft_preview", fx.with_tables(f"SELECT doc_id, CASE WHEN length(line) > 80 THEN substr(line, 1, 77) || '...' ELSE line END AS preview FROM (SELECT doc_id, {_LINE} AS line FROM drafts)", "drafts"))
def draft_preview(spark, sf):
    return fx.drafts(spark, sf).select("doc_id", text.preview(F.col("raw_text")).alias("preview"))


_DIRTY = "SELECT doc_id, chr(27) || '[31m' || raw_text || chr(27) || ']0;title' || chr(27) || 'x' || chr(7) || chr(1) || 'x' || chr(9) || chr(27) || 'Zy' || chr(27) || ']open' || chr(10) AS raw_text FROM drafts"


@query("terminal_sanitise", fx.with_tables(f"SELECT doc_id, {_CLEAN} AS clean FROM dirty", "drafts", dirty=_DIRTY))
def terminal_sanitise(spark, sf):
    esc = F.lit("\x1b")
    dirty = F.concat(esc, F.lit("[31m"), F.col("raw_text"), esc, F.lit("]0;title"), esc, F.lit("x\x07\x01x\t"), esc, F.lit("Zy"), esc, F.lit("]open\n"))
    return fx.drafts(spark, sf).select("doc_id", text.terminal_safe(dirty).alias("clean"))


@query("token_estimate", fx.with_tables(r"SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(1, (n+3)//4) END AS BIGINT) AS tokens FROM (SELECT doc_id, length(regexp_replace(raw_text, '^\s+|\s+$', '', 'g')) AS n FROM drafts)", "drafts"))
def token_estimate(spark, sf):
    return fx.drafts(spark, sf).select("doc_id", text.token_estimate(F.col("raw_text")).alias("tokens"))


@query(
    "raw_archive_facts",
    fx.with_tables(
        f"""SELECT 'draft_' || id AS s, p, o, source, confidence, least(submitted_at, 30000000) AS valid_at FROM (
            SELECT id, submitted_at, 'raw_checkpoint' AS p, raw_text AS o, 'pending_verification' AS source, 39321::BIGINT AS confidence FROM d
            UNION ALL SELECT id, submitted_at, 'data_surface', 'raw_draft.data.v1', 'librarian_assignment', 65535 FROM d
            UNION ALL SELECT id, submitted_at, 'instruction_boundary', 'data_only_never_execute', 'librarian_assignment', 65535 FROM d
            UNION ALL SELECT id, submitted_at, 'consumer_rule', 'structure_memory_do_not_execute', 'librarian_assignment', 65535 FROM d
            UNION ALL SELECT id, submitted_at, 'source_surface', surface, 'librarian_assignment', 65535 FROM d
            UNION ALL SELECT id, submitted_at, 'submitted_at_ms', submitted_at::VARCHAR, 'librarian_assignment', 65535 FROM d
            UNION ALL SELECT id, submitted_at, 'source_agent', agent, 'librarian_assignment', 65535 FROM d WHERE agent IS NOT NULL
            UNION ALL SELECT id, submitted_at, 'source_project', project, 'librarian_assignment', 65535 FROM d WHERE project IS NOT NULL
            UNION ALL SELECT id, submitted_at, 'provenance_uri', provenance_uri, 'librarian_assignment', 65535 FROM d WHERE provenance_uri IS NOT NULL)""",
        "drafts", d=f"SELECT *, {_ID} AS id FROM drafts",
    ),
)
def raw_archive_facts(spark, sf):
    return dr.raw_archive(dr.with_ids(fx.drafts(spark, sf)), F.lit(30_000_000))


# Candidates for the store: each stored row again, changed in nothing, in one field, or in its valid time by 0.5 or 1.5 seconds.
_CHANGES = {
    "sem": (("s", "s + 1"), ("p", "concat(p, '_')"), ("o", "o + 1"), ("source", "concat(source, '_')"), ("confidence", "confidence + 1"), ("projected", "NOT projected")),
    "inf": (("s", "s + 1"), ("p", "concat(p, '_')"), ("o", "o + 1"), ("method", "concat(method, '_')"), ("confidence", "confidence + 1"), ("projected", "NOT projected")),
    "pro": (("rule_id", "rule_id + 1000000"), ("trigger", "concat(\"trigger\", '_')"), ("action", "action + 1"), ("scope", "concat(scope, '_')"), ("source", "concat(source, '_')"), ("confidence", "confidence + 1"), ("precondition", "'x'")),
    "epi": (("event_id", "event_id + 1000000"), ("kind", "concat(kind, '_')"), ("location", "'there'"), ("at_time", "at_time + 1"), ("observed_at", "observed_at + 1"), ("source", "concat(source, '_')"), ("confidence", "confidence + 1")),
}
_MORE = {"sem": "", "inf": "", "pro": ", CASE WHEN log_pos%2 = 0 THEN 'if' END AS precondition", "epi": ", CASE WHEN log_pos%2 = 0 THEN 'here' END AS location"}
_LISTS = {"inf": "derived_from", "epi": "participants"}


def _candidates_sql(kind: str) -> str:
    n = len(_CHANGES[kind]) + 4
    replaced = [f'CASE WHEN log_pos%{n} = {k} THEN {e} ELSE "{c}" END AS "{c}"' for k, (c, e) in enumerate(_CHANGES[kind])]
    if kind in va.DATED:
        replaced.append(f"CASE log_pos%{n} WHEN {n - 2} THEN valid_at+500 WHEN {n - 3} THEN valid_at+1500 ELSE valid_at END AS valid_at")
    if kind in _LISTS:
        replaced.append(f"CASE WHEN log_pos%{n} = {n - 4} THEN list_append({_LISTS[kind]}, -1) ELSE {_LISTS[kind]} END AS {_LISTS[kind]}")
    return f"SELECT * REPLACE ({', '.join(replaced)}) FROM (SELECT *{_MORE[kind]} FROM {kind})"


def _stored(spark, sf, kind):
    rows = getattr(fx, kind)(spark, sf)
    more = {"pro": ("precondition", "if"), "epi": ("location", "here")}.get(kind)
    return rows if more is None else rows.withColumn(more[0], F.when(F.col("log_pos") % 2 == 0, more[1]))


def _candidates(spark, sf, kind):
    rows, turn = _stored(spark, sf, kind), F.col("log_pos") % (len(_CHANGES[kind]) + 4)
    n = len(_CHANGES[kind]) + 4
    changed = {c: F.when(turn == k, F.expr(e.replace('"', "`"))).otherwise(F.col(c)) for k, (c, e) in enumerate(_CHANGES[kind])}
    if kind in va.DATED:
        changed["valid_at"] = F.when(turn == n - 2, F.col("valid_at") + 500).when(turn == n - 3, F.col("valid_at") + 1500).otherwise(F.col("valid_at"))
    if kind in _LISTS:
        changed[_LISTS[kind]] = F.when(turn == n - 4, F.array_append(_LISTS[kind], F.lit(-1).cast("long"))).otherwise(F.col(_LISTS[kind]))
    return rows.withColumns(changed)


def _duplicate_sql(kind: str, window: int) -> str:
    equal = " AND ".join(f't."{c}" IS NOT DISTINCT FROM c."{c}"' for c in va.DUPLICATE_FIELDS[kind])
    dated = f" AND abs(t.valid_at - c.valid_at) <= {window}" if kind in va.DATED else ""
    return f"SELECT c.memory_id, EXISTS (SELECT 1 FROM st t WHERE {equal}{dated}) AS duplicate FROM ca c"


def _dedup(name: str, kind: str, window: int = 0):
    tables = dict(st=f"SELECT *{_MORE[kind]} FROM {kind}", ca=_candidates_sql(kind))
    run = lambda spark, sf: va.duplicates(_candidates(spark, sf, kind), _stored(spark, sf, kind), kind, window)
    query(name, fx.with_tables(_duplicate_sql(kind, window), kind, **tables))(run)
    return run, tables


for _kind in va.DUPLICATE_FIELDS:
    _dedup(f"dedup_{_kind}", _kind)
_dedup_window, _DEDUP = _dedup("dedup_window", "sem", 1000)
_dedup("dedup_window_inf", "inf", 1000)


@query(
    "batch_dedup_counts",
    fx.with_tables(f"SELECT memory_id//100 AS batch, count(*) FILTER (NOT duplicate) AS unique_rows, count(*) FILTER (duplicate) AS duplicate_rows FROM ({_duplicate_sql('sem', 1000)}) GROUP BY ALL", "sem", **_DEDUP),
)
def batch_dedup_counts(spark, sf):
    """Unique rows and duplicates of each batch of a hundred candidates."""
    found = _dedup_window(spark, sf).withColumn("batch", F.expr("memory_id div 100"))
    return found.groupBy("batch").agg(F.count_if(~F.col("duplicate")).alias("unique_rows"), F.count_if("duplicate").alias("duplicate_rows"))


_MOVES = "SELECT user_id AS id, event_id AS position, (['pending', 'processing', 'accepted', 'skipped', 'failed', 'quarantined'])[1+(event_id*7)%6] AS state FROM events"


@query(
    "lifecycle_audit",
    fx.with_tables(
        """SELECT id, position, state, "before", coalesce(CASE WHEN "before" IS NULL THEN state = 'pending' WHEN "before" = 'pending' THEN state = 'processing'
            WHEN "before" = 'processing' THEN state <> 'processing' END, false) AS allowed FROM (SELECT *, lag(state) OVER (PARTITION BY id ORDER BY position) AS "before" FROM moves)""",
        moves=_MOVES,
    ),
)
def lifecycle_audit(spark, sf):
    e = fx.table(spark, sf, "events")
    return dr.audit_moves(e.select(F.col("user_id").alias("id"), F.col("event_id").alias("position"), fx.pick(dr.STATES, (F.col("event_id") * 7) % 6).alias("state")))


@query("stale_claims", fx.with_tables("SELECT doc_id, CASE WHEN state = 'processing' AND submitted_at+5 <= 30000000-900000 THEN 'pending' ELSE state END AS state FROM drafts", "drafts"))
def stale_claims(spark, sf):
    claims = fx.drafts(spark, sf).select("doc_id", "state", (F.col("submitted_at") + 5).alias("claimed_at"))
    return dr.recover_stale(claims, F.lit(30_000_000)).select("doc_id", "state")


# A run at a time at which some claims are stale; every 23rd pending draft is claimed by another runner meanwhile.
_NOW = 30_000_000
_RUN = f"""SELECT *, recovered OR state = 'pending' AS seen FROM (SELECT doc_id, surface, state, state = 'processing' AND submitted_at+5 <= {_NOW}-900000 AS recovered,
    CASE WHEN doc_id%7 < 5 THEN (['accepted', 'skipped', 'failed', 'quarantined', 'deferred'])[1+doc_id%7] END AS made, doc_id%23 = 0 AS gone FROM drafts)"""
_RAN = """SELECT *, seen AND NOT gone AS claimed, seen AND gone AS missed, CASE WHEN seen AND NOT gone THEN coalesce(made, 'deferred') END AS decision FROM run"""


def _run_once(spark, sf):
    d = fx.drafts(spark, sf).select(F.col("doc_id").alias("id"), "surface", "state", F.when(F.col("state") == "processing", F.col("submitted_at") + 5).alias("claimed_at"))
    turn = F.col("id") % 7
    decisions = d.filter(turn < 5).select("id", fx.pick(tuple(rn.TARGETS), turn).alias("decision"))
    return rn.run_once(d, decisions, _NOW, d.filter("id % 23 = 0").select("id"))


@query(
    "run_once",
    fx.with_tables(
        "SELECT doc_id AS id, state, recovered, claimed, missed, decision, CASE WHEN missed THEN 'processing' WHEN decision = 'deferred' THEN 'pending' WHEN decision IS NOT NULL THEN decision ELSE state END AS final_state FROM ran",
        "drafts", run=_RUN, ran=_RAN,
    ),
)
def run_once(spark, sf):
    """What one run makes of each draft."""
    return _run_once(spark, sf).select("id", "state", "recovered", "claimed", "missed", "decision", "final_state")


@query(
    "run_summary",
    fx.with_tables(
        "SELECT surface, count(*) FILTER (recovered) AS recovered_processing, count(*) FILTER (seen) AS pending_seen, count(*) FILTER (claimed) AS claimed, "
        + ", ".join(f"count(*) FILTER (decision = '{d}') AS {d}" for d in ("accepted", "skipped", "failed", "quarantined", "deferred"))
        + ", count(*) FILTER (missed) AS claim_misses FROM ran GROUP BY surface",
        "drafts", run=_RUN, ran=_RAN,
    ),
)
def run_summary(spark, sf):
    """The nine counters of a run, by surface."""
    return rn.summary(_run_once(spark, sf), "surface")


@query(
    "health_zone",
    """SELECT c_custkey, CASE WHEN c_custkey%11 = 0 OR r IN ('error', 'diverged') THEN 'red' WHEN c_custkey%7 = 0 OR c_custkey%5 > 0 AND c_custkey%2 = 0 OR a IN ('push', 'pull') THEN 'amber' ELSE 'green' END AS zone
    FROM (SELECT c_custkey, (['ok', 'error', 'diverged', 'ok', 'ok', 'ok'])[1+c_custkey%6] AS r, (['push', 'pull', 'none', NULL, 'none'])[1+c_custkey%5] AS a FROM customer)""",
)
def health_zone(spark, sf):
    k = F.col("c_custkey")
    zone = dr.health_zone(
        k % 11 != 0, fx.pick(("ok", "error", "diverged", "ok", "ok", "ok"), k % 6), k % 7 != 0,
        F.when((k % 5 > 0) & (k % 2 == 0), 1).otherwise(0), fx.pick(("push", "pull", "none", None, "none"), k % 5),
    )
    return fx.table(spark, sf, "customer").select("c_custkey", zone.alias("zone"))


@query("draft_sweep", fx.with_tables("SELECT doc_id, length(raw_text) AS n FROM drafts WHERE regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g') <> '' AND surface IN ('directory', 'claude_memory', 'codex_memory', 'repo_handoff', 'agent_export')", "drafts"))
def draft_sweep(spark, sf):
    """A sweep takes texts of five surfaces that aren't blank."""
    d = fx.drafts(spark, sf).filter(F.col("surface").isin("directory", "claude_memory", "codex_memory", "repo_handoff", "agent_export"))
    return d.filter(F.regexp_replace("raw_text", r"^\s+|\s+$", "") != "").select("doc_id", F.length("raw_text").cast("long").alias("n"))


@query("draft_conflicts", fx.with_tables("SELECT a.doc_id FROM drafts a JOIN (SELECT doc_id, state, CASE WHEN doc_id%9 = 4 THEN 'other' ELSE raw_text END AS raw_text FROM drafts WHERE doc_id%2 = 0) b USING (doc_id, state) WHERE sha256(a.raw_text) <> sha256(b.raw_text)", "drafts"))
def draft_conflicts(spark, sf):
    """Drafts that stand under the same state and name in two mirrors with other bytes."""
    d = fx.drafts(spark, sf).select("doc_id", "state", F.sha2("raw_text", 256).alias("mine"))
    mirror = fx.drafts(spark, sf).filter("doc_id % 2 = 0").select("doc_id", "state", F.sha2(F.when(F.col("doc_id") % 9 == 4, "other").otherwise(F.col("raw_text")), 256).alias("theirs"))
    return d.join(mirror, ["doc_id", "state"]).filter("mine <> theirs").select("doc_id")


# -- sessions -------------------------------------------------------------------

_SESSIONS = """SELECT 's' || conv_id AS id, 'owner/repo' || (conv_id%4) AS repository, 'main' AS branch, 'talk ' || conv_id AS summary, conv_id*1000000 AS created_at,
    CASE WHEN conv_id%3 > 0 THEN conv_id*1000000 + max(turn)*60000 END AS updated_at FROM conversations GROUP BY conv_id"""
_TURNS = """SELECT 's' || conv_id AS session_id, turn AS turn_index, text AS user_message, reply AS assistant_response, conv_id*1000000 + turn*60000 AS "timestamp"
    FROM (SELECT *, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'"""
_FILES = """SELECT 's' || conv_id AS session_id, 'src/part' || (conv_id%7) || '/f' || turn || '.py' AS file_path, CASE WHEN turn%8 = 0 THEN 'edit' END AS tool_name, turn AS turn_index, conv_id*1000000 + turn*60000 + 7 AS first_seen_at
    FROM conversations WHERE role = 'user' AND turn%4 = 0"""


def _sessions(spark, sf):
    c, i, t = fx.table(spark, sf, "conversations"), F.col("conv_id"), F.col("turn")
    sid = F.concat(F.lit("s"), i.cast("string"))
    sessions = c.groupBy("conv_id").agg(F.max("turn").alias("last")).select(
        sid.alias("id"), F.concat(F.lit("owner/repo"), (i % 4).cast("string")).alias("repository"), F.lit("main").alias("branch"), F.concat(F.lit("talk "), i.cast("string")).alias("summary"),
        (i * 1_000_000).alias("created_at"), F.when(i % 3 > 0, i * 1_000_000 + F.col("last") * 60_000).alias("updated_at"),
    )
    w = Window.partitionBy("conv_id").orderBy("turn")
    reply = F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w))
    turns = c.withColumn("reply", reply).filter("role = 'user'").select(
        sid.alias("session_id"), t.alias("turn_index"), F.col("text").alias("user_message"), F.col("reply").alias("assistant_response"), (i * 1_000_000 + t * 60_000).alias("timestamp")
    )
    files = c.filter("role = 'user' and turn % 4 = 0").select(
        sid.alias("session_id"), F.concat(F.lit("src/part"), (i % 7).cast("string"), F.lit("/f"), t.cast("string"), F.lit(".py")).alias("file_path"),
        F.when(t % 8 == 0, "edit").alias("tool_name"), t.alias("turn_index"), (i * 1_000_000 + t * 60_000 + 7).alias("first_seen_at"),
    )
    return sessions, turns, files


_S = dict(sessions=_SESSIONS, turns=_TURNS, files=_FILES)


@query(
    "recent_sessions",
    fx.with_tables(
        """SELECT id, repository, coalesce(updated_at, created_at) AS changed_at, (SELECT count(*) FROM turns WHERE session_id = id) AS turns, (SELECT count(*) FROM files WHERE session_id = id) AS files
        FROM sessions WHERE repository = 'owner/repo1' ORDER BY coalesce(updated_at, created_at) DESC, id LIMIT 10""",
        **_S,
    ),
)
def recent_sessions(spark, sf):
    """The ten sessions changed last are the feature."""
    return se.recent_sessions(*_sessions(spark, sf), repository="owner/repo1").select("id", "repository", "changed_at", "turns", "files")


@query("recent_files", fx.with_tables("SELECT session_id, file_path, turn_index, first_seen_at FROM files ORDER BY first_seen_at DESC, session_id, file_path, turn_index LIMIT 10", **_S))
def recent_files(spark, sf):
    sessions, _, files = _sessions(spark, sf)
    return se.recent_files(sessions, files).select("session_id", "file_path", "turn_index", "first_seen_at")


@query(
    "session_search",
    fx.with_tables(
        """SELECT * FROM (SELECT 0 AS rank, session_id, turn_index, "timestamp" AS "at", substr(trim(coalesce(user_message, '') || chr(10) || coalesce(assistant_response, '')), 1, 400) AS excerpt
            FROM turns JOIN sessions ON id = session_id WHERE contains(lower(coalesce(user_message, '')), 'part') OR contains(lower(coalesce(assistant_response, '')), 'part') OR contains(lower(summary), 'part')
            UNION ALL SELECT 1, session_id, turn_index, first_seen_at, file_path || coalesce(' (' || tool_name || ')', '') FROM files WHERE contains(lower(file_path), 'part'))
        ORDER BY rank, "at" DESC, session_id, turn_index, excerpt LIMIT 100""",
        **_S,
    ),
)
def session_search(spark, sf):
    """A limited result list is the feature: turns first, files for the remainder."""
    return se.search(*_sessions(spark, sf), term="Part", limit=100)


@query("session_counts", fx.with_tables("SELECT id, (SELECT count(*) FROM turns WHERE session_id = id) AS turns, (SELECT count(*) FROM files WHERE session_id = id) AS files FROM sessions", **_S))
def session_counts(spark, sf):
    sessions, turns, files = _sessions(spark, sf)
    t = turns.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("turns"))
    f = files.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("files"))
    return sessions.select("id").join(t, "id", "left").join(f, "id", "left").select("id", F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("files", F.lit(0)).alias("files"))


@query("schema_drift", "SELECT * FROM (VALUES ('turns', 'assistant_response'), ('session_refs', ''), ('checkpoints', '')) t(\"table\", missing)")
def schema_drift(spark, sf):
    sessions, turns, files = _sessions(spark, sf)
    tables = {"sessions": sessions.columns, "turns": turns.drop("assistant_response").columns, "session_files": [*files.columns, "extra"]}
    return spark.createDataFrame(se.schema_problems(tables), "table string, missing string")


@query(
    "checkpoint_drafts",
    fx.with_tables(
        """SELECT session_id, checkpoint_number, raw_text, project, 'session-store://' || session_id || '/checkpoints/' || checkpoint_number AS provenance_uri FROM (
            SELECT session_id, turn_index AS checkpoint_number, 'part ' || turn_index || chr(10) || chr(10) || user_message AS raw_text, repository AS project FROM turns JOIN sessions ON id = session_id ORDER BY "timestamp" DESC, session_id, turn_index LIMIT 5)""",
        **_S,
    ),
)
def checkpoint_drafts(spark, sf):
    sessions, turns, _ = _sessions(spark, sf)
    points = turns.select("session_id", F.col("turn_index").alias("checkpoint_number"), F.concat(F.lit("part "), F.col("turn_index").cast("string")).alias("title"), F.col("user_message").alias("overview"), F.col("timestamp").alias("created_at"))
    return se.checkpoint_drafts(sessions, points).select("session_id", "checkpoint_number", "raw_text", "project", "provenance_uri")


_URL = "chr(9) || ' ' || CASE WHEN page_id%3 = 0 THEN upper(url) ELSE url END || '/É.git' || chr(10)"


@query("workspace_ids", f"SELECT page_id, sha256(regexp_replace(regexp_replace(translate(regexp_replace({_URL}, '^\\s+|\\s+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\.git$', ''), '/$', '')) AS id FROM pages")
def workspace_ids(spark, sf):
    url = F.concat(F.lit("\t "), F.when(F.col("page_id") % 3 == 0, F.upper("url")).otherwise(F.col("url")), F.lit("/É.git\n"))
    return fx.table(spark, sf, "pages").select("page_id", text.workspace_id(url).alias("id"))


@query("origin_urls", "SELECT page_id, CASE WHEN page_id%4 < 3 THEN url END AS origin FROM pages")
def origin_urls(spark, sf):
    """The remote of a git configuration, whose section is written in three ways, or is another remote's."""
    i = F.col("page_id")
    head = fx.pick(('[remote "origin"]', "[ remote 'origin' ]", "[remote origin]", '[remote "fork"]'), i % 4)
    config = F.concat(F.lit("[core]\n\tbare = false\n\turl = no\n; url = no\n"), head, F.lit("\n# url = no\n\tfetch = +refs\n\turl\t=  "), F.col("url"), F.lit(" \r\n\turl = later\n[branch]\n\turl = no\n"))
    return fx.table(spark, sf, "pages").select("page_id", text.origin_url(config).alias("origin"))


@query(
    "repository_slugs",
    "SELECT page_id, nullif(CASE WHEN page_id%2 = 0 THEN regexp_extract('https://host.example/own' || page_id || '/repo', '^[^:]+://[^/]+/(.+)$', 1) ELSE 'own' || page_id || '/repo' END, '') AS slug FROM pages",
)
def repository_slugs(spark, sf):
    i = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://host.example/own"), i, F.lit("/repo.git"))).otherwise(F.concat(F.lit("git@host.example:own"), i, F.lit("/repo/")))
    return fx.table(spark, sf, "pages").select("page_id", text.repository_slug(url).alias("slug"))


@query("quorum_slugs", "SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 1, 48) || '-' || substr(sha256(url), 1, 16) AS slug FROM pages WHERE url <> ''")
def quorum_slugs(spark, sf):
    return fx.table(spark, sf, "pages").filter("url <> ''").select("page_id", text.quorum_slug(F.col("url")).alias("slug"))
