"""Supersession and bi-temporal resolution of semantic and procedural rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import resolve as rs
from ..operators import supersession as sp
from ..registry import query

#: Points in valid and commit time inside the data's range.
T, TC = 1_705_320_000_000, 1_705_500_000_000


def history(spark, sf):
    return sp.semantic_history(fx.sem(spark, sf))


@query("sem_supersession_kind_counts", fx.with_tables("SELECT kind, count(*) AS n FROM kinded GROUP BY kind", "kinded"))
def kind_counts(spark, sf):
    return history(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "sem_supersession_edges",
    fx.with_tables("SELECT memory_id AS from_id, head_id AS to_id, committed_at AS \"at\", kind FROM sem_state WHERE kind IN ('forward', 'retro')", "sem_state"),
)
def edges(spark, sf):
    return sp.supersession_edges(history(spark, sf)).select("from_id", "to_id", "at", "kind")


_COARSE = fx.CTES["ranked"].replace("FROM sem", "FROM sem_coarse")


@query(
    "sem_conflicts_coarse",
    fx.with_tables("SELECT memory_id, s, p, valid_at, committed_at FROM r WHERE valid_at = head", "sem_coarse", r=_COARSE),
)
def conflicts(spark, sf):
    return sp.semantic_history(fx.sem_coarse(spark, sf)).filter("kind = 'conflict'").select("memory_id", "s", "p", "valid_at", "committed_at")


@query(
    "head_tracking",
    fx.with_tables("SELECT memory_id, head, head_id, kind, closed_by, close_at, close_committed FROM sem_state", "sem_state"),
)
def heads(spark, sf):
    return history(spark, sf).select("memory_id", "head", "head_id", "kind", "closed_by", "close_at", "close_committed")


_BEST = "SELECT memory_id, s, p, o, valid_at, committed_at FROM (SELECT *, row_number() OVER (PARTITION BY s, p ORDER BY committed_at DESC, log_pos) AS turn FROM ({rows})) WHERE turn = 1"


def _rows_sql(t: str | None, tc: str | None, mode: str) -> str:
    known = f"CASE WHEN x.close_committed <= {tc} THEN x.close_at END" if tc else "x.close_at"
    pulled = ""
    if mode == rs.REFERENCE:
        cut = f" AND y.committed_at <= {tc}" if tc else ""
        pulled = f", (SELECT min(y.valid_at) FROM sem_state y WHERE y.kind = 'retro' AND y.head_id = x.memory_id{cut})"
    ends = f"least(CASE WHEN x.kind = 'retro' THEN x.head END, {known}{pulled})"
    where = ["x.kind <> 'conflict'"]
    where += [f"x.committed_at <= {tc}"] if tc else []
    where += [f"x.valid_at <= {t} AND coalesce({ends} > {t}, true)"] if t else []
    return f"SELECT x.* FROM sem_state x WHERE {' AND '.join(where)}"


def _resolved(t=None, tc=None, mode=rs.SPEC):
    sql = fx.with_tables(_BEST.format(rows=_rows_sql(t, tc, mode)), "sem_state", "watermark")

    def run(spark, sf):
        return rs.resolve(history(spark, sf), None if t is None else int(t), None if tc is None else int(tc), mode).select("memory_id", "s", "p", "o", "valid_at", "committed_at")

    return sql, run


def _register(name, **kw):
    sql, run = _resolved(**kw)
    query(name, sql)(run)


_register("as_of", t=str(T))
_register("as_committed", tc=str(TC))
_register("bitemporal", t=str(T), tc=str(TC))
_register("bitemporal_reference", t=str(T), tc=str(TC), mode=rs.REFERENCE)


def current(spark, sf, mode=rs.SPEC, rows=None):
    """What is the case at the watermark, as known there."""
    rows = rows if rows is not None else fx.sem(spark, sf)
    now = rows.agg(F.max("committed_at")).scalar()
    return rs.resolve(sp.semantic_history(rows), now, None, mode)


CURRENT = "SELECT max(committed_at) FROM sem"


@query("current_state_spec", fx.with_tables(_BEST.format(rows=_rows_sql(f"({CURRENT})", None, rs.SPEC)), "sem_state"))
def current_spec(spark, sf):
    return current(spark, sf).select("memory_id", "s", "p", "o", "valid_at", "committed_at")


@query("current_state_reference", fx.with_tables(_BEST.format(rows=_rows_sql(f"({CURRENT})", None, rs.REFERENCE)), "sem_state"))
def current_reference(spark, sf):
    return current(spark, sf, rs.REFERENCE).select("memory_id", "s", "p", "o", "valid_at", "committed_at")


#: SQL of the current state's rows, with every column, for queries that read it.
CURRENT_ROWS = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, p ORDER BY committed_at DESC, log_pos) AS turn FROM ({_rows_sql(f'({CURRENT})', None, rs.SPEC)})) WHERE turn = 1"


PRO = """SELECT p.*, least(
    (SELECT min(struct_pack(c := q.committed_at, l := q.log_pos, m := q.memory_id)) FROM pro q WHERE q.rule_id = p.rule_id AND q.log_pos > p.log_pos),
    (SELECT min(struct_pack(c := q.committed_at, l := q.log_pos, m := q.memory_id)) FROM pro q WHERE q."trigger" = p."trigger" AND q.scope = p.scope AND q.log_pos > p.log_pos)) AS next FROM pro p"""


@query("pro_supersession", fx.with_tables("SELECT memory_id, next.m AS closed_by, next.c AS close_committed FROM h", "pro", h=PRO))
def pro_supersession(spark, sf):
    return sp.procedural_history(fx.pro(spark, sf)).select("memory_id", "closed_by", "close_committed")


@query("pro_current", fx.with_tables('SELECT memory_id, rule_id, "trigger", scope, action FROM h WHERE next IS NULL', "pro", h=PRO))
def pro_current(spark, sf):
    return rs.resolve_procedural(sp.procedural_history(fx.pro(spark, sf))).select("memory_id", "rule_id", "trigger", "scope", "action")


_PRO_TC = 1_710_000_010_000


@query(
    "pro_as_committed",
    fx.with_tables(f'SELECT memory_id, rule_id, "trigger", scope, action FROM h WHERE committed_at <= {_PRO_TC} AND (next IS NULL OR next.c > {_PRO_TC})', "pro", h=PRO),
)
def pro_as_committed(spark, sf):
    return rs.resolve_procedural(sp.procedural_history(fx.pro(spark, sf)), None, _PRO_TC).select("memory_id", "rule_id", "trigger", "scope", "action")


@query(
    "monotonic_clock",
    "SELECT event_id, max(w - event_id) OVER (ORDER BY event_id) + event_id AS clock FROM (SELECT event_id, epoch_us(ts)//1000 - ((event_id*7919)%13)*500 AS w FROM events)",
)
def clock(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", (fx.millis("ts") - ((F.col("event_id") * 7919) % 13) * 500).alias("w"))
    return sp.monotonic_clock(e, "w", "event_id").select("event_id", "clock")


@query("watermark", fx.with_tables("SELECT wm FROM watermark", "watermark"))
def watermark(spark, sf):
    from ..operators.state import watermark as over

    return over(fx.sem(spark, sf), fx.inf(spark, sf), fx.pro(spark, sf))
