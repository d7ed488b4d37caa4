"""Inferred rows: supersession, staleness, confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import inference
from ..operators import graph
from ..operators import supersession as sp
from ..registry import query

_INF_KINDS = """SELECT *, CASE WHEN head IS NULL THEN 'first' WHEN valid_at > head THEN 'forward' WHEN valid_at < head THEN 'retro' ELSE 'conflict' END AS kind
    FROM (SELECT *, max(valid_at) OVER (PARTITION BY s, p ORDER BY committed_at, log_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head FROM inf)"""


@query("inf_supersession", fx.with_tables("SELECT memory_id, head, kind FROM k", "inf", k=_INF_KINDS))
def inf_supersession(spark, sf):
    return sp.key_history(fx.inf(spark, sf), "s", "p").select("memory_id", "head", "kind")


def _edges(spark, sf):
    return sp.supersession_edges(sp.semantic_history(fx.sem(spark, sf)))


_EDGES = "SELECT memory_id AS from_id, head_id AS to_id, committed_at AS \"at\", log_pos AS at_pos FROM sem_state WHERE kind IN ('forward', 'retro')"
_LISTED = "SELECT memory_id AS inf_id, log_pos AS inf_pos, method, unnest(derived_from) AS parent_id FROM inf"


@query(
    "stale_parent_edges",
    fx.with_tables('SELECT l.inf_id, l.parent_id, e."at" FROM l JOIN e ON e.to_id = l.parent_id AND l.inf_pos < e.at_pos', "sem_state", "inf", e=_EDGES, l=_LISTED),
)
def stale_parent_edges(spark, sf):
    return graph.stale_parent_edges(fx.inf(spark, sf), _edges(spark, sf))


@query(
    "born_stale",
    fx.with_tables("SELECT inf_id, bool_or(EXISTS (SELECT 1 FROM e WHERE e.to_id = l.parent_id AND e.at_pos < l.inf_pos)) AS stale FROM l GROUP BY inf_id", "sem_state", "inf", e=_EDGES, l=_LISTED),
)
def born_stale(spark, sf):
    return graph.born_stale(fx.inf(spark, sf), _edges(spark, sf))


#: Keys on which a record in conflict came, and when first; the fixture cuts valid times to 6 hours to have some.
_CONFLICTS = "SELECT s, p, min(log_pos) AS first_pos FROM co WHERE valid_at = head GROUP BY s, p"


@query(
    "staleness_by_rule",
    fx.with_tables(
        """SELECT inf_id, method, n_parents, n_superseded, CASE WHEN method = 'pattern_summarize' THEN 2*n_superseded > n_parents WHEN method = 'multi_source_consensus' THEN n_parents-n_superseded < 2
            WHEN method = 'conflict_reconciliation' THEN n_superseded > 0 OR conflict WHEN method = 'entity_count' THEN n_superseded > 0 OR inf_id%3 = 0 ELSE n_superseded > 0 END AS stale
        FROM (SELECT l.inf_id, l.method, count(*) AS n_parents, count(*) FILTER (l.parent_id IN (SELECT to_id FROM e)) AS n_superseded, bool_or(coalesce(x.first_pos > i.log_pos, false)) AS conflict
            FROM l JOIN inf i ON i.memory_id = l.inf_id LEFT JOIN x ON x.s = i.s AND x.p = i.p GROUP BY l.inf_id, l.method)""",
        "sem_state", "inf", "sem_coarse", e=_EDGES, l=_LISTED, co=fx.CTES["ranked"].replace("FROM sem", "FROM sem_coarse"), x=_CONFLICTS,
    ),
)
def staleness_by_rule(spark, sf):
    """All six rules: superseded parents, changed counts (every third row is taken to have one), conflicts after the row."""
    hit = _edges(spark, sf).select(F.col("to_id").alias("parent_id")).distinct().withColumn("hit", F.lit(1))
    rows = fx.inf(spark, sf)
    listed = rows.select(F.col("memory_id").alias("inf_id"), "method", "s", "p", "log_pos", F.explode("derived_from").alias("parent_id"))
    n = listed.join(hit, "parent_id", "left").groupBy("inf_id", "method", "s", "p", "log_pos").agg(F.count("*").alias("n_parents"), F.count("hit").alias("n_superseded"))
    bad = sp.semantic_history(fx.sem_coarse(spark, sf)).filter("kind = 'conflict'").groupBy("s", "p").agg(F.min("log_pos").alias("first_pos"))
    n = n.join(bad, ["s", "p"], "left")
    stale = inference.is_stale(F.col("method"), F.col("n_parents"), F.col("n_superseded"), F.col("inf_id") % 3 == 0, F.col("first_pos") > F.col("log_pos"))
    return n.select("inf_id", "method", "n_parents", "n_superseded", stale.alias("stale"))


def _with_parents(spark, sf):
    """Inferred rows with their parents' confidences in the order in which they are listed."""
    parents = fx.sem(spark, sf).select(F.col("memory_id").alias("parent_id"), F.col("confidence").alias("c"))
    listed = fx.inf(spark, sf).select("memory_id", "method", F.posexplode("derived_from").alias("k", "parent_id"))
    found = listed.join(parents, "parent_id").groupBy("memory_id", "method").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("all"))
    return found.select("memory_id", "method", F.transform("all", lambda x: x["c"]).alias("parents"))


_PARENTS = """SELECT i.memory_id, i.method, list(s.confidence ORDER BY i.k) AS ps FROM
    (SELECT memory_id, method, unnest(derived_from) AS parent_id, generate_subscripts(derived_from, 1) AS k FROM inf) i JOIN sem s ON s.memory_id = i.parent_id GROUP BY ALL"""
_MUL = "lambda a, b: (a*b+32767)//65535"


def _confidence(name: str, methods: dict[str, str]) -> None:
    cases = " ".join(f"WHEN method = '{m}' THEN {e}" for m, e in methods.items())
    names = ", ".join(f"'{m}'" for m in methods)
    sql = fx.with_tables(f"SELECT memory_id, method, CAST(CASE {cases} END AS BIGINT) AS confidence FROM ps WHERE method IN ({names})", "sem", "inf", ps=_PARENTS)

    def run(spark, sf):
        rows = _with_parents(spark, sf).filter(F.col("method").isin(*methods))
        return rows.select("memory_id", "method", inference.inferred_confidence(F.col("method"), F.col("parents")).alias("confidence"))

    query(name, sql)(run)


_confidence(
    "inference_min_family",
    {"direct_lookup": "ps[1]"} | {m: f"(list_min(ps)*{a}+{b // 2})//{b}" for m, (a, b) in inference.MIN_SCALES.items()},
)
_PRODUCT = f"list_reduce(list_prepend(CAST(65535 AS BIGINT), ps), {_MUL})"
_confidence("inference_product_family", {m: f"({_PRODUCT}*{a}+{b // 2})//{b}" for m, (a, b) in inference.PRODUCT_SCALES.items()})
_confidence("inference_noisy_or", {"multi_source_consensus": f"65535 - list_reduce(list_prepend(CAST(65535 AS BIGINT), list_transform(ps, lambda x: 65535-x)), {_MUL})"})
_confidence("inference_max", {"conflict_reconciliation": "(list_max(ps)*4+2)//5"})


@query(
    "inference_geomean",
    # An exact integer root: the largest r whose cube is within the product of three.
    fx.with_tables(
        """SELECT memory_id, CAST((r*4+2)//5 AS BIGINT) AS confidence FROM (SELECT memory_id, CASE WHEN (g+1)*(g+1)*(g+1) <= prod THEN g+1 WHEN g*g*g > prod THEN g-1 ELSE g END AS r
        FROM (SELECT memory_id, CAST(ps[1] AS HUGEINT)*ps[2]*ps[3] AS prod, CAST(floor(cbrt(CAST(ps[1] AS DOUBLE)*ps[2]*ps[3])) AS HUGEINT) AS g FROM ps WHERE method = 'pattern_summarize'))""",
        "sem", "inf", ps=_PARENTS,
    ),
)
def inference_geomean(spark, sf):
    rows = _with_parents(spark, sf).filter("method = 'pattern_summarize'")
    return rows.select("memory_id", inference.pattern_summarize(F.col("parents")).alias("confidence"))


def _rule(least: int, exact: bool, odd: bool) -> str:
    return f"n = {least}" if exact else f"n >= {least}" + (" AND n % 2 = 1" if odd else "")


@query(
    "parent_count_audit",
    fx.with_tables(
        "SELECT memory_id, method, n, CASE " + " ".join(f"WHEN method = '{m}' THEN {_rule(*r)}" for m, r in inference.PARENT_RULES.items()) + " END AS fits FROM (SELECT memory_id, method, len(derived_from) - (log_pos % 3 = 0)::INT AS n FROM inf)",
        "inf",
    ),
)
def parent_count_audit(spark, sf):
    """Every third row is taken to have lost a parent, so that some don't fit."""
    rows = fx.inf(spark, sf).select("memory_id", "method", (F.size("derived_from") - (F.col("log_pos") % 3 == 0).cast("int")).cast("long").alias("n"))
    return rows.withColumn("fits", inference.parents_fit(F.col("method"), F.col("n")))


@query("parent_index", fx.with_tables("SELECT parent_id, count(*) AS dependents, min(inf_id) AS first_dependent FROM l GROUP BY parent_id", "inf", l=_LISTED))
def parent_index(spark, sf):
    listed = fx.inf(spark, sf).select("memory_id", F.explode("derived_from").alias("parent_id"))
    return listed.groupBy("parent_id").agg(F.count("*").alias("dependents"), F.min("memory_id").alias("first_dependent"))
