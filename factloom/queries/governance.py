"""Multi-participant review and benchmark scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import quorum as qo
from ..operators import scoring as sc
from ..registry import query

_P = "SELECT e AS episode_id, 'p' || k AS participant_id FROM (SELECT DISTINCT doc_id//5 AS e FROM documents) CROSS JOIN (SELECT unnest(range(3)) AS k)"
_O = """SELECT doc_id//5 AS episode_id, (['independent', 'critique', 'revision'])[1+doc_id%3] AS round, 'p' || (doc_id%4) AS participant_id, 'out_' || doc_id AS output_id,
    CASE WHEN doc_id%13 = 0 THEN 2 ELSE 1 END AS schema_version FROM documents"""
_V = """SELECT doc_id//5 AS episode_id, 'p' || (doc_id%4) AS participant_id, CASE WHEN doc_id%17 = 0 THEN 1.5 ELSE quality*0.5 END AS confidence,
    CASE WHEN doc_id%19 = 0 THEN '  ' ELSE 'because' END AS rationale FROM labels"""
_Q = dict(participants=_P, outputs=_O, votes=_V)


def _participants(spark, sf):
    episodes = fx.table(spark, sf, "documents").select(F.expr("doc_id div 5").alias("episode_id")).distinct()
    return episodes.select("episode_id", F.explode(F.array(*(F.lit(f"p{k}") for k in range(3)))).alias("participant_id"))


def _outputs(spark, sf):
    d, i = fx.table(spark, sf, "documents"), F.col("doc_id")
    return d.select(
        F.expr("doc_id div 5").alias("episode_id"), fx.pick(qo.ROUNDS, i % 3).alias("round"), F.concat(F.lit("p"), (i % 4).cast("string")).alias("participant_id"),
        F.concat(F.lit("out_"), i.cast("string")).alias("output_id"), F.when(i % 13 == 0, 2).otherwise(1).alias("schema_version"),
    )


def _votes(spark, sf):
    i = F.col("doc_id")
    return fx.table(spark, sf, "labels").select(
        F.expr("doc_id div 5").alias("episode_id"), F.concat(F.lit("p"), (i % 4).cast("string")).alias("participant_id"),
        F.when(i % 17 == 0, 1.5).otherwise(F.col("quality") * 0.5).alias("confidence"), F.when(i % 19 == 0, "  ").otherwise("because").alias("rationale"),
    )


@query(
    "round_completeness",
    fx.with_tables(
        "SELECT p.episode_id, r.round, p.participant_id FROM participants p CROSS JOIN (SELECT unnest(['independent', 'critique', 'revision']) AS round) r WHERE NOT EXISTS (SELECT 1 FROM outputs o WHERE o.episode_id = p.episode_id AND o.round = r.round AND o.participant_id = p.participant_id)",
        **_Q,
    ),
)
def round_completeness(spark, sf):
    return qo.missing_outputs(_participants(spark, sf), _outputs(spark, sf))


_VISIBLE = """SELECT o.output_id, count(v.output_id) AS visible, max(v.output_id) AS last_visible FROM outputs o LEFT JOIN outputs v ON v.episode_id = o.episode_id
    AND (o.round = 'critique' AND v.round = 'independent' OR o.round = 'revision' AND v.round IN ('independent', 'critique')) GROUP BY o.output_id"""


@query("visible_outputs", fx.with_tables(_VISIBLE, **_Q))
def visible_outputs(spark, sf):
    out = qo.visible_prior(_outputs(spark, sf))
    return out.select("output_id", F.size("visible_ids").cast("long").alias("visible"), F.array_max("visible_ids").alias("last_visible"))


@query(
    "output_audit",
    fx.with_tables(
        """SELECT o.output_id, CASE WHEN schema_version <> 1 THEN 'schema_version' WHEN output_id = '' THEN 'output_id' WHEN NOT EXISTS (SELECT 1 FROM participants p WHERE p.episode_id = o.episode_id AND p.participant_id = o.participant_id) THEN 'unknown_participant'
            WHEN (SELECT count(*) FROM outputs v WHERE v.episode_id = o.episode_id AND (o.round = 'critique' AND v.round = 'independent' OR o.round = 'revision' AND v.round IN ('independent', 'critique'))) > 2 THEN 'visible_prior_ids' END AS reject_reason FROM outputs o""",
        **_Q,
    ),
)
def output_audit(spark, sf):
    """Each output lists at most two of the outputs that it could see, so some lists are short."""
    outputs = _outputs(spark, sf)
    listed = qo.visible_prior(outputs).select("output_id", F.slice("visible_ids", 1, 2).alias("listed_ids"))
    return qo.audit_outputs(outputs.join(listed, "output_id"), _participants(spark, sf)).select("output_id", "reject_reason")


@query("first_outputs", fx.with_tables("SELECT episode_id, round, participant_id, min(output_id) AS output_id, count(*)-1 AS rejected FROM outputs GROUP BY ALL", **_Q))
def first_outputs(spark, sf):
    return qo.one_output_each(_outputs(spark, sf))


_VOTE_AUDIT = """SELECT p.episode_id, p.participant_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN low < 0 OR high > 1 THEN 'confidence_range' WHEN blank THEN 'blank_rationale' END AS problem
        FROM participants p LEFT JOIN (SELECT episode_id, participant_id, count(*) AS n, min(confidence) AS low, max(confidence) AS high, bool_or(trim(rationale) = '') AS blank FROM votes GROUP BY ALL) v USING (episode_id, participant_id)
        UNION ALL SELECT DISTINCT episode_id, participant_id, 'unknown_participant' FROM votes v WHERE NOT EXISTS (SELECT 1 FROM participants p WHERE p.episode_id = v.episode_id AND p.participant_id = v.participant_id)"""


@query("vote_set_audit", fx.with_tables(_VOTE_AUDIT, **_Q))
def vote_set_audit(spark, sf):
    return qo.audit_votes(_votes(spark, sf), _participants(spark, sf))


@query("evidence_uris", fx.with_tables("SELECT episode_id, string_agg('quorum-output://' || episode_id || '/' || round || '/' || output_id, ' ' ORDER BY participant_id, output_id) AS uris FROM outputs GROUP BY episode_id", **_Q))
def evidence_uris(spark, sf):
    return qo.evidence(_outputs(spark, sf))


# Extension: a tally of votes, which are otherwise only recorded.
@query("vote_tally", fx.with_tables("SELECT episode_id, count(*) AS votes, count(*) FILTER (confidence >= 0.5) AS agree FROM votes GROUP BY episode_id", **_Q))
def vote_tally(spark, sf):
    return _votes(spark, sf).groupBy("episode_id").agg(F.count("*").alias("votes"), F.count_if(F.col("confidence") >= 0.5).alias("agree"))


# -- scoring --------------------------------------------------------------------

# Facts of a ground truth of 20: some totals are off, some arms lack a field, some runs did not recover.
_SCORES = """SELECT *, 20 - correct - prompted - wrong + CASE WHEN (scenario+k)%9 = 0 THEN 1 ELSE 0 END AS silent FROM (
    SELECT c_custkey AS scenario, b AS baseline, k, CASE WHEN (c_custkey*(3+k))%7 = 0 OR c_custkey%17 = 0 THEN NULL ELSE CAST(1+(c_custkey*(5+k))%11 AS DOUBLE) END AS minutes, c_custkey%17 > 0 AS did_not_recover,
    (c_custkey+7*k)%21 AS correct, CASE WHEN c_custkey%31 = 5 AND k = 2 THEN NULL ELSE (c_custkey%5) END AS prompted, c_custkey%3 AS wrong, 20 AS facts,
    (c_custkey+k)%4 AS hallucinations, (c_custkey*k)%5 AS decisions, CASE WHEN b = 'D' THEN 0 ELSE (c_custkey+3*k)%3 END AS stale, 1000+(c_custkey*(11+k))%500 AS input_tokens, (c_custkey*k)%300 AS output_tokens
    FROM customer CROSS JOIN (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3)) t(b, k))"""
_SUMMARY = """SELECT scenario, baseline, minutes IS NULL AS did_not_recover, minutes, round_even(correct*10000.0::DOUBLE/facts, 0)/10000 AS correct_pct, hallucinations,
    CASE WHEN decisions = 0 THEN 0.0 ELSE round_even(hallucinations*10000.0::DOUBLE/decisions, 0)/10000 END AS hallucination_rate, stale, input_tokens+output_tokens AS tokens FROM scores"""


def _scores(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("scenario"), F.posexplode(F.array(*(F.lit(b) for b in "ABCD"))).alias("k", "baseline"))
    s, k = F.col("scenario"), F.col("k")
    rows = c.select(
        "scenario", "baseline", "k", F.when(((s * (3 + k)) % 7 != 0) & (s % 17 != 0), (1 + (s * (5 + k)) % 11).cast("double")).alias("minutes"), (s % 17 > 0).alias("did_not_recover"),
        ((s + 7 * k) % 21).alias("correct"), F.when((s % 31 != 5) | (k != 2), s % 5).alias("prompted"), (s % 3).alias("wrong"), F.lit(20).alias("facts"),
        ((s + k) % 4).alias("hallucinations"), ((s * k) % 5).alias("decisions"), F.when(F.col("baseline") == "D", 0).otherwise((s + 3 * k) % 3).alias("stale"),
        (1000 + (s * (11 + k)) % 500).alias("input_tokens"), ((s * k) % 300).alias("output_tokens"),
    )
    return rows.withColumn("silent", 20 - F.col("correct") - F.col("prompted") - F.col("wrong") + F.when((s + k) % 9 == 0, 1).otherwise(0))


@query("score_summary", fx.with_tables("SELECT * FROM summary", scores=_SCORES, summary=_SUMMARY))
def score_summary(spark, sf):
    return sc.summarise(_scores(spark, sf))


_METRICS = (("minutes", "lower"), ("correct_pct", "higher"), ("hallucination_rate", "lower"), ("stale", "lower"), ("tokens", "lower"))
_LONG = " UNION ALL ".join(
    f"SELECT scenario, baseline, '{m}' AS metric, {'-1' if d == 'lower' else '1'} * coalesce(CAST({m} AS DOUBLE), {'CAST(1e308 AS DOUBLE)' if d == 'lower' else '-1e308'}) AS good FROM summary" for m, d in _METRICS
)
_BEST = "SELECT scenario, metric, arg_min(baseline, struct_pack(g := -good, b := baseline)) AS best, max(good) AS best_good FROM long WHERE baseline <> 'D' GROUP BY ALL"
_WINS = "SELECT b.scenario, count(*) FILTER (d.good > b.best_good) AS wins FROM best b JOIN long d ON d.scenario = b.scenario AND d.metric = b.metric AND d.baseline = 'D' GROUP BY b.scenario"
_VERDICT = """SELECT w.scenario, w.wins, d.hallucinations <= b.hallucinations AS hallucinations_ok, d.stale < b.stale AS staleness_ok, w.wins >= 3 AND d.hallucinations <= b.hallucinations AND d.stale < b.stale AS win
    FROM wins w JOIN summary d ON d.scenario = w.scenario AND d.baseline = 'D' JOIN summary b ON b.scenario = w.scenario AND b.baseline = 'B'"""
_SC = dict(scores=_SCORES, summary=_SUMMARY, long=_LONG, best=_BEST, wins=_WINS, verdict=_VERDICT)


@query("best_baseline", fx.with_tables("SELECT scenario, metric, best FROM best", **_SC))
def best_baseline(spark, sf):
    return sc.best_of_others(sc.summarise(_scores(spark, sf))).select("scenario", "metric", "best")


@query("scenario_verdict", fx.with_tables("SELECT * FROM verdict", **_SC))
def scenario_verdict(spark, sf):
    return sc.scenario_verdicts(sc.summarise(_scores(spark, sf)))


_COMPLETE = """SELECT scenario, missing, transcripts_ready, missing = 0 AND transcripts_ready AS complete FROM (SELECT scenario, CAST(sum((minutes IS NULL AND NOT did_not_recover)::INT + (prompted IS NULL)::INT
    + (silent IS NULL)::INT) AS BIGINT) AS missing, bool_and(scenario%13 > 0) AS transcripts_ready FROM scores GROUP BY scenario)"""


def _complete(spark, sf):
    return sc.completeness(_scores(spark, sf), F.col("scenario") % 13 > 0)


@query("completeness_audit", fx.with_tables("SELECT * FROM complete", scores=_SCORES, complete=_COMPLETE))
def completeness_audit(spark, sf):
    """Missing fields of each scenario's arms, and whether its transcripts are there."""
    return _complete(spark, sf)


@query(
    "benchmark_verdict",
    fx.with_tables(
        """SELECT c.complete AND c.scenario%2 = 0 AS "group", count(*) AS scenarios, count(*) FILTER (complete) AS complete_scenarios, count(*) FILTER (complete AND win) AS wins, (2*count(*) FILTER (complete)+2)//3 AS required_wins,
        count(*) = count(*) FILTER (complete) AND count(*) FILTER (complete AND win) >= (2*count(*) FILTER (complete)+2)//3 AS benchmark_win FROM complete c LEFT JOIN verdict v USING (scenario) GROUP BY ALL""",
        **_SC, complete=_COMPLETE,
    ),
)
def benchmark_verdict(spark, sf):
    """Two benchmarks: complete scenarios of even number, and the others, among which some lack fields."""
    even = F.col("complete") & (F.col("scenario") % 2 == 0)
    return sc.benchmark_verdict(sc.scenario_verdicts(sc.summarise(_scores(spark, sf))), _complete(spark, sf).withColumn("group", even), by=("group",))


@query(
    "score_audit",
    fx.with_tables("SELECT scenario, baseline, CASE WHEN minutes > 10 THEN 'time_over_cutoff' WHEN decisions = 0 THEN 'no_decisions' WHEN stale > 1 THEN 'stale_over_tests' WHEN correct+prompted+wrong+silent <> facts THEN 'fact_total' WHEN hallucinations > decisions THEN 'hallucinations_over_total' END AS problem FROM scores", scores=_SCORES),
)
def score_audit(spark, sf):
    return sc.audit(_scores(spark, sf), cutoff=10.0, staleness_tests=1)


@query(
    "transcript_status",
    """SELECT doc_id, CASE WHEN doc_id%11 = 0 THEN 'missing' WHEN doc_id%11 = 1 THEN 'not_file' WHEN trim(t) = '' THEN 'empty' WHEN contains(t, '<paste full agent transcript here>') THEN 'placeholder' WHEN NOT contains(t, 'that') OR NOT contains(t, 'the') THEN 'missing_prompt_evidence' ELSE 'captured' END AS status
    FROM (SELECT doc_id, CASE WHEN doc_id%11 = 2 THEN '  ' WHEN doc_id%11 = 3 THEN 'x <paste full agent transcript here>' ELSE text END AS t FROM documents)""",
)
def transcript_status(spark, sf):
    i = F.col("doc_id")
    t = F.when(i % 11 == 2, "  ").when(i % 11 == 3, "x <paste full agent transcript here>").otherwise(F.col("text"))
    return fx.table(spark, sf, "documents").select("doc_id", sc.transcript_status(i % 11 != 0, i % 11 != 1, t, "that", "the").alias("status"))
