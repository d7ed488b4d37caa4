"""One run over the draft store: recover stale claims, claim what is pending, apply decisions, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .drafts import STALE_CLAIM_MS

# What a processor may decide, and the state that a draft gets by it.
TARGETS = {"accepted": "accepted", "skipped": "skipped", "failed": "failed", "quarantined": "quarantined", "deferred": "pending"}


def run_once(drafts: DataFrame, decisions: DataFrame, now: int, lost: DataFrame | None = None, stale_after_ms: int = STALE_CLAIM_MS) -> DataFrame:
    """Each draft (id, state, claimed_at) with what the run did to it.

    ``decisions`` (id, decision) is what the processor makes of a draft;
    ``lost`` are ids that another runner claims between listing and claim.
    Columns added: recovered, claimed, missed, decision, final_state. A pending
    draft without a decision is deferred.
    """
    stale_before = now - stale_after_ms
    recovered = (F.col("state") == "processing") & F.coalesce(F.col("claimed_at") <= stale_before, F.lit(False))
    seen = recovered | (F.col("state") == "pending")
    rows = drafts.withColumn("recovered", recovered).withColumn("seen", seen).join(decisions.select("id", F.col("decision").alias("made")), "id", "left")
    if lost is not None:
        rows = rows.join(lost.select("id", F.lit(True).alias("gone")).distinct(), "id", "left")
    else:
        rows = rows.withColumn("gone", F.lit(False))
    missed = F.col("seen") & F.coalesce("gone", F.lit(False))
    claimed = F.col("seen") & ~F.coalesce("gone", F.lit(False))
    decision = F.when(claimed, F.coalesce("made", F.lit("deferred")))
    state = F.when(missed, "processing")
    for name, target in TARGETS.items():
        state = state.when(decision == name, target)
    return rows.select(
        *drafts.columns, "recovered", "seen", claimed.alias("claimed"), missed.alias("missed"), decision.alias("decision"),
        state.otherwise(F.col("state")).alias("final_state"),
    )


def summary(run: DataFrame, *by: str) -> DataFrame:
    """The nine counters of a run, over all drafts or by the columns ``by``."""
    made = (F.count_if(F.col("decision") == d).alias(d) for d in TARGETS)
    return run.groupBy(*by).agg(
        F.count_if("recovered").alias("recovered_processing"), F.count_if("seen").alias("pending_seen"), F.count_if("claimed").alias("claimed"),
        *made, F.count_if("missed").alias("claim_misses"),
    )
