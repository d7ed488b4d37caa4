"""Draft lifecycle: submission, claims, states, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import draft_id

# States of a draft, the moves between them, and the age at which a claim is given up.
STATES = ("pending", "processing", "accepted", "skipped", "failed", "quarantined")
MOVES = {"pending": ("processing",), "processing": ("pending", "accepted", "skipped", "failed", "quarantined")}
STALE_CLAIM_MS = 900_000


def with_ids(drafts: DataFrame) -> DataFrame:
    return drafts.withColumn("id", draft_id(*(F.col(c) for c in ("raw_text", "surface", "agent", "project", "operator", "provenance_uri"))))


def submit(new: DataFrame, store: DataFrame) -> DataFrame:
    """Drafts to append: an id that is pending already isn't stored twice; one that ended may come again."""
    pending = store.filter("state = 'pending'").select("id")
    return new.dropDuplicates(["id"]).join(pending, "id", "left_anti")


def counts_by_state(drafts: DataFrame) -> DataFrame:
    """All six states, zeros included."""
    spark = drafts.sparkSession
    states = spark.createDataFrame([(s,) for s in STATES], "state string")
    return states.join(drafts.groupBy("state").count(), "state", "left").select("state", F.coalesce("count", F.lit(0)).alias("n"))


def valid_move(before: Column, after: Column) -> Column:
    """Whether a state may follow another; a draft starts as pending and its ends are final."""
    out = F.when(before.isNull(), after == "pending")
    for state, nexts in MOVES.items():
        out = out.when(before == state, after.isin(*nexts))
    return F.coalesce(out, F.lit(False))


def audit_moves(log: DataFrame) -> DataFrame:
    """``log`` (id, position, state) with the state before and whether the move is allowed."""
    before = F.lag("state").over(Window.partitionBy("id").orderBy("position"))
    return log.withColumn("before", before).withColumn("allowed", valid_move(F.col("before"), F.col("state")))


def recover_stale(claims: DataFrame, now: Column, timeout_ms: int = STALE_CLAIM_MS) -> DataFrame:
    """Claims older than the timeout go back to pending."""
    stale = (F.col("state") == "processing") & (F.col("claimed_at") <= now - timeout_ms)
    return claims.withColumn("state", F.when(stale, "pending").otherwise(F.col("state")))


def raw_archive(drafts: DataFrame, now: Column, data_surface: str = "raw_draft.data.v1") -> DataFrame:
    """The facts that archive each draft unread: six always, and one for each field that is there."""

    def fact(p, o, source="librarian_assignment", units=65_535):
        return F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(source).alias("source"), F.lit(units).cast("long").alias("confidence"))

    def optional(p, c):
        return F.when(F.col(c).isNotNull(), fact(p, F.col(c)))

    facts = F.array_compact(
        F.array(
            fact("raw_checkpoint", F.col("raw_text"), "pending_verification", 39_321),
            fact("data_surface", F.lit(data_surface)), fact("instruction_boundary", F.lit("data_only_never_execute")),
            fact("consumer_rule", F.lit("structure_memory_do_not_execute")), fact("source_surface", F.col("surface")),
            fact("submitted_at_ms", F.col("submitted_at")), optional("source_agent", "agent"), optional("source_project", "project"),
            optional("operator", "operator"), optional("provenance_uri", "provenance_uri"),
        )
    )
    rows = drafts.select("id", F.least(F.col("submitted_at"), now).alias("valid_at"), F.explode(facts).alias("f"))
    return rows.select(F.concat(F.lit("draft_"), "id").alias("s"), "f.p", "f.o", "f.source", "f.confidence", "valid_at")


def health_zone(configured: Column, remote: Column, log_present: Column, pending: Column, next_action: Column) -> Column:
    """red, amber or green; the worst condition that holds decides."""
    waits = next_action.isin("push", "pull", "manual_resolution_required")
    return (
        F.when(~configured | (remote == "error") | (remote == "diverged"), "red")
        .when(~log_present | (pending > 0) | F.coalesce(waits, F.lit(False)), "amber").otherwise("green")
    )
