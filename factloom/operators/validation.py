"""Admission of records: one reason for each row, the first rule that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decay, inference


def _admits(kind: str, source: Column) -> Column:
    return source.isin(*(s for s, kinds in decay.SOURCE_ADMITS.items() if kind in kinds))


def semantic_reason(wall: Column) -> Column:
    """For columns source, confidence, valid_at, projected; null if the row is good."""
    return (
        F.when(F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > decay.FULL), "confidence_range")
        .when(~_admits("sem", F.col("source")), "source_not_admitted")
        .when(F.col("confidence") > decay.lookup(decay.SOURCE_BOUNDS, F.col("source")), "confidence_bound")
        .when((F.col("valid_at") > wall) & ~F.col("projected"), "future_validity")
    )


def episodic_reason() -> Column:
    return (
        F.when(F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > decay.FULL), "confidence_range")
        .when(~_admits("epi", F.col("source")), "source_not_admitted")
        .when(F.col("confidence") > decay.lookup(decay.SOURCE_BOUNDS, F.col("source")), "confidence_bound")
        .when(F.col("observed_at") < F.col("at_time"), "clock_order")
    )


def procedural_reason() -> Column:
    """For columns source, confidence and scope; triggers and actions may be anything."""
    return (
        F.when(F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > decay.FULL), "confidence_range")
        .when(F.col("scope").isNull(), "missing_scope")
        .when(~_admits("pro", F.col("source")), "source_not_admitted")
        .when(F.col("confidence") > decay.lookup(decay.SOURCE_BOUNDS, F.col("source")), "confidence_bound")
    )


def inferential_reason(wall: Column) -> Column:
    """For columns derived_from, method, confidence, valid_at, projected. How many parents a method wants isn't asked on write."""
    return (
        F.when(~F.col("method").isin(*inference.PARENT_RULES), "unregistered_method")
        .when(F.coalesce(F.size("derived_from"), F.lit(0)) < 1, "empty_derived_from")
        .when(F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > decay.FULL), "confidence_range")
        .when((F.col("valid_at") > wall) & ~F.col("projected"), "future_validity")
    )


# Fixed value: bytes of an episode's label at most.
LABEL_BYTES = 256


def episode_reason(directives_of_batch: Column) -> Column:
    """For column label and the number of episode forms in the batch."""
    return F.when(F.octet_length("label") > LABEL_BYTES, "label_too_long").when(directives_of_batch > 1, "multiple_episode_directives")


def merged_metadata(form: DataFrame, given: DataFrame) -> DataFrame:
    """Episode metadata by episode_id: what the form says wins, what it leaves out comes from the caller."""
    theirs = given.select("episode_id", *(F.col(c).alias(f"given_{c}") for c in ("label", "parent", "retracts")))
    out = form.join(theirs, "episode_id", "full_outer")
    empty = F.coalesce(F.size("retracts"), F.lit(0)) < 1
    return out.select(
        "episode_id", F.coalesce("label", "given_label").alias("label"), F.coalesce("parent", "given_parent").alias("parent"),
        F.when(empty, F.col("given_retracts")).otherwise(F.col("retracts")).alias("retracts"),
    )


def accept(rows: DataFrame, reason: Column, batch: str | None = None) -> DataFrame:
    """Rows without a reason; with ``batch``, only of batches in which every row is good."""
    judged = rows.withColumn("reject_reason", reason)
    if batch is None:
        return judged.filter("reject_reason is null").drop("reject_reason")
    bad = judged.filter("reject_reason is not null").select(batch).distinct()
    return judged.join(bad, batch, "left_anti").drop("reject_reason")


# The fields in which a record must equal a stored one to be its duplicate, and whether valid times are compared.
DUPLICATE_FIELDS = {
    "sem": ("s", "p", "o", "source", "confidence", "projected"), "pro": ("rule_id", "trigger", "action", "precondition", "scope", "source", "confidence"),
    "inf": ("s", "p", "o", "derived_from", "method", "confidence", "projected"),
    "epi": ("event_id", "kind", "participants", "location", "at_time", "observed_at", "source", "confidence"),
}
DATED = ("sem", "inf")


def duplicates(candidates: DataFrame, store: DataFrame, kind: str, window_ms: int = 0) -> DataFrame:
    """(memory_id, duplicate): whether the store, as it was, has a row equal in all fields; nulls equal nulls.

    Valid times may differ by ``window_ms``, none by default: the band join
    works on buckets of that width, each candidate looking into three of them.
    Equality is tested on one digest of the fields, and again on the fields.
    """
    fields = DUPLICATE_FIELDS[kind]
    digest = F.xxhash64(*(F.to_json(F.array(c)) for c in fields))
    own = candidates.select("memory_id", digest.alias("digest"), *((F.col("valid_at"),) if kind in DATED else ()), *fields)
    there = store.select(digest.alias("digest"), *((F.col("valid_at").alias("other_at"),) if kind in DATED else ()), *(F.col(c).alias(f"their_{c}") for c in fields)).distinct()
    keys = ["digest"]
    if kind in DATED:
        width = F.lit(max(1, 2 * window_ms))
        bucket = lambda c: F.floor(F.col(c) / width)
        near = [bucket("valid_at")] if window_ms == 0 else [bucket("valid_at") - 1, bucket("valid_at"), bucket("valid_at") + 1]
        own, there, keys = own.withColumn("bucket", F.explode(F.array(*near))), there.withColumn("bucket", bucket("other_at")), [*keys, "bucket"]
    equal = F.lit(True)
    for c in fields:
        equal = equal & F.col(c).eqNullSafe(F.col(f"their_{c}"))
    if kind in DATED:
        equal = equal & (F.abs(F.col("valid_at") - F.col("other_at")) <= window_ms)
    found = own.join(there, keys).filter(equal).select("memory_id").distinct().withColumn("duplicate", F.lit(True))
    return candidates.select("memory_id").join(found, "memory_id", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))
