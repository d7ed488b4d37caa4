"""Review by several participants in three rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The rounds, and which of them an output of each round can see.
ROUNDS = ("independent", "critique", "revision")
SEES = {"critique": ("independent",), "revision": ("independent", "critique")}


def missing_outputs(participants: DataFrame, outputs: DataFrame) -> DataFrame:
    """Participants without an output in a round."""
    wanted = participants.withColumn("round", F.explode(F.array(*(F.lit(r) for r in ROUNDS))))
    return wanted.join(outputs, ["episode_id", "round", "participant_id"], "left_anti").select("episode_id", "round", "participant_id")


def visible_prior(outputs: DataFrame) -> DataFrame:
    """``outputs`` with visible_ids: the sorted ids of the earlier rounds of the episode."""
    by_round = outputs.groupBy("episode_id").agg(*(F.sort_array(F.collect_set(F.when(F.col("round") == r, F.col("output_id")))).alias(r) for r in SEES["revision"]))
    seen = F.when(F.col("round") == "critique", F.col("independent")).when(F.col("round") == "revision", F.sort_array(F.concat("independent", "critique")))
    return outputs.join(by_round, "episode_id").withColumn("visible_ids", F.coalesce(seen, F.array().cast("array<string>"))).drop("independent", "critique")


def audit_outputs(outputs: DataFrame, participants: DataFrame, schema_version: int = 1) -> DataFrame:
    """``outputs`` (with listed_ids) and the first rule that an output breaks."""
    known = participants.select("episode_id", "participant_id", F.lit(True).alias("known"))
    judged = visible_prior(outputs).join(known, ["episode_id", "participant_id"], "left")
    listed = F.array_distinct("listed_ids")
    exact = (F.sort_array(listed) == F.col("visible_ids")) & (F.size(listed) == F.size("listed_ids"))
    reason = (
        F.when(F.col("schema_version") != schema_version, "schema_version").when(F.col("output_id") == "", "output_id")
        .when(F.col("known").isNull(), "unknown_participant").when(~exact, "visible_prior_ids")
    )
    return judged.withColumn("reject_reason", reason)


def one_output_each(outputs: DataFrame) -> DataFrame:
    """The output that counts for each participant and round, and how many more were rejected."""
    w = Window.partitionBy("episode_id", "round", "participant_id")
    ranked = outputs.withColumns({"turn": F.row_number().over(w.orderBy("output_id")), "rejected": F.count("*").over(w) - 1})
    return ranked.filter("turn = 1").select("episode_id", "round", "participant_id", "output_id", "rejected")


def audit_votes(votes: DataFrame, participants: DataFrame) -> DataFrame:
    """One row for each participant, and one for each voter that is none, with what is wrong if anything."""
    cast = votes.groupBy("episode_id", "participant_id").agg(
        F.count("*").alias("n"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.bool_or(F.trim("rationale") == "").alias("blank")
    )
    problem = (
        F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when((F.col("low") < 0) | (F.col("high") > 1), "confidence_range")
        .when(F.col("blank"), "blank_rationale")
    )
    keys = ["episode_id", "participant_id"]
    strangers = cast.join(participants, keys, "left_anti").select(*keys, F.lit("unknown_participant").alias("problem"))
    return participants.join(cast, keys, "left").select(*keys, problem.alias("problem")).unionByName(strangers)


def evidence(outputs: DataFrame) -> DataFrame:
    uri = F.concat(F.lit("quorum-output://"), F.concat_ws("/", F.col("episode_id").cast("string"), "round", "output_id"))
    listed = outputs.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("participant_id", "output_id", uri.alias("uri")))).alias("x"))
    return listed.select("episode_id", F.array_join(F.transform("x", lambda e: e["uri"]), " ").alias("uris"))


def audit_synthesis(proposed: DataFrame, votes: DataFrame, participants: DataFrame, schema_version: int = 1) -> DataFrame:
    """``proposed`` (with wanted_episode_id) and the first rule that a proposed synthesis breaks."""
    bad_votes = audit_votes(votes, participants).filter("problem is not null").groupBy("episode_id").agg(F.lit(True).alias("votes_bad"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    out = F.when(F.col("schema_version") != schema_version, "schema_version").when(blank("episode_id"), "episode_id").when(F.col("episode_id") != F.col("wanted_episode_id"), "other_episode")
    out = out.when(blank("recommendation"), "recommendation").when(F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence")
    for c in ("supporting_points", "dissenting_points", "unresolved_questions", "evidence_used", "proposed_memory_drafts"):
        out = out.when(F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x) == ""), c)
    joined = proposed.join(bad_votes.withColumnRenamed("episode_id", "wanted_episode_id"), "wanted_episode_id", "left")
    return joined.withColumn("reject_reason", out.when(F.col("votes_bad"), "participant_votes")).drop("votes_bad")


def in_round_order(outputs: DataFrame) -> DataFrame:
    """``outputs`` with ``place``: within the episode by round, participant and output id, from 1."""
    turn = F.array_position(F.array(*(F.lit(r) for r in ROUNDS)), F.col("round"))
    return outputs.withColumn("place", F.row_number().over(Window.partitionBy("episode_id").orderBy(turn, "participant_id", "output_id")).cast("long"))
