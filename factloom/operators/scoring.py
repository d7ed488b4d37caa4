"""Scores of recovery benchmarks: summaries, best baselines, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Metrics and their direction; the arm that is judged and the one that guards it.
METRICS = (("minutes", "lower"), ("correct_pct", "higher"), ("hallucination_rate", "lower"), ("stale", "lower"), ("tokens", "lower"))
JUDGED, GUARD, WINS_NEEDED = "D", "B", 3


def _share(part: Column, whole: Column) -> Column:
    """Four decimals, ties to even."""
    return F.bround(part * 10_000.0 / whole) / 10_000


def summarise(scores: DataFrame) -> DataFrame:
    rate = F.when(F.col("decisions") == 0, 0.0).otherwise(_share(F.col("hallucinations"), F.col("decisions")))
    return scores.select(
        "scenario", "baseline", F.col("minutes").isNull().alias("did_not_recover"), "minutes", _share(F.col("correct"), F.col("facts")).alias("correct_pct"),
        "hallucinations", rate.alias("hallucination_rate"), "stale", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
    )


def _good(metric: str, direction: str) -> Column:
    """Larger is better, an absent value is the worst."""
    value = F.col(metric).cast("double")
    return -F.coalesce(value, F.lit(float("inf"))) if direction == "lower" else F.coalesce(value, F.lit(float("-inf")))


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` by scenario, ahead of what groups them: scenarios have few arms, so to group in front of
    the shuffle as well saves little and sorts a whole file's rows in one task.
    """
    return rows.repartition("scenario")


def best_of_others(summary: DataFrame) -> DataFrame:
    """The best arm but the judged one, for each metric; the first arm wins ties."""
    others = summary.filter(F.col("baseline") != JUDGED).select("scenario", "baseline", *((-_good(*m)).alias(f"bad_{m[0]}") for m in METRICS))
    best = _dealt(others).groupBy("scenario").agg(*(F.min(F.struct(F.col(f"bad_{m}").alias("bad"), "baseline")).alias(m) for m, _ in METRICS))
    one = lambda m: F.struct(F.lit(m).alias("metric"), F.col(m)["baseline"].alias("best"), (-F.col(m)["bad"]).alias("best_good"))
    return best.select("scenario", F.inline(F.array(*(one(m) for m, _ in METRICS))))


def scenario_verdicts(summary: DataFrame) -> DataFrame:
    """One sort by scenario holds all that a scenario is judged by; a repeated arm is judged as often as it stands there."""
    arms = summary.filter(F.col("scenario").isNotNull()).select("scenario", "baseline", "hallucinations", "stale", *((-_good(*m)).alias(f"bad_{m[0]}") for m in METRICS))
    bad, whole = [f"bad_{m}" for m, _ in METRICS], Window.partitionBy("scenario")
    others = [F.min(F.when(F.col("baseline") != JUDGED, F.col(c))).over(whole) for c in bad]
    won = sum((F.when(F.col(c) < least, 1).otherwise(0) for c, least in zip(bad, others, strict=True)), F.lit(0))
    guards = F.collect_list(F.when(F.col("baseline") == GUARD, F.struct("hallucinations", "stale"))).over(whole)
    judged = _dealt(arms).select("scenario", "baseline", "hallucinations", "stale", won.alias("won"), guards.alias("guards"))
    judged = judged.withColumn("wins", F.sum(F.when(F.col("baseline") == JUDGED, F.col("won"))).over(whole)).filter(F.col("baseline") == JUDGED)
    out = judged.select("scenario", "wins", "hallucinations", "stale", F.explode("guards").alias("guard"))
    fine, fresh = F.col("hallucinations") <= F.col("guard.hallucinations"), F.col("stale") < F.col("guard.stale")
    return out.select("scenario", "wins", fine.alias("hallucinations_ok"), fresh.alias("staleness_ok"), ((F.col("wins") >= WINS_NEEDED) & fine & fresh).alias("win"))


def benchmark_verdict(verdicts: DataFrame, scenarios: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Won if all scenarios are complete and at least two thirds of them are won.

    ``scenarios`` (scenario, complete) lists all of them; without it those with a verdict are all there are.
    Each value of its columns ``by`` is a benchmark of its own.
    """
    known = scenarios if scenarios is not None else verdicts.select("scenario", F.lit(True).alias("complete"))
    # Sizes told from the files do not count the arms: no verdicts are broadcast on their word. Both sides are dealt by scenario.
    rows = known.join(verdicts.select("scenario", "win").hint("merge"), "scenario", "left")
    out = rows.groupBy(*by).agg(F.count("*").alias("scenarios"), F.count_if("complete").alias("complete_scenarios"), F.count_if(F.col("complete") & F.col("win")).alias("wins"))
    out = out.withColumn("required_wins", F.expr("(2 * complete_scenarios + 2) div 3"))
    whole = (F.col("scenarios") > 0) & (F.col("complete_scenarios") == F.col("scenarios"))
    return out.withColumn("benchmark_win", whole & (F.col("wins") >= F.col("required_wins")))


# What a score row must hold to be complete.
SCORE_FIELDS = ("minutes", "correct", "prompted", "wrong", "silent", "hallucinations", "decisions", "stale", "input_tokens", "output_tokens")


def completeness(scores: DataFrame, transcripts_ready: Column | None = None) -> DataFrame:
    """scenario, missing fields over its arms, and whether it is complete; a run that did not recover has its minutes in ``did_not_recover``."""
    gone = [F.col(c).isNull() if c != "minutes" else F.col(c).isNull() & ~F.coalesce("did_not_recover", F.lit(False)) for c in SCORE_FIELDS]
    missing = sum((g.cast("long") for g in gone), F.lit(0).cast("long"))
    ready = F.lit(True) if transcripts_ready is None else transcripts_ready
    arms = _dealt(scores.select("scenario", missing.alias("missing"), ready.alias("ready")))
    out = arms.groupBy("scenario").agg(F.sum("missing").alias("missing"), F.bool_and("ready").alias("transcripts_ready"))
    return out.withColumn("complete", (F.col("missing") == 0) & F.col("transcripts_ready"))


def audit(scores: DataFrame, cutoff: float, staleness_tests: int) -> DataFrame:
    """The first rule that a complete score row breaks; ``facts`` is the number of facts in the scenario's ground truth."""
    total = F.col("correct") + F.col("prompted") + F.col("wrong") + F.col("silent")
    problem = (
        F.when(F.col("minutes") > cutoff, "time_over_cutoff").when(F.col("decisions") == 0, "no_decisions")
        .when(F.col("stale") > staleness_tests, "stale_over_tests").when(total != F.col("facts"), "fact_total")
        .when(F.col("hallucinations") > F.col("decisions"), "hallucinations_over_total")
    )
    return scores.select("scenario", "baseline", problem.alias("problem"))


def transcript_status(exists: Column, is_file: Column, text: Column, prompt: str, instruction: str) -> Column:
    return (
        F.when(~exists, "missing").when(~is_file, "not_file").when(F.trim(text) == "", "empty")
        .when(F.contains(text, F.lit("<paste full agent transcript here>")), "placeholder")
        .when(~F.contains(text, F.lit(prompt)) | ~F.contains(text, F.lit(instruction)), "missing_prompt_evidence").otherwise("captured")
    )
