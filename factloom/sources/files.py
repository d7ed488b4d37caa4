"""Draft folders, text sweeps, review artifacts and score files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRAFT_SCHEMA = (
    "schema_version int, id string, source_surface string, source_agent string, source_project string, operator string, "
    "provenance_uri string, context_tags array<string>, submitted_at long, raw_text string"
)
SCORE_SCHEMA = (
    "scenario string, baseline string, minutes double, correct long, prompted long, wrong long, silent long, hallucinations long, "
    "decision_total long, stale_occurrences long, input_tokens long, output_tokens long"
)
#: Endings of the files that a sweep takes.
SWEPT = "*.{md,markdown,txt}"


def read_drafts(spark: SparkSession, folder: str) -> DataFrame:
    """Drafts below ``folder``/state=.../; the state is a partition column, so filters on it prune folders."""
    return spark.read.schema(DRAFT_SCHEMA).option("basePath", folder).json(f"{folder}/state=*")


def write_drafts(drafts: DataFrame, folder: str) -> None:
    """Append drafts; the column ``state`` names their folder."""
    drafts.write.mode("append").partitionBy("state").json(folder)


def sweep(spark: SparkSession, folder: str) -> DataFrame:
    """(path, raw_text) of every text file below ``folder`` that isn't blank."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=SWEPT)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("raw_text")).filter(F.regexp_replace("raw_text", r"^\s+|\s+$", "") != "")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scores with ``problem``: the first thing that is wrong with a row; numbers are integers, not booleans."""
    raw = spark.read.schema(SCORE_SCHEMA).json(path, multiLine=True)
    counts = ("correct", "prompted", "wrong", "silent", "hallucinations", "decision_total", "stale_occurrences", "input_tokens", "output_tokens")
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in counts)))
    negative = F.array_compact(F.array(*(F.when(F.col(c) < 0, c) for c in counts)))
    problem = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.element_at(missing, 1))).when(F.size(negative) > 0, F.concat(F.lit("negative "), F.element_at(negative, 1)))
    return raw.withColumn("problem", problem)


SCENARIO_SCHEMA = (
    "schema_version int, id string, status string, title string, source_markdown string, situation string, cold_start_prompt string, work_instruction_test string, cutoff_minutes double, "
    "baselines array<struct<id: string, name: string, preserved_state: string>>, "
    "ground_truth array<struct<id: string, category: string, text: string, source_refs: array<string>, auto_fail_if_wrong: boolean>>, "
    "staleness_tests array<struct<id: string, superseded_fact: string, current_fact: string, expected_behavior: string>>"
)
_SCENARIO_TEXTS = ("id", "status", "title", "source_markdown", "situation", "cold_start_prompt", "work_instruction_test")


def _blank(x):
    return F.trim(F.coalesce(x, F.lit(""))) == ""


def read_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """Scenarios of the JSON files of a folder, with ``problem``: the first thing that is wrong with one."""
    rows = spark.read.schema(SCENARIO_SCHEMA).option("columnNameOfCorruptRecord", "_broken").json(f"{folder}/*.json", multiLine=True)
    rows = rows.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    lacks = lambda c, *names: F.exists(c, lambda x: F.exists(F.array(*(x[n] for n in names)), _blank))
    ids = lambda c: F.transform(c, lambda x: x["id"])
    repeated = lambda c: F.size(F.array_distinct(ids(c))) < F.size(c)
    problem = F.when(F.coalesce(F.col("schema_version") != 1, F.lit(True)), "schema_version")
    for c in _SCENARIO_TEXTS:
        problem = problem.when(_blank(F.col(c)), c)
    cutoff = F.col("cutoff_minutes")
    problem = (
        problem.when(F.coalesce((cutoff <= 0) | (cutoff != F.floor(cutoff)), F.lit(True)), "cutoff_minutes")
        .when(~F.coalesce(ids("baselines") == F.array(*(F.lit(b) for b in "ABCD")), F.lit(False)), "baselines").when(lacks("baselines", "id", "name", "preserved_state"), "baselines")
        .when(none("ground_truth") | lacks("ground_truth", "id", "category", "text"), "ground_truth")
        .when(F.exists("ground_truth", lambda x: x["source_refs"].isNull() | x["auto_fail_if_wrong"].isNull()) | repeated("ground_truth"), "ground_truth")
        .when(F.col("staleness_tests").isNull() | lacks("staleness_tests", "id", "superseded_fact", "current_fact", "expected_behavior") | repeated("staleness_tests"), "staleness_tests")
        .when(F.col("file") != F.col("id"), "file name")
    )
    return rows.withColumn("problem", problem)


def write_artifacts(rows: DataFrame, folder: str) -> None:
    """Review episodes, outputs and votes as JSON lines, by kind and episode."""
    rows.write.mode("append").partitionBy("kind", "episode_id").json(folder)


def read_artifacts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)
