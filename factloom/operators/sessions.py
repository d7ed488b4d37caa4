"""Session-history reads: recency, counts, search, drafts from checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Page sizes, and the columns that a session store must have.
DEFAULT_LIMIT, MOST, CHECKPOINT_LIMIT, EXCERPT = 10, 100, 5, 400
EXPECTED = {
    "sessions": ("id", "repository", "branch", "summary", "created_at", "updated_at"),
    "turns": ("session_id", "turn_index", "user_message", "assistant_response", "timestamp"),
    "session_files": ("session_id", "file_path", "tool_name", "turn_index", "first_seen_at"),
    "session_refs": ("session_id", "ref_type", "ref_value", "turn_index", "created_at"),
    "checkpoints": ("session_id", "checkpoint_number", "title", "overview", "created_at"),
}


def clamp(limit: int | None, default: int = DEFAULT_LIMIT, most: int = MOST) -> int:
    return default if limit is None else max(1, min(limit, most))


def schema_problems(tables: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(table, missing column), or (table, '') if the table is missing; extra columns are fine."""
    out = []
    for name, columns in EXPECTED.items():
        if name not in tables:
            out.append((name, ""))
        else:
            out += [(name, c) for c in columns if c not in tables[name]]
    return out


def _repository(df: DataFrame, repository: str | None) -> DataFrame:
    return df if repository is None else df.filter(F.lower("repository") == repository.lower())


def recent_sessions(sessions: DataFrame, turns: DataFrame, files: DataFrame, repository: str | None = None, limit: int | None = None) -> DataFrame:
    """Sessions by last change, with their numbers of turns and files; the id decides ties."""
    n_turns = turns.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("turns"))
    n_files = files.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("files"))
    page = _repository(sessions, repository).withColumn("changed_at", F.coalesce("updated_at", "created_at"))
    page = page.orderBy(F.desc("changed_at"), "id").limit(clamp(limit))
    out = page.join(n_turns, "id", "left").join(n_files, "id", "left")
    return out.withColumns({"turns": F.coalesce("turns", F.lit(0)), "files": F.coalesce("files", F.lit(0))})


def recent_files(sessions: DataFrame, files: DataFrame, repository: str | None = None, limit: int | None = None) -> DataFrame:
    joined = files.join(_repository(sessions, repository).select(F.col("id").alias("session_id"), "repository"), "session_id")
    return joined.orderBy(F.desc("first_seen_at"), "session_id", "file_path", "turn_index").limit(clamp(limit))


def turn_excerpt():
    return F.trim(F.concat(F.coalesce("user_message", F.lit("")), F.lit("\n"), F.coalesce("assistant_response", F.lit(""))))


def search(sessions: DataFrame, turns: DataFrame, files: DataFrame, term: str, repository: str | None = None, limit: int | None = None) -> DataFrame:
    """Turns that mention the term come first, newest first; files fill what is left of the limit."""
    n = clamp(limit)
    own = _repository(sessions, repository).select(F.col("id").alias("session_id"), "summary")
    # As LIKE does: letter case counts for no ASCII letter; wildcards in the term stand for themselves.
    fold = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    has = lambda c: F.contains(fold(F.coalesce(c, F.lit(""))), fold(F.lit(term)))
    of_turns = turns.join(own, "session_id").filter(has("user_message") | has("assistant_response") | has("summary"))
    of_turns = of_turns.select(F.lit(0).alias("rank"), "session_id", "turn_index", F.col("timestamp").alias("at"), F.substring(turn_excerpt(), 1, EXCERPT).alias("excerpt"))
    of_files = files.join(own, "session_id").filter(has("file_path"))
    of_files = of_files.select(F.lit(1).alias("rank"), "session_id", "turn_index", F.col("first_seen_at").alias("at"), F.concat("file_path", F.coalesce(F.concat(F.lit(" ("), "tool_name", F.lit(")")), F.lit(""))).alias("excerpt"))
    return of_turns.unionByName(of_files).orderBy("rank", F.desc("at"), "session_id", "turn_index", "excerpt").limit(n)


def checkpoint_drafts(sessions: DataFrame, checkpoints: DataFrame, limit: int | None = None) -> DataFrame:
    """The latest checkpoints as drafts, with tags and a provenance URI."""
    joined = checkpoints.join(sessions.select(F.col("id").alias("session_id"), "repository"), "session_id")
    page = joined.orderBy(F.desc("created_at"), "session_id", "checkpoint_number").limit(clamp(limit, CHECKPOINT_LIMIT))
    return page.select(
        "session_id", "checkpoint_number", F.concat_ws("\n\n", "title", "overview").alias("raw_text"), F.lit("copilot_session_store").alias("surface"),
        F.col("repository").alias("project"), F.array(F.lit("session_checkpoint"), "session_id").alias("tags"),
        F.concat(F.lit("session-store://"), "session_id", F.lit("/checkpoints/"), F.col("checkpoint_number").cast("string")).alias("provenance_uri"),
    )
