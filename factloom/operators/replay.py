"""Replay of a log into the state that the next write needs; what the log holds was checked when it was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heads(rows: DataFrame, *key: str) -> DataFrame:
    """head_id, valid_at and history (rows) of each key: the latest valid time, the first row that had it.

    One aggregation with partial sums; no history is ordered.
    """
    latest = F.max(F.struct("valid_at", (-F.col("committed_at")).alias("c"), (-F.col("log_pos")).alias("l"), F.col("memory_id").alias("id")))
    out = rows.groupBy(*key).agg(latest.alias("top"), F.count("*").alias("history"))
    return out.select(*key, F.col("top.id").alias("head_id"), F.col("top.valid_at").alias("valid_at"), "history")


def counters(names: DataFrame) -> DataFrame:
    """(prefix, next): where the counters of made names such as ``__mem_12`` go on."""
    parts = names.select(F.regexp_extract("name", r"^(__(?:mem|ep))_([0-9]{1,18})$", 1).alias("prefix"), F.regexp_extract("name", r"_([0-9]{1,18})$", 1).alias("n"))
    return parts.filter("prefix <> ''").groupBy("prefix").agg((F.max(F.col("n").cast("long")) + 1).alias("next"))
