"""Supersession over a stream of rows: the head of each key is the only state.

Rows of a key are folded in log order within a micro-batch, by array
operations; each gives its kind and the head that it met. Rows must come in log
order between batches. One that comes behind a row already folded would change
what was put out, so it is not folded: its kind is ``late``, and the batch
derivation has to be run over its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "memory_id long, s long, p string, kind string, head_id long, head long, committed_at long"
STATE = "head long, head_id long, committed_at long, log_pos long"
_NONE = np.iinfo(np.int64).min


def _fold(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    head, head_id, at, pos = state.get if state.exists else (_NONE, None, _NONE, _NONE)
    rows = pd.concat(list(chunks)).sort_values(["committed_at", "log_pos"], ignore_index=True)
    late = ((rows["committed_at"] < at) | ((rows["committed_at"] == at) & (rows["log_pos"] <= pos))).to_numpy()
    good = rows[~late]
    valid, ids = good["valid_at"].to_numpy(np.int64), good["memory_id"].to_numpy(np.int64)
    met = np.maximum.accumulate(np.concatenate([[head], valid]))[:-1]
    kind = np.select([met == _NONE, valid > met, valid < met], ["first", "forward", "retro"], "conflict")
    chain = pd.Series(np.where(np.isin(kind, ["first", "forward"]), ids, 0), dtype="Int64").where(np.isin(kind, ["first", "forward"]))
    before = pd.concat([pd.Series([head_id], dtype="Int64"), chain], ignore_index=True).ffill()
    if len(good):
        last = good.iloc[-1]
        state.update((int(max(head, valid.max())), int(before.iloc[-1]), int(last["committed_at"]), int(last["log_pos"])))
    out = pd.DataFrame(
        {
            "memory_id": ids, "s": key[0], "p": key[1], "kind": kind, "head_id": before.iloc[:-1].array,
            "head": pd.Series(met, dtype="Int64").where(met != _NONE).array, "committed_at": good["committed_at"].to_numpy(),
        }
    )
    behind = rows[late]
    if len(behind):
        nothing = pd.array([pd.NA] * len(behind), dtype="Int64")
        behind = pd.DataFrame({"memory_id": behind["memory_id"].to_numpy(), "s": key[0], "p": key[1], "kind": "late", "head_id": nothing, "head": nothing, "committed_at": behind["committed_at"].to_numpy()})
        out = behind if out.empty else pd.concat([out, behind], ignore_index=True)
    yield out.astype({"head_id": "Int64", "head": "Int64"})


def supersede_stream(rows: DataFrame) -> DataFrame:
    return rows.groupBy("s", "p").applyInPandasWithState(_fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def idle_sessions(events: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Episodes of a user's events that end after an idle gap; late events are waited for."""
    window = F.session_window("ts", gap)
    counted = events.withWatermark("ts", late).groupBy("user_id", window).agg(F.count("*").alias("events"))
    return counted.select("user_id", F.col("session_window.start").alias("starts_at"), F.col("session_window.end").alias("ends_at"), "events")


def expire_leases(leases: DataFrame, now, ttl_ms: int = 1_800_000, most_ms: int = 86_400_000) -> DataFrame:
    """Leases (holder, granted_at, ttl_ms) with whether they still hold; the time to live is clamped."""
    ttl = F.least(F.coalesce(F.col("ttl_ms"), F.lit(ttl_ms)), F.lit(most_ms))
    return leases.withColumn("holds", F.col("granted_at") + ttl > now)
