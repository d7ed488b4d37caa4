"""The draft runner over a stream: every micro-batch of drafts is one run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import runner


def watch(drafts: DataFrame, decide: Callable[[DataFrame], DataFrame], clock: Callable[[], int], items: str, summaries: str) -> DataStreamWriter:
    """A writer that runs over each batch of ``drafts`` and appends its items and its counters to two folders.

    ``decide`` makes (id, decision) of a batch. A batch that is tried again
    after a failure writes the same batch number again, so readers keep the
    last rows of a number. The polling interval is the writer's trigger.
    """

    def one(batch: DataFrame, number: int) -> None:
        run = runner.run_once(batch, decide(batch), clock()).withColumn("batch", F.lit(number))
        run.write.mode("overwrite").parquet(f"{items}/batch={number}")
        runner.summary(run).write.mode("overwrite").parquet(f"{summaries}/batch={number}")

    return drafts.writeStream.foreachBatch(one)
