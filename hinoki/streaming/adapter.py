"""Checking a stream of messages (an addition: batch is the model's own form).

The carry-over of actors between sentences needs a message's rows in order, which
windows over streams don't give; so each micro-batch is checked as a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.checker import Checker


def check_stream(messages: DataFrame, checker: Checker, path: str, checkpoint: str):
    """Start a query that appends the findings of each micro-batch to Parquet files."""

    def each(batch: DataFrame, epoch: int) -> None:
        checker.check(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
