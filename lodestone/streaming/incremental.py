"""Incremental scans: an operator over new files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def scan_new(files: DataFrame, scan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply `scan` to each micro-batch of a stream of files and write its findings to a folder per batch.

    A batch that is repeated after a failure replaces its folder, so each
    finding is there once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        scan(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
