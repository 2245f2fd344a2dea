"""Scans that remember earlier batches: ratchet budgets and clone classes in a state store.

Rows of a key are worked through in order of `order` within a batch, and batches
in the order in which they come, so a stream cut into batches along that order
gives the rows of one batch. A key's rows of one batch are in one task's memory;
bound a batch by the source (`maxFilesPerTrigger`). Output goes through a sink
with a checkpoint, so each row is there once also after a failure.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Budget(StatefulProcessor):
    """Findings of a key that the baseline has too, as many as are left of it."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle) -> None:
        self.left = handle.getValueState("left", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        left = self.left.get()[0] if self.left.exists() else 0
        self.left.update((max(0, left - len(pdf)),))
        yield pdf.drop(columns="_key", errors="ignore").assign(grandfathered=[i < left for i in range(len(pdf))])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.left.update((int(initialState["n"].sum()),))

    def close(self) -> None:
        pass


class _Class(StatefulProcessor):
    """Places of one passage, numbered as they come, each with the first of them."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "n long, stream string, start long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["stream", "start"], kind="stable")
        n, stream, start = self.seen.get() if self.seen.exists() else (0, pdf["stream"].iloc[0], int(pdf["start"].iloc[0]))
        self.seen.update((n + len(pdf), stream, start))
        yield pd.DataFrame({"passage": key[0], "stream": pdf["stream"], "start": pdf["start"], "nth": range(n + 1, n + len(pdf) + 1), "first_stream": stream, "first_start": start})

    def close(self) -> None:
        pass


def _started(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes with the state store that this operator needs; the session's own setting comes back."""
    spark = rows.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)


def ratchet_stream(findings: DataFrame, baseline: DataFrame, keys: list[str], order: str, out: str, checkpoint: str) -> StreamingQuery:
    """Adds `grandfathered` to a stream of findings: the first of each key, over all batches, as many as the baseline has of it. Null keys are equal."""
    named = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key")
    had = baseline.select(named).groupBy("_key").agg(F.count("*").alias("n"))
    rows = findings.select(named, *findings.columns)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in findings.schema.fields)
    flagged = rows.groupBy("_key").transformWithStateInPandas(_Budget(order), f"{kind}, grandfathered boolean", "append", "none", initialState=had.groupBy("_key"))
    return _started(flagged, out, checkpoint)


def clone_stream(places: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """(passage, stream, start, nth, first_stream, first_start) of a stream of places (passage, stream, start); a passage is a clone from its second place on."""
    kind = places.schema["passage"].dataType.simpleString()
    rows = places.select("passage", F.col("stream").cast("string").alias("stream"), F.col("start").cast("long").alias("start")).where("passage is not null")
    numbered = rows.groupBy("passage").transformWithStateInPandas(_Class(), f"passage {kind}, stream string, start long, nth long, first_stream string, first_start long", "append", "none")
    return _started(numbered, out, checkpoint)
