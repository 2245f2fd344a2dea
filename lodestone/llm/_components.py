"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a minimum per vertex, which Spark combines before the shuffle, and
a join, whose hot vertices adaptive execution splits. Each round is written to
the shared folder, so lineage stays short and nothing is collected. Up to
`ONE_TASK` edges, counted first, one task finds them all at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with b < a. Large: larger neighbours of u join the least of u and all its neighbours; small: u and its smaller ones do."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # v > u with (u, v): pair (v, m(u))
        out = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "u"), "u")
        return out.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    out = edges.join(least, "a")
    pairs = out.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pairs.union(least.select("a", F.col("m").alias("b"))).distinct()


ONE_TASK = 500_000


def _united(batches):
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    ids = np.fromiter(root, dtype=np.int64, count=len(root))
    tops = np.fromiter((find(x) for x in ids.tolist()), dtype=np.int64, count=len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tops)], ["id", "component_id"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component_id) of every vertex on an edge (a, b); component_id is the least id that edges reach."""
    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    if now.count() <= ONE_TASK:
        return store(now.repartition(1).mapInArrow(_united, "id long, component_id long"), name)
    mark = None
    while True:
        now = store(_star(_star(now, True), False), name)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(now.select(F.col("b"), F.col("b"))).distinct()
