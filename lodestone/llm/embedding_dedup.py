"""Near-duplicate vectors by collision counting on one-dimensional projections.

Vectors are cut to unit length, and equal ones count as one with a number of
copies. A random line orders all vectors by their projections; two vectors
collide on a line if one lies in the window around the other. A pair at the
threshold collides on each line with a known chance, so a count of collisions
that such pairs reach with probability `RECALL_COUNT` tells which pairs are
verified by their cosine in double precision.

Counting for all pairs would grow with the square of the table, and a window that
keeps pairs at the threshold holds a third of a line, so sorted lines alone don't
prune. So vectors first meet in cells, where collisions of all lines are counted
for every pair of a block at once: the signs of K lines name a cell, and L independent cells
per vector make a pair at the threshold meet at least once with probability
`RECALL_CELLS`. K grows with the logarithm of the number of vectors, which keeps
cells at about `CELL` vectors, and L with about its power 0.22. A pair that
meets in several cells counts in the first of them only, so link counts are
sums, and no pair leaves its task: a cell gives a row per vector with links and
a vector it is connected to. Cells of more than `BLOCK` vectors are compared
block against block, in tasks of their own.

A row without an id links with nothing. Null or zero vectors and those with null or non-finite components link with
nothing. Vectors of different lengths are never compared. Repeated ids keep a
row each, with the links of its own vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._store import store

LINES = 32
CELL = 256
BLOCK = 4096
RECALL_CELLS = 0.98
RECALL_COUNT = 0.998
SEED = 20_240_131


def _normal_within(z: float) -> float:
    return math.erf(z / math.sqrt(2))


class Plan:
    """Lines, cells, window and count for a threshold, calibrated on pairs that just reach it."""

    def __init__(self, n: int, cosine: float):
        self.cosine = cosine
        self.bits = max(1, min(40, round(math.log2(max(2, n) / CELL))))
        same_sign = 1 - math.acos(cosine) / math.pi
        self.cells = max(1, math.ceil(math.log(1 - RECALL_CELLS) / math.log(1 - min(same_sign**self.bits, 1 - 1e-9))))
        # The difference of unit vectors has length sqrt(2 - 2 cos), its projection that deviation.
        deviation = math.sqrt(max(2 - 2 * cosine, 1e-12))
        self.window = 1.35 * deviation
        p = _normal_within(1.35)
        chance, self.count = 1.0, 0
        for k in range(LINES + 1):
            self.count = k
            chance -= math.comb(LINES, k) * p**k * (1 - p) ** (LINES - k)
            if chance < RECALL_COUNT:
                break

    def lines(self, dim: int) -> np.ndarray:
        return np.random.default_rng(SEED + dim).standard_normal((dim, LINES))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector in each of the L rounds."""
        signs = x @ np.random.default_rng(SEED * 31 + x.shape[1]).standard_normal((x.shape[1], self.cells * self.bits)) > 0
        powers = 1 << np.arange(self.bits, dtype=np.int64)
        return signs.reshape(len(x), self.cells, self.bits) @ powers + (x.shape[1] << 42)


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by length of vector: (indices, unit vectors)."""
    size = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(size) - size
    out = []
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        x = values[begin[at][:, None] + np.arange(d)]
        # Scaled first, so that squares of very large or small components stay finite.
        x = x / np.abs(x).max(1, keepdims=True)
        out.append((at, x / np.sqrt((x * x).sum(1, keepdims=True))))
    return out


def _deal(plan: Plan):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for at, x in _matrix(batch.column(2)):
                codes = plan.codes(x)
                some = batch.take(pa.array(at))
                for t in range(plan.cells):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(codes[:, t]), *some.columns], ["t", "code", "rep", "copies", "v"])

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least connected index of each of n rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def cell_links(plan: Plan, t: int, rep: np.ndarray, copies: np.ndarray, x: np.ndarray, side: np.ndarray):
    """Links of a cell (or of two blocks of one): (rep, links, root) of vectors that have any."""
    first = np.flatnonzero(side == 0)
    second = np.flatnonzero(side == 1)
    whole = not len(second)
    second = first if whole else second
    p = (x @ plan.lines(x.shape[1])).astype(np.float32)
    codes = plan.codes(x)
    links, pairs = np.zeros(len(rep), dtype=np.int64), []
    for at in range(0, len(first), 256):
        i = first[at : at + 256]
        for to in range(0, len(second), 1024):
            j = second[to : to + 1024]
            hits = np.zeros((len(i), len(j)), dtype=np.uint8)
            for m in range(LINES):
                hits += np.abs(p[i, m][:, None] - p[j, m][None, :]) <= plan.window
            a, b = np.nonzero(hits >= plan.count)
            a, b = i[a], j[b]
            keep = rep[a] < rep[b] if whole else rep[a] != rep[b]
            a, b = a[keep], b[keep]
            for cut in range(0, len(a), 1 << 16):
                u, v = a[cut : cut + (1 << 16)], b[cut : cut + (1 << 16)]
                near = np.einsum("ij,ij->i", x[u], x[v]) >= plan.cosine
                u, v = u[near], v[near]
                mine = np.argmax(codes[u] == codes[v], axis=1) == t
                u, v = u[mine], v[mine]
                np.add.at(links, u, copies[v])
                np.add.at(links, v, copies[u])
                pairs.append((u, v))
    if not pairs:
        return rep[:0], links[:0], rep[:0]
    u, v = (np.concatenate(q) for q in zip(*pairs))
    by_rep = np.argsort(rep, kind="stable")
    place = np.empty(len(rep), dtype=np.int64)
    place[by_rep] = np.arange(len(rep))
    root = rep[by_rep[_roots(len(rep), place[u], place[v])[place]]]
    some = links > 0
    return rep[some], links[some], root[some]


def _count(plan: Plan):
    def give(key, held):
        rep, copies, side = (np.concatenate([h[c] for h in held]) for c in (0, 1, 2))
        vectors = pa.concat_arrays([h[3] for h in held])
        if len(rep) < 2 or not (side == 0).any():
            return None
        (_, x), = _matrix(vectors)
        out = cell_links(plan, key[0], rep, copies, x, side)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["rep", "links", "root"])

    def run(batches):
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)], 1).astype(np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                k = tuple(keys[a].tolist())
                if k != key:
                    if held and (out := give(key, held)) is not None:
                        yield out
                    key, held = k, []
                held.append((*(batch.column(c).slice(a, b - a).to_numpy() for c in (4, 5, 6)), batch.column(7).slice(a, b - a)))
        if held and (out := give(key, held)) is not None:
            yield out

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row; vectors link when their cosine is `cosine` or more.

    Recall of links is `RECALL_CELLS` times `RECALL_COUNT` for pairs at the
    threshold, more above it; no pair below it is linked.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    good = rows.where(F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull())
    # A key of its own for each vector, fixed by being stored: an id may have several.
    distinct = store(good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("rep"), "least", "copies", "v"), "vectors")
    plan = Plan(distinct.count(), cosine)
    kind = dict(distinct.dtypes)["v"]
    dealt = distinct.select("rep", "copies", "v").mapInArrow(_deal(plan), f"t int, code long, rep long, copies long, v {kind}")
    large = dealt.groupBy("t", "code").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    dealt = dealt.join(large.hint("merge"), ["t", "code"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("t", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "copies", F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "v")
    found = store(dealt.repartition("t", "code", "i", "j").sortWithinPartitions("t", "code", "i", "j").mapInArrow(_count(plan), "rep long, links long, root long"), "links")
    labels = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).where("a <> b"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    tops = distinct.join(labels.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").select("rep", "least", "copies", "v", F.coalesce("component_id", "rep").alias("top"))
    names = tops.groupBy("top").agg(F.min("least").alias("component_id"))
    classes = tops.join(names.hint("merge"), "top").join(links.hint("merge"), "rep", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    # Vectors that link with nothing stay where they are; a vector with many copies is a skewed key, which adaptive execution splits.
    fine = F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull()
    linked = rows.where(fine).join(classes.hint("merge"), "v").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = linked.union(rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
