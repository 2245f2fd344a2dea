"""Hard negatives by dual-tree search.

Components become whole numbers, so scores are exact inner products. A top tree,
fitted on a bounded sample, orders all vectors by its leaves; ranges of that
order are parts of bounded size, and each part builds a tree of its own.
Anchors, in the same order, form groups with trees too. The inner products of
two nodes, balls around their centres, lie in an interval: a pair of nodes whose
interval misses what all anchors of the one still look for, or whose labels
can't give a partner, is left with all its pairs, first between groups of
anchors and leaves of the top tree, so that anchors aren't even sent there, and
then between nodes within the part. Pairs of leaves are scored exactly.

Two searches run: the positives of each anchor, then, for each distinct score of
its positives, the negatives in the band of that score. Each search takes two
rounds: an anchor first visits the part it lies in and about the square root of
all parts, evenly spaced; the worst of the best so far bounds what the rest of
the parts send, so each sends few rows.

A row takes part if its label and vector are there and all components are
finite. Vectors of different lengths never meet. Rows without an identifier are
no anchors and come after all others of the same score. Rows that repeat an
identifier are rows of their own. Components that scaling takes beyond doubles
count as the largest double, and scores beyond 64 bits as the largest such
number. An anchor without positives, and a positive whose band is empty, give no
rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import store
from ._text import trimmed

#: Vectors of the sample that the top tree is fitted on, and of one of its leaves at least.
FIT = 8192
FIT_LEAF = 64
#: Rows of a part, about, and its bytes as doubles; rows of a candidate leaf, of an anchor leaf, and of anchors searched at once.
PART = 1 << 17
PART_BYTES = 64 << 20
LEAF = 512
ANCHOR_LEAF = 128
ANCHORS = 1024

_LEAST, _MOST = -(2**63) + 1, 2**63 - 1
_NO_ID = _MOST


def _numbers(column: pa.Array, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by length: (indices, whole numbers as doubles)."""
    size = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(size) - size
    out = []
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        with np.errstate(over="ignore"):
            x = np.floor(values[begin[at][:, None] + np.arange(d)] * scale)
        out.append((at, np.nan_to_num(x, posinf=np.finfo(float).max, neginf=-np.finfo(float).max)))
    return out


def _bytes(x: np.ndarray) -> list[bytes]:
    """Each row in 16 bits a number if all its numbers fit, else as doubles."""
    small = (np.abs(x) < 1 << 15).all(1) if x.shape[1] else np.ones(len(x), bool)
    narrow, wide = x[small].astype("<i2"), x[~small].astype("<f8")
    out: list[bytes] = [b""] * len(x)
    for rows, block in ((np.flatnonzero(small), narrow), (np.flatnonzero(~small), wide)):
        for i, row in zip(rows.tolist(), block):
            out[i] = row.tobytes()
    return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of `_bytes` of vectors of length d."""
    if not d:
        return np.zeros((len(column), 0))
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.diff(edges)
    out = np.zeros((len(column), d))
    for width, kind in ((2 * d, "<i2"), (8 * d, "<f8")):
        some = np.flatnonzero(size == width)
        out[some] = np.ascontiguousarray(raw[edges[some][:, None] + np.arange(width)]).view(kind)
    return out


def _direction(x: np.ndarray) -> np.ndarray:
    """About the direction of greatest spread, from at most 1024 evenly spaced rows."""
    some = x[:: max(1, len(x) // 1024)]
    some = some - some.mean(0)
    top = np.abs(some).max(initial=0)
    if not x.shape[1] or not top:
        return np.zeros(x.shape[1])
    some = some / top
    v = np.zeros(x.shape[1])
    v[np.argmax((some * some).sum(0))] = 1
    for _ in range(4):
        v = some.T @ (some @ v)
        v /= max(np.linalg.norm(v), 1e-300)
    return v


class Router:
    """The top tree of vectors of one length."""

    def __init__(self, x: np.ndarray):
        self.depth = max(0, int(math.log2(max(1, len(x) / FIT_LEAF))))
        self.lines, self.cuts = np.zeros((2**self.depth, x.shape[1])), np.zeros(2**self.depth)
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            for i in np.unique(node).tolist():
                mine = x[node == i]
                self.lines[i] = _direction(mine)
                self.cuts[i] = np.median(mine @ self.lines[i])
            node = self._down(x, node)
        leaf = node - 2**self.depth
        self.centres = np.array([x[leaf == i].mean(0) if (leaf == i).any() else np.zeros(x.shape[1]) for i in range(2**self.depth)])

    def _down(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        return 2 * node + (np.einsum("ij,ij->i", x, self.lines[node]) > self.cuts[node])

    def leaf(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each vector, and its distance to the leaf's centre."""
        node = np.ones(len(x), np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            for _ in range(self.depth):
                node = self._down(x, node)
            leaf = node - 2**self.depth
            return leaf, np.linalg.norm(x - self.centres[leaf], axis=1)


class Tree:
    """Balls over rows; node i holds rows begin[i]:end[i] of `order`, and has children unless left[i] is 0."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        self.begin, self.end, self.left, self.right = [0], [len(x)], [0], [0]
        i = 0
        while i < len(self.begin):
            a, b = self.begin[i], self.end[i]
            if b - a > leaf:
                rows = self.order[a:b]
                with np.errstate(over="ignore", invalid="ignore"):
                    self.order[a:b] = rows[np.argsort(x[rows] @ _direction(x[rows]), kind="stable")]
                for side, (lo, hi) in zip((self.left, self.right), ((a, (a + b) // 2), ((a + b) // 2, b))):
                    side[i] = len(self.begin)
                    for to, value in zip((self.begin, self.end, self.left, self.right), (lo, hi, 0, 0)):
                        to.append(value)
            i += 1
        self.x = x[self.order]
        self.labels = labels[self.order]
        self.centre, self.radius, self.norm, self.mask, self.only = [], [], [], [], []
        with np.errstate(over="ignore", invalid="ignore"):
            for a, b in zip(self.begin, self.end):
                c = self.x[a:b].mean(0) if b > a else np.zeros(x.shape[1])
                self.centre.append(c)
                self.radius.append(float(np.linalg.norm(self.x[a:b] - c, axis=1).max(initial=0)))
                self.norm.append(float(np.linalg.norm(c)))
                own = np.unique(self.labels[a:b])
                self.mask.append(int(np.bitwise_or.reduce(np.uint64(1) << (own % 64).astype(np.uint64))) if len(own) else 0)
                self.only.append(int(own[0]) if len(own) == 1 else None)


def interval(centre, radius: float, norm: float, other, other_radius: float, other_norm: float) -> tuple[float, float]:
    """Bounds of the inner products of points of two balls."""
    with np.errstate(over="ignore", invalid="ignore"):
        middle = float(centre @ other)
        reach = radius * other_norm + other_radius * norm + radius * other_radius
        reach += 1e-9 * (abs(middle) + reach) + 1e-6
    return middle - reach, middle + reach


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    with np.errstate(over="ignore"):
        small = a.shape[1] * np.abs(a).max(initial=0) * np.abs(c).max(initial=0) < 2**53
    if small:
        return (a @ c.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], dtype=object)
    return np.clip(whole(a) @ whole(c).T, _LEAST, _MOST).astype(np.int64)


class Best:
    """The best `k` of each entry so far, higher scores and then smaller ids first."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.k, self.low, self.high = k, low.copy(), high
        self.tie = np.full(len(low), _MOST)
        self.n = np.zeros(len(low), np.int64)
        self.score, self.ids = np.zeros((len(low), k), np.int64), np.zeros((len(low), k), np.int64)

    def add(self, first: int, stop: int, s: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Scores of entries first..stop with some rows."""
        low, tie, full = self.low[first:stop, None], self.tie[first:stop, None], (self.n[first:stop] == self.k)[:, None]
        hit = allowed & (s <= self.high[first:stop, None]) & ((s > low) | ((s == low) & ((ids[None, :] < tie) | ~full)))
        e, j = np.nonzero(hit)
        if not len(e):
            return
        touched, e = np.unique(e, return_inverse=True)
        slots = np.arange(self.k)[None, :] < self.n[first + touched][:, None]
        old, _ = np.nonzero(slots)
        all_e = np.concatenate([old, e])
        all_s = np.concatenate([self.score[first + touched][slots], s[touched[e], j]])
        all_i = np.concatenate([self.ids[first + touched][slots], ids[j]])
        order = np.lexsort((all_i, -all_s, all_e))
        all_e, all_s, all_i = all_e[order], all_s[order], all_i[order]
        rank = np.arange(len(all_e)) - np.searchsorted(all_e, all_e)
        kept = rank < self.k
        at = first + touched[all_e[kept]]
        self.score[at, rank[kept]], self.ids[at, rank[kept]] = all_s[kept], all_i[kept]
        at = first + touched
        self.n[at] = np.minimum(np.bincount(all_e, minlength=len(touched)), self.k)
        done = at[self.n[at] == self.k]
        self.low[done], self.tie[done] = self.score[done, -1], self.ids[done, -1]


def search(c: Tree, ids: np.ndarray, keys: np.ndarray, a: Tree, anchor_keys: np.ndarray, edges: np.ndarray, best: Best, same: bool) -> int:
    """Fill `best` with rows of c for the entries of anchors a; entries of anchor i, in the tree's order, are edges[i]:edges[i + 1]. Returns the pairs scored."""
    stack, scored = [(0, 0)], 0
    while stack:
        i, j = stack.pop()
        e0, e1 = edges[a.begin[i]], edges[a.end[i]]
        if e0 == e1:
            continue
        least, most = interval(a.centre[i], a.radius[i], a.norm[i], c.centre[j], c.radius[j], c.norm[j])
        if most < best.low[e0:e1].min() or least > best.high[e0:e1].max():
            continue
        if (not a.mask[i] & c.mask[j]) if same else (a.only[i] is not None and a.only[i] == c.only[j]):
            continue
        if c.left[j] and (not a.left[i] or c.radius[j] >= a.radius[i]):
            # The nearer child is searched first.
            pair = sorted((c.left[j], c.right[j]), key=lambda k: float(a.centre[i] @ c.centre[k]))
            stack += [(i, k) for k in pair]
        elif a.left[i]:
            stack += [(a.left[i], j), (a.right[i], j)]
        else:
            rows, some = slice(a.begin[i], a.end[i]), slice(c.begin[j], c.end[j])
            s = scores(a.x[rows], c.x[some])
            scored += s.size
            equal = a.labels[rows][:, None] == c.labels[some][None, :]
            allowed = equal & (anchor_keys[rows][:, None] != keys[some][None, :]) if same else ~equal
            who = np.repeat(np.arange(s.shape[0]), np.diff(edges[a.begin[i] : a.end[i] + 1]))
            best.add(e0, e1, s[who], ids[some], allowed[who])
    return scored


_ENTRY = pa.struct([("e", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def _prepare(routers: dict[int, Router], scale: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for at, x in _numbers(batch.column(3), scale):
                d = x.shape[1]
                leaf, far = routers[d].leaf(x) if d in routers else (np.full(len(x), -1), np.zeros(len(x)))
                some = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*some.columns[:3], some.column(4), pa.array(np.full(len(at), d, np.int32)), pa.array(leaf), pa.array(far), pa.array(_bytes(x), pa.binary())], ["key", "cid", "label", "anchor", "d", "leaf", "far", "q"])

    return trimmed(run)


def _visit(routers: dict[int, Router], leaves: dict[tuple[int, int], tuple[float, int, int]], parts: int, stride: int, again: bool):
    """Anchors with the parts that they have to visit in the first round, or in the second."""
    by_length: dict[int, list] = {}
    for (d, leaf), (radius, first, last) in sorted(leaves.items()):
        centre = routers[d].centres[leaf]
        by_length.setdefault(d, []).append((centre, radius, float(np.linalg.norm(centre)), first, last))

    def run(batches):
        for batch in batches:
            length, home = batch.column(3).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(length)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(length)]):
                for lo in range(a, b, ANCHOR_LEAF):
                    hi = min(b, lo + ANCHOR_LEAF)
                    group = batch.slice(lo, hi - lo)
                    wanted = np.ones(parts, bool)
                    if int(length[lo]) in by_length:
                        x = _matrix(group.column(4), int(length[lo]))
                        centre = x.mean(0)
                        radius, norm = float(np.linalg.norm(x - centre, axis=1).max()), float(np.linalg.norm(centre))
                        entries = group.column(5).flatten()
                        low, high = (entries.field(i).to_numpy() for i in (1, 2))
                        wanted[:] = False
                        for other, other_radius, other_norm, first, last in by_length[int(length[lo])]:
                            least, most = interval(centre, radius, norm, other, other_radius, other_norm)
                            if not (most < low.min() or least > high.max()):
                                wanted[first : last + 1] = True
                    for part in np.flatnonzero(wanted).tolist():
                        first_round = (home[lo:hi] == part) | (part % stride == 0)
                        mine = np.flatnonzero(~first_round if again else first_round)
                        if len(mine):
                            some = group.take(pa.array(mine))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), part, np.int32)), pa.array(np.ones(len(mine), np.int8)), some.column(0), pa.nulls(len(mine), pa.int64()), some.column(2), some.column(3), some.column(4), some.column(5)], ["part", "side", "key", "cid", "label", "d", "q", "entries"])

    return run


def _joined(held: list[pa.RecordBatch], d: int):
    t = pa.Table.from_batches(held).combine_chunks()
    col = lambda name: t.column(name).combine_chunks()
    return col, _matrix(col("q"), d)


def _find(k: int, same: bool):
    def candidates(held, d):
        col, x = _joined(held, d)
        tree = Tree(x, col("label").to_numpy(), LEAF)
        return tree, col("cid").to_numpy()[tree.order], col("key").to_numpy()[tree.order]

    def ask(part, held, d):
        col, x = _joined(held, d)
        tree = Tree(x, col("label").to_numpy(), ANCHOR_LEAF)
        lists = col("entries").take(pa.array(tree.order))
        size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        e, low, high = (lists.flatten().field(i).to_numpy() for i in range(3))
        keys = col("key").to_numpy()[tree.order]
        best = Best(low, high, k)
        search(*part, tree, keys, edges, best, same)
        got = np.arange(k)[None, :] < best.n[:, None]
        entry = np.nonzero(got)[0]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, size)[entry]), pa.array(e[entry]), pa.array(best.score[got]), pa.array(best.ids[got])], ["key", "e", "score", "cid"])

    def run(batches):
        at, rows, trees, waiting, n = None, {}, {}, {}, 0

        def flush():
            for d, held in waiting.items():
                if d in rows and d not in trees:
                    trees[d] = candidates(rows.pop(d), d)
                if d in trees:
                    yield ask(trees[d], held, d)
            waiting.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in (0, 1, 5)], 1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(marks)]):
                part, side, d = marks[a].tolist()
                if part != at:
                    yield from flush()
                    at, rows, trees, n = part, {}, {}, 0
                if not side:
                    rows.setdefault(d, []).append(batch.slice(a, b - a))
                    continue
                for lo in range(a, b, ANCHORS):
                    some = batch.slice(lo, min(b - lo, ANCHORS))
                    waiting.setdefault(d, []).append(some)
                    n += some.num_rows
                    if n >= ANCHORS:
                        yield from flush()
                        n = 0
        yield from flush()

    return trimmed(run)


_DEALT = "key long, cid long, label long, anchor boolean, d int, leaf long, far double, q binary"
_VISIT = "part int, side byte, key long, cid long, label long, d int, q binary, entries array<struct<e: long, low: long, high: long>>"


class _Index:
    """All rows in parts of the top tree's order."""

    def __init__(self, rows: DataFrame, scale: float):
        spark = rows.sparkSession
        n, numbers = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
        self.parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART), -(-numbers * 8 // PART_BYTES))
        self.stride = max(1, math.isqrt(self.parts))
        sample = rows.select("key", "v").orderBy(F.xxhash64("key"), "key").limit(FIT).collect()
        by_length: dict[int, list] = {}
        for r in sample:
            by_length.setdefault(len(r.v), []).append(r.v)
        routers = {}
        for d, some in by_length.items():
            (_, x), = _numbers(pa.array(some, pa.list_(pa.float64())), scale)
            with np.errstate(over="ignore", invalid="ignore"):
                routers[d] = Router(x)
        self.routers = routers
        dealt = rows.select("key", "cid", "label", "v", "anchor").mapInArrow(_prepare(routers, scale), _DEALT)
        dealt = dealt.repartitionByRange(self.parts, "d", "leaf", "cid", "key").sortWithinPartitions("d", "leaf", "cid", "key").withColumn("part", F.spark_partition_id())
        self.rows = store(dealt, "vectors")
        # As many rows as the top trees have leaves.
        found = self.rows.where(F.col("leaf") >= 0).groupBy("d", "leaf").agg(F.max("far").alias("radius"), F.min("part").alias("first"), F.max("part").alias("last")).collect()
        self.leaves = {(r.d, r.leaf): (r.radius, r.first, r.last) for r in found}
        self.anchors = store(self.rows.where("anchor").select("key", "part", "label", "d", "leaf", "q", "cid"), "anchors")

    def round(self, entries: DataFrame, k: int, same: bool, again: bool) -> DataFrame:
        lists = entries.groupBy("key").agg(F.collect_list(F.struct("e", "low", "high")).alias("entries"))
        asked = self.anchors.join(lists.hint("merge"), "key").repartition(self.parts, "part").sortWithinPartitions("part", "d", "leaf", "cid")
        visits = asked.select("key", "part", "label", "d", "q", "entries").mapInArrow(_visit(self.routers, self.leaves, self.parts, self.stride, again), _VISIT)
        held = self.rows.select("part", F.lit(0).cast("byte").alias("side"), "key", "cid", "label", "d", "q", F.lit(None).cast("array<struct<e: long, low: long, high: long>>").alias("entries"))
        dealt = held.unionByName(visits).repartition(self.parts, "part").sortWithinPartitions("part", "side", "d")
        return dealt.mapInArrow(_find(k, same), "key long, e long, score long, cid long")

    def best(self, entries: DataFrame, k: int, same: bool) -> DataFrame:
        """The first k rows of each entry (key, e, low, high) of anchors: (key, e, score, cid, rank)."""
        place = Window.partitionBy("key", "e").orderBy(F.desc("score"), "cid")
        first = store(self.round(entries, k, same, False).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k), "first")
        worst = first.groupBy("key", "e").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
        low = F.when(F.col("n") == k, F.greatest("low", "worst")).otherwise(F.col("low"))
        rest = entries.join(worst.hint("merge"), ["key", "e"], "left").select("key", "e", low.alias("low"), "high")
        both = first.drop("rank").unionByName(self.round(rest, k, same, True))
        return store(both.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k), "best")


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, scale: float = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), for rows where `anchor` holds.

    Positives are the anchor's best other rows of its label; negatives of a
    positive are the best rows of other labels whose score is between
    `low_percent` and `high_percent` of the positive's.
    """
    if not 0 <= low_percent <= 100 or not 0 <= high_percent <= 100:
        raise ValueError("percentages are from 0 to 100")
    ids, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    v = F.col(vector_col)
    usable = label.isNotNull() & v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.monotonically_increasing_id().alias("key"), F.coalesce(ids, F.lit(_NO_ID)).alias("cid"), label.alias("label"), v.cast("array<double>").alias("v"), (F.coalesce(anchor, F.lit(False)) & ids.isNotNull()).alias("anchor")
    )
    index = _Index(rows, scale)
    everything = index.anchors.select("key", F.lit(0).cast("long").alias("e"), F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high"))
    found = index.best(everything, positives, True).select("key", F.col("score").alias("e"), F.col("cid").alias("positive"), F.col("rank").alias("place"))
    part = lambda percent, up: F.expr(f"e div 100 * {percent} + (e % 100 * {percent} + {up}) div 100")
    # No score lies between two negative shares of which the smaller is asked to be the larger.
    bands = found.where("e >= 0").select("key", "e", part(low_percent, 99).alias("low"), part(high_percent, 0).alias("high")).distinct()
    mined = index.best(bands, negatives, False)
    out = found.join(mined.hint("merge"), ["key", "e"]).join(index.anchors.select("key", F.col("cid").alias("anchor_id")).hint("merge"), "key")
    shown = lambda c: F.nullif(F.col(c), F.lit(_NO_ID))
    return out.select("anchor_id", shown("positive").alias("positive_id"), "rank", shown("cid").alias("negative_id"), F.col("e").alias("positive_score"), F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM r AS a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.q) = len(r.q)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
