"""Hard negatives against all scores."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab, *_ in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    late = lambda i: (i is None, i or 0)
    out = []
    for at, (i, lab, q) in enumerate(good):
        if i is None or not anchor(i):
            continue
        scored = [(sum(x * y for x, y in zip(q, r)), j, other) for k, (j, other, r) in enumerate(good) if k != at and len(r) == len(q)]
        scored.sort(key=lambda s: (-s[0], late(s[1])))
        for p, j, _ in [s for s in scored if s[2] == lab][:positives]:
            found = [s for s in scored if s[2] != lab and low * p <= 100 * s[0] <= high * p][:negatives]
            out += [(i, j, r + 1, n, p, s) for r, (s, n, _) in enumerate(found)]
    return sorted(out, key=str)


def vectors(seed=1, n=500, d=8):
    """Clusters, copies, a vector that a third of all rows have, and odd rows."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d))
    x = np.stack([c / np.linalg.norm(c) for c in centres[r.integers(0, 12, n)] + r.normal(size=(n, d)) * r.choice([0.01, 0.4], (n, 1))])
    x[r.random(n) < 0.33] = x[3]
    rows = [(i, v.astype(np.float32).tolist(), int(r.integers(0, 4)), "clash") for i, v in enumerate(x)]
    rows[20] = (20, None, 1, "")
    rows[30] = (30, [float("nan")] * d, 1, "")
    rows[40] = (40, [*rows[41][1][:-1], None], 1, "")
    rows[50] = (50, rows[50][1], None, "")
    rows[60] = (60, [0.0] * d, 2, "")
    return rows + [(None, rows[3][1], 1, ""), (None, rows[5][1], 2, ""), (7000, [], 1, ""), (7001, [], 1, ""), (7002, [], 2, ""), (7100, [1.0, 2.0], 1, ""), (7101, [2.0, 2.0], 1, ""), (7102, [1.0, 1.5], 3, ""), (-100, rows[8][1], 2, "")]


def mined(spark, rows, every, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in hard.hard_negatives(df, F.col("vec_id") % every == 0, **options).collect()), key=str)


@pytest.mark.parametrize(("part", "fit", "options"), [(1 << 17, 8192, {}), (40, 70, {"positives": 3, "negatives": 4, "low": 10, "high": 99})])
def test_hard_negatives(spark, monkeypatch, part, fit, options):
    monkeypatch.setattr(hard, "PART", part)
    monkeypatch.setattr(hard, "FIT", fit)
    rows = vectors()
    names = {"low": "low_percent", "high": "high_percent"}
    got = mined(spark, rows, 10, **{names.get(k, k): v for k, v in options.items()})
    assert len(got) > 500 and got == brute(rows, lambda i: i % 10 == 0, **options)


def test_hard_negatives_of_large_numbers(spark):
    """Scores beyond doubles are exact; those beyond 64 bits are the largest."""
    rows = [(0, [3e6, 1.0], 1, ""), (1, [3e6, 5.0], 1, ""), (2, [2e6, 3.0], 2, ""), (3, [2e6, 2.0], 2, ""), (4, [2e6, 2.0], 2, "")]
    assert mined(spark, rows, 100) == brute(rows, lambda i: i % 100 == 0)
    rows = [(0, [3e38], 1, ""), (1, [3e38], 1, ""), (2, [1e-20], 2, ""), (3, [2e38], 2, "")]
    assert mined(spark, rows, 100) == []
    rows += [(4, [-1.0], 2, "")]
    assert mined(spark, rows, 100) == []


def test_hard_negatives_of_an_empty_table(spark):
    assert mined(spark, [], 10) == [] and mined(spark, [(None, None, None, None)], 10) == []
    with pytest.raises(ValueError):
        mined(spark, [], 10, low_percent=101)


def test_query_equals_its_sql(spark, tmp_path):
    rows = [(i * 5, *r[1:]) for i, r in enumerate(vectors(4, 400, 16)[:400])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in hard.op11_hard_negatives(spark, str(tmp_path)).collect())
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got and got == sorted(duckdb.sql(hard.ORACLE).fetchall())


def _search(x, labels, anchors, k, same, low=hard._LEAST, high=hard._MOST):
    tree, a = hard.Tree(x, labels, 16), hard.Tree(x[anchors], labels[anchors], 8)
    edges = np.arange(len(anchors) + 1)
    best = hard.Best(np.full(len(anchors), low), np.full(len(anchors), high), k)
    n = hard.search(tree, tree.order, tree.order, a, anchors[a.order], edges, best, same)
    return {int(anchors[a.order[i]]): list(zip(best.score[i, : best.n[i]].tolist(), best.ids[i, : best.n[i]].tolist())) for i in range(len(anchors))}, n


@pytest.mark.parametrize("same", [True, False])
def test_node_pairs_are_pruned_without_loss(same):
    r = np.random.default_rng(3)
    centre = r.normal(size=(20, 12)) * 200
    x = np.floor(np.repeat(centre, 100, 0) + r.normal(size=(2000, 12)) * 5)
    labels = r.integers(0, 3, 2000)
    anchors = np.arange(0, 2000, 7)
    got, pairs = _search(x, labels, anchors, 5, same)
    s = (x[anchors] @ x.T).astype(np.int64)
    for row, i in zip(s, anchors):
        fine = (labels == labels[i]) == same
        fine[i] = False
        at = np.flatnonzero(fine)
        assert got[int(i)] == [(int(row[j]), int(j)) for j in at[np.lexsort((at, -row[at]))][:5]]
    assert pairs < 0.5 * len(anchors) * 2000
