"""Clones of many copies, without pairs of what isn't returned."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from lodestone.operators import clones
from lodestone.plans import catalogue


def _brute(streams, k, apart):
    """Maximal runs of equal tokens on each diagonal."""
    out = set()
    for a in streams:
        for b in streams:
            if a > b:
                continue
            x, y = streams[a], streams[b]
            for d in range(apart if a == b else -len(x), len(y)):
                run = 0
                for i in range(max(0, -d), min(len(x), len(y) - d) + 1):
                    if i < min(len(x), len(y) - d) and x[i] == y[i + d]:
                        run += 1
                        continue
                    if run >= k:
                        out.add((a, b, i - run, i - run + d, run))
                    run = 0
    return out


def test_spans_equal_a_search_over_all_diagonals(spark):
    rng = random.Random(5)
    for apart in (3, 1):
        streams = {s: [rng.choice("ab" if s % 2 else "abc") for _ in range(rng.choice((2, 3, 9, 30)))] for s in range(12)}
        rows = spark.createDataFrame(list(streams.items()), "stream long, tokens array<string>")
        got = [tuple(r) for r in clones.spans(clones.windows(rows, 3), 3, apart).collect()]
        assert len(got) == len(set(got)) and set(got) == _brute(streams, 3, apart)


def test_spans_of_a_repeated_unit_take_no_square(spark):
    n = 80_000
    rows = spark.range(1).select(F.col("id").alias("stream"), F.array_repeat(F.lit("a b"), n).alias("units")).select("stream", F.split(F.array_join("units", " "), " ").alias("tokens"))
    began = time.time()
    got = clones.spans(clones.windows(rows, 4), 4).agg(F.count("*"), F.min("tokens"), F.max("tokens"), F.max("a_start")).first()
    assert tuple(got) == (n - 3, 4, 2 * n - 4, 0)
    assert time.time() - began < 60


def test_clone_files_of_many_copies_take_no_pairs(spark, tmp_path):
    n, words = 15_000, lambda p, m: " ".join(f"{p}{i}" for i in range(m))
    odd = [(None, words("n", 60)), (-1, None), (-2, words("x", 49)), (-3, " ".join(["y"] * 99)), (-4, " ".join(["z"] * 100)), (-5, words("u", 200)), (-6, "q " + words("c", 60))]
    copies = spark.range(n).select("id", F.lit(words("c", 60)))
    copies.union(spark.createDataFrame(odd, "id long, text string")).toDF("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    assert catalogue.clone_files(spark, str(tmp_path)).first().files == n + 2
    assert time.time() - began < 40
