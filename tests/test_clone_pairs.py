"""Clones of pairs: what is shuffled, and texts whose lines break at different words."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import clone_classes
from lodestone.plans import catalogue

from .test_clone_classes import stream, walk


def _shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()


def test_texts_of_few_copies_shuffle_no_row_for_each_window(spark, tmp_path):
    r = random.Random(3)
    rows = []
    for i in range(300):
        words = [f"w{r.randrange(10**7)}" for _ in range(1500)] if i % 10 else [f"c{j}" for j in range(i // 50, 300)]
        rows.append((i, "\n".join(" ".join(words[j : j + 12]) for j in range(0, len(words), 12))))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    before = _shuffled(spark)
    found = catalogue.QUERIES["clone_coalesced"](spark, str(tmp_path)).agg(F.count_distinct("a", "b")).first()[0]
    assert found == 30 * 29 // 2
    assert _shuffled(spark) - before < 2 * sum(len(t) for _, t in rows)


def test_texts_whose_lines_break_at_different_words(spark):
    k = 10
    wrap = lambda words, n: "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))
    texts = [wrap((["a"] * p + ["b"]) * 30, n)[: 10 * p + 150] for p in (1, 2, 9) for n in (9, 12, 13, 17, 19)] + [wrap(["x"] * 60, n) for n in (12, 14, 17)]
    texts += ["\n\n\n".join(texts[:2]), "y " * 9, "", None]
    rows = [(f"s{i:02}", t) for i, t in enumerate(texts)]
    got = clone_classes.coalesced_texts(spark.createDataFrame(rows, "path string, text string"), "path", "text", k, 2)
    streams = {p: stream(t or "") for p, t in rows}
    want = [(a, b, *m) for a in streams for b in streams if a <= b for m in walk(streams[a], streams[b], k, 2, a == b)]
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == sorted(want)


def test_a_name_repeats_with_the_same_text_only(spark):
    text = "\n".join(f"{c} " * 4 for c in "abcdefg")
    names = ["p", "q", "q", None]
    found = lambda texts: clone_classes.coalesced_texts(spark.createDataFrame(list(zip(names, texts)), "path string, text string"), "path", "text", 6, 2).collect()
    assert [tuple(r) for r in found([text] * 4)] == [("p", "q", 0, 0, 28, 1, 7, 1, 7)] * 2
    with pytest.raises(Exception, match="'q' has several texts"):
        found([text, text, "x\n" + text, text])
