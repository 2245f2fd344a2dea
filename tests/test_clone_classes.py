"""Clone classes and merged alignments against walks over all windows."""

from __future__ import annotations

import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import clone_classes, clones


def texts(seed, n=24):
    """Lines of few words, with shifted and repeated blocks shared between texts."""
    r = random.Random(seed)
    blocks = [[r.choice("abc") if r.random() < 0.5 else f"w{r.randrange(12)}" for _ in range(r.randrange(5, 30))] for _ in range(4)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(r.randrange(1, 6)):
            w += r.choice(blocks) * r.choice([1, 1, 2, 3]) if r.random() < 0.8 else [f"u{r.randrange(99)}" for _ in range(r.randrange(6))]
            if r.random() < 0.3:
                w = w[r.randrange(3) :]
        lines, at = [], 0
        while at < len(w):
            step = r.choice([1, 2, 3, 3, 8])
            lines.append(" ".join(w[at : at + step]))
            at += step
        out.append("\n".join(lines))
    return out


def stream(text):
    tokens = [(w, i) for i, line in enumerate(text.split("\n"), 1) for w in line.split()]
    return [t for t, _ in tokens], [i for _, i in tokens]


def walk(a, b, k, min_lines, same):
    """Every equal pair of windows in order, one after another."""
    (wa, la), (wb, lb) = a, b
    raw = []
    for i in range(len(wa) - k + 1):
        for j in range(len(wb) - k + 1):
            if wa[i : i + k] == wb[j : j + k] and la[i + k - 1] - la[i] + 1 >= min_lines and lb[j + k - 1] - lb[j] + 1 >= min_lines:
                if not same or (j > i and lb[j] > la[i + k - 1] + min_lines):
                    raw.append((la[i], lb[j], j, i))
    out = []
    for fa, fb, j, i in sorted(raw):
        x = dict(a=i, ae=i + k - 1, b=j, be=j + k - 1, fa=fa, la=la[i + k - 1], fb=fb, lb=lb[j + k - 1])
        if out:
            o = out[-1]
            near = x["fa"] <= o["la"] + 2 and x["fb"] <= o["lb"] + 2 and x["a"] <= o["ae"] + 1 and x["b"] <= o["be"] + 1
            s = (min(o["a"], i), max(o["ae"], x["ae"]), min(o["b"], j), max(o["be"], x["be"]))
            if near and wa[s[0] : s[1] + 1] == wb[s[2] : s[3] + 1]:
                o["a"], o["ae"], o["b"], o["be"] = s
                o["la"], o["lb"] = max(o["la"], x["la"]), max(o["lb"], x["lb"])
                continue
            if (x["a"] <= o["ae"] and x["ae"] >= o["a"]) or (x["b"] <= o["be"] and x["be"] >= o["b"]):
                continue
        out.append(x)
    return [(o["a"], o["b"], o["ae"] - o["a"] + 1, o["fa"], o["la"], o["fb"], o["lb"]) for o in out if min(o["la"] - o["fa"], o["lb"] - o["fb"]) + 1 >= min_lines]


def all_runs(a, b, k, same):
    """Maximal runs of equal tokens of k or more, diagonal by diagonal."""
    (wa, la), (wb, lb) = a, b
    out = []
    for d in range(-len(wa) + 1, len(wb)):
        if same and d < 1:
            continue
        i = max(0, -d)
        while i < len(wa) and i + d < len(wb):
            n = 0
            while i + n < len(wa) and i + d + n < len(wb) and wa[i + n] == wb[i + d + n]:
                n += 1
            if n >= k:
                out.append(clone_classes.Alignment(i, i + d, np.array(la[i : i + n]), np.array(lb[i + d : i + d + n])))
            i += n + 1
    return out


@pytest.mark.parametrize(("k", "min_lines"), [(5, 1), (6, 2), (8, 3), (4, 4)])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merged_alignments_of_repetitive_pairs(seed, k, min_lines):
    streams = [stream(t) for t in texts(seed, 9)]
    for i, a in enumerate(streams):
        for j, b in enumerate(streams[i:], i):
            got = [(m.a, m.b, m.a_end - m.a + 1, m.first_a, m.last_a, m.first_b, m.last_b) for m in clone_classes.merged(all_runs(a, b, k, i == j), k, min_lines, i == j)]
            assert got == walk(a, b, k, min_lines, i == j)


@pytest.mark.parametrize(("k", "min_lines"), [(6, 2), (9, 1)])
def test_coalesced_streams(spark, k, min_lines):
    rows = [(f"s{i:02}", t) for i, t in enumerate([*texts(7, 14), "", None, "a b c\n" * 30])]
    got = clone_classes.coalesced(clone_classes.text_streams(spark.createDataFrame(rows, "path string, text string"), "path", "text"), k, min_lines)
    streams = {p: stream(t or "") for p, t in rows}
    want = [(a, b, *m) for a in streams for b in streams if a <= b for m in walk(streams[a], streams[b], k, min_lines, a == b)]
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == sorted(want)


def chains(streams, k):
    """Places of longest chains of repeated windows that always follow each other."""
    at = defaultdict(list)
    for s, w in streams.items():
        for i in range(len(w) - k + 1):
            at[tuple(w[i : i + k])].append((s, i))
    many = {g: p for g, p in at.items() if len(p) > 1}
    window = lambda s, i: tuple(streams[s][i : i + k])

    def chained(g):
        before = {window(s, i - 1) if i else None for s, i in many[g]}
        p = next(iter(before))
        return len(before) == 1 and p is not None and len(at[p]) == len(many[g])

    out = []
    for g, places in many.items():
        for s, i in places:
            if not chained(g):
                n = k
                while (nxt := window(s, i + n - k + 1)) in many and len(nxt) == k and chained(nxt):
                    n += 1
                out.append((" ".join(streams[s][i : i + n]), n, s, i))
    return sorted(out)


@pytest.mark.parametrize("k", [1, 4, 7])
def test_passages_and_classes(spark, k):
    rows = [(i, t) for i, t in enumerate([*texts(11, 20), None, "", "x " * 40, "one two three four five six seven eight", "one two three four five six seven eight"])]
    df = spark.createDataFrame(rows, "stream long, text string").select("stream", clones.word_tokens(F.col("text")).alias("tokens"))
    found = clone_classes.occurrences(df, k)
    streams = {i: (t or "").split() for i, t in rows}
    got = sorted((" ".join(streams[r.stream][r.start : r.start + r.tokens]), r.tokens, r.stream, r.start) for r in found.collect())
    want = chains(streams, k)
    assert want and got == want
    members = defaultdict(list)
    for p, n, s, _ in want:
        members[p, n].append(s)
    classes = sorted((r.tokens, r.places, r.streams, r.links) for r in clone_classes.classes(found).collect())
    assert classes == sorted((n, len(m), len(set(m)), len(m) * (len(m) - 1) // 2) for (_, n), m in members.items() if len(m) > 1)


def test_a_common_passage_makes_a_row_for_each_place(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    df = spark.range(3000).select(F.col("id").alias("stream"), F.split(F.concat_ws(" ", F.col("id").cast("string"), F.lit(passage), (F.col("id") * 7 + 5000).cast("string")), " ").alias("tokens"))
    found = clone_classes.occurrences(df, 20)
    assert found.count() == 3000
    assert [tuple(r)[1:] for r in clone_classes.classes(found).collect()] == [(40, 3000, 3000, 3000 * 2999 // 2)]


def test_frequent_hashes(spark):
    df = spark.createDataFrame([(i, ["a", "b", "c"] * 5 + [f"z{i}"]) for i in range(30)], "stream long, tokens array<string>")
    found = clones.windows(df, 3)
    want = {r.n for r in clones.over_capacity(found, 100).collect()}
    assert want == {150, 120} and {r.n for r in clone_classes.over_capacity(found, 100).collect()} == want
    assert {r.n for r in clone_classes.over_capacity(found, 100, most=4).collect()} == want


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13, 50])
def test_window_hashes_tell_windows_apart(spark, k):
    w = [random.Random(4).choice("ab") for _ in range(200)]
    df = spark.createDataFrame([(0, w), (1, w[3:]), (2, w[: k - 1]), (3, None)], "stream long, tokens array<string>")
    hashes = {r.stream: r.hs for r in clones.window_hashes(df, k).collect()}
    assert set(hashes) == {0, 1}
    by = defaultdict(set)
    for s, tokens in ((0, w), (1, w[3:])):
        assert len(hashes[s]) == len(tokens) - k + 1
        for i, h in enumerate(hashes[s]):
            by[tuple(tokens[i : i + k])].add(h)
    assert all(len(h) == 1 for h in by.values()) and len(set.union(*by.values())) == len(by)


@pytest.mark.parametrize("held", [1, 40])
def test_windows_held_by_lines_give_the_same_clones(monkeypatch, held):
    monkeypatch.setattr(clone_classes, "HELD", held)
    streams = [stream(t) for t in texts(4, 9)]
    for i, a in enumerate(streams):
        for j, b in enumerate(streams[i:], i):
            got = [(m.a, m.b, m.a_end - m.a + 1, m.first_a, m.last_a, m.first_b, m.last_b) for m in clone_classes.merged(all_runs(a, b, 6, i == j), 6, 2, i == j)]
            assert got == walk(a, b, 6, 2, i == j)


def test_a_text_of_one_unit_is_not_walked_window_by_window():
    """Nine million equal windows on 3,000 diagonals."""
    n, k = 6000, 50
    lines = np.arange(n) // 10 + 1
    runs = [clone_classes.Alignment(0, d, lines[: n - d], lines[d:]) for d in range(2, n - k, 2)]
    began = time.time()
    found = clone_classes.merged(runs, k, 2, True)
    assert time.time() - began < 12
    assert found[0].a == 0 and all(min(m.last_a - m.first_a, m.last_b - m.first_b) > 0 and m.first_b > m.first_a + 2 for m in found)
    ends = sorted((m.a, m.a_end) for m in found)
    assert all(x[1] < y[0] for x, y in zip(ends, ends[1:]))
