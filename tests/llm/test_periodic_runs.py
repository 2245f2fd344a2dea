"""Periodic runs against a search over all stretches."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import _text, periodic_runs

from .helpers import SCHEMA, corpus, frame, words


def brute(w, min_length=24, min_periods=3):
    """Maximal stretches of each period, of which the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(w) // min_periods + 1):
        k = 0
        while k + q < len(w):
            if w[k] != w[k + q]:
                k += 1
                continue
            start = k
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            length = k + q - start
            if length >= max(min_length, min_periods * q):
                found.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def contract(doc_id, text):
    w = planted(doc_id, words(text))
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    shown = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *shown, sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(collapsed(w, runs)))


def repetitive(seed, n=120):
    """Texts of few letters and repeated blocks, where runs overlap and touch."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = []
        while len(w) < r.randrange(5, 160):
            block = [r.choice("ab" if r.random() < 0.7 else "abcdé") for _ in range(r.randrange(1, 14))]
            w += block * r.randrange(1, 12)
            if r.random() < 0.5:
                w = w[: max(0, len(w) - r.randrange(3))]
        out.append(" ".join(w))
    return out


def found(texts, **limits):
    out = []
    for s in _text.slices(pa.array(texts, pa.string()), limit=700):
        w = _text.words(s)
        runs = periodic_runs.find_runs(s, w, **limits)
        for row in range(s.n):
            mine = runs[(runs[:, 0] >= w.first[row]) & (runs[:, 0] < w.first[row + 1])]
            out.append(sorted((int(a - w.first[row]), int(b - a), int(q)) for a, b, q in mine))
    return out


@pytest.mark.parametrize("limits", [{}, {"min_length": 4}, {"min_length": 1, "min_periods": 4}])
def test_runs_of_repetitive_texts(limits, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK", 50)
    texts = repetitive(5)
    assert found(texts, **limits) == [brute(words(t), **limits) for t in texts]


def test_runs_where_hashes_collide(monkeypatch):
    """Prefix hashes that hold everything equal to everything: words decide."""
    monkeypatch.setattr(periodic_runs._Prefix, "same", lambda self, i, q, size: np.ones(len(i), bool))
    texts = repetitive(9, 40)
    assert found(texts) == [brute(words(t)) for t in texts]


def test_runs_of_the_pattern_that_cancels_powers():
    w = ["ab"[bin(i).count("1") % 2] for i in range(4096)]
    assert found([" ".join(w)], min_length=3) == [brute(w, 3)]


def test_runs_of_a_very_long_text():
    same = "x " * 40_000
    block = [f"w{i}" for i in range(9_000)]
    long = " ".join([*block, *block, *block, *block[:17], "end"])
    assert found([same, long]) == [[(0, 40_000, 1)], [(0, 27_017, 9_000)]]


def test_contract_of_odd_rows(spark):
    rows = corpus(60) + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(repetitive(2, 150))]
    rows += [(1003, rows[70][1], "en", "s", 0), (None, "a b " * 20, "en", "s", 0), (-7, "y " * 30, "en", "s", 0)]
    docs = frame(spark, rows)
    docs = docs.select("doc_id", periodic_runs.with_repetitions(docs.text, docs.doc_id).alias("text"), docs.lang.alias("runs"))
    got = sorted(map(tuple, periodic_runs.digest(periodic_runs.periodic_runs(docs)).collect()), key=str)
    want = [(r[0], *contract(r[0], r[1])) if r[0] is not None else (None, 1, 0, 40, 2, 20_000, *contract(5, "a b " * 20)[5:]) for r in rows]
    assert zlib.crc32(b"5") % 10 and got == sorted(want, key=str)


def test_collapsed_text_and_empty_table(spark):
    rows = [(1, "go " + "la di " * 13 + "la end", "en", "s", 0), (2, None, "en", "s", 0)]
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(frame(spark, rows)).collect()}
    assert got == {1: (29, [(1, 27, 2)], "go la di end"), 2: (0, [], "")}
    assert periodic_runs.digest(periodic_runs.periodic_runs(spark.createDataFrame([], SCHEMA))).collect() == []
    assert periodic_runs.periodic_runs(frame(spark, rows), texts=False).columns == ["doc_id", "n_words", "runs"]
