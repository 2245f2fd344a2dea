"""Operators on texts against brute force."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import _components, _parity, _text, decontaminate, lm_scoring, ngram_jaccard, substring_dedup

from .helpers import SCHEMA, alnum, components, corpus, frame, words


def shingles(text, k):
    w = words(text, fold=True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("k", "num", "small", "block", "pivot", "one_task"), [(4, 85, 16, 8192, 256, 500_000), (5, 80, 2, 3, 2, 0)])
def test_jaccard_components(spark, monkeypatch, k, num, small, block, pivot, one_task):
    """Both sides of each bound: keys above and below the small group, several blocks, several copies of a pivot, star contraction and one task."""
    monkeypatch.setattr(ngram_jaccard, "SMALL_GROUP", small)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    monkeypatch.setattr(ngram_jaccard, "PIVOT_BLOCK", pivot)
    monkeypatch.setattr(_components, "ONE_TASK", one_task)
    rows = corpus(150, seed=k)
    sets = {r[0]: shingles(r[1], k) for r in rows}
    ids = list(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = components(ids, links)
    docs = frame(spark, rows).withColumn("sid", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r.doc_id: r for r in ngram_jaccard.jaccard_components(docs, k=k, num=num, den=100).collect()}
    assert {i: (len(sets[i]), want[i]) for i in ids} == {i: (r.n_shingles, r.component_id) for i, r in got.items()}
    assert links


def test_jaccard_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d e f", None, None, 1)] * 3 + [(2, "a b c d e f", None, None, 1), (None, "a b c d e f", None, None, 1), (None, "q r s t u v", None, None, 1), (None, None, None, None, 0), (7, " ", None, None, 1)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 0, None), (None, 2, None), (None, 2, 1), (1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (7, 0, 7)], key=str)
    assert ngram_jaccard.jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_jaccard_one_id_with_two_texts(spark):
    """Each text of a repeated id links on its own."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a, None, None, 1), (5, b, None, None, 1), (6, a + " more", None, None, 1), (7, b + " more", None, None, 1), (8, "x" * 300_000 + " y", None, None, 1)]
    got = sorted((r.doc_id, r.component_id) for r in ngram_jaccard.jaccard_components(frame(spark, rows)).collect())
    assert got == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 8)]


def test_keep_one_of_each_component(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a, "x", None, 1), (5, a, "y", None, 1), (6, a + " more", None, None, 1), (None, a, None, None, 1), (7, b, None, None, 1), (5, b + " more", None, None, 1), (None, "q r s", None, None, 1), (None, "q r s", None, None, 1), (None, None, None, None, 0), (9, "", None, None, 1), (9, "", None, None, 1), (10, "lone words", None, None, 1)]
    docs = frame(spark, rows).withColumn("heads", F.lit("clash"))
    kept = ngram_jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(5, a), (5, b + " more"), (None, "q r s"), (None, None), (9, ""), (9, ""), (10, "lone words")], key=str)
    assert ngram_jaccard.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_components_of_chains_stars_and_cycles(spark, monkeypatch, one_task):
    monkeypatch.setattr(_components, "ONE_TASK", one_task)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(1, 2), (2, 3), (3, 1), (5, 5), (1, 2), (300, 7)]
    want = components({v for e in edges for v in e}, edges)
    got = {r.id: r.component_id for r in _components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: c for i, c in want.items() if i != 5}


def test_words_of_two_letters_in_the_pattern_that_cancels_powers():
    """Thue-Morse words and their complements collide under any polynomial modulo 2**64 with an odd base."""
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    (s,) = _text.slices(pa.array([a, b]))
    h = _text.words(s).hash
    assert len(h) == 2
    assert h[0] != h[1]


@pytest.mark.parametrize("size", [1, 2, 5, 6, 7, 12, 13, 40, 120, 500])
def test_similar_sets_share_a_key(size):
    """Every pair of sets at the threshold shares a key, also where bands are empty."""
    bands, rng = _parity.Bands(85, 100), np.random.default_rng(size)
    for _ in range(150):
        grown = size * 100 // 85
        n = int(rng.integers(size, grown + 1))
        universe = rng.choice(1 << 40, size=2 * n, replace=False).astype(np.uint64) << np.uint64(8)
        a, pool = universe[:size], universe[size:]
        swap = 0
        while 100 * (size - swap - 1) >= 85 * (n + swap + 1):
            swap += 1
        b = np.concatenate([a[swap:], pool[: n - size + swap]])
        assert 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
        keys, owner = bands.keys(np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)]))
        assert np.intersect1d(keys[owner == 0], keys[owner == 1]).size


def test_substring_dedup(spark):
    rows = corpus(120, seed=9)
    seen, want = set(), {}
    for i, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            t = tuple(w[j : j + 20])
            if t in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(t)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.id: r for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want
    assert all(sum(s.size for s in r.spans) == r.n_removed for r in got.values())
    assert sum(x[1] for x in want.values()) > 100
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_decontaminate(spark, monkeypatch):
    rows = corpus(90, seed=5)
    items = [(1, " ".join(words(rows[4][1])[3:20])), (2, "two WORDS"), (3, None), (4, ""), (10, " ".join(words(rows[10][1])[-12:])), (5, "absent item of words"), (2, "two words")]
    texts = {}
    for i, t in items:
        texts.setdefault(i, []).append(alnum(t))
    want = {}
    for i, text, *_ in rows:
        w, hit, found = alnum(text), set(), set()
        for item, versions in texts.items():
            for v in versions:
                k = min(10, len(v))
                for s in range(len(v) - k + 1 if v else 0):
                    for p in range(len(w) - k + 1):
                        if w[p : p + k] == v[s : s + k]:
                            hit |= set(range(p, p + k))
                            found.add(str(item))
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = {r.doc_id: tuple(r)[1:] for r in decontaminate.digest(decontaminate.scan(frame(spark, rows), bench)).collect()}
        assert got == want
        bare = {r.doc_id: tuple(r)[1:] for r in decontaminate.digest(decontaminate.scan(frame(spark, rows), bench, spans=False)).collect()}
        assert bare == want
        kept = {r.doc_id for r in decontaminate.clean_documents(frame(spark, rows), bench).collect()}
        assert kept == {i for i, x in want.items() if not x[4]}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.digest(decontaminate.scan(frame(spark, rows), empty)).where("contaminated").count()


def test_lm_scoring(spark):
    rows = corpus(120, seed=8)
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    tokens = {r[0]: [*words(r[1], fold=True), None] for r in rows}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    out = lm_scoring.score_documents(frame(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 7 != 2).collect()
    assert len(out) == len(rows)
    for r in out:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r.score < 0
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)


def test_mixture_weights_maximise_likelihood():
    cells = np.array([(3 * 100 + 96) * 100 + 90, (3 * 100 + 0) * 100 + 80, (5 * 100 + 90) * 100 + 95], dtype=np.int64)
    a = lm_scoring.mixture_weights(cells, np.array([5.0, 5.0, 1.0]), 1e-6)
    assert np.allclose(a.sum(1), 1)
    p = lambda q: 0.0 if q == 0 else 2.0 ** ((q - 98) / 2)

    def gain(w):
        return sum(n * math.log(w[0] * p(c // 100 % 100) + w[1] * p(c % 100) + w[2] * 1e-6) for c, n in zip(cells[:2], (5, 5)))

    best = max(gain((x / 50, y / 50, max(1e-6, 1 - x / 50 - y / 50))) for x in range(50) for y in range(50 - x))
    assert gain(a[3]) >= best - 1e-3


def test_decontaminate_rows_stay_apart_over_blocks(spark, monkeypatch):
    one, two = "alpha beta gamma delta", "one two three four five"
    rows = [(i, t, "en", "src0", 1) for i, t in ((1, f"x {one} y"), (1, f"{two} z"), (1, None), (None, f"{one} {two}"), (None, "nothing here"), (2, f"{two} {two}"), (2, f"{two} {two}"))]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate((one, two, "three four", "gamma delta one two"))], "item_id long, text string")
    got = []
    for block in (decontaminate.BLOCK_BYTES, 20):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got += [sorted(map(str, decontaminate.digest(decontaminate.scan(frame(spark, rows), bench, spans=x)).collect())) for x in (True, False)]
    assert len(got[0]) == len(rows)
    assert got[0] == got[1] == got[2] == got[3]


def test_decontaminate_repeated_words_on_both_sides(spark):
    same = "w " * 20_000
    rows = [(1, same + "end", "en", "s", 1), (2, "a " + "w " * 9 + "b", "en", "s", 1), (3, "go w w w now", "en", "s", 1)]
    bench = spark.createDataFrame([("long", same), ("again", same), ("short", "w w w")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.digest(decontaminate.scan(frame(spark, rows), bench, spans=False)).collect()}
    assert got == {1: (20_001, 20_000, 3), 2: (11, 9, 1), 3: (5, 3, 1)}


def test_substrings_of_repeated_ids_are_the_same_in_each_run(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"{passage} {i} " + " ".join(f"u{i}x{j}" for j in range(30)), "en", "s", 1) for i in range(6)] + [(0, "alone", "en", "s", 1)]
    runs = [sorted((r.id, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, rows, 5)).collect()) for _ in range(3)]
    assert runs[0] == runs[1] == runs[2]
    assert sorted(x[1] for x in runs[0]) == [0, 0, 40, 40, 40, 40, 40]
