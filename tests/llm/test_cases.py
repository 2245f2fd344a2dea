"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator; and models against independent ones."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import _blocks, decontaminate, embedding_dedup, lm_scoring, mixing, ngram_jaccard, quality_crf, secret_scan, substring_dedup, token_counts, token_output

from .helpers import SCHEMA, alnum, components, corpus, frame, words

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "w" * 70_000 + " " + "word " * 30_000


def odd_rows():
    """Repeated and null ids, repeated rows, ties, null, empty and very long texts."""
    r = random.Random(1)
    text = lambda n: " ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(n))
    out = [(i, text(12), "en", "src0", 1) for i in range(30)] + [(5, text(9), "en", "src0", 1) for _ in range(4)] + [(7, "same same", "en", "src0", 1)] * 6
    out += [(None, text(7), "en", "src0", 1) for _ in range(5)] + [(None, "twice told", "en", "src0", 1)] * 3 + [(40, None, "en", "src0", 0), (41, "", "de", None, 0), (42, LONG, "de", "src3", 1), (43, "x", None, "odd", 1), (None, None, None, None, None)]
    return out


def clashing(df):
    for c in ("text_", "id", "row", "key", "n", "hash", "body", "block_id", "sid", "score", "tokens", "__mix_x"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Mixing ------------------------------------------------------------------


@pytest.mark.parametrize("mix", [mixing.PRODUCTION, mixing.Mix(percent=25, max_epochs=1), mixing.Mix(percent=350, max_epochs=5, domains={"web": 3}, digits=1)])
def test_mixing_equals_its_sql_on_odd_rows(spark, mix):
    rows = odd_rows()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    c = duckdb.connect()
    c.register("documents", documents)
    want = sorted(c.execute(mixing.oracle(mix)).fetchall(), key=str)
    names = [x[0] for x in c.description]
    got = mixing.mixture(clashing(frame(spark, rows)), mix).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == want
    total = sum(len(words(x[1])) for x in rows)
    assert sum(r.n_taken for r in got) <= min(mix.percent, 100 * mix.max_epochs) * total // 100
    kept = mixing.take_documents(frame(spark, rows), mix)
    taken = Counter((r.doc_id, r.n_tokens) for r in got if r.epoch == 0)
    assert Counter((r.doc_id, len(words(r.text))) for r in kept.collect()) == taken


def test_mixing_keeps_its_budget_with_one_id_for_all_rows(spark):
    for i in (None, 3):
        rows = [(i, f"a b c d e f g h i {k}", "en", "src0", 1) for k in range(20)]
        got = mixing.mixture(frame(spark, rows), mixing.Mix(percent=25)).collect()
        assert sum(r.n_taken for r in got) == 50


# Vectors -----------------------------------------------------------------


def test_embeddings_of_odd_rows(spark):
    one, two = [1.0, 0.0, 0.0], [0.999, 0.01, 0.0]
    rows = [(1, one), (1, two), (2, one), (None, one), (3, None), (3, [0.0] * 3), (None, None), (4, [5e-300, 0.0, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("rep", F.lit(1))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(docs).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 0, None, None), (3, 0, 3, True), (3, 0, 3, True), (None, 0, None, None), (4, 3, 1, False)], key=str)
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# Secrets -----------------------------------------------------------------


def test_secrets_of_odd_rows_and_planted_ones(spark):
    model = secret_scan.fit(secret_scan.labelled(spark, 3000), trees=20)
    key = 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"'
    rows = [(1, key, "en", "src0", 1)] * 2 + [(None, key, None, None, 1), (2, "a " * 60_000 + key, None, None, 1)]
    got = secret_scan.scan(clashing(frame(spark, rows)).withColumn("start", F.lit("clash")), model=model).collect()
    assert sorted((r.id or 0, r.start) for r in got) == [(0, 9), (1, 9), (1, 9), (2, 120_009)]
    assert secret_scan.scan(empty(spark), model=model).collect() == []
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = r'(?<=token = ")[0-9a-f]{40}(?=")|(?<=password=)[0-9a-f]{12,}'
    want = {(r.doc_id, hashlib.sha256(t.encode()).hexdigest()) for r in docs.select("doc_id", F.regexp_extract_all("text", F.lit(planted), F.lit(0)).alias("t")).collect() for t in r.t or []}
    found = {(r.id, r.secret_sha256) for r in secret_scan.scan(docs, model=model).collect()}
    assert want
    assert len(want & found) >= 0.95 * len(want)
    assert len(found - want) <= 0.3 * len(found) + 5


def test_transitions_are_counted_ratios(spark):
    examples = spark.createDataFrame([("aB1-", 1.0), ("aaaa", 0.0)], "token string, label double")
    got = secret_scan.learn_transitions(examples)
    assert got["aa"] == pytest.approx(math.log((1 / 5) / (4 / 7)))
    assert got["aA"] == pytest.approx(math.log((2 / 5) / (1 / 7)))
    assert got["A0"] == pytest.approx(math.log((2 / 5) / (1 / 4)))


# Tokens ------------------------------------------------------------------


def test_token_output_of_odd_rows(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = odd_rows()
    manifest = token_output.write_tokens(clashing(frame(spark, rows)), PATH, str(tmp_path / "out"))
    got = [tuple(r) for r in token_output.read_tokens(manifest).orderBy("start").collect()]
    crc = lambda text: zlib.crc32(np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes())
    assert Counter((i, c) for i, _, _, c in got) == Counter((r[0], crc(r[1])) for r in rows)
    ids = [i for i, *_ in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n


def test_token_counts_of_odd_rows(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = odd_rows()
    got = token_counts.token_counts(clashing(frame(spark, rows)).drop("id"), PATH).collect()
    count = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((r[0], len((r[1] or "").encode()), count(r[1]), count(r[1]) > 512) for r in rows)
    assert token_counts.token_counts(empty(spark), PATH).collect() == []


# Quality -----------------------------------------------------------------


def test_quality_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    x, first, label = rng.standard_normal((9, 3)), np.array([0, 2, 3, 9]), np.array([1, 0, 1])
    w, t = rng.standard_normal(3), rng.standard_normal((2, 2))

    def brute(w, t):
        total = 0.0
        for d, (a, b) in enumerate(itertools.pairwise(first)):
            z = held = 0.0
            for y in itertools.product((0, 1), repeat=b - a):
                p = math.exp(sum((x[a + i] @ w) * y[i] for i in range(b - a)) + sum(t[y[i], y[i + 1]] for i in range(b - a - 1)))
                z += p
                held += p * math.prod(1 - quality_crf.NOISE if v == label[d] else quality_crf.NOISE for v in y)
            total += math.log(held / z) / (b - a)
        return total / 3

    value, gw, gt = quality_crf.likelihood(x, first, label, w, t)
    assert value == pytest.approx(brute(w, t))
    for i in range(3):
        e = np.eye(3)[i] * 1e-5
        assert gw[i] == pytest.approx((brute(w + e, t) - brute(w - e, t)) / 2e-5, abs=1e-6)
    for i, j in itertools.product((0, 1), repeat=2):
        e = np.zeros((2, 2))
        e[i, j] = 1e-5
        assert gt[i, j] == pytest.approx((brute(w, t + e) - brute(w, t - e)) / 2e-5, abs=1e-6)


def test_quality_scores_are_weighted_marginals(spark):
    """Scores of a fixed model against all labellings of the lines."""
    rng = np.random.default_rng(3)
    width = 3 * quality_crf.OWN + 3
    model = {"w": rng.standard_normal(width) / 4, "t": rng.standard_normal((2, 2)), "mean": np.zeros(width), "scale": np.ones(width)}
    texts = ["One line.", "a | b\nThe good one here.\n\nx", "", None, "\n\n", "l1\nl2\nl3 | |\nl4", "é ß\r\nz"]
    got = {r.id: r.score for r in quality_crf.score(clashing(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])).drop("id", "score"), model).collect()}
    from lodestone.llm._text import slices

    for i, text in enumerate(texts):
        (s,) = slices(pa.array([text or ""]))
        x, size, _ = quality_crf.features(s)
        e = x @ model["w"]
        total, good = 0.0, np.zeros(len(e))
        for y in itertools.product((0, 1), repeat=len(e)):
            p = math.exp(sum(e[k] * y[k] for k in range(len(e))) + sum(model["t"][y[k], y[k + 1]] for k in range(len(e) - 1)))
            total += p
            good += p * np.array(y)
        assert got[i] == pytest.approx(float(((size + 1) * good / total).sum() / (size + 1).sum()))


def test_quality_learns_that_kinds_of_lines_stay_together(spark):
    r = random.Random(6)
    prose = lambda: " ".join("".join(r.choice("aeioustrln") for _ in range(r.randint(2, 8))) for _ in range(9)).capitalize() + "."
    junk = lambda: " | ".join("".join(r.choice("ABCDEFG$%#") for _ in range(4)) for _ in range(6))
    rows, labels = [], []
    for i in range(240):
        n = r.randint(3, 8)
        text = [prose() for _ in range(n)] if i % 2 else [prose() for _ in range(r.randint(0, 2))] + [junk() for _ in range(n)]
        rows.append((i, "\n".join(text), None, None, 1))
        labels.append((i, i % 2, 0))
    docs, labels = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_crf.fit(docs, labels, F.lit(True))
    assert model["t"][0, 0] + model["t"][1, 1] > model["t"][0, 1] + model["t"][1, 0]
    clean, bad = quality_crf.score(frame(spark, [(1, "\n".join(prose() for _ in range(5)), None, None, 1), (2, "\n".join(junk() for _ in range(5)), None, None, 1)]), model).orderBy("id").collect()
    assert min(clean.lines) > 0.5 > max(bad.lines)
    assert quality_crf.score(empty(spark), model).collect() == []
    twice = quality_crf.score(frame(spark, rows[:3] * 2), model).collect()
    assert len(twice) == 6
    assert len({(x.id, x.score) for x in twice}) == 3
    again = quality_crf.fit(docs.union(docs), labels, F.lit(True))
    assert np.allclose(model["w"], again["w"])


# Language models ---------------------------------------------------------


def independent_scores(rows, held):
    """Deleted interpolation by dictionaries over words themselves."""
    tokens = [(["<s>"], [*words(r[1], fold=True), "</s>"]) for r in rows]
    uni, pair, docs = Counter(), Counter(), 0
    for (begin, t), out in zip(tokens, held):
        if not out:
            docs += 1
            uni.update(t)
            pair.update(zip(begin + t[:-1], t))
    n, v = sum(uni.values()), len(uni)
    context = Counter(uni)
    context["<s>"] = docs
    fine = lambda x: 2.0 ** (round(math.log2(max(x, 1)) * 4) / 4)
    half = lambda p: min(99, max(1, round(98 + 2 * math.log2(p)))) if p > 0 else 0
    cells = defaultdict(float)
    for (u, w), c in pair.items():
        cu, cw = fine(context[u]), fine(uni[w])
        p2 = (c - 1) / max(1, max(cu - 1, c - 1)) if c > 1 else 0.0
        p1 = max(cw - 1, c - 1) / max(1, n - 1)
        cells[(min(int(math.log2(max(cu, 1))), 39) * 100 + half(p2)) * 100 + half(p1)] += c
    keys = sorted(cells)
    weights = lm_scoring.mixture_weights(np.array(keys, dtype=np.int64), np.array([cells[k] for k in keys]), 1 / (v + 1))
    out = []
    for begin, t in tokens:
        total = 0.0
        for u, w in zip(begin + t[:-1], t):
            c = context[u]
            a = weights[min(int(math.log2(c)), 39) if c else 40]
            total += math.log10((a[0] * pair[u, w] / c if c else 0) + a[1] * uni[w] / max(1, n) + a[2] / (v + 1))
        out.append(total)
    return out


def test_lm_scores_equal_an_independent_model(spark):
    rows = corpus(90, seed=4) + [(None, "no id here", None, None, 1), (3, "another text", None, None, 1), (3, "another text", None, None, 1)]
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    held = [r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    got = lm_scoring.score_documents(clashing(frame(spark, rows)).drop("id"), train).collect()
    want = Counter((r[0], h, round(s, 6)) for r, h, s in zip(rows, held, independent_scores(rows, held)))
    assert Counter((r.doc_id, r.held_out, round(r.score, 6)) for r in got) == want
    assert lm_scoring.score_documents(empty(spark), train).collect() == []


# Decontamination and substrings ------------------------------------------


def test_decontamination_of_odd_rows(spark):
    rows = odd_rows()
    items = spark.createDataFrame([(1, "same same"), (2, "told"), (2, None), (None, "same"), (3, "word word word word word word word word word word")], "item_id long, text string")
    got = decontaminate.scan(clashing(frame(spark, rows)).drop("id"), items).collect()
    hit = lambda t: {i for i, k in ((1, "same same"), (2, "told"), (3, " ".join(["word"] * 10))) if f" {k} " in f" {' '.join(alnum(t))} "}
    assert Counter((r.id, tuple(r["items"])) for r in got) == Counter((r[0], tuple(map(str, sorted(hit(r[1]))))) for r in rows)
    assert decontaminate.scan(empty(spark), items).collect() == []
    plain = decontaminate.digest(decontaminate.scan(frame(spark, rows), items, spans=False)).collect()
    assert Counter(map(str, plain)) == Counter(map(str, decontaminate.digest(decontaminate.scan(frame(spark, rows), items)).collect()))


def test_substrings_of_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [*odd_rows(), (50, passage, None, None, 1), (51, f"x {passage}", None, None, 1), (None, passage + " end", None, None, 1)]
    got = substring_dedup.remove_repeats(clashing(frame(spark, rows)).drop("id"), texts=True).collect()
    assert len(got) == len(rows)
    by = {(r.id, r.n_words): r for r in got}
    # The row without an id comes first and keeps the passage.
    assert (by[None, 31].n_removed, by[50, 30].n_removed, by[51, 31].n_removed) == (0, 30, 30)
    assert by[51, 31].kept_sha256 == "x"
    assert {r.n_removed for r in got if r.n_words < 20} == {0}


def test_blocks_are_made_of_whole_tables(spark):
    assert _blocks.cut(np.array([1, 1 << 63], dtype=np.uint64), 1).tolist() == [0, 1, 2]


# Pipeline ----------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on a small corpus: which rows it keeps, and that it keeps them whole."""
    import corpus_pipeline

    base = corpus(80, seed=12)
    passage = " ".join(f"bench{i}" for i in range(14))
    rows = [*base, (200, f"start {passage} end of it", "en", "src0", 1), (201, "some words " * 3, "de", "src1", 1), (201, "some words " * 3, "de", "src1", 1), (None, "lone words without an id here", None, None, 1), (202, None, None, None, 0)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, stages = str(tmp_path), dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda r: tuple(r)

    kept = stages["quality"](spark, docs, sf).collect()
    model = quality_crf.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), quality_crf.remainder() != 0)
    good = Counter((r.id, r.score >= 0.3) for r in quality_crf.score(docs, model).collect())
    assert Counter(r.doc_id for r in kept) == Counter(dict((i, n) for (i, ok), n in good.items() if ok))

    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w := words(r[1], fold=True)) >= 5 else frozenset([tuple(w)] if w else []) for r in rows]
    n = len(rows)
    links = [(a, b) for a in range(n) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    top = components(range(n), links)
    best = {}
    for i, r in enumerate(rows):
        if sets[i]:
            best[top[i]] = min(best.get(top[i], (2, 0, 0)), (r[0] is None, r[0] or 0, i))
    want = Counter(rows[i][0] for _, _, i in best.values()) + Counter(r[0] for r, x in zip(rows, sets) if not x)
    out = stages["near_duplicates"](spark, docs, sf)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == want
    assert {key(r) for r in out.collect()} <= {key(r) for r in docs.collect()}

    out = stages["decontamination"](spark, docs, sf)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in rows if passage not in " ".join(alnum(r[1])))

    out = stages["mixing"](spark, docs, sf)
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"}))
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in c.execute(mixing.oracle(corpus_pipeline.MIX)).fetchall())

    last = stages["token_output"](spark, docs, sf).collect()
    assert Counter(r.doc_id for r in last) == Counter(r[0] for r in rows)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(whole) < n
    for name, stage in corpus_pipeline.STAGES:
        none = spark.createDataFrame([], SCHEMA)
        assert stage(spark, none, sf).collect() == [], name
    assert ngram_jaccard.SMALL_GROUP > 1
