"""Packing: pieces against the library, sequences against their capacities and a packing piece by piece."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import best_fit_packing as packing

from .helpers import SCHEMA, corpus, frame

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def pieces_of(rows, longest):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    out = []
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % longest or longest, len(ids) + 1, longest)] if len(ids) > longest else [0, len(ids)]
        out += [(r[0], i, a, ids[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def held(sequences, cap):
    """All capacities hold and offsets have no gaps; sequences: lists of (offset, length)."""
    for parts in sequences:
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap.tokens
        assert cap.documents is None or len(parts) <= cap.documents
        assert cap.cost is None or sum(n * n for _, n in parts) <= cap.cost


def one_by_one(lengths, cap):
    """Best fit by tokens left, a piece at a time, longest first."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if sum(b) + n <= cap.tokens and (cap.documents is None or len(b) < cap.documents) and (cap.cost is None or sum(x * x for x in b) + n * n <= cap.cost)]
        if fits:
            max(fits, key=sum).append(n)
        else:
            bins.append([n])
    return len(bins)


@pytest.mark.parametrize("cap", [packing.Capacity(60), packing.Capacity(60, 3), packing.Capacity(60, None, 1200), packing.Capacity(60, 4, 900), packing.Capacity(7, 1, 49)])
@pytest.mark.parametrize("seed", [1, 2])
def test_plans_place_each_piece_once(cap, seed):
    r = random.Random(seed)
    lengths = [min(cap.piece, max(1, round(r.choice([r.gauss(8, 5), r.uniform(1, 60), 17])))) for _ in range(700)]
    count = Counter(lengths)
    n, c = np.array(sorted(count)), np.array([count[x] for x in sorted(count)])
    for rule in ("norm", "dot"):
        p = packing.plan_bins(n, c, cap, rule)
        length = np.repeat(n, c)
        rank = np.concatenate([np.arange(x) for x in c])
        shuffled = np.random.default_rng(seed).permutation(len(length))
        sequence, offset = p.place(length[shuffled], rank[shuffled])
        assert sorted(set(sequence.tolist())) == list(range(p.n_sequences))
        bins = defaultdict(list)
        for s, o, x in zip(sequence.tolist(), offset.tolist(), length[shuffled].tolist()):
            bins[s].append((o, x))
        held(bins.values(), cap)
    best = packing.best_plan(n, c, cap).n_sequences
    bounds = [(n * c).sum() / cap.tokens, c.sum() / (cap.documents or 1e9), (n * n * c).sum() / (cap.cost or 1e18)]
    assert max(bounds) <= best <= one_by_one(lengths, cap) * 1.02 + 1


def test_plans_dont_grow_with_the_documents():
    n = np.arange(1, 2049)
    few, many = (packing.plan_bins(n, np.full(2048, k), packing.Capacity(), "norm") for k in (3, 3_000_000))
    assert many.n_sequences == pytest.approx(few.n_sequences * 1e6, rel=1e-3)
    assert len(many.first) < 20 * 2048


@pytest.mark.parametrize("cap", [packing.Capacity(), packing.Capacity(64, 5, 2500)])
def test_packed_pieces(spark, cap):
    rows = corpus(50) + [(None, "no id", None, None, 0), (7, "again", None, None, 0), (7, "again", None, None, 0), (90, "word " * 7000, None, None, 0)]
    docs = frame(spark, rows).withColumn("length", F.lit("clash")).withColumn("rank", F.lit(1))
    got = packing.pack(docs, PATH, cap).collect()
    want = pieces_of(rows, cap.piece)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(((d, i, a, len(x), crc(x)) for d, i, a, x in want), key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    held(bins.values(), cap)
    assert len(bins) <= one_by_one([len(x) for *_, x in want], cap) * 1.02 + 1


def test_sequences_hold_the_tokens(spark):
    rows = corpus(40)
    cap = packing.Capacity(100, 6)
    got = packing.sequences(frame(spark, rows), PATH, cap).collect()
    left = Counter((d, tuple(x)) for d, _, _, x in pieces_of(rows, 100))
    for r in got:
        assert sum(r.lengths) == len(r.ids) <= 100 and len(r.lengths) <= 6
        at = 0
        for doc, n in zip(r.doc_ids, r.lengths):
            left[doc, tuple(r.ids[at : at + n])] -= 1
            at += n
    assert not any(left.values()) and len({r.sequence_id for r in got}) == len(got)


def test_packing_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack(empty, PATH).collect() == [] and packing.sequences(empty, PATH).collect() == []
    assert [tuple(r)[1:4] for r in packing.pack(frame(spark, [(1, None, None, None, None)]), PATH).collect()] == [(0, 0, 1)]
    with pytest.raises(ValueError):
        packing.Capacity(0)
