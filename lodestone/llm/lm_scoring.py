"""Language-model scoring by deleted interpolation.

    p(w | u) = a(b) c(u, w) / c(u) + d(b) c(w) / N + e(b) / (V + 1)

Maximum-likelihood estimates of bigrams and unigrams and a uniform share are
mixed with weights of the bucket b that the frequency of the context u falls
into (its power of two). The weights of each bucket are learned by expectation
maximisation on held-out counts: each training n-gram is predicted from the
counts of all the others (its own occurrence deleted), so no text is set aside.
Contexts that training never saw use weights learned without the bigram term.

Words are hashed to 64 bits once; blocks of documents ask for the counts of
their distinct words and then of their distinct bigrams (`_blocks`). The driver
gets sums and a histogram of fixed size for the weights.

Null texts count as empty: their only token is the end. Rows with a null id are
scored but not learned from, and count as held out. Repeated rows count each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as B
from ._text import WHITESPACE_WORDS, mix64, slices, words

SLICE = 3 << 20
_END = np.uint64(0x1D8E4E27C47D124F)
_BEGIN = np.uint64(0xEB44ACCAB455D165)
_FINE = 4
_BUCKETS = 40


def _z(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _uz(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def _blob(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unblob(b: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at : at + 4], "little")
        out.append(b[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _blocks(batches):
    for batch in batches:
        for s in slices(batch.column(2), SLICE):
            w = words(s, WHITESPACE_WORDS, lower=True)
            u, inverse = np.unique(w.hash, return_inverse=True)
            part = batch.slice(s.first, s.n)
            arrays = [u, inverse.astype(np.uint32), np.diff(w.first).astype(np.int64), part.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], ["ids", "u", "token", "count", "train"])


class _Block:
    def __init__(self, body):
        batch = B.unpack(body.as_buffer())
        self.ids = batch.column(0)[0].as_py()
        self.u, self.token, self.count, self.train = (np.frombuffer(batch.column(i)[0].as_buffer(), t) for i, t in ((1, np.uint64), (2, np.uint32), (3, np.int64), (4, np.uint8)))
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def unigrams(self) -> np.ndarray:
        """Training count of each distinct word of this block."""
        return np.bincount(self.token[self.train[self.row] > 0], minlength=len(self.u))

    def bigrams(self):
        """Contexts and words of all tokens, rows' ends included: (context, word, row), where len(u) stands for begin and end."""
        n, k = len(self.count), len(self.u)
        total = len(self.token) + n
        stop = np.cumsum(self.count + 1) - 1
        word = np.full(total, k, dtype=np.int64)
        inside = np.ones(total, dtype=bool)
        inside[stop] = False
        word[inside] = self.token
        context = np.empty(total, dtype=np.int64)
        context[1:] = word[:-1]
        context[:1] = k
        return context, word, np.repeat(np.arange(n), self.count + 1)

    def distinct(self, context, word):
        """Distinct bigrams in order of their hashes: (hash, context, word, index of each token's bigram)."""
        k = len(self.u)
        code, inverse = np.unique(context * (k + 1) + word, return_inverse=True)
        c, w = code // (k + 1), code % (k + 1)
        h = np.append(self.u, _BEGIN)[c] * np.uint64(0xC2B2AE3D27D4EB4F) + np.append(self.u, _END)[w]
        h = mix64(h)
        order = np.argsort(h)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return h[order], c[order], w[order], place[inverse]


def _ask_words(bits: int):
    def run(batches):
        for batch in batches:
            for block_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = _Block(body)
                n = block.unigrams().astype(np.uint32)
                yield B.questions(block_id, block.u, bits, lambda a, b: _blob(block.u[a:b].tobytes(), _z(n[a:b])))

    return run


def _sums(blobs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Hashes and counts of all blobs: (count of each distinct hash, distinct hash of each entry, entries that show each, sizes)."""
    h = np.concatenate([np.frombuffer(b[0], np.uint64) for b in blobs])
    n = np.concatenate([_uz(b[1], np.uint32) for b in blobs]).astype(np.int64)
    _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
    return np.bincount(inverse, weights=n).astype(np.int64), inverse, index, [len(b[0]) // 8 for b in blobs]


def _answer_words(ids, bodies):
    total, inverse, _, sizes = _sums([_unblob(b) for b in bodies])
    out = total[inverse]
    return [_z(x.astype(np.uint32 if x.max(initial=0) < 1 << 32 else np.uint64)) + bytes([4 if x.max(initial=0) < 1 << 32 else 8]) for x in np.split(out, np.cumsum(sizes)[:-1])], [float(total.sum()), float((total > 0).sum())]


def _counts(found: list[bytes]) -> np.ndarray:
    return np.concatenate([_uz(b[:-1], np.uint32 if b[-1] == 4 else np.uint64).astype(np.int64) for b in found]) if found else np.zeros(0, np.int64)


def _fine(n: np.ndarray) -> np.ndarray:
    """Quarter powers of two of a count (1 or more)."""
    return np.round(np.log2(np.maximum(n, 1)) * _FINE).astype(np.uint8)


def _asked(block: _Block, n_words: np.ndarray, docs: int):
    """Distinct bigrams whose word and context training has: what is asked for, in order of hashes."""
    context, word, row = block.bigrams()
    h, c, w, place = block.distinct(context, word)
    n = np.append(n_words, docs)
    return context, word, row, h, c, w, place, n, (n[c] > 0) & (n[w] > 0)


def _ask_bigrams(bits: int, docs: int):
    def run(batches):
        for batch in batches:
            for i, (block_id, body) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                block = _Block(body)
                _, _, row, h, c, w, place, n, ask = _asked(block, _counts(B.bodies(batch.column(2), i)), docs)
                train = np.bincount(place[block.train[row] > 0], minlength=len(h)).astype(np.uint32)
                h, train, qc, qw = h[ask], train[ask], _fine(n[c[ask]]), _fine(n[w[ask]])
                yield B.questions(block_id, h, bits, lambda a, b: _blob(h[a:b].tobytes(), _z(train[a:b]), _z(qc[a:b]), _z(qw[a:b])))

    return run


def _half(p: np.ndarray) -> np.ndarray:
    """Half powers of two of a probability as 1..99; 0 for none."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round(98 + 2 * np.log2(p)), 1, 99), 0).astype(np.int64)


def _answer_bigrams(total_tokens: int):
    def answer(ids, bodies):
        blobs = [_unblob(b) for b in bodies]
        total, inverse, index, sizes = _sums(blobs)
        context = 2.0 ** (np.concatenate([_uz(b[2], np.uint8) for b in blobs])[index] / _FINE)
        word = 2.0 ** (np.concatenate([_uz(b[3], np.uint8) for b in blobs])[index] / _FINE)
        # Deleted estimates: what the other occurrences say about this one.
        some = total > 0
        c = total[some].astype(float)
        others = np.maximum(context[some] - 1, c - 1)
        p2 = np.where(c > 1, (c - 1) / np.maximum(others, 1), 0.0)
        p1 = np.maximum(word[some] - 1, c - 1) / max(1, total_tokens - 1)
        bucket = np.minimum(np.log2(np.maximum(context[some], 1)).astype(np.int64), _BUCKETS - 1)
        cell = (bucket * 100 + _half(p2)) * 100 + _half(p1)
        cells, at = np.unique(cell, return_inverse=True)
        weight = np.bincount(at, weights=c, minlength=len(cells))
        stats = np.stack([cells.astype(float), weight], 1).ravel().tolist()
        out = total[inverse]
        return [_z(x.astype(np.uint32 if x.max(initial=0) < 1 << 32 else np.uint64)) + bytes([4 if x.max(initial=0) < 1 << 32 else 8]) for x in np.split(out, np.cumsum(sizes)[:-1])], stats

    return answer


def mixture_weights(cells: np.ndarray, weight: np.ndarray, p0: float, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket by expectation maximisation; the last row is for unseen contexts."""

    def value(q):
        return np.where(q > 0, 2.0 ** ((q - 98) / 2), 0.0)

    bucket, p2, p1 = cells // 10_000, value(cells // 100 % 100), value(cells % 100)
    out = np.zeros((_BUCKETS + 1, 3))
    none = np.zeros_like(p2)
    for b in range(_BUCKETS + 1):
        mine = bucket == b if b < _BUCKETS else np.ones(len(cells), dtype=bool)
        p = np.stack([p2[mine] if b < _BUCKETS else none[mine], p1[mine], np.full(mine.sum(), p0)], 1)
        w = weight[mine]
        a = np.array([0.5, 0.4, 0.1]) if b < _BUCKETS else np.array([0.0, 0.8, 0.2])
        for _ in range(rounds if len(w) else 0):
            share = p * a
            share /= share.sum(1, keepdims=True)
            a = (share * w[:, None]).sum(0) / w.sum()
        a = np.maximum(a, [0.0, 0.0, 1e-6])
        out[b] = a / a.sum()
    return out


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(weights: np.ndarray, total: int, distinct: int, docs: int):
    def run(batches):
        for batch in batches:
            for i, body in enumerate(batch.column(0)):
                block = _Block(body)
                context, word, row, h, c, w, place, n, ask = _asked(block, _counts(B.bodies(batch.column(1), i)), docs)
                pair = np.zeros(len(h), dtype=np.int64)
                pair[ask] = _counts(B.bodies(batch.column(2), i))
                nc, nw = n[c], n[w]
                bucket = np.where(nc > 0, np.minimum(np.log2(np.maximum(nc, 1)).astype(np.int64), _BUCKETS - 1), _BUCKETS)
                a = weights[bucket]
                p = a[:, 0] * pair / np.maximum(nc, 1) + a[:, 1] * nw / max(1, total) + a[:, 2] / (distinct + 1)
                size = len(block.count)
                score = np.bincount(row, weights=np.log10(p)[place], minlength=size)
                base = np.bincount(row, weights=np.log10((n + 1) / (total + distinct + 1))[word], minlength=size)
                known = np.bincount(row, weights=n[word] > 0, minlength=size).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids, pa.int64()), pa.array(block.train == 0), pa.array(block.count + 1), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
                )

    return run


def score_documents(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all documents with a model of those where the boolean column `train` holds.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score, both log10.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(text_col, F.lit("")).alias("text"))
    blocks = B.build(rows, _blocks, "words")
    bits = B.range_bits(blocks)
    learned = rows.where("train").count()
    unigrams = B.answered(blocks.mapInArrow(_ask_words(bits), B.QUESTION), _answer_words, bits, "unigrams")
    sums = unigrams.where("stats is not null").agg(F.sum(F.col("stats")[0]), F.sum(F.col("stats")[1])).first()
    total, distinct = int(sums[0] or 0) + learned, int(sums[1] or 0) + (learned > 0)
    asked = B.with_answers(blocks, words=unigrams).select("block_id", "body", "words").mapInArrow(_ask_bigrams(bits, learned), B.QUESTION)
    pairs = B.answered(asked, _answer_bigrams(total), bits, "bigrams")
    seen = pairs.where("size(stats) > 0").selectExpr("inline(transform(sequence(1, size(stats), 2), i -> struct(cast(stats[i - 1] AS long) AS cell, stats[i] AS weight)))")
    cells = seen.groupBy("cell").agg(F.sum("weight").alias("weight")).orderBy("cell").collect()
    weights = mixture_weights(np.array([r[0] for r in cells], dtype=np.int64), np.array([r[1] for r in cells], dtype=float), 1 / (distinct + 1))
    out = B.with_answers(blocks, words=unigrams, pairs=pairs).select("body", "words", "pairs").mapInArrow(_score(weights, total, distinct, learned), _OUT)
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
