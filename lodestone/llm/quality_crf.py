"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Emissions are linear in the line's own
features and those of the lines before and after it; transitions are four
weights. Forward-backward marginals, weighted by line length, give the score of
a document, so one bad line in a long good text weighs little.

Labels are of documents, so lines are latent in training: each line is taken to
show its document's label, wrongly with the chance `NOISE`. What is maximised is
the likelihood of the labels over all labellings of the lines; its gradient, for
emissions and transitions alike, is the difference of expected counts with and
without the labels, and each document weighs the same. So a document may have
lines of both kinds, and the transitions between kinds are learned.

Training takes a bounded sample of labelled documents with their whole texts: in
order of a hash of their id, `SAMPLE` documents at most, of which one that would
bring all of them above `SAMPLE_LINES` lines is passed over. Scores are of whole
texts. Labels, language, source and id
are no features.

Null and empty texts are one empty line and get a score as any other. Rows that
repeat an id get a row each (in training one of them counts). Without labels of
both kinds, every score is the share of good labels (0.5 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import store
from ._text import WHITESPACE_WORDS, TextSlice, slices, trimmed, words

SAMPLE = 6000
SAMPLE_LINES = 150_000
THRESHOLD = 0.3
NOISE = 0.02
OWN = 15


def _kinds() -> np.ndarray:
    """Class of each byte: 0 letter, 1 capital, 2 digit, 3 blank, 4 stop, 5 bar, 6 other sign, 7 beyond ASCII."""
    k = np.full(256, 6, dtype=np.uint8)
    k[97:123], k[65:91], k[48:58], k[128:] = 0, 1, 2, 7
    k[[0x20, *range(9, 14)]] = 3
    k[list(b".,;:'-()\"?")] = 4
    k[ord("|")] = 5
    return k


_KINDS = _kinds()


def lines_of(s: TextSlice) -> tuple[TextSlice, np.ndarray]:
    """The lines of a slice as a slice of their own, and the number of lines before each row (n + 1 values); each row has a line at least."""
    breaks = np.flatnonzero(s.data == 0x0A) + 1
    # A break at a row's very end starts no further line.
    inner = breaks[~np.isin(breaks, s.offsets[1:])]
    starts = np.sort(np.concatenate([s.offsets[:-1], inner]), kind="stable")
    first = np.searchsorted(inner, s.offsets) + np.arange(s.n + 1)
    return TextSlice(s.first, len(starts), s.data, np.append(starts, len(s.data))), first


def _own_features(lines: TextSlice) -> np.ndarray:
    n = lines.n
    size = np.diff(lines.offsets)
    line = np.repeat(np.arange(n), size)
    kinds = np.bincount(line * 8 + _KINDS[lines.data], minlength=8 * n).reshape(n, 8).astype(float)
    w = words(lines, WHITESPACE_WORDS, lower=True)
    count = np.diff(w.first).astype(float)
    at_least = np.maximum(count, 1)
    length = (w.end - w.start).astype(float)
    same = np.zeros(len(w.hash), dtype=bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    order = np.lexsort((w.hash, w.row))
    h, r = w.hash[order], w.row[order]
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (r[1:] == r[:-1])]) if len(h) else np.zeros(0, bool)
    last = _KINDS[lines.data[w.end - 1]] if len(w.hash) else np.zeros(0, np.uint8)
    per = lambda x, rows=w.row: np.bincount(rows, weights=x, minlength=n)
    signs = np.bincount(line, weights=(_KINDS[lines.data] == 6), minlength=n)
    total = np.maximum(size, 1)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1] + kinds[:, 7], 1)
    mean = per(length) / at_least
    return np.stack(
        [
            np.log1p(size), np.log1p(count), mean / 8, np.sqrt(np.maximum(per(length**2) / at_least - mean**2, 0)) / 8,
            kinds[:, 1] / letters, kinds[:, 2] / total, kinds[:, 4] / total * 4, np.minimum(kinds[:, 5] / at_least, 1), np.minimum(signs / at_least, 3),
            per(same.astype(float)) / at_least, per(again.astype(float), r) / at_least, per((length <= 3).astype(float)) / at_least,
            per((last == 6).astype(float)) / at_least, per((length == 1).astype(float)) / at_least, (size == 0).astype(float),
        ],
        axis=1,
    )


def features(s: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, bytes of each line, lines before each row)."""
    lines, first = lines_of(s)
    own = _own_features(lines)
    n = len(own)
    begins, ends = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    begins[first[:-1]] = True
    ends[first[1:] - 1] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[begins], after[ends] = 0, 0
    x = np.concatenate([own, before, after, begins[:, None], ends[:, None], np.ones((n, 1))], axis=1)
    return x, np.diff(lines.offsets).astype(float), first


def _logaddexp(a, b):
    return np.logaddexp(a, b)


def marginals(emission: np.ndarray, first: np.ndarray, t: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transitions and the sum of log partition sums.

    emission: score of good against bad; t[i, j]: score of label j after i;
    weight: of each row in the two sums. All rows advance together, one line a step.
    """
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    n = len(emission)
    e = np.stack([np.zeros(n), emission], 1)
    f, b = np.zeros((n, 2)), np.zeros((n, 2))
    longest = int(count[0]) if len(count) else 0
    live = [int(np.searchsorted(-count, -step, side="left")) for step in range(longest)]
    if longest:
        f[begin] = e[begin]
    for step in range(1, longest):
        at = begin[: live[step]] + step
        p = f[at - 1]
        f[at] = e[at] + np.stack([_logaddexp(p[:, 0] + t[0, j], p[:, 1] + t[1, j]) for j in (0, 1)], 1)
    for step in range(longest - 2, -1, -1):
        at = begin[: live[step + 1]] + step
        q = b[at + 1] + e[at + 1]
        b[at] = np.stack([_logaddexp(q[:, 0] + t[i, 0], q[:, 1] + t[i, 1]) for i in (0, 1)], 1)
    z = _logaddexp(*(f + b).T)
    good = np.exp(np.minimum(f[:, 1] + b[:, 1] - z, 0))
    pairs = np.zeros((2, 2))
    inner = np.ones(n, dtype=bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    each = np.ones(len(first) - 1) if weight is None else weight
    line = np.repeat(each, np.diff(first))[at]
    for i in (0, 1):
        for j in (0, 1):
            pairs[i, j] = (line * np.exp(np.minimum(f[at - 1, i] + t[i, j] + e[at, j] + b[at, j] - z[at], 0))).sum()
    return good, pairs, float((each[order] * z[begin]).sum())


def likelihood(x: np.ndarray, first: np.ndarray, label: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log likelihood of the documents' labels, each weighed by 1 / lines, and its gradient in emissions and transitions."""
    count = np.diff(first)
    share = 1 / count
    e = x @ w
    # A shown label is right with chance 1 - NOISE: a score for its own kind of line.
    shown = np.repeat(np.where(label > 0, 1.0, -1.0), count) * np.log((1 - NOISE) / NOISE)
    free, free_pairs, free_z = marginals(e, first, t, share)
    held, held_pairs, held_z = marginals(e + shown, first, t, share)
    # A bad label's factor is (1 - NOISE) for bad lines and NOISE for good ones; e holds the difference only.
    base = (share * count * np.where(label > 0, np.log(NOISE), np.log(1 - NOISE))).sum()
    n = len(label)
    return (held_z + base - free_z) / n, x.T @ ((held - free) * np.repeat(share, count)) / n, (held_pairs - free_pairs) / n


def train(x: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 250, ridge: float = 1e-3) -> dict:
    """Weights by full-batch Adam on the likelihood of the documents' labels."""
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale[scale < 1e-9] = 0, 1
    x = (x - mean) / scale
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, rounds + 1):
        _, gw, gt = likelihood(x, first, label, w, t)
        g = np.concatenate([gw - ridge * w, (gt - ridge * t).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w += move[: len(w)]
        t += move[len(w) :].reshape(2, 2)
    return {"w": w, "t": t, "mean": mean, "scale": scale}


def _collect(batches):
    for batch in batches:
        for s in slices(batch.column(1)):
            x, _, first = features(s)
            body = [x[first[i] : first[i + 1]].astype(np.float32).tobytes() for i in range(s.n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.array(body, pa.binary())], ["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> dict:
    """A model from at most `sample` labelled documents of `sample_lines` lines in all where `learn`, a boolean column of labels, holds."""
    rows = labels.where(learn).where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("quality"))
    # At most `sample` rows of two numbers: small enough to send to each executor.
    chosen = rows.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    found = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.first("quality").alias("quality"), F.min(F.coalesce(text_col, F.lit(""))).alias("text"))
    found = store(found.select(id_col, "quality", "text", (F.regexp_count("text", F.lit("\n")) + 1).alias("lines")), "sample")
    # As many rows as the sample has; each is taken whole or not at all.
    taken, left = [], sample_lines
    for r in found.select(id_col, "lines").orderBy(F.xxhash64(id_col), id_col).collect():
        if r.lines <= left:
            taken.append((r[0],))
            left -= r.lines
    kept = docs.sparkSession.createDataFrame(taken, found.select(id_col).schema)
    got = found.join(F.broadcast(kept), id_col).select("quality", "text").mapInArrow(trimmed(_collect), "quality int, x binary").toArrow()
    y = got["quality"].to_numpy().astype(int) if got.num_rows else np.zeros(0, int)
    if len(set(y.tolist())) < 2:
        return {"share": float(y.mean()) if len(y) else 0.5}
    width = 3 * OWN + 3
    xs = [np.frombuffer(b, np.float32).reshape(-1, width) for b in got["x"].to_pylist()]
    # The driver's rows come in no fixed order; a fixed one makes the same model each time.
    order = sorted(range(len(xs)), key=lambda i: (y[i], xs[i].tobytes()))
    xs, y = [xs[i] for i in order], y[order]
    first = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
    return train(np.concatenate(xs).astype(float), first, y)


def _score(model: dict):
    def run(batches):
        for batch in batches:
            for s in slices(batch.column(1)):
                if "share" in model:
                    score, lines = np.full(s.n, model["share"]), [[]] * s.n
                else:
                    x, size, first = features(s)
                    good, _, _ = marginals((x - model["mean"]) / model["scale"] @ model["w"], first, model["t"])
                    weight = size + 1
                    # Rounded, so that equal texts get equal scores wherever they lie in a batch.
                    score = np.round(np.add.reduceat(weight * good, first[:-1]) / np.add.reduceat(weight, first[:-1]), 12)
                    lines = [good[first[i] : first[i + 1]].tolist() for i in range(s.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.array(np.clip(score, 0, 1)), pa.array(lines, pa.list_(pa.float64()))], ["id", "score", "lines"])

    return run


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, lines): the score and P(good) of every line."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_score(model), f"id {kind}, score double, lines array<double>")


def remainder(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5


def keep_good(docs: DataFrame, labels: DataFrame, learn, threshold: float = THRESHOLD) -> DataFrame:
    """Documents scored at the threshold or above, with all their columns."""
    model = fit(docs, labels, learn)
    columns = docs.columns
    at = columns.index("text")

    def run(batches):
        for batch in batches:
            keep = []
            for out in _score(model)(iter([pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(at)], ["id", "text"])])):
                keep.append(pa.array(out.column(1).to_numpy() >= threshold))
            if keep:
                yield batch.filter(pa.concat_arrays(keep))

    return docs.mapInArrow(trimmed(run), docs.schema)


def op6_quality_crf(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(docs, labels, remainder() != 0))
    return out.select(F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
