"""Periodic runs of words, and texts with their repetitions collapsed.

A run is a stretch of consecutive words in which words `q` apart are identical
and which no neighbouring word extends; it has at least `min_periods` periods
and `min_length` words, and `q` is its smallest period. A run of three periods
covers three neighbours of the grid of multiples of `q`, so all runs start from
(period, grid point) pairs, about n log n of them: pairs whose words differ
leave at once, those whose two blocks of `q` words have other prefix hashes
next, and the common extensions of all the rest, to both sides, are found by
one binary search over arrays. Runs found from several grid points or under
multiples of their period are counted once. Words themselves are compared
before a run is given; where hashes collided, its stretch is cut at the words
that differ.

A pass over rows without a shuffle. A slice of texts is a few megabytes, a
longer text its own slice, and pairs are extended in chunks, so memory follows
the longest text. Null and empty texts have no words, no runs and an empty
collapsed text. Repeated rows and ids give a row each; a null id stays null.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import TextSlice, Words, slices, trimmed, words

MIN_LENGTH = 24
MIN_PERIODS = 3
#: Pairs of period and grid point that are extended at once.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Prefix:
    """Prefix sums of word hashes times powers of an odd base, modulo 2 ** 64."""

    def __init__(self, h: np.ndarray):
        self.power = np.full(len(h) + 1, _BASE, dtype=np.uint64)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.power[:-1], dtype=np.uint64)])

    def same(self, i: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether `size` words from i on have the hash of those from i + q on."""
        t = self.total
        return (t[i + size] - t[i]) * self.power[q] == t[i + q + size] - t[i + q]


def _grid_pairs(h: np.ndarray, row: np.ndarray, longest: int, min_periods: int):
    """Chunks of (grid point, period): three neighbours of the grid with the same word, in one row."""
    held, n = [], 0
    for q in range(1, longest // min_periods + 1):
        g = h[::q]
        same = g[1:] == g[:-1]
        k = np.flatnonzero(same[1:] & same[:-1])
        if len(k):
            k *= q
            k = k[row[k] == row[k + 2 * q]]
            held.append((k, np.full(len(k), q)))
            n += len(k)
            if n >= CHUNK:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _longest(low: np.ndarray, high: np.ndarray, holds) -> np.ndarray:
    """The largest value in low..high for which `holds`, for all places at once; it holds at low."""
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) // 2
        good = holds(open_, mid)
        low[open_] = np.where(good, mid, low[open_])
        high[open_] = np.where(good, high[open_], mid - 1)


def _extended(p: _Prefix, first: np.ndarray, row: np.ndarray, i: np.ndarray, q: np.ndarray, min_length: int, min_periods: int) -> np.ndarray:
    """Distinct (start, end, period) of the stretches around grid points whose two blocks agree."""
    some = p.same(i, q, q)
    i, q = i[some], q[some]
    begin, stop = first[row[i]], first[row[i] + 1]
    ahead = _longest(q.copy(), stop - q - i, lambda at, size: p.same(i[at], q[at], size))
    back = _longest(np.zeros(len(i), np.int64), i - begin, lambda at, size: p.same(i[at] - size, q[at], size))
    out = np.stack([i - back, i + ahead + q, q], 1)
    size = out[:, 1] - out[:, 0]
    return np.unique(out[size >= np.maximum(min_length, min_periods * q)], axis=0)


class _Letters:
    """Compares words of a slice by their bytes."""

    def __init__(self, s: TextSlice, w: Words):
        self.size = w.end - w.start
        inside = np.zeros(len(s.data) + 1, dtype=np.int8)
        np.add.at(inside, w.start, 1)
        np.add.at(inside, w.end, -1)
        self.body = s.data[np.cumsum(inside)[:-1] > 0]
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    def differing(self, start: int, end: int, q: int) -> np.ndarray:
        """Places k in start..end - q whose word isn't that of k + q."""
        a, b, n = start, start + q, end - q - start
        sizes = self.size[a : a + n] == self.size[b : b + n]
        if sizes.all() and (self.body[self.at[a] : self.at[a + n]] == self.body[self.at[b] : self.at[b + n]]).all():
            return np.zeros(0, np.int64)
        raw, at = self.body.tobytes(), self.at.tolist()
        return start + np.flatnonzero([raw[at[k] : at[k + 1]] != raw[at[k + q] : at[k + q + 1]] for k in range(a, a + n)])


def find_runs(s: TextSlice, w: Words, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Rows (start, end, period) by start and period; start and end are places among the words of the slice."""
    counts = np.diff(w.first)
    if not len(counts) or counts.max() < min_periods:
        return np.zeros((0, 3), np.int64)
    p = _Prefix(w.hash)
    found = [_extended(p, w.first, w.row, i, q, min_length, min_periods) for i, q in _grid_pairs(w.hash, w.row, int(counts.max()), min_periods)]
    found = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    if not len(found):
        return found
    letters = _Letters(s, w)
    kept, held = [], None
    for start, end, q in found.tolist():
        if (start, end) == held:
            continue  # a multiple of the run's period
        wrong = letters.differing(start, end, q)
        if not len(wrong):
            held = (start, end)
            kept.append((start, end, q))
            continue
        edges = [start - 1, *wrong.tolist(), end - q]
        kept += [(a + 1, b + q, q) for a, b in zip(edges, edges[1:]) if b + q - a - 1 >= max(min_length, min_periods * q)]
    out = np.unique(np.array(kept, np.int64).reshape(-1, 3), axis=0)
    if len(out):
        out = out[np.concatenate([[True], (out[1:, :2] != out[:-1, :2]).any(1)])]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _joined(s: TextSlice, w: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each row with one space between."""
    start, size, row = w.start[keep], (w.end - w.start)[keep], w.row[keep]
    blank = np.zeros(len(row), dtype=np.int64)
    blank[:-1] = row[1:] == row[:-1]
    to = np.cumsum(size + blank)
    out = np.full(int(to[-1]) if len(to) else 0, 0x20, dtype=np.uint8)
    to -= size + blank
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + step] = s.data[np.repeat(start, size) + step]
    per_row = np.zeros(s.n + 1, dtype=np.int64)
    np.add.at(per_row, row + 1, size + blank)
    offsets = np.cumsum(per_row).astype(np.int32)
    return pa.StringArray.from_buffers(s.n, pa.py_buffer(offsets), pa.py_buffer(out))


def _scan(min_length: int, min_periods: int, texts: bool):
    def run(batches):
        for batch in batches:
            for s in slices(batch.column(1)):
                w = words(s)
                runs = find_runs(s, w, min_length, min_periods)
                row = w.row[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
                order = np.lexsort((runs[:, 2], runs[:, 0], row))
                runs, row = runs[order], row[order]
                held = pa.StructArray.from_arrays([pa.array(runs[:, 0] - w.first[row]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(_RUN))
                offsets = np.searchsorted(row, np.arange(s.n + 1)).astype(np.int32)
                columns = [batch.column(0).slice(s.first, s.n), pa.array(np.diff(w.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), held)]
                if texts:
                    dropped = np.zeros(len(w.hash) + 1, dtype=np.int64)
                    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
                    np.add.at(dropped, runs[:, 1], -1)
                    columns.append(_joined(s, w, np.cumsum(dropped)[:-1] == 0))
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"][: len(columns)])

    return trimmed(run)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS, texts: bool = True) -> DataFrame:
    """(id_col, n_words, runs, collapsed) of each row.

    `runs` are structs (start, length, period), by start and then period, in
    words from 0. `collapsed` has the words that no run holds after its first
    period, joined by one space; it is left out without `texts`.
    """
    if min_periods < 3 or min_length < 1:
        raise ValueError("runs have three periods and one word at least")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>" + ", collapsed string" * texts
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan(min_length, min_periods, texts), schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the strongest run and digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    # Runs come by start and period, so of equally strong ones the first stays; ratios are compared by products of whole numbers.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r.length * a.period > a.length * r.period, r).otherwise(a))
    out = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(id_col, "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_repetitions(text: Column, doc_id: Column) -> Column:
    """A tenth of the texts, by the crc32 of their id, with words from a place on repeated at a period, both from that crc32."""
    w = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(doc_id.cast("string").cast("binary"))
    rows = F.struct(w.alias("w"), F.size(w).cast("long").alias("n"), F.floor(h / 10).alias("g"))
    row = F.transform(F.array(rows), lambda x: F.struct(x.w.alias("w"), x.n.alias("n"), x.g.alias("g"), F.pmod(x.g, F.nullif(x.n, F.lit(0))).alias("a")))

    def repeated(x):
        p = F.lit(1) + F.floor((x.n - x.a) / (F.lit(3) + F.pmod(x.g, F.lit(8))))
        period = F.slice(x.w, (x.a + 1).cast("int"), p.cast("int"))
        whole = F.concat(F.slice(x.w, F.lit(1), x.a.cast("int")), F.flatten(F.array_repeat(period, F.ceil((x.n - x.a) / p).cast("int"))))
        return F.array_join(F.slice(whole, F.lit(1), x.n.cast("int")), " ")

    planted = F.get(F.transform(row, repeated), F.lit(0))
    return F.when((h % 10 == 0) & F.exists(row, lambda x: x.n > 0), planted).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", with_repetitions(F.col("text"), F.col("doc_id")).alias("text"))
    return digest(periodic_runs(docs))
