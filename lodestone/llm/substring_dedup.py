"""Substring dedup: seed on winnowed anchors, extend, keep maximal repeats.

Of the grams of `ANCHOR` words in a window of `WINDOW` words the one with the
least hash is the window's anchor, so equal windows have equal anchors.

1. Seed. Blocks ask which of their anchors occur elsewhere too.
2. Extend. Around each repeated anchor, both ways, the windows that it anchors
   are hashed, and blocks ask for each distinct one whether an earlier document
   has it. Within a block, later occurrences are known at once.
3. Repeated windows of a document that overlap or touch merge to maximal
   repeats, whose words are removed. The first occurrence always stays.

The order is that of doc_id, then of place in the text. Rows that repeat a
doc_id count as one document each, in an order of their own. Null texts have no
words; rows with a null id come before all others. Texts of fewer words than a
window stay whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as B
from ._text import TextSlice, ngrams, slices, window_starts, words

WINDOW = 20
ANCHOR = 10


def _least(h: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k consecutive values."""
    size, out = 1, h
    while size * 2 <= k:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    return np.minimum(out[: len(h) - k + 1], out[k - size :])


class _Block:
    """Word windows of a block's texts and the anchor of each."""

    def __init__(self, body, window: int, anchor: int):
        batch = B.unpack(body)
        self.ids, self.texts = batch.column(0), batch.column(1)
        self.slice = next(slices(self.texts, 1 << 40))
        self.words = words(self.slice)
        self.window = window
        h = self.words.hash
        self.at = window_starts(self.words, window)
        if len(self.at):
            self.anchors = _least(ngrams(h, anchor), window - anchor + 1)[self.at]
        else:
            self.anchors = np.zeros(0, np.uint64)

    def seeds(self, anchor: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, sorted, and whether each has more than one place here."""
        u = np.unique(self.anchors)
        grams = ngrams(self.words.hash, anchor)
        begin = window_starts(self.words, anchor)
        g = grams[begin]
        slot = np.searchsorted(u, g)
        slot[slot == len(u)] = 0
        places = np.bincount(slot[u[slot] == g], minlength=len(u)) if len(u) else np.zeros(0, int)
        return u, places > 1

    def windows(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows with a repeated anchor: their first words, sorted distinct hashes, index of the first of each, and index of each window's hash."""
        u = np.unique(self.anchors)
        at = self.at[repeated[np.searchsorted(u, self.anchors)]] if len(u) else self.at
        h = ngrams(self.words.hash, self.window)[at]
        u, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        return at, u, index, inverse


def _blocks(batches):
    for batch in batches:
        for s in slices(batch.column(1)):
            part = batch.slice(s.first, s.n)
            yield part.take(pc.sort_indices(part.column(0), null_placement="at_start"))


def _ask_anchors(window: int, anchor: int, bits: int):
    def run(batches):
        for batch in batches:
            for block_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                u, twice = _Block(body.as_buffer(), window, anchor).seeds(anchor)
                yield B.questions(block_id, u, bits, lambda a, b: np.packbits(twice[a:b]).tobytes() + u[a:b].tobytes())

    return run


def _packed(body: bytes, width: int) -> tuple[np.ndarray, bytes]:
    """Flags and the rest of a blob of n flags and n entries of `width` bytes."""
    n = (8 * len(body)) // (8 * width + 1)
    while -(-n // 8) + n * width != len(body):
        n += 1 if -(-n // 8) + n * width < len(body) else -1
    cut = -(-n // 8)
    return np.unpackbits(np.frombuffer(body, np.uint8, cut), count=n).astype(bool), body[cut:]


def _answer_anchors(ids: list[int], blobs: list[bytes]) -> tuple[list[bytes], list[float]]:
    flags, hashes = zip(*(_packed(b, 8) for b in blobs))
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in hashes])
    twice = np.concatenate(flags)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    often = (np.bincount(group) > 1) | (np.bincount(group, weights=twice[order]) > 0)
    repeated = np.empty(len(h), dtype=bool)
    repeated[order] = often[group]
    ends = np.cumsum([len(f) for f in flags])[:-1]
    return [np.packbits(x).tobytes() + len(x).to_bytes(8, "little") for x in np.split(repeated, ends)], []


def _flags(found: list[bytes]) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(b, np.uint8, len(b) - 8), count=int.from_bytes(b[-8:], "little")).astype(bool) for b in found]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _ordered(ids: pa.Array) -> np.ndarray:
    """Ids as 64-bit keys in their order; null comes first."""
    x = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)
    return x


def _ask_windows(window: int, anchor: int, bits: int):
    def run(batches):
        for batch in batches:
            for i, (block_id, body) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                repeated = _flags(B.bodies(batch.column(2), i))
                if not repeated.any():
                    continue
                block = _Block(body.as_buffer(), window, anchor)
                at, u, index, _ = block.windows(repeated)
                row = block.words.row[at[index]].astype(np.uint16 if len(block.ids) <= 1 << 16 else np.uint32)
                ids = _ordered(block.ids)

                def blob(a, b, u=u, row=row, ids=ids):
                    used, which = np.unique(row[a:b], return_inverse=True)
                    which = which.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
                    return len(used).to_bytes(8, "little") + (b - a).to_bytes(8, "little") + ids[used].tobytes() + u[a:b].tobytes() + which.tobytes()

                yield B.questions(block_id, u, bits, blob)

    return run


def _answer_windows(ids: list[int], blobs: list[bytes]) -> tuple[list[bytes], list[float]]:
    """Whether a document before the block's own first one has the window."""
    hashes, docs, sizes = [], [], []
    for b in blobs:
        used, n = int.from_bytes(b[:8], "little"), int.from_bytes(b[8:16], "little")
        table = np.frombuffer(b, np.int64, used, 16)
        hashes.append(np.frombuffer(b, np.uint64, n, 16 + 8 * used))
        docs.append(table[np.frombuffer(b, np.uint16 if used <= 1 << 16 else np.uint32, n, 16 + 8 * (used + n))])
        sizes.append(n)
    h, d = np.concatenate(hashes), np.concatenate(docs)
    rank = np.repeat(np.argsort(np.argsort(np.array(ids))), sizes)
    order = np.lexsort((rank, d, h))
    s = h[order]
    later = np.empty(len(h), dtype=bool)
    later[order] = np.concatenate([[False], s[1:] == s[:-1]]) if len(s) else False
    return [np.packbits(x).tobytes() + len(x).to_bytes(8, "little") for x in np.split(later, np.cumsum(sizes)[:-1])], []


_OUT = "id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first: long, size: long>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("size", pa.int64())]))


def _remove(window: int, anchor: int, texts: bool):
    def run(batches):
        for batch in batches:
            for i, body in enumerate(batch.column(0)):
                block = _Block(body.as_buffer(), window, anchor)
                w, n = block.words, len(block.ids)
                gone = np.zeros(len(w.hash) + 1, dtype=np.int64)
                repeated = _flags(B.bodies(batch.column(1), i))
                if repeated.any():
                    at, u, index, inverse = block.windows(repeated)
                    later = _flags(B.bodies(batch.column(2), i))[inverse]
                    first = np.zeros(len(at), dtype=bool)
                    first[index] = True
                    some = at[later | ~first]
                    np.add.at(gone, some, 1)
                    np.add.at(gone, some + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                yield _kept(block, gone, n, texts)

    return run


def _kept(block: _Block, gone: np.ndarray, n: int, texts: bool) -> pa.RecordBatch:
    w = block.words
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[w.first[1:]] - total[w.first[:-1]]
    raw = block.slice.data.tobytes()
    start, end, keep = w.start.tolist(), w.end.tolist(), (~gone).tolist()
    kept, spans = [], []
    first = w.first.tolist()
    for r in range(n):
        a, b = first[r], first[r + 1]
        kept.append(b" ".join([raw[start[j] : end[j]] for j in range(a, b) if keep[j]]))
        spans.append(_runs(gone[a:b]) if removed[r] else [])
    shown = pa.array([x.decode() for x in kept], pa.string()) if texts else pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
    return pa.RecordBatch.from_arrays([block.ids.cast(pa.int64()), pa.array(np.diff(w.first)), pa.array(removed), shown, pa.array(spans, _SPANS)], ["id", "n_words", "n_removed", "kept_sha256", "spans"])


def _runs(gone: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return [{"first": int(a), "size": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, texts: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans) of each document; with `texts`, kept_sha256 holds the kept words themselves.

    `spans` are the maximal repeats that are removed: first word and size.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    blocks = B.build(rows, _blocks, "texts")
    bits = B.range_bits(blocks)
    anchors = B.answered(blocks.mapInArrow(_ask_anchors(window, anchor, bits), B.QUESTION), _answer_anchors, bits, "anchors")
    asked = B.with_answers(blocks, anchors=anchors).select("block_id", "body", "anchors").mapInArrow(_ask_windows(window, anchor, bits), B.QUESTION)
    found = B.answered(asked, _answer_windows, bits, "windows")
    return B.with_answers(blocks, anchors=anchors, windows=found).select("body", "anchors", "windows").mapInArrow(_remove(window, anchor, texts), _OUT)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
