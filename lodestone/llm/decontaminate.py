"""Benchmark decontamination with suffix arrays of the training texts.

Each slice of documents is a shard. Its suffix array holds the word suffixes
that begin with a word pair of the test items (no other suffix can match a
window of them), sorted by the hashes of their first words. Every distinct
window that a test suffix begins with is searched by bisection, all of them at
once; the run of suffixes that share it gives its places, so a place counts once
for each size of window, however often a window is repeated on either side. For
spans, the words from each place on give the longest verbatim match of each test
suffix.

The test items are sent to the executors in blocks of at most `BLOCK_BYTES` of
text, so what is broadcast is bounded; more blocks mean more passes.

An item of fewer words than a window, but not none, is one window. Null and
empty texts have no words, hit nothing and are hit by nothing; items without an
id are no items. Repeated items
and rows count as rows of their own; an item_id is listed once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import ALNUM_WORDS, TextSlice, Words, mix64, ngrams, slices, trimmed, words

WINDOW = 10
BLOCK_BYTES = 8 << 20


@dataclass
class TestItems:
    """Word hashes of all items, item after item, and their ids."""

    ids: np.ndarray
    hash: np.ndarray
    item: np.ndarray
    last: np.ndarray
    start: np.ndarray
    size: np.ndarray
    heads: np.ndarray
    single: np.ndarray
    #: Distinct windows: a first word, the number of words, and the class of all windows with the same items.
    window_start: np.ndarray
    window_size: np.ndarray
    window_class: np.ndarray
    class_items: list[np.ndarray]


def _distinct_windows(h: np.ndarray, item: np.ndarray, start: np.ndarray, size: np.ndarray):
    gram = np.zeros(len(start), np.uint64)
    for k in np.unique(size).tolist():
        mine = size == k
        gram[mine] = ngrams(h, k)[start[mine]]
    order = np.lexsort((item[start], gram, size))
    start, size, gram = start[order], size[order], gram[order]
    if not len(start):
        return start, size, start, []
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (size[1:] != size[:-1])])
    other = new | np.concatenate([[True], item[start][1:] != item[start][:-1]])
    window, of = (np.cumsum(new) - 1)[other], item[start][other]
    first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
    marks = mix64(of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    named = np.stack([np.add.reduceat(marks, first), np.diff(np.append(first, len(of))).astype(np.uint64)], 1)
    _, one, group = np.unique(named, axis=0, return_index=True, return_inverse=True)
    stop = np.append(first, len(of))
    return start[new], size[new], group.reshape(-1), [of[stop[i] : stop[i + 1]] for i in one.tolist()]


def prepare(ids: list, texts: list, window: int = WINDOW) -> TestItems:
    """Test suffixes that begin a window: `start` is their first word, `size` the words of that window."""
    hashes, item = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for s in slices(pa.array(texts, pa.string())):
        w = words(s, ALNUM_WORDS, lower=True)
        hashes.append(w.hash)
        item.append(w.row + s.first)
    h, item = np.concatenate(hashes), np.concatenate(item)
    count = np.bincount(item, minlength=len(ids))
    first = np.cumsum(count) - count
    last = (first + count)[item]
    left = last - np.arange(len(h))
    size = np.minimum(window, count[item])
    start = np.flatnonzero(left >= size)
    pair = ngrams(h, 2)
    heads = np.unique(pair[start[size[start] >= 2]]) if len(h) > 1 else np.zeros(0, np.uint64)
    single = np.unique(h[start[size[start] == 1]])
    return TestItems(np.array(ids, dtype=object), h, item, last, start, size[start], heads, single, *_distinct_windows(h, item, start, size[start]))


def _among(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(of, x)
    at[at == len(of)] = 0
    return of[at] == x


class SuffixArray:
    """Sorted suffixes of a shard's word hashes, from the given positions; a suffix ends with its row."""

    def __init__(self, w: Words, at: np.ndarray, depth: int):
        self.hash, self.stop = w.hash, w.first[w.row + 1] if len(w.hash) else w.first[:0]
        n = len(at)
        self.at = at[np.lexsort([self._word(at, i) for i in reversed(range(depth))])] if n else at

    def _word(self, at: np.ndarray, i: int) -> np.ndarray:
        """Hash of the word i places on, 0 beyond the row's end."""
        to = at + i
        inside = to < self.stop[at]
        return np.where(inside, self.hash[np.where(inside, to, 0)], np.uint64(0))

    def _compare(self, suffix: np.ndarray, q: TestItems, start: np.ndarray, words_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sign of (array suffix - test suffix) over the first `words_` words, and how many words agree."""
        sign = np.zeros(len(start), dtype=np.int64)
        same = np.zeros(len(start), dtype=np.int64)
        open_ = np.arange(len(start))
        i = 0
        while len(open_):
            open_ = open_[words_[open_] > i]
            a = self._word(suffix[open_], i)
            b = q.hash[start[open_] + i]
            equal = a == b
            sign[open_[~equal]] = np.where(a[~equal] < b[~equal], -1, 1)
            open_ = open_[equal]
            same[open_] += 1
            i += 1
        return sign, same

    def bound(self, q: TestItems, start: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
        """First place whose suffix is not below (upper: is above) each test window."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.at), np.int64)
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return low
            mid = (low[live] + high[live]) >> 1
            sign, _ = self._compare(self.at[mid], q, start[live], size[live])
            right = sign <= 0 if upper else sign < 0
            low[live[right]] = mid[right] + 1
            high[live[~right]] = mid[~right]

    def search(self, q: TestItems) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the test suffix, position, words matched) of every place where a test window occurs."""
        low = self.bound(q, q.start, q.size, False)
        high = self.bound(q, q.start, q.size, True)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        place = self.at[np.repeat(low, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
        start = q.start[which]
        _, same = self._compare(place, q, start, q.last[start] - start)
        return which, place, same


    def places(self, q: TestItems) -> tuple[np.ndarray, np.ndarray]:
        """(distinct window, position) of every place where one occurs."""
        low = self.bound(q, q.window_start, q.window_size, False)
        n = self.bound(q, q.window_start, q.window_size, True) - low
        which = np.repeat(np.arange(len(n)), n)
        return which, self.at[np.repeat(low, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]


def _array(s: TextSlice, q: TestItems, window: int) -> tuple[Words, SuffixArray | None]:
    w = words(s, ALNUM_WORDS, lower=True)
    at = np.zeros(0, np.int64)
    if len(w.hash) and len(q.start):
        starts = _among(w.hash, q.single)
        if len(w.hash) > 1:
            starts[:-1] |= _among(ngrams(w.hash, 2), q.heads)
        at = np.flatnonzero(starts)
    return w, SuffixArray(w, at, window) if len(at) else None


def occurrences(s: TextSlice, q: TestItems, window: int = WINDOW) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a slice, and (distinct window, position) of each place of a window."""
    w, array = _array(s, q, window)
    none = np.zeros(0, np.int64)
    return w, *(array.places(q) if array else (none, none))


def matches(s: TextSlice, q: TestItems, window: int = WINDOW) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice, and (test suffix, position, words matched) of each pair of a place and a test suffix; as many as there are such pairs."""
    w, array = _array(s, q, window)
    none = np.zeros(0, np.int64)
    return w, *(array.search(q) if array else (none, none, none))


def _hits(q: TestItems, window: int, more: bool):
    """What `_scan` gives without spans: with `more`, the stretches of words hit are carried to the next block of items."""

    def run(batches):
        for batch in batches:
            earlier = "items" in batch.schema.names
            for s in slices(batch.column(1)):
                w, which, place = occurrences(s, q, window)
                hit = np.zeros(len(w.hash) + 1, dtype=np.int64)
                np.add.at(hit, place, 1)
                np.add.at(hit, place + q.window_size[which], -1)
                if earlier:
                    known = batch.column("hits").slice(s.first, s.n)
                    row = np.repeat(np.arange(s.n), pa.compute.list_value_length(known).to_numpy(zero_copy_only=False))
                    first, size = (known.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    np.add.at(hit, w.first[row] + first, 1)
                    np.add.at(hit, w.first[row] + first + size, -1)
                hit = np.cumsum(hit)[:-1] > 0
                inside = np.concatenate([[0], np.cumsum(hit)])
                pairs = np.unique(np.stack([w.row[place], q.window_class[which]], 1), axis=0) if len(place) else np.zeros((0, 2), np.int64)
                count = np.array([len(q.class_items[c]) for c in pairs[:, 1].tolist()], dtype=np.int64)
                items = np.concatenate([q.class_items[c] for c in pairs[:, 1].tolist()]) if len(pairs) else np.zeros(0, np.int64)
                listed = batch.column("items").slice(s.first, s.n).to_pylist() if earlier else []
                found = {"n_words": pa.array(np.diff(w.first)), "n_hit": pa.array(inside[w.first[1:]] - inside[w.first[:-1]]), "items": _listed(q.ids, np.repeat(pairs[:, 0], count), items, s.n, listed)}
                if more:
                    edge = np.concatenate([hit, [False]]) ^ np.concatenate([[False], hit])
                    edge[w.first] |= np.concatenate([hit, [False]])[w.first]
                    begins = np.flatnonzero(edge[:-1] & hit) if len(hit) else np.zeros(0, np.int64)
                    row_end = w.first[w.row[begins] + 1] if len(begins) else begins
                    off = np.flatnonzero(~hit)
                    stop = np.append(off, len(hit))[np.searchsorted(off, begins)] if len(begins) else begins
                    row = w.row[begins] if len(begins) else begins
                    struct = pa.StructArray.from_arrays([pa.array(begins - w.first[row]), pa.array(np.minimum(stop, row_end) - begins)], fields=list(_HIT))
                    found["hits"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(s.n + 1)).astype(np.int32)), struct)
                yield pa.RecordBatch.from_pydict({c: batch.column(c).slice(s.first, s.n) for c in ("id", "text")[: 1 + more]} | found)

    return trimmed(run)


_HIT = pa.struct([("first", pa.int64()), ("size", pa.int64())])


def _listed(ids: np.ndarray, rows: np.ndarray, items: np.ndarray, n: int, known: list) -> pa.Array:
    """Ids of the distinct items of each row as sorted strings, with those that are known already."""
    pairs = np.unique(np.stack([rows, items], 1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
    out = [list(x) for x in known] if known else [[] for _ in range(n)]
    for r, i in pairs.tolist():
        out[r].append(ids[i])
    return pa.array([sorted(set(map(str, x))) for x in out], pa.list_(pa.string()))


def _scan(q: TestItems, window: int, more: bool = False):
    """Each occurrence of each test suffix; more: each row keeps its text for the next block of items, and what the blocks before have found."""

    def run(batches):
        for batch in batches:
            earlier = "items" in batch.schema.names
            for s in slices(batch.column(1)):
                w, which, place, same = matches(s, q, window)
                hit = np.zeros(len(w.hash) + 1, dtype=np.int64)
                np.add.at(hit, place, 1)
                np.add.at(hit, place + q.size[which], -1)
                inside = np.concatenate([[0], np.cumsum(np.cumsum(hit)[:-1] > 0)])
                row = w.row[place]
                known = batch.column("items").slice(s.first, s.n).to_pylist() if earlier else []
                found = {"n_words": pa.array(np.diff(w.first)), "n_hit": pa.array(inside[w.first[1:]] - inside[w.first[:-1]]), "items": _listed(q.ids, row, q.item[q.start[which]], s.n, known)}
                each = batch.column("spans").slice(s.first, s.n).to_pylist() if earlier else [[] for _ in range(s.n)]
                for r, i, p, m, z in zip(row.tolist(), q.item[q.start[which]].tolist(), (place - w.first[row]).tolist(), same.tolist(), q.size[which].tolist()):
                    each[r].append({"first": p, "size": z, "longest": m, "item_id": q.ids[i]})
                found["spans"] = pa.array(each, pa.list_(_SPAN))
                yield pa.RecordBatch.from_pydict({c: batch.column(c).slice(s.first, s.n) for c in ("id", "text")[: 1 + more]} | found)

    return run


_SPAN = pa.struct([("first", pa.int64()), ("size", pa.int64()), ("longest", pa.int64()), ("item_id", pa.string())])


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, spans: bool = True) -> DataFrame:
    """(id, n_words, n_hit, items, spans) of each document; without `spans` they aren't made, and repeated windows cost nothing more.

    `items` are the ids, as sorted strings, of items with occurring windows;
    `spans` has each occurrence: first word, words of the window, longest
    verbatim match from there, item.
    """
    tests = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and length(text) > 0")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<first: long, size: long, longest: long, item_id: string>>"
    blocks = _blocks(tests, window)
    if not spans:
        plain = schema.partition(", spans")[0]
        for q in blocks[:-1]:
            rows = rows.mapInArrow(_hits(q, window, True), plain.replace(", n_words", ", text string, n_words", 1) + ", hits array<struct<first: long, size: long>>")
        return rows.mapInArrow(_hits(blocks[-1], window, False), plain)
    if len(blocks) == 1:
        return rows.mapInArrow(_scan(blocks[0], window), schema)
    for q in blocks:
        rows = rows.mapInArrow(_scan(q, window, True), schema.replace(", n_words", ", text string, n_words", 1))
    return _recounted(rows)


def _blocks(tests: DataFrame, window: int) -> list[TestItems]:
    """The items in blocks of bounded text; the driver holds one block's texts at a time."""
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    dealt = tests.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    out = []
    for i in range(n):
        got = dealt.where(F.col("part") == i).orderBy("item_id").toArrow() if n > 1 else tests.orderBy("item_id").toArrow()
        out.append(prepare(got["item_id"].to_pylist(), got["text"].to_pylist(), window))
    return out


def _recounted(rows: DataFrame) -> DataFrame:
    """After several blocks: hit words are recounted from the spans of all."""
    merged = rows.withColumn("spans", F.array_sort("spans"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        stop = x["first"] + x["size"]
        return F.struct(F.greatest(acc["end"], stop).alias("end"), (acc["n"] + F.greatest(stop - F.greatest(acc["end"], x["first"]), F.lit(0))).alias("n"))

    return merged.withColumn("n_hit", F.aggregate("spans", start, step)["n"]).select("id", "n_words", "n_hit", "items", "spans")


def digest(scanned: DataFrame) -> DataFrame:
    listed = F.array_join("items", ",")
    return scanned.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Documents in which no window of any item occurs, with all their columns; each row is judged where it lies, so nothing is shuffled."""
    tests = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and length(text) > 0")
    at = docs.columns.index(text_col)

    def keep(q: TestItems):
        def run(batches):
            for batch in batches:
                hit = np.zeros(batch.num_rows, dtype=bool)
                for s in slices(batch.column(at)):
                    w, _, place = occurrences(s, q, window)
                    hit[s.first + w.row[place]] = True
                yield batch.filter(pa.array(~hit))

        return trimmed(run)

    for q in _blocks(tests, window):
        docs = docs.mapInArrow(keep(q), docs.schema)
    return docs


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spans=False))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS g
       FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS g
       FROM d, ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k),
hits AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
