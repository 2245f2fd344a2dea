"""Clones as classes of equal passages, and alignments of two streams merged into clones.

Pairs of copies grow with the square of a group; classes don't. A window that
occurs more than once is a node; where all its occurrences are followed by one
and the same window, which follows no other, the two belong to one passage. So
a passage is a longest chain of such windows, each occurrence of it is one row,
and a passage in 10,000 streams makes 10,000 rows. Passages are named by a
digest of their tokens of 128 bits, read from the streams themselves, so two
windows with one 64-bit hash make no clone.

Windows of a stream meet in one task, as do the alignments of one pair of
streams; both are bounded by the streams. Null streams of tokens have no
windows. Streams have a name each; repeated names count as one stream with
repeated places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clone_pairs import clones_of_pairs
from .clones import MAX_WINDOWS_PER_HASH, windows

#: Hashes that a sketch looks out for: those of a larger share of all windows than 1 / TRACKED are surely among them.
TRACKED = 4096

# Alignments merge over so many lines and tokens on both sides.
LINE_GAP = 2
TOKEN_GAP = 1


def heavy_hashes(found: DataFrame, most: int = TRACKED) -> DataFrame:
    """At most `most` hashes with their exact number of windows, from a sketch: the hot keys of a join, and the first to look at for capacity."""
    sketch = found.agg(F.expr(f"approx_top_k(h, {most}, {2 * most})").alias("top")).select(F.explode("top").alias("t")).select(F.col("t.item").alias("h"))
    return found.join(F.broadcast(sketch), "h").groupBy("h").agg(F.count("*").alias("n"))


def over_capacity(found: DataFrame, limit: int = MAX_WINDOWS_PER_HASH, most: int = TRACKED) -> DataFrame:
    """(h, n) of windows that occur more than `limit` times.

    The sketch answers alone where it tracks everything that frequent: with n
    windows, from a limit of n / most on. Else all hashes are counted.
    """
    total = found.count()
    counted = heavy_hashes(found, most) if limit * most >= total else found.groupBy("h").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit)


def _with_counts(found: DataFrame) -> DataFrame:
    """Windows that occur more than once, with their number and whether one and the same window comes before all of them.

    The rows of the most frequent hashes meet their counts by a broadcast of at
    most TRACKED rows, so no key is hot in the join of the rest.
    """
    one = (F.count("before") == F.count("*")) & (F.min("before") == F.max("before"))
    stats = found.groupBy("h").agg(F.count("*").alias("n"), F.coalesce(one, F.lit(False)).alias("chained")).where("n > 1")
    hot = stats.orderBy(F.desc("n"), "h").limit(TRACKED // 4)
    marks = hot.select("h", F.lit(True).alias("hot"))
    dealt = found.select("stream", "i", "h").join(F.broadcast(marks), "h", "left")
    frequent = dealt.where("hot").join(F.broadcast(hot), "h")
    rest = dealt.where("hot is null").join(stats.hint("merge"), "h")
    return frequent.unionByName(rest).select("stream", "i", "h", "n", "chained")


def occurrences(streams: DataFrame, k: int) -> DataFrame:
    """(passage, tokens, stream, start): each place of each repeated passage of k tokens or more."""
    rows = _with_counts(windows(streams, k))
    by = Window.partitionBy("stream").orderBy("i")
    goes_on = F.col("chained") & (F.lag("i").over(by) == F.col("i") - 1) & (F.lag("n").over(by) == F.col("n"))
    rows = rows.withColumn("begins", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    chains = rows.withColumn("chain", F.sum("begins").over(by)).groupBy("stream", "chain").agg(F.min("i").alias("start"), (F.count("*") + (k - 1)).alias("size"))
    # A stream's chains go to its tokens as one row, so tokens aren't copied for each of them.
    lists = chains.groupBy("stream").agg(F.collect_list(F.struct("start", "size")).alias("chains"))
    named = streams.select("stream", "tokens").join(lists.hint("merge"), "stream")
    digest = F.transform("chains", lambda c: F.struct(F.md5(F.to_json(F.slice("tokens", (c.start + 1).cast("int"), c.size.cast("int")))).alias("passage"), c.size.alias("tokens"), c.start.alias("start")))
    return named.select("stream", F.explode(digest).alias("c")).select("c.passage", "c.tokens", "stream", "c.start")


def classes(found: DataFrame) -> DataFrame:
    """(passage, tokens, places, streams, links) of each class of equal passages; links are its pairs of places."""
    n = F.col("places")
    out = found.groupBy("passage", "tokens").agg(F.count("*").alias("places"), F.count_distinct("stream").alias("streams")).where("places > 1")
    return out.withColumn("links", F.expr("places * (places - 1) div 2")).select("passage", "tokens", n, "streams", "links")


@dataclass
class Alignment:
    """Equal tokens of two streams from two places on, with the line of each token."""

    a: int
    b: int
    lines_a: np.ndarray
    lines_b: np.ndarray


@dataclass
class Merged:
    a: int
    a_end: int
    b: int
    b_end: int
    first_a: int
    last_a: int
    first_b: int
    last_b: int


class _Sweep:
    """Takes the equal windows of a pair in order and keeps the alignment that is open.

    A window joins it if it begins within the gaps on both sides and what both
    sides then span is equal, wherever its own diagonal lies; one that overlaps
    it and doesn't join is dropped; any other opens the next one.

    Runs are three arrays: where they begin on both sides and their tokens.
    """

    def __init__(self, runs: tuple[np.ndarray, np.ndarray, np.ndarray], k: int):
        self.k, self.done, self.open = k, [], None
        self.a, self.b, self.n = runs

    def _verified(self, a: int, a_end: int, b: int, b_end: int) -> bool:
        return a_end - a == b_end - b and bool(((self.a - self.b == a - b) & (self.a <= a) & (a_end < self.a + self.n)).any())

    def take(self, a: int, b: int, first_a: int, last_a: int, first_b: int, last_b: int) -> None:
        o, a_end, b_end = self.open, a + self.k - 1, b + self.k - 1
        if o is None:
            self.open = Merged(a, a_end, b, b_end, first_a, last_a, first_b, last_b)
            return
        near = first_a <= o.last_a + LINE_GAP and first_b <= o.last_b + LINE_GAP and a <= o.a_end + TOKEN_GAP and b <= o.b_end + TOKEN_GAP
        if near:
            touching = o.a - o.b == a - b and o.a <= a_end + 1 and o.b <= b_end + 1
            whole = (min(o.a, a), max(o.a_end, a_end), min(o.b, b), max(o.b_end, b_end))
            if touching or self._verified(*whole):
                o.a, o.a_end, o.b, o.b_end = whole
                o.last_a, o.last_b = max(o.last_a, last_a), max(o.last_b, last_b)
                return
        if (a <= o.a_end and a_end >= o.a) or (b <= o.b_end and b_end >= o.b):
            return
        self.done.append(o)
        self.open = Merged(a, a_end, b, b_end, first_a, last_a, first_b, last_b)

    def _next(self, at: int, a, b, first_a, first_b) -> int:
        """The first window from `at` on that could make the open alignment larger or open another; all before it change nothing."""
        o, size = self.open, 32
        while at < len(a):
            x, y, fa, fb = (c[at : at + size] for c in (a, b, first_a, first_b))
            x_end, y_end = x + (self.k - 1), y + (self.k - 1)
            over = ((x <= o.a_end) & (x_end >= o.a)) | ((y <= o.b_end) & (y_end >= o.b))
            near = (fa <= o.last_a + LINE_GAP) & (fb <= o.last_b + LINE_GAP) & (x <= o.a_end + TOKEN_GAP) & (y <= o.b_end + TOKEN_GAP)
            grown_a = np.maximum(o.a - x, 0) + np.maximum(x_end - o.a_end, 0)
            grown_b = np.maximum(o.b - y, 0) + np.maximum(y_end - o.b_end, 0)
            alike = (x - y == o.a - o.b) | (o.a_end - o.a + grown_a == o.b_end - o.b + grown_b)
            may = (near & (grown_a + grown_b > 0) & alike) | ~over
            first = int(may.argmax())
            if may[first]:
                return at + first
            at, size = at + size, min(4 * size, 8192)
        return at

    def take_all(self, a, b, first_a, last_a, first_b, last_b) -> None:
        """Windows in order. Those that go on along the diagonal of one that has joined, in line and order, join as well, at once."""
        follows = (a[1:] == a[:-1] + 1) & (b[1:] == b[:-1] + 1) & (first_a[1:] <= last_a[:-1] + LINE_GAP) & (first_b[1:] <= last_b[:-1] + LINE_GAP)
        stops = np.append(np.flatnonzero(~follows), len(a) - 1)
        at = 0
        while at < len(a):
            if self.open is not None:
                at = self._next(at, a, b, first_a, first_b)
                if at >= len(a):
                    return
            x, y = int(a[at]), int(b[at])
            self.take(x, y, int(first_a[at]), int(last_a[at]), int(first_b[at]), int(last_b[at]))
            o, end = self.open, int(stops[np.searchsorted(stops, at)])
            if o.a - o.b == x - y and o.a <= x and o.a_end >= x + self.k - 1:
                o.a_end, o.b_end = max(o.a_end, int(a[end]) + self.k - 1), max(o.b_end, int(b[end]) + self.k - 1)
                o.last_a, o.last_b = max(o.last_a, int(last_a[end])), max(o.last_b, int(last_b[end]))
                at = end
            at += 1


#: Windows of a pair that are held at once, or those of one line where it has more.
HELD = 1 << 20


def _ordered(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by keys, the first counting most."""
    packed, bits = np.zeros(len(keys[0]), np.int64), 0
    for c in keys:
        low = int(c.min())
        width = (int(c.max()) - low).bit_length()
        bits += width
        if bits > 62:
            return np.lexsort(keys[::-1])
        packed = (packed << width) | (c - low)
    return np.argsort(packed)


def _swept(runs: tuple[np.ndarray, np.ndarray, np.ndarray], equal: tuple[np.ndarray, np.ndarray, np.ndarray], lines_a: np.ndarray, lines_b: Callable, k: int, min_lines: int, same: bool) -> list[Merged]:
    """Clones of one pair of streams, from runs of equal windows and maximal runs of equal tokens (begins on both sides, tokens), the lines of all tokens of a, and the first and last lines in b of windows by (run, x, y)."""
    sweep, (a, b, n) = _Sweep(equal, k), runs
    good = np.flatnonzero(lines_a[k - 1 :] - lines_a[: len(lines_a) - k + 1] + 1 >= min_lines)
    low, high = np.searchsorted(good, a), np.searchsorted(good, a + n - (k - 1))
    # Windows come in order of their first line, so those of some lines can be taken before the next are made.
    starts = np.append(np.flatnonzero(np.diff(lines_a[good], prepend=-1)), len(good))
    change = np.bincount(low, minlength=len(good) + 1) - np.bincount(high, minlength=len(good) + 1)
    before = np.append(0, np.cumsum(np.cumsum(change[:-1])))[starts] if len(good) else np.zeros(1, np.int64)
    at = 0
    while at < len(starts) - 1:
        to = max(at + 1, int(np.searchsorted(before, before[at] + HELD, "right")) - 1)
        first, last = np.maximum(low, starts[at]), np.minimum(high, starts[to])
        at, count = to, np.maximum(last - first, 0)
        if not count.any():
            continue
        run = np.repeat(np.arange(len(a)), count)
        x = good[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        y = x + (b - a)[run]
        rows = [x, y, lines_a[x], lines_a[x + k - 1], *lines_b(run, x, y)]
        kept = rows[5] - rows[4] + 1 >= min_lines
        if same:
            kept &= rows[4] > rows[3] + min_lines
        rows = [c[kept] for c in rows]
        if len(rows[0]):
            order = _ordered(rows[2], rows[4], rows[1], rows[0])
            sweep.take_all(*(c[order] for c in rows))
    if sweep.open is not None:
        sweep.done.append(sweep.open)
    return [m for m in sweep.done if min(m.last_a - m.first_a, m.last_b - m.first_b) + 1 >= min_lines]


def merged(runs: Iterable[Alignment], k: int, min_lines: int, same: bool) -> list[Merged]:
    """Clones of one pair of streams, from its maximal runs of equal tokens; `same`: the pair is one stream."""
    runs = list(runs)
    if not runs:
        return []
    begins = [np.array(c, np.int64) for c in ([r.a for r in runs], [r.b for r in runs], [len(r.lines_a) for r in runs])]
    lines = []
    for side, begin in (("lines_a", begins[0]), ("lines_b", begins[1])):
        own = np.zeros(int((begin + begins[2]).max()), np.int64)
        for r, at in zip(runs, begin):
            own[at : at + len(getattr(r, side))] = getattr(r, side)
        lines.append(own)
    return _swept(tuple(begins), tuple(begins), lines[0], lambda run, x, y: (lines[1][y], lines[1][y + k - 1]), k, min_lines, same)


def _of_pieces(pieces, equal, lines, shifts, k: int, min_lines: int, same: bool) -> list[Merged]:
    """Clones of one pair, from pieces whose lines in b are those in a and a number for their first and one for their last."""
    return _swept(pieces, equal, lines, lambda run, x, y: (lines[x] + shifts[0][run], lines[x + k - 1] + shifts[1][run]), k, min_lines, same)


def coalesced(streams: DataFrame, k: int, min_lines: int) -> DataFrame:
    """Clones between streams (stream, tokens, lines): (a, b, a_start, b_start, tokens, a_first, a_last, b_first, b_last).

    Equal windows of k tokens over `min_lines` lines or more on both sides, in
    one stream only if the later begins more than `min_lines` lines after the
    end of the earlier, in the order of their lines; those of a pair merge over
    small gaps, also from other diagonals where that keeps both sides equal, and
    overlapping ones are dropped. Windows over fewer lines and those that occur
    once are left out before windows meet.
    """
    body = F.transform("tokens", lambda t, i: F.struct(F.xxhash64(t).alias("h"), F.get("lines", i).cast("long").alias("l")))
    return clones_of_pairs(streams.select("stream", body.alias("body")), k, min_lines, _of_pieces)


def coalesced_texts(texts: DataFrame, stream: str, text: str, k: int, min_lines: int) -> DataFrame:
    """`coalesced` of the words of texts; what moves is the texts, not their tokens."""
    return clones_of_pairs(texts.select(F.col(stream).alias("stream"), F.col(text).cast("string").alias("body")), k, min_lines, _of_pieces)


def text_streams(texts: DataFrame, stream: str, text: str) -> DataFrame:
    """(stream, tokens, lines): the words of texts and the line of each, from 1."""
    by_line = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda t, i: F.transform(F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.struct(w.alias("w"), (i + 1).cast("long").alias("l"))))
    rows = texts.select(F.col(stream).alias("stream"), F.explode(F.array(F.flatten(by_line))).alias("x"))
    return rows.select("stream", F.col("x.w").alias("tokens"), F.col("x.l").alias("lines"))
