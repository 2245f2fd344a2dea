"""N-gram Jaccard join by parity sketches.

1. One Arrow pass turns each text into a 128-bit digest of its set of shingles;
   texts with equal sets count as one set from there on, so copies make no
   pairs. A second pass issues the band keys of `_parity`.
2. Sets meet by key. A key of up to `SMALL_GROUP` sets gives all its pairs; a
   larger one gives those of its least set with each other. Pairs leave whose
   sizes don't allow a link, or that share fewer keys than any partners must.
3. Sets that still have a partner get a parity bit sketch, four to eight bits a
   token. Each set of larger keys is compared on sketches within its two largest
   ones and paired with the nearest, which joins groups of near copies without
   making their pairs. The Hamming distance of sketches is at most the symmetric
   difference, and rejects most of the pairs.
4. The rest are verified on whole sets in rounds: in each, a set goes to the one
   of its partners that has most of them, and pairs that verified links connect
   already leave before the next.
5. Sets of a larger key that still lie in different components are compared on
   sketches, all of those outside the key's largest component with all others.
   What passes is verified as well, so no link between components is lost.

Only components are searched: pairs of texts that other links connect already
may stay unverified, so there are no pairs and no number of links.

A task holds one pivot's set and a few megabytes of its partners, or the
sketches of two blocks of `BLOCK` sets. Texts of sets that have a partner are
stored once, bucketed by set, and only those that a round asks for move again.
A key with many components makes (sets outside the largest)^2 / `BLOCK` rows.

Null and empty texts have no shingles and link with nothing. Every row of the
documents gives a row. A repeated id with different texts stands for each of
them. A null id is no id that links could reach: such a row gets the component
of its set, or null where no row with an id has that set.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._among import bitmap, with_chance
from ._components import components
from ._parity import Bands, bit_sketches, folded
from ._store import discard, shared_dir, small_batches, store
from ._text import mix64, shingle_sets, slices, trimmed

SMALL_GROUP = 16
#: Sets of a key whose sketches meet in one task.
BLOCK = 8192
#: Sets that are verified against one copy of a pivot.
PIVOT_BLOCK = 256
#: Rounds in which a set is verified against one partner, before all pairs that are left.
ROUNDS = 2
#: Bytes of text that are turned into sets at a time.
RAW = 1 << 20
#: Bytes of text whose keys are made at a time.
SLICE = 1 << 20


def _digests(h: np.ndarray, counts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of token hashes for each row (the same for equal sets)."""
    out = []
    some = np.flatnonzero(counts)
    begin = (np.cumsum(counts) - counts)[some]
    for salt in (0x1234567 + 2 * seed, 0x89ABCDE + 2 * seed):
        d = np.zeros(len(counts), dtype=np.uint64)
        if len(some):
            d[some] = np.add.reduceat(mix64(h ^ np.uint64(salt << 20)), begin)
        out.append(mix64(d + counts.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _features(k: int, num: int, den: int, seed: int):
    def run(batches):
        bands = Bands(num, den)
        for batch in batches:
            ids = batch.column(0)
            for s in slices(batch.column(1), SLICE):
                h, _, counts = shingle_sets(s, k)
                d1, d2 = _digests(h, counts, seed)
                _, _, needs = bands.keys_and_needs(h >> np.uint64(16), counts)
                yield pa.RecordBatch.from_arrays([ids.slice(s.first, s.n), pa.array(counts.astype(np.int64)), pa.array(d1), pa.array(d2), pa.array(needs)], ["doc_id", "n_shingles", "sid", "sid2", "need"])

    return trimmed(run)


def _keys(k: int, num: int, den: int, seed: int):
    """(key, sid) of each set; copies within a slice issue their keys once."""

    def run(batches):
        bands = Bands(num, den)
        for batch in batches:
            for s in slices(batch.column(0), SLICE):
                h, rows, counts = shingle_sets(s, k)
                sid, _ = _digests(h, counts, seed)
                once = np.zeros(s.n, dtype=bool)
                once[np.unique(sid, return_index=True)[1]] = True
                some = once & (counts > 0)
                # The leading 48 bits of a hash name a token here.
                key, owner = bands.keys(h[some[rows]] >> np.uint64(16), counts[some])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sid[some][owner])], ["key", "sid"])

    return trimmed(run)


def _ranges(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return new, np.diff(np.concatenate([new, [len(keys)]]))


def _pairs_of_groups(sid: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = [], []
    for g in np.unique(size[(size > 1) & (size <= SMALL_GROUP)]):
        at = begin[size == g][:, None]
        i, j = np.triu_indices(int(g), 1)
        a.append(sid[at + i].ravel())
        b.append(sid[at + j].ravel())
    large = size > SMALL_GROUP
    if large.any():
        g = size[large]
        rows = np.repeat(begin[large], g)
        at = rows + np.arange(len(rows)) - np.repeat(np.cumsum(g) - g, g)
        keep = at != rows
        a.append(sid[rows[keep]])
        b.append(sid[at[keep]])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def _meet(batches):
    """Rows (key, sid) sorted: pairs (a, b) of sets with n common keys, and the rows of large keys (hot, sid as b, size as n)."""
    held_k, held_s = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def give(key, sid):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])])
        key, sid = key[new], sid[new]
        begin, size = _ranges(key)
        a, b = _pairs_of_groups(sid, begin, size)
        times = np.zeros(0, np.int64)
        if len(a):
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            times = np.diff(np.append(first, len(a)))
            a, b = a[first], b[first]
        large = np.repeat(size > SMALL_GROUP, size)
        n = int(large.sum())
        sizes = np.repeat(size, size)[large]
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(a), pa.nulls(n, pa.int64())]), pa.concat_arrays([pa.array(b), pa.array(sid[large])]), pa.concat_arrays([none, pa.array(key[large])]), pa.concat_arrays([pa.array(times), pa.array(sizes.astype(np.int64))])],
            ["a", "b", "hot", "n"],
        )

    pending: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        pending.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows < 1 << 19:
            continue
        key, sid = np.concatenate([held_k, *(p[0] for p in pending)]), np.concatenate([held_s, *(p[1] for p in pending)])
        pending, rows = [], 0
        cut = int(np.searchsorted(key, key[-1]))
        held_k, held_s = key[cut:], sid[cut:]
        new = np.concatenate([[True], (held_s[1:] != held_s[:-1])])
        held_k, held_s = held_k[new], held_s[new]
        if cut:
            yield give(key[:cut], sid[:cut])
    key, sid = np.concatenate([held_k, *(p[0] for p in pending)]), np.concatenate([held_s, *(p[1] for p in pending)])
    if len(key):
        yield give(key, sid)


def _allowed(n_a: np.ndarray, n_b: np.ndarray, far: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes and the distance of sketches allow a link."""
    return (np.minimum(n_a, n_b) * den >= np.maximum(n_a, n_b) * num) & (far <= (den - num) * (n_a + n_b) // (den + num))


class _Sketches:
    """Sketches of different lengths, compared at the shorter one's."""

    def __init__(self, bodies: list):
        self.length = np.array([len(x) for x in bodies], dtype=np.int64)
        self.at, self.rows = np.empty(len(bodies), dtype=np.int64), {}
        for n in np.unique(self.length).tolist():
            some = np.flatnonzero(self.length == n)
            self.at[some] = np.arange(len(some))
            self.rows[n] = np.frombuffer(b"".join(bodies[i] for i in some.tolist()), dtype=np.uint64).reshape(len(some), n // 8)

    def of(self, index: np.ndarray, length: int, shown: int) -> np.ndarray:
        return folded(self.rows[length][self.at[index]], shown // 8)

    def far(self, other: "_Sketches") -> np.ndarray:
        """Distances of row i from row i of the other."""
        out = np.zeros(len(self.length), dtype=np.int64)
        for m, n in {*zip(self.length.tolist(), other.length.tolist())}:
            some = np.flatnonzero((self.length == m) & (other.length == n))
            shown = min(m, n)
            out[some] = np.bitwise_count(self.of(some, m, shown) ^ other.of(some, n, shown)).sum(axis=1, dtype=np.int64)
        return out

    def matrices(self, first: np.ndarray, second: np.ndarray, size: np.ndarray, num: int, den: int):
        """(rows of first, rows of second, distances, whether a link is allowed) in blocks of a few megabytes; blocks that sizes rule out are left out."""
        for m in self.rows:
            x = first[self.length[first] == m]
            for n in self.rows:
                y = second[self.length[second] == n]
                if not len(x) or not len(y) or size[y].max() * den < size[x].min() * num or size[x].max() * den < size[y].min() * num:
                    continue
                shown = min(m, n)
                theirs = self.of(y, n, shown)
                step = max(1, (1 << 22) // theirs.size)
                for at in range(0, len(x), step):
                    i = x[at : at + step]
                    far = np.bitwise_count(self.of(i, m, shown)[:, None, :] ^ theirs[None, :, :]).sum(axis=-1, dtype=np.int64)
                    yield i, y, far, _allowed(size[i][:, None], size[y][None, :], far, num, den)


def _nearest(num: int, den: int):
    """Rows (hot, block, sid, size, sketch), sorted by the first two: each set with the nearest one that may link with it."""

    def run(batches):
        for _, (sid, n, bodies) in _by_key(batches, 2):
            sid, n, sk = np.array(sid, dtype=np.int64), np.array(n, dtype=np.int64), _Sketches(bodies)
            every = np.arange(len(sid))
            least, best = np.full(len(sid), 1 << 40), np.full(len(sid), -1)
            for i, j, far, ok in sk.matrices(every, every, n, num, den):
                # Distances at different lengths compare by their share of the bits.
                share = np.where(ok & (i[:, None] != j[None, :]), (far << 20) // (8 * np.minimum(sk.length[i][:, None], sk.length[j][None, :])), 1 << 40)
                at = share.argmin(1)
                found = share[np.arange(len(i)), at]
                nearer = found < least[i]
                least[i[nearer]], best[i[nearer]] = found[nearer], j[at[nearer]]
            some = np.flatnonzero(best >= 0)
            a, b = sid[some], sid[best[some]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return trimmed(run)


def _across(num: int, den: int):
    """Rows (hot, i, j, sid, comp, size, side, sketch), sorted by the first three: sets of side 0 and side 1 (of side 0 alone where i = j) that lie in different components and may link."""

    def run(batches):
        for (_, i, j), (sid, comp, n, side, bodies) in _by_key(batches, 3):
            sid, comp, n, side = (np.array(x, dtype=np.int64) for x in (sid, comp, n, side))
            sk, first, second = _Sketches(bodies), np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for x, y, _, ok in sk.matrices(first, first if i == j else second, n, num, den):
                p, q = np.nonzero(ok & (comp[x][:, None] != comp[y][None, :]))
                a, b = sid[x[p]], sid[y[q]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return trimmed(run)


def _by_key(batches, width: int):
    """Groups of rows with equal first `width` columns, of sorted batches: (key, lists of the other columns)."""
    key, held = None, None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols):
            k = row[:width]
            if k != key:
                if key is not None:
                    yield key, held
                key, held = k, [[] for _ in row[width:]]
            for to, v in zip(held, row[width:]):
                to.append(v)
    if key is not None:
        yield key, held


def _bodies(k: int, seed: int):
    """Rows (text) to (sid, size, sketch, body): a set's digest, size, sketch and compressed text; copies within a slice once."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for s in slices(batch.column(0)):
                h, rows, counts = shingle_sets(s, k)
                sid, _ = _digests(h, counts, seed)
                some = np.unique(sid, return_index=True)[1]
                raw = s.data.tobytes()
                sketch, at = bit_sketches(h, rows, counts)
                sketch = sketch.tobytes()
                body = [z.compress(raw[s.offsets[i] : s.offsets[i + 1]]) for i in some.tolist()]
                bits = [sketch[at[i] : at[i + 1]] for i in some.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(sid[some]), pa.array(counts[some].astype(np.int64)), pa.array(bits, pa.binary()), pa.array(body, pa.binary())], ["sid", "size", "sketch", "body"])

    return trimmed(run)


def _sets(bodies: pa.Array, k: int):
    """(index, set) of each compressed text, a few megabytes at a time."""
    z = zstandard.ZstdDecompressor()
    held, size, at = [], 0, 0
    for i in range(len(bodies) + 1):
        if held and (i == len(bodies) or size > RAW):
            for s in slices(pa.array(held, pa.large_binary()).cast(pa.large_string())):
                h, _, counts = shingle_sets(s, k)
                cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
                for r in range(s.n):
                    yield at + s.first + r, h[cuts[r] : cuts[r + 1]]
            held, size, at = [], 0, i
        if i < len(bodies):
            held.append(z.decompress(bodies[i].as_buffer()))
            size += len(held[-1])


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return both * den >= num * (len(x) + len(y) - both)


def _verified(k: int, num: int, den: int):
    """Rows (pivot, block, role, sid, body), the pivot itself (role 0) before its partners: the pairs that link."""

    def run(batches):
        pivot, own = None, None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            key = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            role, sid = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, x in _sets(batch.column(4), k):
                if role[i] == 0:
                    pivot, own = key[i], x
                elif pivot != key[i]:
                    raise ValueError("a partner came without its pivot")
                elif _similar(own, x, num, den):
                    out[0].append(key[i][0])
                    out[1].append(sid[i])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    return trimmed(run)


def _distinct_sets(rows: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows' features and the distinct sets (sid, n_shingles, rep, need); no two sets share a sid: another seed is taken if two do."""
    for seed in range(8):
        made = store(rows.mapInArrow(_features(k, num, den, seed), "doc_id long, n_shingles long, sid long, sid2 long, need long"), "features")
        by = made.where("n_shingles > 0").groupBy("sid").agg(
            F.min("n_shingles").alias("n_shingles"), F.min("doc_id").alias("rep"), F.min("need").alias("need"), ((F.min("sid2") != F.max("sid2")) | (F.min("n_shingles") != F.max("n_shingles"))).alias("clash")
        )
        sets = store(by, "sets")
        if sets.where("clash").isEmpty():
            return made, sets.select("sid", "n_shingles", "rep", "need"), seed
        discard(made, sets)
    raise ValueError("no seed gives each set a digest of its own")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; two link when den * |A & B| >= num * |A | B|.

    component_id is the least id that links reach. Defaults are five words and a
    similarity of 0.8.
    """
    out, _ = _jaccard(docs, id_col, text_col, k, num, den)
    return out.select("doc_id", "n_shingles", "component_id")


def _jaccard(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> tuple[DataFrame, int]:
    """The components with each row's set (sid) and that of its component (top), both null without words; and the seed of the sets' digests."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        made, sets, seed = _distinct_sets(rows, k, num, den)
        # Sets that only rows without an id have can't be reached and reach nothing.
        named = sets.where("rep is not null")
        labels = _components_of_sets(rows, named, k, num, den, seed)
    tops = named.join(labels.withColumnRenamed("id", "sid").hint("merge"), "sid", "left").select("sid", "rep", F.coalesce("component_id", "sid").alias("top"))
    least = tops.groupBy("top").agg(F.min("rep").alias("component"))
    by_set = tops.select("sid", "top").join(least.hint("merge"), "top").select("sid", "top", "component")
    own = made.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("sid")).alias("sid"))
    return own.join(by_set.hint("merge"), "sid", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "sid", F.coalesce("top", "sid").alias("top")), seed


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component, with all its columns: that of the least id (null last), any one of rows that repeat it; rows without words stay.

    Rows that no other row shares a component with stay where they are; only the
    others meet the decisions.
    """
    out, seed = _jaccard(docs, id_col, text_col, k, num, den)
    found = store(out.where("sid is not null").select("doc_id", "sid", "top"), "found")
    head = found.groupBy("top").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "sid")).alias("h"))
    sets = found.groupBy("sid").agg(F.first("top").alias("top"), F.count("*").alias("rows"))
    sets = sets.join(head.hint("merge"), "top").select("sid", "rows", (F.col("h.sid") == F.col("sid")).alias("heads"), F.col("h.doc_id").alias("id"))
    # Several rows of the id and set that stay.
    same = found.groupBy("sid", "doc_id").agg(F.count("*").alias("same")).where("same > 1").select("sid", F.col("doc_id").alias("id"), F.lit(True).alias("many"))
    joined = sets.join(same.hint("merge"), (sets["sid"] == same["sid"]) & sets["id"].eqNullSafe(same["id"]), "left").where("rows > 1 or not heads")
    decided = store(joined.select(sets["sid"].alias("__sid"), F.col("heads").alias("__heads"), sets["id"].alias("__id"), F.coalesce("many", F.lit(False)).alias("__many")), "decided")
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        for batch in batches:
            for s in slices(batch.column(at)):
                h, _, counts = shingle_sets(s, k)
                sid, _ = _digests(h, counts, seed)
                part = batch.slice(s.first, s.n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sid, mask=counts == 0)], [*names, "__sid"])

    kind = T.StructType([*docs.schema.fields, T.StructField("__sid", T.LongType())])
    rows = with_chance(docs.mapInArrow(trimmed(run), kind), "__sid", bitmap(decided, "__sid"))
    near = rows.where("__chance").join(decided.hint("merge"), "__sid", "left")
    near = near.where(F.col("__heads").isNull() | (F.col("__heads") & F.col(id_col).cast("long").eqNullSafe(F.col("__id"))))
    once = F.coalesce("__many", F.lit(False))
    return rows.where(~F.col("__chance")).select(*names).union(near.where(~once).select(*names)).union(near.where(once).dropDuplicates(["__sid"]).select(*names))


def _components_of_sets(rows: DataFrame, sets: DataFrame, k: int, num: int, den: int, seed: int) -> DataFrame:
    """(id, component_id) of the sets that link with others, by sid."""
    keys = rows.where("doc_id is not null").select("text").mapInArrow(_keys(k, num, den, seed), "key long, sid long")
    met = store(keys.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(trimmed(_meet), "a long, b long, hot long, n long"), "met")
    hot = store(met.where("hot is not null").select("hot", F.col("b").alias("sid"), "n"), "hot")
    near = store(_likely(met.where("hot is null").groupBy("a", "b").agg(F.sum("n").alias("shared")), sets, hot, num, den), "near")
    discard(met)
    texts = _texts(rows, sets, near.select(F.explode(F.array("a", "b")).alias("sid")).union(hot.select("sid")).distinct(), k, seed)
    sketches = rows.sparkSession.table(texts).select("sid", "size", "sketch")
    pool = store(_near(near, sketches, num, den).union(_hot_pairs(hot, sketches, num, den)).distinct(), "pool")
    discard(near)
    found, labels = None, None
    for last in [False] * ROUNDS + [True]:
        chosen = store(pool.select(F.col("a").alias("pivot"), F.col("b").alias("sid")) if last else _uphill(pool), "chosen")
        links = store(_verify(chosen, texts, k, num, den), "links")
        found = links if found is None else found.union(links)
        labels = components(found)
        tried = chosen.select(F.least("pivot", "sid").alias("a"), F.greatest("pivot", "sid").alias("b"))
        rest = store(_apart(pool.join(tried.hint("merge"), ["a", "b"], "left_anti"), labels), "pool")
        discard(pool, chosen)
        pool = rest
        if pool.isEmpty():
            break
    across = store(_hot_rest(hot, sketches, labels, num, den).distinct(), "pool")
    if not across.isEmpty():
        chosen = across.select(F.col("a").alias("pivot"), F.col("b").alias("sid"))
        labels = components(found.union(store(_verify(chosen, texts, k, num, den), "links")))
    rows.sparkSession.sql(f"DROP TABLE {texts}")
    return labels


def _likely(pairs: DataFrame, sets: DataFrame, hot: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, shared) whose sizes allow a link and that share as many keys as the smaller set needs; keys of larger groups may all be shared."""
    more = hot.groupBy("sid").agg(F.count("*").alias("hots"))
    known = sets.select("sid", F.col("n_shingles").alias("n"), "need").join(more.hint("merge"), "sid", "left").withColumn("hots", F.coalesce("hots", F.lit(0)))
    side = lambda c: known.select(*(F.col(x).alias(y) for x, y in (("sid", c), ("n", f"n_{c}"), ("need", f"need_{c}"), ("hots", f"hots_{c}")))).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    need = F.when(F.col("n_a") < F.col("n_b"), F.col("need_a")).when(F.col("n_a") > F.col("n_b"), F.col("need_b")).otherwise(F.greatest("need_a", "need_b"))
    return both.where(sizes & (F.col("shared") + F.least("hots_a", "hots_b") >= need)).select("a", "b")


def _near(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) of sets whose sizes and sketches allow a link."""
    left = sketches.select(F.col("sid").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("ka"))
    right = sketches.select(F.col("sid").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("kb"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                a, na, ka, b, nb, kb = batch.slice(at, 1024).columns
                keep = _allowed(na.to_numpy(), nb.to_numpy(), _Sketches(ka.to_pylist()).far(_Sketches(kb.to_pylist())), num, den)
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep))

    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "na", "ka", "b", "nb", "kb").mapInArrow(trimmed(run), "a long, b long")


def _hot_pairs(hot: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of nearest sets within the two largest keys of each set."""
    by = Window.partitionBy("sid").orderBy(F.desc("n"), "hot")
    two = hot.withColumn("rank", F.row_number().over(by)).where("rank <= 2")
    rows = two.join(sketches.hint("merge"), "sid")
    rows = rows.select("hot", F.pmod(F.xxhash64("sid"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("block"), "sid", "size", "sketch")
    return rows.repartition("hot", "block").sortWithinPartitions("hot", "block").mapInArrow(_nearest(num, den), "a long, b long")


def _texts(rows: DataFrame, sets: DataFrame, wanted: DataFrame, k: int, seed: int) -> str:
    """The table (sid, size, sketch, body) of the wanted sets, bucketed by sid; returns its name."""
    spark = rows.sparkSession
    shared_dir(spark)
    wanted = store(wanted.join(sets.select("sid", "rep").hint("merge"), "sid").select("sid", "rep"), "wanted")
    some = with_chance(rows, "doc_id", bitmap(wanted, "rep")).where("__chance").select("text")
    made = some.mapInArrow(_bodies(k, seed), "sid long, size long, sketch binary, body binary")
    kept = made.join(wanted.select("sid").hint("merge"), "sid", "left_semi").dropDuplicates(["sid"])
    table = f"lodestone_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bodies are compressed already.
    kept.write.format("parquet").option("compression", "none").bucketBy(buckets, "sid").sortBy("sid").saveAsTable(table)
    discard(wanted)
    return table


def _uphill(pairs: DataFrame) -> DataFrame:
    """(pivot, sid): each set with the one of its partners that has most partners, unless it has more itself."""
    both = pairs.select(F.col("a").alias("sid"), F.col("b").alias("of")).union(pairs.select("b", "a"))
    degree = both.groupBy(F.col("sid").alias("of")).agg(F.count("*").alias("n"))
    best = both.join(degree.hint("merge"), "of").groupBy("sid").agg(F.count("*").alias("own"), F.max(F.struct("n", (-F.col("of")).alias("x"))).alias("top"))
    return best.where((F.col("top.n") > F.col("own")) | ((F.col("top.n") == F.col("own")) & (F.col("top.x") > -F.col("sid")))).select((-F.col("top.x")).alias("pivot"), "sid")


def _verify(chosen: DataFrame, texts: str, k: int, num: int, den: int) -> DataFrame:
    """Those pairs (pivot, sid) that link, by their whole sets. Partners of one pivot are dealt to blocks with a copy of it each."""
    blocks = chosen.groupBy("pivot").agg(F.ceil(F.count("*") / PIVOT_BLOCK).alias("blocks"))
    dealt = chosen.join(blocks.hint("merge"), "pivot").select("pivot", F.pmod(F.xxhash64("sid"), "blocks").cast("int").alias("block"), F.lit(1).alias("role"), "sid")
    pivots = dealt.select("pivot", "block", F.lit(0).alias("role"), F.col("pivot").alias("sid")).distinct()
    asked = dealt.union(pivots).join(chosen.sparkSession.table(texts).select("sid", "body").hint("merge"), "sid").select("pivot", "block", "role", "sid", "body")
    return asked.repartition("pivot", "block").sortWithinPartitions("pivot", "block", "role").mapInArrow(_verified(k, num, den), "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) that lie in different components."""
    ends = [labels.select(F.col("id").alias(c), F.col("component_id").alias(f"top_{c}")).hint("merge") for c in ("a", "b")]
    tops = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
    return tops.where(F.coalesce("top_a", "a") != F.coalesce("top_b", "b")).select("a", "b")


def _hot_rest(hot: DataFrame, sketches: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of the larger keys' sets that lie in different components and may link.

    Sets of the key's largest component are dealt to blocks once; the others
    meet each of these blocks and each block of their own.
    """
    rows = store(hot.join(labels.withColumnRenamed("id", "sid").hint("merge"), "sid", "left").select("hot", "sid", "n", F.coalesce("component_id", "sid").alias("comp")), "hot")
    largest = rows.groupBy("hot", "comp").agg(F.count("*").alias("c"), F.first("n").alias("n")).groupBy("hot").agg(F.max(F.struct("c", "comp")).alias("top"), F.first("n").alias("n"))
    mixed = largest.where("top.c < n").select("hot", F.col("top.comp").alias("major"), F.ceil(F.col("top.c") / BLOCK).cast("int").alias("majors"), F.ceil((F.col("n") - F.col("top.c")) / BLOCK).cast("int").alias("minors"))
    rows = rows.join(mixed.hint("merge"), "hot").join(sketches.hint("merge"), "sid")
    own = F.pmod(F.xxhash64("sid"), F.when(F.col("comp") == F.col("major"), F.col("majors")).otherwise(F.col("minors"))).cast("int")
    rows = rows.withColumn("own", own)
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    to_major = F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda m: place(m, F.lit(-1), F.lit(0)))
    to_minor = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda o: place(F.least("own", o), F.greatest("own", o), F.when(F.col("own") <= o, 0).otherwise(1)))
    places = F.when(F.col("comp") == F.col("major"), F.array(place(F.col("own"), F.lit(-1), F.lit(1)))).otherwise(F.concat(to_major, to_minor))
    dealt = rows.select("hot", "sid", "comp", "size", "sketch", F.explode(places).alias("p")).select("hot", "p.i", "p.j", "sid", "comp", "size", "p.side", "sketch")
    return dealt.repartition("hot", "i", "j").sortWithinPartitions("hot", "i", "j").mapInArrow(_across(num, den), "a long, b long")


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Shingles of four words, similarity of 85 %."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, num=85, den=100)
