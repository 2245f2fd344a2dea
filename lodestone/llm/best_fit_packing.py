"""Best-fit packing of tokenised documents into sequences under several capacities.

A document is its token ids and an end id. Only one longer than a sequence is
cut, into whole sequences' worth of tokens; its first piece has what is left
over. A sequence holds at most so many tokens, so many pieces, and so much
attention cost, the sum of squared lengths of its pieces.

What a piece needs of each capacity follows from its length, so pieces of one
length are alike, and their counts, at most one for each length, say all that
the choice of bins needs: lengths are placed from long to short; each takes the
open bins in which it fits under every constraint and that the rule likes best:
least weighted norm of what is left afterwards, or greatest weighted dot product
of what is left and what is needed. Bins with the same content are one group
with a number, so the plan grows with the number of lengths, never with the
number of documents. Both rules are tried and the plan of fewer sequences is
kept. The plan gives each length's pieces, in order of their rank, a sequence
and an offset.

Texts are encoded where they lie and are not shuffled; a piece gets its rank
among those of its length by counting within a task and a sum over tasks, so a
length that a third of all pieces share is no hot key. Null texts count as
empty: the end id alone. Rows without an identifier and repeated rows are packed
like any others. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import small_batches, store
from ._text import slices, trimmed

END_ID = 0
_RANK_BITS = 42


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds; None is no constraint of its own. `tokens` is at most 2 ** 20, which bounds the plan."""

    tokens: int = 2048
    documents: int | None = None
    cost: int | None = None

    def __post_init__(self):
        if not 1 <= self.tokens <= 1 << 20 or (self.documents or 1) < 1 or (self.cost or 1) < 1:
            raise ValueError("capacities are whole numbers from 1, tokens up to 2 ** 20")

    @property
    def piece(self) -> int:
        """Tokens of the longest piece that a sequence can hold."""
        return self.tokens if self.cost is None else min(self.tokens, math.isqrt(self.cost))

    @property
    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.cost or self.tokens**2], dtype=np.int64)

    def needs(self, length: int) -> np.ndarray:
        return np.array([length, 1, length * length], dtype=np.int64)

    def weights(self, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each capacity the share of the sequences that it alone would ask for; what can't bind weighs nothing."""
        asked = np.array([(lengths * counts).sum(), counts.sum(), (lengths.astype(float) ** 2 * counts).sum()], dtype=float) / self.limits
        asked[1] *= self.documents is not None
        asked[2] *= self.cost is not None
        return asked / max(asked.sum(), 1e-300)


@dataclass
class Plan:
    """Placements by length and rank: pieces of `length` from rank `first` on get sequences from `sequence` on, one each, at `offset`."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        at = np.searchsorted((self.length << _RANK_BITS) + self.first, (length << _RANK_BITS) + rank, side="right") - 1
        return self.sequence[at] + rank - self.first[at], self.offset[at]


def plan_bins(lengths: np.ndarray, counts: np.ndarray, capacity: Capacity, rule: str) -> Plan:
    """Place all pieces of each length, from long to short, by `rule`: "norm" or "dot"."""
    order = np.argsort(-lengths)
    lengths, counts = lengths[order], counts[order]
    limits, weights = capacity.limits, capacity.weights(lengths, counts)
    left = np.zeros((0, 3), np.int64)  # what a bin of each group has left
    head = np.zeros((0, 2), np.int64)  # first sequence and number of bins of each group
    placed, opened = [], 0
    for at, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        need, rank = capacity.needs(length), 0
        share = need / limits
        while rank < count:
            fits = np.flatnonzero((left >= need).all(1))
            if len(fits):
                some = left[fits] / limits
                liked = -(weights * (some - share) ** 2).sum(1) if rule == "norm" else (weights * some * share).sum(1)
                g = int(fits[np.argmax(liked)])
                room, (first, bins) = left[g], head[g].tolist()
            else:
                g, room, first, bins = None, limits, opened, count - rank
            each = int((room // need).min())
            full = min(bins, (count - rank) // each)
            rest = count - rank - full * each if full < bins else 0
            used = int(limits[0] - room[0])
            new = []
            for n, m, start in ((full, each, first), (1 if rest else 0, min(rest, each), first + full)):
                if n:
                    for j in range(m):
                        placed.append((length, rank, start, used + j * length))
                        rank += n
                    new.append((room - m * need, start, n))
            took = full + (1 if rest else 0)
            if g is None:
                opened += took
            elif took < bins:
                new.append((room, first + took, bins - took))
            if g is not None:
                left, head = np.delete(left, g, 0), np.delete(head, g, 0)
            left = np.concatenate([left, *[x[0][None] for x in new]])
            head = np.concatenate([head, np.array([x[1:] for x in new], np.int64).reshape(-1, 2)])
        if at + 1 < len(lengths):  # bins that can't take the shortest piece are done
            alive = (left >= capacity.needs(int(lengths[-1]))).all(1)
            left, head = left[alive], head[alive]
    p = np.array(placed, np.int64).reshape(-1, 4)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    return Plan(p[:, 0], p[:, 1], p[:, 2], p[:, 3], opened)


def best_plan(lengths: np.ndarray, counts: np.ndarray, capacity: Capacity) -> Plan:
    return min((plan_bins(lengths, counts, capacity, rule) for rule in ("norm", "dot")), key=lambda p: p.n_sequences)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int, rank long"


def _cut(vocabulary_path: str, longest: int, end_id: int, keep_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        from ._bpe import vocabulary

        v = vocabulary(vocabulary_path)
        bucket = TaskContext.get().partitionId()
        seen = np.zeros(longest + 1, dtype=np.int64)
        for batch in batches:
            for s in slices(batch.column(1)):
                flat, at = v.encode(s)
                ids = np.insert(flat, at[1:], end_id).astype("<u4")
                size = np.diff(at) + 1
                begin = np.cumsum(size) - size
                n = -(-size // longest)
                row = np.repeat(np.arange(s.n), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                first = size - (n - 1) * longest
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * longest)
                length = np.where(piece == 0, first[row], longest)
                order = np.argsort(length, kind="stable")
                by = length[order]
                rank = np.empty(len(row), dtype=np.int64)
                rank[order] = seen[by] + np.arange(len(by)) - np.searchsorted(by, by)
                seen += np.bincount(length, minlength=longest + 1)
                raw, lo = memoryview(ids.tobytes()), (begin[row] + start) * 4
                bodies = [raw[a:b] for a, b in zip(lo.tolist(), (lo + length * 4).tolist())]
                columns = [batch.column(0).slice(s.first, s.n).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(b) for b in bodies], pa.int64())]
                columns += [pa.array(np.full(len(row), bucket, np.int32)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "bucket", "rank"]
                if keep_ids:
                    columns.append(pa.array([bytes(b) for b in bodies], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return trimmed(run)


def _assign(plan: Plan):
    def run(batches):
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            sequence, offset = plan.place(batch.column(at["length"]).to_numpy(), batch.column(at["rank"]).to_numpy())
            kept = [n for n in batch.schema.names if n not in ("bucket", "rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary_path: str, capacity: Capacity = Capacity(), end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece; with `keep_ids` also `ids`, as little-endian 32-bit integers before sequence_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = _PIECES + ", ids binary" * keep_ids
    with small_batches(docs.sparkSession):
        pieces = store(rows.mapInArrow(_cut(vocabulary_path, capacity.piece, end_id, keep_ids), schema), "pieces")
    in_bucket = store(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    # A row for each length: bounded by the capacity.
    found = in_bucket.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()
    plan = best_plan(np.array([r.length for r in found], np.int64), np.array([r.n for r in found], np.int64), capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = in_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base.hint("merge"), ["length", "bucket"]).select(*[c for c in pieces.columns if c != "rank"], (F.col("rank") + F.col("base")).alias("rank"))
    kept = [f for f in pieces.schema.fields if f.name not in ("bucket", "rank")]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return ranked.mapInArrow(_assign(plan), f"{out}, sequence_id long, offset long")


def _fill(batches):
    """Sequences from pieces that come by sequence and offset."""
    held, parts = None, []

    def whole():
        ids = np.concatenate([np.frombuffer(p, "<u4") for _, p in parts]).astype(np.int64)
        return {"sequence_id": held, "ids": ids.tolist(), "doc_ids": [d for d, _ in parts], "lengths": [len(p) // 4 for _, p in parts]}

    kind = pa.schema([("sequence_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
    for batch in batches:
        out = []
        for sequence, doc, body in zip(*(c.to_pylist() for c in batch.columns)):
            if sequence != held and parts:
                out.append(whole())
                parts = []
            held = sequence
            parts.append((doc, body))
        yield pa.RecordBatch.from_pylist(out, kind)
    if parts:
        yield pa.RecordBatch.from_pylist([whole()], kind)


def sequences(docs: DataFrame, vocabulary_path: str, capacity: Capacity = Capacity(), **options) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): the token ids of each sequence, and whose they are."""
    packed = pack(docs, vocabulary_path, capacity, keep_ids=True, **options)
    dealt = packed.select("sequence_id", "doc_id", "ids", "offset").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    return dealt.select("sequence_id", "doc_id", "ids").mapInArrow(_fill, "sequence_id long, ids array<long>, doc_ids array<long>, lengths array<long>")


def op12_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
