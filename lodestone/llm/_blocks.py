"""Blocks of documents that ask for corpus-wide facts about their hashes.

A block is a few megabytes of consecutive rows, stored once as compressed Arrow
in a table bucketed by its id, so later passes join answers to it without
moving the texts again. A question is a blob: the sorted distinct hashes of one
block that fall into one range of hashes. As each block asks once per hash,
however often it holds it, a hot hash is pre-aggregated before the shuffle and
weighs one entry per block. A range is answered as a whole from the blobs of
all blocks, and each blob gets an answer of as many entries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import fresh_path, store

#: Blocks per range of hashes: about as many hashes in a range as in some blocks.
BLOCKS_PER_RANGE = 8


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(body) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(body) if isinstance(body, bytes) else body).read_next_batch()


def build(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str) -> DataFrame:
    """Store the batches that `make` gives for each partition as blocks (block_id, body), numbered by partition and place: a repeated task gives the same blocks."""

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for n, block in enumerate(make(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([first + n], pa.int64()), pa.array([pack(block)], pa.binary())], ["block_id", "body"])

    spark = rows.sparkSession
    table = f"lodestone_{name}_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Bodies are compressed already.
    rows.mapInArrow(run, "block_id long, body binary").write.format("parquet").option("compression", "none").option("path", fresh_path(spark, name)).bucketBy(buckets, "block_id").saveAsTable(table)
    return spark.table(table)


def range_bits(blocks: DataFrame) -> int:
    """Ranges are named by so many leading bits of a hash."""
    n = blocks.count()
    return max(4, (max(1, n // BLOCKS_PER_RANGE) - 1).bit_length())


def cut(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each range begins in sorted hashes (2 ** bits + 1 values)."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def questions(block_id: int, sorted_hashes: np.ndarray, bits: int, body: Callable[[int, int], bytes]) -> pa.RecordBatch:
    """Rows (part, block_id, body) of one block; body gets the slice of its hashes."""
    at = cut(sorted_hashes, bits)
    parts = np.flatnonzero(at[1:] > at[:-1])
    return pa.RecordBatch.from_arrays(
        [pa.array(parts.astype(np.int32)), pa.array(np.full(len(parts), block_id)), pa.array([body(int(at[p]), int(at[p + 1])) for p in parts], pa.binary())], ["part", "block_id", "body"]
    )


QUESTION = "part int, block_id long, body binary"


def answered(asked: DataFrame, answer: Callable[[list[int], list[bytes]], tuple[list[bytes], list[float]]], bits: int, name: str) -> DataFrame:
    """Answer each range from all its blobs: rows (part, block_id, body, stats); stats, of the whole range, are in one row of it."""

    def run(batches):
        part, ids, bodies = None, [], []

        def give():
            out, stats = answer(ids, bodies)
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array([stats] + [None] * (len(ids) - 1), pa.list_(pa.float64()))], ["part", "block_id", "body", "stats"]
            )

        for batch in batches:
            for p, i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if p != part:
                    if part is not None:
                        yield give()
                    part, ids, bodies = p, [], []
                ids.append(i)
                bodies.append(b)
        if part is not None:
            yield give()

    n = max(1 << bits, 1)
    spread = asked.repartition(min(n, max(n // 4, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "part").sortWithinPartitions("part")
    return store(spread.mapInArrow(run, QUESTION + ", stats array<double>"), name)


def with_answers(blocks: DataFrame, **answers: DataFrame) -> DataFrame:
    """Blocks with a column of each kind of answer: array<struct<part, body>> in order of part, null where there are none."""
    out = blocks
    for name, table in answers.items():
        got = table.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("part", "body"))).alias(name))
        out = out.join(got, "block_id", "left")
    return out


def bodies(column: pa.Array, i: int) -> list[bytes]:
    found = column[i].as_py()
    return [x["body"] for x in found] if found else []
