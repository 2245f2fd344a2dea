"""Token-ID output as sorted-string-table shards, and reading it back.

Texts are dealt by ranges of their identifier (and a hash of the text, so that
one identifier on many rows doesn't make one large shard), sorted, encoded and
written shard by shard; a shard is written under a name of its own attempt and
moved to its final name, so a lost or repeated task leaves one whole file. The
manifest has one row per shard with its first token's place among all tokens.

Null texts count as empty: the end id alone. Rows without an identifier have a
key of their own that comes before all others. Repeated identifiers give an
entry for each row, ordered by a hash of their texts. Other columns are ignored.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import fresh_path, small_batches, store
from ._text import slices, trimmed

END_ID = 0
#: Bytes of text in a shard, about; there are as many shards as shuffle partitions at least.
SHARD_BYTES = 64 << 20
_MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _write(vocabulary_path: str, out: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        from ._bpe import vocabulary
        from .sstable import Writer

        v = vocabulary(vocabulary_path)
        width = 2 if v.tokenizer.get_vocab_size() <= 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        system, folder = _filesystem(out)
        system.create_dir(folder, recursive=True)
        name = f"shard-{shard:08d}.sst"
        attempt = posixpath.join(folder, f".{name}-{uuid.uuid4().hex}")
        n = 0
        with system.open_output_stream(attempt) as sink:
            w = Writer(sink, width)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for s in slices(batch.column(1)):
                    flat, at = v.encode(s)
                    for i in range(s.n):
                        w.add(ids[s.first + i], np.append(flat[at[i] : at[i + 1]], end_id))
                    n += s.n
            w.close()
        path = posixpath.join(folder, name)
        if n:
            system.move(attempt, path)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([posixpath.join(out, name)]), pa.array([n]), pa.array([w.n_tokens])], ["shard", "path", "n_docs", "n_tokens"])
        else:
            system.delete_file(attempt)

    return trimmed(run)


def write_tokens(docs: DataFrame, vocabulary_path: str, out: str, shards: int | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards to folder `out`, which all executors see; returns the stored manifest (shard, path, n_docs, n_tokens, start)."""
    spark = docs.sparkSession
    if shards is None:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    with small_batches(spark):
        manifest = store(dealt.mapInArrow(_write(vocabulary_path, out, end_id), _MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return store(manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "manifest")


def _read(batches):
    from .sstable import Reader

    for batch in batches:
        for path, start in zip(*(c.to_pylist() for c in batch.columns)):
            system, name = _filesystem(path)
            cols: list[list] = [[], [], [], []]
            with system.open_input_file(name) as source:
                for doc_id, ids in Reader(source):
                    for to, x in zip(cols, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        to.append(x)
                    start += len(ids)
                    if len(cols[0]) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        cols = [[], [], [], []]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(trimmed(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_tables(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("byte_bpe_50k.json")
    return read_tokens(write_tokens(docs, vocabulary_path, fresh_path(docs.sparkSession, "tokens")))


def op5_token_output(spark, sf_dir: str) -> DataFrame:
    return token_tables(spark.read.parquet(f"{sf_dir}/documents.parquet"))
