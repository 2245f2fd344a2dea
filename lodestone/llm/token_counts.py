"""Token counts by the whole-token shortcut.

Vocabulary strings that encode alone as one token are proved when a worker
loads the vocabulary. Pre-tokens that match one count 1 at once; only the rest
goes through the merges of the tokenizers library, each distinct one once per
worker (`_bpe`). One pass, no shuffle; texts are never cut.

Null counts as empty (0 bytes, 0 tokens). Texts with a special token's string,
or with characters newer than this Python's Unicode tables, go through the
library whole. Repeated rows and ids give a row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices

LIMIT = 512


def _count(path: str):
    def run(batches):
        from ._bpe import vocabulary

        v = vocabulary(path)
        for batch in batches:
            for s in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.array(np.diff(s.offsets)), pa.array(v.count(s))], ["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of each row. The path must be readable on the executors."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_count(vocabulary_path), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
