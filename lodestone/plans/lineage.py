"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own is set only in local mode where none is."""
    context = spark.sparkContext
    kept = context._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A name below the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of the rows in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back.

    For loops: a checkpoint keeps what the optimizer knows of its rows, and
    where each round derives columns from those of the last, that knowledge
    grows with the rounds until planning takes longer than the work.
    """
    path = fresh_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, keys: list[str], order: str, name: str = "rank") -> DataFrame:
    """Adds each row's rank from 1 within its keys, nulls being equal, without bringing the rows of a key together.

    Rows are dealt by ranges of keys and order, which is checkpointed so that
    all that follows sees one dealing; ranks within a range and the numbers of
    a key's rows in the ranges before it give the rank.
    """
    dealt = cut(rows.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A key has a row here for each range that it spans.
    sizes = sizes.select("_part", *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(order)))
    same = [inside["_part"] == sizes["_part"], *(inside[k].eqNullSafe(sizes[f"_k{i}"]) for i, k in enumerate(keys))]
    return inside.join(sizes, same).select(*(inside[c] for c in rows.columns), (F.col("_rank") + F.col("_before")).alias(name))


def running(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows that come before in order, without bringing them together; rows of one order are summed in any order, but the same each time."""
    dealt = cut(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    # A row for each range.
    base = sizes.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(base, "_part").select(*rows.columns, (F.col("_base") + F.col("_in")).alias(name))


def dense_ids(rows: DataFrame, key: str, name: str = "id") -> DataFrame:
    """Adds dense ids from 0 in order of a key."""
    found = ranked(rows.withColumn("_all", F.lit(0)), ["_all"], key, "_rank")
    return found.select((F.col("_rank") - 1).cast("long").alias(name), *rows.columns)
