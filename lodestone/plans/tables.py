"""The driver's tables, and projections of them that queries share.

Expressions that stand for made-up texts are strings that Spark and the
reference database read alike, so that both start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projected(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*(f"{e} AS `{n}`" for n, e in columns.items()))


def sql(name: str, columns: dict[str, str]) -> str:
    """The same projection as SQL of the reference database, in brackets."""
    return "(SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in columns.items()) + f" FROM {name})"
