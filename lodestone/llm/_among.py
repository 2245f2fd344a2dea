"""A bitmap of fixed size that tells which rows may have an id of a table.

Rows that have none of the ids leave a scan, or stay where they are, without a
shuffle; the others, a few too many, meet the table by a join. The bitmap has
`BITS` bits in at most `BITS / 32768` rows, so it may be sent to every executor
whatever the number of ids; with many more ids than bits it only saves less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import store

BITS = 1 << 25


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def bitmap(ids: DataFrame, column: str) -> DataFrame:
    at = _bit(F.col(column))
    return store(ids.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits")), "bitmap")


def with_chance(rows: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """Adds boolean `__chance`: false where the column's value is surely no id of the bitmap."""
    at = _bit(F.col(column))
    place = F.bitmap_bit_position(at)
    out = rows.withColumn("__bucket", F.bitmap_bucket_number(at)).withColumn("__octet", (F.floor(place / 8) + 1).cast("int")).withColumn("__place", (place % 8).cast("int"))
    out = out.join(F.broadcast(bits), "__bucket", "left")
    return out.select(*rows.columns, F.coalesce(F.expr("getbit(cast(conv(hex(substring(__bits, __octet, 1)), 16, 10) as int), __place)") == 1, F.lit(False)).alias("__chance"))
