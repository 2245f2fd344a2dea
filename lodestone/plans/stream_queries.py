"""Queries of streams with state and of the atomic sink over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import atomic
from ..streaming import stateful
from .lineage import fresh_folder
from .tables import projected, sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


_DEBT = {"ord": "o_orderkey", "half": "o_orderkey % 2", "key": "CASE WHEN o_custkey % 4 > 0 THEN o_orderpriority || o_custkey % 7 END"}


def _batches(spark, rows, parts: int) -> str:
    """Rows (batch, ...) as folders of a stream, one batch after the other."""
    folder = fresh_folder(spark, "stream")
    for i in range(parts):
        rows.where(F.col("batch") == i).drop("batch").coalesce(1).write.parquet(f"{folder}/b{i}")
    return folder


def _stream(spark, folder: str, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


@query(
    "ratchet_stream",
    f"""WITH o AS (SELECT o_orderkey AS ord, o_orderkey % 2 AS half, {_DEBT['key']} AS key FROM orders), b AS (SELECT key, count(*) AS n FROM o WHERE half = 0 AND ord % 3 = 0 GROUP BY key)
    SELECT ord, row_number() OVER (PARTITION BY o.key ORDER BY ord) <= coalesce(n, 0) AS grandfathered FROM o LEFT JOIN b ON o.key IS NOT DISTINCT FROM b.key WHERE half = 1""",
)
def ratchet_stream(spark, d):
    """Findings that come in three batches, held against one baseline."""
    o = projected(spark, d, "orders", _DEBT)
    most = o.agg(F.max("ord")).first()[0] or 0
    new = o.where("half = 1").select("ord", "key", F.floor(F.col("ord") * 3 / (most + 1)).alias("batch"))
    stream = _stream(spark, _batches(spark, new, 3), new.drop("batch").schema)
    out = fresh_folder(spark, "ratchet")
    stateful.ratchet_stream(stream, o.where("half = 0 and ord % 3 = 0").select("key"), ["key"], "ord", out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).select("ord", "grandfathered")


_PLACES = {"passage": "l_partkey % 1500 || l_returnflag", "stream": "CAST(l_orderkey AS STRING)", "start": "l_linenumber", "k": "l_orderkey"}


@query(
    "clone_stream",
    f"""WITH p AS (SELECT passage, CAST(k AS VARCHAR) AS stream, start, k < (SELECT max(o_orderkey) // 2 FROM orders) AS early FROM {sql('lineitem', {**_PLACES, 'stream': 'l_orderkey'})}), n AS (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY NOT early, stream, start) AS nth, first_value(stream) OVER w AS first_stream FROM p WINDOW w AS (PARTITION BY passage ORDER BY NOT early, stream, start))
    SELECT passage, count(*) AS places, max(nth) AS last, min(first_stream) AS first_stream FROM n GROUP BY passage""",
)
def clone_stream(spark, d):
    """Places of passages in two batches, numbered by what came before."""
    most = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    p = projected(spark, d, "lineitem", _PLACES).select("passage", "stream", F.col("start").cast("long").alias("start"), F.when(F.col("k") < most // 2, 0).otherwise(1).alias("batch"))
    out = fresh_folder(spark, "classes")
    stateful.clone_stream(_stream(spark, _batches(spark, p, 2), p.drop("batch").schema), out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).groupBy("passage").agg(F.count("*").alias("places"), F.max("nth").alias("last"), F.min("first_stream").alias("first_stream"))


@query("atomic_sink", "SELECT event_type, count(*) AS n, count(user_id) AS users, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def atomic_sink(spark, d):
    """Events through the sink that publishes a write as a whole, read back."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    folder = f"{fresh_folder(spark, 'sink')}/events"
    atomic.write_atomic(rows, folder)
    return atomic.read_atomic(spark, folder, rows.schema).groupBy("event_type").agg(F.count("*").alias("n"), F.count("user_id").alias("users"), F.sum("event_id").alias("ids"))
