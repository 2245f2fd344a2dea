"""Queries of merge bases and baselines over commits made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import history
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


# Every order is a commit on one of the two orders before it; urgent ones merge an older order, and the parents of some aren't there.
_COMMITS = {"commit": "o_orderkey", "first": "o_orderkey - CASE WHEN o_custkey % 40 = 0 THEN 2 ELSE 1 END", "second": "CASE WHEN o_orderpriority = '1-URGENT' AND o_custkey % 5 = 0 THEN o_orderkey - 2 - o_custkey % 30 END"}
_PAIRS = {"pair": "c_custkey", "head": "c_custkey * 9 + c_nationkey", "reference": "c_custkey * 9 - c_nationkey * 2", "keep": "c_custkey % 25 = 3"}
_GRAPH = f"""e AS (SELECT commit, p FROM (SELECT commit, unnest([first, second]) AS p FROM {sql('orders', _COMMITS)}) WHERE p IN (SELECT o_orderkey FROM orders)),
    pr AS (SELECT pair, head, reference FROM {sql('customer', _PAIRS)} WHERE keep),
    anc AS (SELECT pair, 0 AS side, head AS c FROM pr WHERE head IN (SELECT o_orderkey FROM orders) UNION SELECT pair, 1, reference FROM pr WHERE reference IN (SELECT o_orderkey FROM orders) UNION SELECT pair, side, p FROM anc JOIN e ON e.commit = anc.c),
    com AS (SELECT pair, c FROM anc GROUP BY pair, c HAVING count(*) = 2)"""


def _commits(spark, d):
    return projected(spark, d, "orders", _COMMITS).select("commit", F.array_compact(F.array("first", "second")).alias("parents"))


@query("merge_bases", f"WITH RECURSIVE {_GRAPH} SELECT pair, c AS base FROM com WHERE NOT EXISTS (FROM e JOIN com k ON k.c = e.commit WHERE e.p = com.c AND k.pair = com.pair)")
def merge_bases(spark, d):
    return history.merge_bases(_commits(spark, d), projected(spark, d, "customer", _PAIRS).where("keep").drop("keep"))


# The lines of an order are its files; a path changes with each order that has its part, and returned ones are deletions.
_DELTAS = {"commit": "l_orderkey", "path": "'src/p' || l_partkey % 300 || CASE l_partkey % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.rs' ELSE '.ts' END", "blob": "CASE WHEN l_returnflag <> 'R' THEN l_suppkey END", "line": "l_linenumber"}


@query(
    "baseline_files",
    f"""WITH RECURSIVE f AS (SELECT commit, first FROM {sql('orders', _COMMITS)}), w AS (SELECT o_orderkey AS commit FROM orders WHERE o_orderkey % 3000 = 7),
    way AS (SELECT commit, commit AS c, 0 AS n FROM w UNION ALL SELECT way.commit, f.first, n + 1 FROM way JOIN f ON f.commit = way.c WHERE f.first IN (SELECT o_orderkey FROM orders)),
    met AS (SELECT way.commit, path, blob, n, line FROM way JOIN {sql('lineitem', _DELTAS)} d ON d.commit = way.c),
    last AS (SELECT commit, path, arg_min(coalesce(blob, -1), (n, coalesce(-blob, 1), -coalesce(blob, 0))) AS blob FROM met GROUP BY commit, path)
    SELECT last.commit, path, s_name || ' of ' || s_suppkey AS text FROM last JOIN supplier ON s_suppkey = blob WHERE blob >= 0 AND NOT path LIKE '%.md'""",
)
def baseline_files(spark, d):
    """Inventoried files and their content at one order in 3,000."""
    blobs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("blob"), F.concat("s_name", F.lit(" of "), F.col("s_suppkey").cast("string")).cast("binary").alias("content"))
    wanted = table(spark, d, "orders").where("o_orderkey % 3000 = 7").select(F.col("o_orderkey").alias("commit"))
    return history.baseline(_commits(spark, d), projected(spark, d, "lineitem", _DELTAS), blobs, wanted).select("commit", "path", "text")
