"""Commits, their merge bases, and the files of a commit, from tables of parents and deltas.

History is cut into chains: each commit has at most one child that continues its
chain, of those whose first parent it is the one with the longest line of
descendants, so that short branches don't cut a long line in pieces. What a commit reaches is then, for each
chain, all of it up to a place, and a search goes from chain to chain instead of
from commit to commit. Chains are found by doubling jumps, in a number of rounds
that is the logarithm of the longest chain; searches take a round for each
change of chain on the longest way.

Parents that have no row of their own are ignored, as are repeated rows and a
commit that is its own parent. A cycle of first parents is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import ranked, stored
from .repository import in_inventory

ROUNDS = 64
#: Steps for which branches of a fork are compared; longer ones count as equal.
LOOKAHEAD = 32


def _edges(commits: DataFrame) -> DataFrame:
    """(commit, parent, nth) of commits (commit, parents)."""
    rows = commits.where("commit is not null").groupBy("commit").agg(F.max("parents").alias("parents"))
    each = rows.select("commit", F.posexplode("parents").alias("nth", "parent")).where("parent <> commit")
    return each.join(rows.select(F.col("commit").alias("parent")), "parent", "left_semi").select("commit", "parent", "nth")


def _heights(first: DataFrame) -> DataFrame | None:
    """(parent, commit, height) of children (commit, parent) at forks: for how many steps descendants follow, as far as it takes to tell them apart."""
    several = lambda rows: rows.groupBy("parent").agg(F.count_distinct("commit").alias("n")).where("n > 1").select("parent")
    live = stored(first.join(several(first), "parent", "left_semi").select("parent", "commit", F.col("commit").alias("at")))
    below, out = first.select(F.col("parent").alias("at"), F.col("commit").alias("next")), None
    for height in range(1, LOOKAHEAD + 1):
        live = stored(live.join(below, "at").select("parent", "commit", F.col("next").alias("at")))
        if live.isEmpty():
            break
        found = live.select("parent", "commit", F.lit(height).alias("height")).distinct()
        out = found if out is None else out.unionByName(found)
        live = live.join(several(live), "parent", "left_semi")
    return None if out is None else out.groupBy("parent", "commit").agg(F.max("height").alias("height"))


def chains(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places (commit, chain, pos) and exits (chain, pos, nth, to_chain, to_pos) of commits (commit, parents).

    A chain is named by its newest commit; pos falls from 0 there. Exits lead
    from a place to a parent in another chain, nth 0 to a first parent. Parents
    further down in a commit's own chain are reached along the chain already.
    """
    edges = stored(_edges(commits))
    first = stored(edges.where("nth = 0").select("commit", "parent"))
    heights = _heights(first)
    ranks = first.withColumn("height", F.lit(0)) if heights is None else first.join(heights, ["parent", "commit"], "left")
    child = ranks.groupBy("parent").agg(F.max(F.struct(F.coalesce("height", F.lit(0)), "commit")).getField("commit").alias("jump")).withColumnRenamed("parent", "commit")
    rows = commits.select("commit").where("commit is not null").distinct().join(child, "commit", "left")
    rows = stored(rows.select("commit", F.coalesce("jump", "commit").alias("jump"), F.when(F.col("jump").isNull(), 0).otherwise(1).cast("long").alias("far"), F.col("jump").isNull().alias("done")))
    for _ in range(ROUNDS):
        rest = rows.where("not done")
        if rest.isEmpty():
            break
        # No two unfinished commits jump to one place.
        ahead = rows.select(F.col("commit").alias("jump"), F.col("jump").alias("next"), F.col("far").alias("more"), F.col("done").alias("ends"))
        moved = rest.join(ahead, "jump").select("commit", F.col("next").alias("jump"), (F.col("far") + F.col("more")).alias("far"), F.col("ends").alias("done"))
        rows = stored(rows.where("done").unionByName(moved))
    else:
        raise ValueError("first parents form a cycle")
    places = rows.select("commit", F.col("jump").alias("chain"), (-F.col("far")).alias("pos"))
    to = places.select(F.col("commit").alias("parent"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
    out = edges.join(places, "commit").join(to, "parent").where("chain <> to_chain or to_pos > pos")
    return places, stored(out.select("chain", "pos", "nth", "to_chain", "to_pos"))


def reached(seeds: DataFrame, exits: DataFrame) -> DataFrame:
    """(key..., chain, pos): the newest place of each chain that seeds (key..., chain, pos) reach, themselves included."""
    keys = [c for c in seeds.columns if c not in ("chain", "pos")]
    found = stored(seeds.groupBy(*keys, "chain").agg(F.max("pos").alias("pos")))
    new = found
    while not new.isEmpty():
        step = new.withColumnRenamed("pos", "top").join(exits, "chain").where("pos <= top").select(*keys, F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos")).groupBy(*keys, "chain").agg(F.max("pos").alias("pos"))
        known = found.withColumnRenamed("pos", "had")
        new = stored(step.join(known, [*keys, "chain"], "left").where("had is null or pos > had").drop("had"))
        found = stored(found.unionByName(new).groupBy(*keys, "chain").agg(F.max("pos").alias("pos")))
    return found


def merge_bases(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, base): the common ancestors of each pair (pair, head, reference) that no other common ancestor reaches.

    Commits are ancestors of themselves. Histories without a common ancestor
    give no row, and neither do names that aren't commits.
    """
    places, exits = chains(commits)
    ends = pairs.select("pair", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("head").alias("commit")), F.struct(F.lit(1).alias("side"), F.col("reference").alias("commit")))).alias("e")).select("pair", "e.*")
    found = reached(ends.join(places, "commit").select("pair", "side", "chain", "pos"), exits)
    common = stored(found.groupBy("pair", "chain").agg(F.min("pos").alias("pos"), F.count("*").alias("n")).where("n = 2").drop("n"))
    # A child of a common ancestor that is one too stands in another chain, at or below what is common there.
    below = common.withColumnRenamed("pos", "top").join(exits, "chain").where("pos <= top").select("pair", F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos")).distinct()
    best = common.join(below, ["pair", "chain", "pos"], "left_anti")
    return best.join(places, ["chain", "pos"]).select("pair", F.col("commit").alias("base"))


def merge_base(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, base, problem) with one base for each pair: of several the greatest name; none is a problem."""
    one = merge_bases(commits, pairs).groupBy("pair").agg(F.max("base").alias("base"))
    return pairs.select("pair").distinct().join(one, "pair", "left").select("pair", "base", F.when(F.col("base").isNull(), "no merge base").alias("problem"))


def first_parents(places: DataFrame, exits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(commit, hop, chain, top): the parts of chains that the first parents of wanted commits (commit) run through, nearest first."""
    rows = stored(wanted.select("commit").distinct().join(places, "commit").select("commit", F.lit(0).alias("hop"), "chain", F.col("pos").alias("top")))
    tails = exits.where("nth = 0").select("chain", "to_chain", "to_pos")
    out, hop = rows, 0
    while not rows.isEmpty():
        hop += 1
        rows = stored(rows.join(tails, "chain").select("commit", F.lit(hop).alias("hop"), F.col("to_chain").alias("chain"), F.col("to_pos").alias("top")))
        out = out.unionByName(rows)
    return out


def trees(commits: DataFrame, deltas: DataFrame, wanted: DataFrame) -> DataFrame:
    """(commit, path, blob): the files of wanted commits, from deltas (commit, path, blob) against the first parent; a null blob takes a file away.

    The nearest delta of a path along the first parents holds: that of the
    newest place in the nearest chain. Of several deltas of one commit and path
    the greatest blob counts, before none.

    A chain's tops, the places from which it is looked at, are numbered from
    below. A delta belongs to the first top at or above it, of each path the
    newest one there, and it holds up to the path's next; so there is a row for
    each top and path, not for each delta below each top.
    """
    places, exits = chains(commits)
    way = stored(first_parents(places, exits, wanted))
    tops = stored(ranked(way.select("chain", "top").distinct(), ["chain"], "top", "nth").select("chain", F.col("top").alias("pos"), F.col("nth").cast("long").alias("nth")))
    kind = deltas.schema
    at = deltas.where("path is not null").join(places, "commit").select("chain", "pos", F.lit(None).cast("long").alias("nth"), "path", "blob")
    marks = tops.select("chain", "pos", "nth", F.lit(None).cast(kind["path"].dataType).alias("path"), F.lit(None).cast(kind["blob"].dataType).alias("blob"))
    dealt = stored(at.unionByName(marks).repartitionByRange("chain", "pos").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part", "chain").orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # A chain has a row here for each range that it spans.
    later = dealt.groupBy("part", "chain").agg(F.min("nth").alias("nth")).select("part", "chain", F.min("nth").over(Window.partitionBy("chain").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)).alias("after"))
    below = dealt.withColumn("own", F.min("nth").over(inside)).where("path is not null").join(later, ["part", "chain"]).withColumn("since", F.coalesce("own", "after")).where("since is not null")
    newest = below.groupBy("chain", "path", "since").agg(F.max(F.struct("pos", F.col("blob").isNotNull().alias("there"), "blob")).getField("blob").alias("blob"))
    until = F.coalesce(F.lead("since").over(Window.partitionBy("chain", "path").orderBy("since")) - 1, "most")
    held = newest.join(tops.groupBy("chain").agg(F.max("nth").alias("most")), "chain").withColumn("until", until)
    held = held.select("chain", "path", "blob", F.explode(F.sequence("since", "until")).alias("nth"))
    met = way.join(tops.withColumnRenamed("pos", "top"), ["chain", "top"]).join(held, ["chain", "nth"])
    return met.groupBy("commit", "path").agg(F.max_by("blob", -F.col("hop")).alias("blob")).where("blob is not null")


def baseline(commits: DataFrame, deltas: DataFrame, blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(commit, path, text, problem): inventoried files of wanted commits with the content of blobs (blob, content); a missing blob and content that isn't UTF-8 are problems."""
    files = trees(commits, deltas, wanted).where(in_inventory(F.col("path")))
    rows = files.join(blobs.groupBy("blob").agg(F.max("content").alias("content"), F.lit(True).alias("there")), "blob", "left")
    valid = F.expr("is_valid_utf8(cast(content as string))")
    problem = F.when(F.col("there").isNull(), "missing blob").when(~valid, "not UTF-8")
    return rows.select("commit", "path", F.when(valid, F.col("content").cast("string")).alias("text"), problem.alias("problem"))

