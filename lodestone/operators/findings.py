"""Reports of findings: order, counts, comparison and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import ranked

STATES = ("disabled", "skipped", "cached", "completed", "failed", "incomplete")


def top_files(findings: DataFrame, file_col: str = "file", limit: int = 10) -> DataFrame:
    return findings.groupBy(F.col(file_col).alias("file")).agg(F.count("*").alias("findings")).orderBy(F.desc("findings"), "file").limit(limit)


def of_top_files(findings: DataFrame, file_col: str = "file", limit: int = 10) -> DataFrame:
    return findings.join(F.broadcast(top_files(findings, file_col, limit).select(F.col("file").alias(file_col))), file_col, "left_semi")


def compare(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct findings of both reports with `change`: added, removed or retained. Null equals null."""
    both = before.select(*columns, F.lit(1).alias("b"), F.lit(0).alias("a")).union(after.select(*columns, F.lit(0), F.lit(1)))
    seen = both.groupBy(*columns).agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return seen.select(*columns, F.when(F.col("b") == 0, "added").when(F.col("a") == 0, "removed").otherwise("retained").alias("change"))


def canonical(findings: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first findings in order of columns; a column that is a path compares part by part if it is given as its parts (`report.order_columns`)."""
    return findings.orderBy(*order).limit(limit)


def grouped_advisories(rows: DataFrame, key: Column, message: str, location: str) -> DataFrame:
    """(message, n, locations): how often a message occurs, with its three first locations.

    Locations are counted before they are ranked, and only the first three of a
    message are ever brought together.
    """
    counted = rows.groupBy(key.alias(message), F.col(location).alias("_at")).agg(F.count("*").alias("n"))
    first = counted.where("_at is not null").withColumn("_r", F.row_number().over(Window.partitionBy(message).orderBy("_at"))).where("_r <= 3")
    shown = first.groupBy(message).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_at")), lambda x: x.cast("string")), ", ").alias("locations"))
    total = counted.groupBy(message).agg(F.sum("n").alias("n")).withColumnRenamed(message, "_m")
    return total.join(shown, F.col("_m").eqNullSafe(F.col(message)), "left").select(F.col("_m").alias(message), "n", F.coalesce("locations", F.lit("")).alias("locations"))


def engine_states(observed: DataFrame, key: str, state: str) -> DataFrame:
    """The worst state that was observed of each engine."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col(state))
    return observed.groupBy(key).agg(F.max_by(state, rank).alias("state"))


def verdict(findings: DataFrame, severity: str, incomplete: Column) -> DataFrame:
    """One row: blocking findings, whether evidence is incomplete, whether it passed, and the exit code."""
    s = findings.agg(F.count_if(F.col(severity) == "error").alias("blocking"), F.count("*").alias("total"), F.coalesce(F.bool_or(incomplete), F.lit(False)).alias("incomplete"))
    return s.withColumn("passed", (F.col("blocking") == 0) & ~F.col("incomplete")).withColumn("exit_code", F.when(F.col("incomplete"), 2).when(F.col("blocking") > 0, 1).otherwise(0))


def budgets_unpivot(metrics: DataFrame, keys: list[str], limits: dict[str, float]) -> DataFrame:
    """(keys, metric, actual, limit) of each metric above its ceiling."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("actual"), F.lit(float(v)).alias("limit")) for m, v in limits.items()))
    return metrics.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*").where("actual > limit")


def contributors(rows: DataFrame, keys: list[str], line: str, score: str, n: int = 5) -> DataFrame:
    """The lines of the n greatest scores of each key, greater first, then earlier; ranked before they are gathered, so no more than n of a key meet."""
    by = Window.partitionBy(*keys).orderBy(F.desc(score), line)
    best = rows.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= n)
    items = F.array_sort(F.collect_list(F.struct("_r", F.col(line).alias("l"))))
    return best.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["l"].cast("string")), ",").alias("lines"))


def deduplicated(rows: DataFrame, keys: list[str], target: str, seq: str) -> DataFrame:
    """One row per message with its targets and the place where it was first seen."""
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(target)), ",").alias("targets"), F.min(seq).alias("first_seen"))


def identity_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, before, after) of inputs whose digests differ or that only one side has."""
    b, a = before.select(key, F.col(digest).alias("before")), after.select(key, F.col(digest).alias("after"))
    return b.join(a, key, "full").where(~F.col("before").eqNullSafe(F.col("after")))


def partition_cover(parts: DataFrame, sources: DataFrame, part: str, source: str) -> DataFrame:
    """(source, problem): sources that two partitions claim, that none claims, or that the inventory doesn't have."""
    claimed = parts.groupBy(source).agg(F.count_distinct(part).alias("n"))
    both = sources.select(source).distinct().withColumn("known", F.lit(True)).join(claimed, source, "full")
    problem = F.when(F.col("n").isNull(), "uncovered").when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "overlap")
    return both.select(source, problem.alias("problem")).where("problem is not null")


def comparison_lines(changes: DataFrame, verdicts: DataFrame, differences: DataFrame, before: str, after: str) -> DataFrame:
    """(section, nth, text): a comparison as the lines of a text, in order of section and nth.

    changes: (engine, file, line, identity, change), as `compare` gives them;
    verdicts: (side, passed, errors) of sides before and after; differences:
    (text) of scope and configuration. Lines of findings are numbered within
    their group in ranges of their order, so no task sees all of them.
    """
    spark = changes.sparkSession
    line = lambda section, text, nth=0: (section, nth, text)
    badge = F.when(F.col("passed"), "PASS").otherwise(F.format_string("FAIL (%d errors)", F.col("errors")))
    both = verdicts.select("side", badge.alias("b")).agg(F.max(F.when(F.col("side") == "before", F.col("b"))).alias("x"), F.max(F.when(F.col("side") == "after", F.col("b"))).alias("y"))
    n = changes.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "retained")))
    heads = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(0).cast("long").alias("nth"), t.alias("text")) for s, t in (
        (3, F.format_string("diff: +%d added, -%d removed, %d retained", "added", "removed", "retained")),
        (6, F.when(F.col("removed") > 0, F.format_string("Removed findings (-%d):", "removed"))), (8, F.when(F.col("added") > 0, F.format_string("New findings (+%d):", "added"))),
    )))
    counted = n.select(F.explode(heads).alias("h")).select("h.*").where("text is not null")
    title = spark.createDataFrame([line(0, f"report compare: {before} vs {after}"), line(1, "-" * 70)], "section int, nth long, text string")
    verdict = both.select(F.lit(2).alias("section"), F.lit(0).cast("long").alias("nth"), F.concat(F.lit("verdict: before: "), "x", F.lit(" -> after: "), "y").alias("text"))
    told = ranked(differences.select("text", F.lit(0).alias("_all")), ["_all"], "text", "nth").select(F.lit(5).alias("section"), F.col("nth").cast("long").alias("nth"), F.concat(F.lit("  - "), "text").alias("text"))
    warned = differences.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(4).alias("section"), F.lit(0).cast("long").alias("nth"), F.lit("warning: Non-equivalent comparison").alias("text"))
    place = F.when(F.col("line").isNull(), F.col("file")).otherwise(F.concat("file", F.lit(":"), F.col("line").cast("string")))
    some = changes.where("change in ('removed', 'added')").select(F.when(F.col("change") == "removed", 7).otherwise(9).alias("section"), F.struct("engine", "file", "line", "identity").alias("_k"), F.format_string("  - [%s] %s: %s", "engine", place, "identity").alias("text"))
    shown = ranked(some, ["section"], "_k", "nth").select("section", F.col("nth").cast("long").alias("nth"), "text")
    out = title
    for part in (verdict, counted, warned, told, shown):
        out = out.unionByName(part)
    return out
