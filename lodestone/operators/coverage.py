"""Coverage records, floors and joins with sources and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import percent
from .code import code_lines, not_executable
from .files import PARSED_EXTENSIONS


def totals(lines: DataFrame) -> DataFrame:
    """Lines (file, line, hits) to (file, found, hit)."""
    return lines.groupBy("file").agg(F.count("*").alias("found"), F.count_if(F.col("hits") > 0).alias("hit"))


def floors(records: DataFrame, floor: float) -> DataFrame:
    """One row (found, hit, pct, below) over all records."""
    s = records.agg(F.coalesce(F.sum("found"), F.lit(0)).alias("found"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hit"))
    return s.withColumn("pct", percent(F.col("hit"), F.col("found"))).withColumn("below", F.col("pct") < floor)


def missing_sources(sources: DataFrame, records: DataFrame) -> DataFrame:
    """(file, reason) of sources without exactly one record."""
    seen = records.groupBy("file").agg(F.count("*").alias("n"))
    out = sources.select("file").distinct().join(seen, "file", "left")
    return out.withColumn("reason", F.when(F.col("n").isNull(), "absent").when(F.col("n") > 1, "ambiguous")).where("reason is not null").select("file", "reason")


def critical(paths: DataFrame, records: DataFrame) -> DataFrame:
    """(file, finding, pct) of critical paths that have no record or aren't wholly covered."""
    out = paths.select("file").distinct().join(records, "file", "left").withColumn("pct", F.when(F.col("found").isNotNull(), percent(F.col("hit"), F.col("found"))))
    finding = F.when(F.col("pct").isNull(), "Missing Critical Path").when(F.col("pct") < 100, "Critical Path 100% Coverage")
    return out.select("file", finding.alias("finding"), "pct").where("finding is not null")


def changed(changes: DataFrame, lines: DataFrame, strict: bool = True) -> DataFrame:
    """Changes (file, line) against lines: (file, covered, uncovered, missing, pct, lines); strict: lines without a record count against the file.

    `lines` lists all that are uncovered, as the report shows them; they are
    those of one file.
    """
    j = changes.distinct().join(lines.groupBy("file", "line").agg(F.max("hits").alias("hits")), ["file", "line"], "left")
    if not strict:
        j = j.where("hits is not null")
    bad = F.when(F.col("hits") == 0, F.col("line"))
    out = j.groupBy("file").agg(
        F.count_if(F.col("hits") > 0).alias("covered"), F.count_if(F.col("hits") == 0).alias("uncovered"), F.count_if(F.col("hits").isNull()).alias("missing"),
        F.array_join(F.transform(F.array_sort(F.collect_list(bad)), lambda x: x.cast("string")), ", ").alias("lines"),
    )
    return out.select("file", "covered", "uncovered", "missing", percent(F.col("covered"), F.col("covered") + F.col("uncovered") + F.col("missing")).alias("pct"), "lines")


def compatible_record(changes: DataFrame, records: DataFrame) -> DataFrame:
    """(changed, file) of changed files (file) with the one record (file) whose path equals theirs or ends in it, or theirs in its; several such records are none.

    A path meets the ends of other paths by equality: each is exploded into its
    suffixes, as many as it has parts.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(\./)+", "")
    parts = lambda c: F.split(c, "/")
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(parts(c))), lambda i: F.array_join(F.slice(parts(c), i, F.size(parts(c))), "/"))
    left = changes.select(F.col("file").alias("changed"), plain(F.col("file")).alias("k")).where("k <> ''").distinct()
    right = records.select("file", plain(F.col("file")).alias("k")).where("k <> ''").distinct()
    found = left.join(right.select("file", F.explode(ends(F.col("k"))).alias("k")), "k").select("changed", "file")
    found = found.union(right.join(left.select("changed", F.explode(ends(F.col("k"))).alias("k")), "k").select("changed", "file")).distinct()
    return found.groupBy("changed").agg(F.count("*").alias("n"), F.min("file").alias("file")).where("n = 1").select("changed", "file")


def repository_key(path: Column, root: str) -> Column:
    """A path relative to the root: .. goes up, and what leaves it or lies outside is null."""
    slashed = F.regexp_replace(path, r"\\", "/")
    step = lambda acc, x: F.when(acc.isNull() | x.isin("", "."), acc).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(x)))
    parts = F.aggregate(F.split(slashed, "/"), F.array().cast("array<string>"), step)
    top = [p for p in root.split("/") if p not in ("", ".")]
    inner = F.when(F.slice(parts, F.lit(1), F.lit(len(top))) == F.array(*map(F.lit, top)).cast("array<string>"), F.slice(parts, F.lit(len(top) + 1), F.greatest(F.size(parts) - len(top), F.lit(0))))
    kept = F.when(slashed.startswith("/") | slashed.rlike("^.:"), inner).otherwise(parts)
    return F.nullif(F.array_join(kept, "/"), F.lit(""))


def indexed(records: DataFrame, root: str) -> DataFrame:
    """(key, file, n): the paths of records (file) by their place in the repository; a key of several paths names none of them."""
    keyed = records.select("file").distinct().withColumn("key", repository_key(F.col("file"), root)).where("key is not null")
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("file").alias("file")).select("key", F.when(F.col("n") == 1, F.col("file")).alias("file"), "n")


def source_records(sources: DataFrame, records: DataFrame, root: str) -> DataFrame:
    """(source, key, file, reason) of each source (file), once per key: its record's path, or why it has none."""
    rows = sources.select(F.col("file").alias("source"), repository_key(F.col("file"), root).alias("key"))
    inside = rows.where("key is not null").groupBy("key").agg(F.min("source").alias("source"))
    found = inside.join(indexed(records, root), "key", "left")
    reason = F.when(F.col("n").isNull(), "absent").when(F.col("n") > 1, "ambiguous")
    outside = rows.where("key is null").distinct().select("source", "key", F.lit(None).cast("string").alias("file"), F.lit("outside").alias("reason"))
    return found.select("source", "key", "file", reason.alias("reason")).unionByName(outside)


_SUMS = ("lines_found", "lines_hit", "functions_found", "functions_hit", "branches_found", "branches_hit")


def all_totals(records: DataFrame) -> DataFrame:
    """One row of the six sums over records; a sum beyond 64 bits is null."""
    return records.agg(*(F.coalesce(F.try_sum(c), F.when(F.count(c) == 0, F.lit(0))).cast("long").alias(c) for c in _SUMS))


def floor_findings(totals_: DataFrame, line: float | None = None, function: float | None = None, branch: float | None = None) -> DataFrame:
    """(metric, actual, limit) of totals below their floors; a sum that overflows is a finding of its own, in place of all others."""
    over = None
    for c in _SUMS:
        over = F.col(c).isNull() if over is None else over | F.col(c).isNull()
    row = lambda metric, actual, limit: F.struct(F.lit(metric).alias("metric"), actual.cast("double").alias("actual"), F.lit(limit).cast("double").alias("limit"))
    checks = [F.when(over, row("Coverage Count Overflow", F.lit(0), 0))]
    for metric, limit, kind in (("Global Line Coverage", line, "lines"), ("Global Function Coverage", function, "functions"), ("Global Branch Coverage", branch, "branches")):
        if limit is not None:
            pct = percent(F.col(f"{kind}_hit"), F.col(f"{kind}_found"))
            checks.append(F.when(~over & (pct < limit), row(metric, pct, limit)))
    return totals_.select(F.explode(F.array_compact(F.array(*checks))).alias("x")).select("x.*")


def functions_without_records(functions: DataFrame, records: DataFrame, root: str) -> DataFrame:
    """(file) once for each file of functions (file) that no single record covers."""
    files = functions.select("file", repository_key(F.col("file"), root).alias("key")).distinct()
    return files.join(indexed(records, root).where("file is not null").select("key"), "key", "left_anti").select("file")


def changed_code(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Changed lines (file, line) of files (path, role, text) with the role source and a parser, those that bear code only; lines beyond the file stay."""
    parsed = F.lower(T.extension_of(F.col("path"))).isin(*PARSED_EXTENSIONS)
    source = files.where((F.col("role") == "source") & parsed & F.col("text").isNotNull())
    wanted = source.join(changes.select(F.col("file").alias("path")).distinct(), "path", "left_semi")
    bearing = code_lines(wanted).select(F.col("path").alias("file"), "line")
    size = wanted.select(F.col("path").alias("file"), F.size(F.split("text", "\n", -1)).alias("_n"))
    rows = changes.select("file", "line").distinct().join(size, "file")
    return rows.where("line = 0 or line > _n").select("file", "line").union(rows.select("file", "line").join(bearing, ["file", "line"], "left_semi"))


def coverage_sources(files: DataFrame, functions: DataFrame) -> DataFrame:
    """(path) of source files (path, role, text) that coverage is asked of: those that can run, and of Rust those with a function (file, test_only) that isn't for tests."""
    own = functions.where(~F.coalesce("test_only", F.lit(False))).select(F.col("file").alias("path")).distinct()
    rows = files.where("role = 'source'").where(~not_executable(F.col("path"), F.col("text")))
    rust = F.lower(T.extension_of(F.col("path"))) == "rs"
    return rows.where(~rust).select("path").union(rows.where(rust).join(own, "path", "left_semi").select("path"))


def evaluated(records: DataFrame, sources: DataFrame, critical_paths: DataFrame, root: str, line: float | None = None, function: float | None = None, branch: float | None = None) -> DataFrame:
    """(file, metric, actual, limit): all that a coverage report is measured by, over the sources' own records."""
    found = source_records(sources, records, root)
    missing = found.where("reason is not null").select(F.col("source").alias("file"), F.lit("Missing Source Coverage").alias("metric"), F.lit(0.0).alias("actual"), F.lit(line or 0.0).alias("limit"))
    mine = records.join(found.where("reason is null").select("file"), "file", "left_semi")
    low = floor_findings(all_totals(mine), line, function, branch).select(F.lit("workspace").alias("file"), "metric", "actual", "limit")
    index = indexed(records, root).where("file is not null")
    wanted = critical_paths.select(F.col("file").alias("_path"), repository_key(F.col("file"), root).alias("key")).join(index, "key", "left").join(records.select("file", "lines_found", "lines_hit"), "file", "left")
    pct = percent(F.col("lines_hit"), F.col("lines_found"))
    crit = wanted.where(F.col("file").isNull() | (pct < 100)).select(F.coalesce(F.when(F.col("file").isNotNull(), F.col("key")), "_path").alias("file"), F.when(F.col("file").isNull(), "Missing Critical Path").otherwise("Critical Path 100% Coverage").alias("metric"), F.coalesce(F.when(F.col("file").isNotNull(), pct), F.lit(0.0)).alias("actual"), F.lit(100.0).alias("limit"))
    return missing.union(low).union(crit)


def production_only(lines: DataFrame, test_lines: DataFrame) -> DataFrame:
    """Totals of lines that no test owns."""
    return totals(lines.join(test_lines.select("file", "line").distinct(), ["file", "line"], "left_anti"))
