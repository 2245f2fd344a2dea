"""Mutation reports, scores and violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of each outcome, after trimming, lower-casing and joining words by _.
STATUSES = {
    "killed": ("killed", "caught"),
    "survived": ("survived", "missed"),
    "timeout": ("timeout", "timed_out"),
    "compile_error": ("compileerror", "compile_error", "compilation_error"),
    "runner_error": ("runtimeerror", "runtime_error", "runnererror", "runner_error", "error"),
    "equivalent": ("equivalent",),
    "unviable": ("unviable", "no_coverage", "nocoverage", "not_covered", "notcovered", "ignored", "pending", "not_run", "notrun"),
}
UNEXECUTED = ("nocoverage", "notcovered", "ignored", "pending", "notrun")
FLOOR = 85.0
MUTANT = "struct<id: string, status: string, location: struct<start: struct<line: int, `column`: int>>>"
STRYKER = f"struct<files: map<string, struct<mutants: array<{MUTANT}>, total: long>>, total: long>"
_PHASE = "struct<phase: string, process_status: string, argv: array<string>>"
CARGO = f"struct<cargo_mutants_version: string, end_time: string, total_mutants: long, caught: long, missed: long, timeout: long, unviable: long, success: long, outcomes: array<struct<scenario: string, summary: string, phase_results: array<{_PHASE}>>>>"


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), key)


def status(raw: Column) -> Column:
    """The category of a status, null where it is unknown."""
    return _lookup({n: kind for kind, names in STATUSES.items() for n in names}, F.translate(F.lower(F.trim(raw)), "- /", "___"))


def report_format(body: Column) -> Column:
    """stryker, cargo or generic by the keys of a report, "invalid" for what is no JSON object."""
    keys = F.json_object_keys(body)
    return F.when(keys.isNull(), "invalid").when(F.array_contains(keys, "files"), "stryker").when(F.array_contains(keys, "outcomes"), "cargo").otherwise("generic")


def stryker(reports: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(report, file, id, status, category, line, column) of each mutant; a malformed report gives one row with a null file."""
    parsed = reports.select(F.col(id_col).alias("report"), F.from_json(json_col, STRYKER).alias("r"))
    files = parsed.select("report", F.explode_outer("r.files").alias("file", "f"))
    m = files.select("report", "file", F.explode_outer("f.mutants").alias("m"))
    return m.select("report", "file", "m.id", "m.status", status(F.col("m.status")).alias("category"), "m.location.start.line", "m.location.start.column")


def _stats(items: Column) -> list[Column]:
    """Numbers of each category in an array of categories."""
    of = lambda c: F.size(F.filter(items, lambda x: x == c)).cast("long")
    return [of(c).alias(c) for c in STATUSES]


def _first(*checks: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for bad, name in reversed(checks):
        out = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(out)
    return out


def stryker_stats(reports: DataFrame, id_col: str = "report", json_col: str = "body") -> DataFrame:
    """(report, a count of each category, total, problem) of each report; declared totals, of files and of the report, must be those of its mutants."""
    rows = reports.select(F.col(id_col).alias("report"), F.from_json(json_col, STRYKER).alias("r"))
    files = F.coalesce(F.map_values("r.files"), F.array())
    rows = rows.withColumn("m", F.flatten(F.transform(F.map_values("r.files"), lambda f: F.coalesce(f["mutants"], F.array()))))
    rows = rows.withColumn("c", F.coalesce(F.transform("m", lambda m: status(m["status"])), F.array().cast("array<string>")))
    declared = F.exists(files, lambda f: f["total"].isNotNull() & (f["total"] != F.size(f["mutants"])))
    problem = _first(
        (F.col("r.files").isNull(), "malformed"), (F.size(files) == 0, "no files"), (F.exists(files, lambda f: f["mutants"].isNull()), "file without mutants"), (F.exists("c", lambda x: x.isNull()), "unknown status"),
        (declared | (F.col("r.total") != F.size("c")), "declared total differs"), (F.size("c") == 0, "no mutants"),
    )
    return rows.select("report", *_stats(F.col("c")), F.size("c").cast("long").alias("total"), problem.alias("problem"))


def _failed(process: Column) -> Column:
    """{"Failure": code} with a code other than 0."""
    return F.coalesce(F.get_json_object(process, "$.Failure").try_cast("long") != 0, F.lit(False))


def _tested(phases: Column, failure: bool) -> Column:
    """A build that succeeded and then a test run, with the status that the summary says."""
    build, test = F.get(phases, F.lit(0)), F.get(phases, F.lit(1))
    runs = F.exists(test["argv"], lambda x: x.isin("test", "nextest")) & ~F.exists(test["argv"], lambda x: x.isin("--no-run", "--list", "--help", "--version"))
    ended = _failed(test["process_status"]) if failure else test["process_status"] == "Success"
    return F.coalesce((F.size(phases) == 2) & (build["phase"] == "Build") & (build["process_status"] == "Success") & (test["phase"] == "Test") & runs & ended, F.lit(False))


def cargo_stats(reports: DataFrame, id_col: str = "report", json_col: str = "body") -> DataFrame:
    """(report, counts, total, problem) of reports with structured outcomes.

    A report needs its producer's version and end, one baseline that passed, and
    for each mutant phases that prove its summary; the counters it declares must
    be those of its outcomes.
    """
    rows = reports.select(F.col(id_col).alias("report"), F.from_json(json_col, CARGO).alias("r"))
    outcomes = F.coalesce("r.outcomes", F.array().cast(f"array<struct<scenario: string, summary: string, phase_results: array<{_PHASE}>>>"))
    base, mutants = F.filter(outcomes, lambda o: o["scenario"] == "Baseline"), F.filter(outcomes, lambda o: ~o["scenario"].eqNullSafe(F.lit("Baseline")))
    p = lambda o: o["phase_results"]

    def category(o):
        return (
            F.when((o["summary"] == "CaughtMutant") & _tested(p(o), True), "killed")
            .when((o["summary"] == "MissedMutant") & _tested(p(o), False), "survived")
            .when((o["summary"] == "Timeout") & F.exists(p(o), lambda x: x["process_status"] == "Timeout"), "timeout")
            .when((o["summary"] == "Unviable") & F.exists(p(o), lambda x: (x["phase"] == "Build") & _failed(x["process_status"])), "unviable")
        )

    rows = rows.withColumn("base", base).withColumn("mutants", mutants).withColumn("c", F.transform("mutants", category))
    n = lambda kind: F.size(F.filter("c", lambda x: x == kind))
    declared = {"total_mutants": F.size("c"), "caught": n("killed"), "missed": n("survived"), "timeout": n("timeout"), "unviable": n("unviable"), "success": F.lit(0)}
    differs = reduce(lambda a, b: a | b, (~F.col(f"r.{k}").eqNullSafe(v.cast("long")) for k, v in declared.items()))
    is_mutant = lambda o: F.coalesce(F.get_json_object(o["scenario"], "$.Mutant").startswith("{"), F.lit(False))
    problem = _first(
        (F.col("r.outcomes").isNull(), "malformed"), (F.coalesce("r.cargo_mutants_version", F.lit("")) == "", "no producer version"), (F.col("r.end_time").isNull(), "no end time"),
        (F.exists("mutants", lambda o: ~is_mutant(o)), "unknown scenario"), (F.size(F.array_distinct(F.transform("mutants", lambda o: o["scenario"]))) < F.size("mutants"), "duplicate scenario"),
        ((F.size("base") != 1) | F.exists("base", lambda o: ~((o["summary"] == "Success") & _tested(p(o), False))), "no baseline that passed"), (F.exists("c", lambda x: x.isNull()), "outcome without evidence"),
        (differs, "declared counters differ"), (F.size("c") == 0, "no mutants"),
    )
    return rows.select("report", *_stats(F.col("c")), F.size("c").cast("long").alias("total"), problem.alias("problem"))


def generic_stats(reports: DataFrame, id_col: str = "report", json_col: str = "body") -> DataFrame:
    """(report, counts, total, problem) of reports that are objects of counts; other numbers, and other keys that name a status, are unknown outcomes."""
    rows = reports.select(F.col(id_col).alias("report"), F.try_variant_get(F.try_parse_json(json_col), "$", "map<string,variant>").alias("m"))
    kind = lambda v: F.schema_of_variant(v)
    number = lambda v: F.try_variant_get(v, "$", "long")
    get = lambda k: F.try_element_at("m", F.lit(k))
    whole = lambda k: kind(get(k)) == "BIGINT"
    count = lambda k: F.coalesce(F.when(whole(k), number(get(k))), F.lit(0))
    others = F.map_filter("m", lambda k, v: ~k.isin(*STATUSES, "total") & (kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") | F.lower(k).rlike("status|outcome|result")))
    bad = reduce(lambda a, b: a | b, (get(k).isNotNull() & (~whole(k) | (number(get(k)) < 0)) for k in (*STATUSES, "total")))
    total = reduce(lambda a, b: F.try_add(a, b), (count(k) for k in STATUSES))
    known = F.arrays_overlap(F.map_keys("m"), F.array(*map(F.lit, STATUSES)))
    problem = _first(
        (F.col("m").isNull(), "malformed"), (~known, "no outcome counts"), (F.size(others) > 0, "unknown outcome"), (bad, "count isn't a whole number"), (total.isNull(), "counts overflow"), (get("total").isNotNull() & (count("total") != total), "declared total differs"), (total == 0, "no mutants")
    )
    return rows.select("report", *(count(k).alias(k) for k in STATUSES), F.coalesce(total, F.lit(0)).alias("total"), problem.alias("problem"))


def stats_of(reports: DataFrame, id_col: str = "report", json_col: str = "body") -> DataFrame:
    """(report, format, counts, total, problem) of reports of any format."""
    rows = reports.select(F.col(id_col).alias("report"), F.col(json_col).alias("body"), report_format(F.col(json_col)).alias("format"))
    out = None
    for name, read in (("stryker", stryker_stats), ("cargo", cargo_stats), ("generic", generic_stats), ("invalid", generic_stats)):
        part = read(rows.where(F.col("format") == name)).withColumn("format", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("report", "format", *STATUSES, "total", "problem")


def unexecuted(reports: DataFrame, id_col: str = "report", json_col: str = "body") -> DataFrame:
    """(report, place) of mutants that no test ran, as file:line:column (mutant id, status)."""
    rows = stryker(reports, id_col, json_col).where(F.translate(F.lower("status"), "- /_", "").isin(*UNEXECUTED))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    return rows.select("report", F.concat("file", F.lit(":"), shown("line"), F.lit(":"), shown("column"), F.lit(" (mutant "), F.coalesce("id", F.lit("unknown")), F.lit(", "), "status", F.lit(")")).alias("place"))


def score_of(killed: Column, survived: Column) -> Column:
    return F.coalesce(F.try_divide(killed * 100.0, killed + survived), F.lit(0.0))


def score(outcomes: DataFrame, *keys: str, floor: float = FLOOR) -> DataFrame:
    """Counts of each category by keys, the kill rate and whether it is below the floor; unknown statuses are counted apart."""
    counts = [F.count_if(F.col("category") == c).alias(c) for c in STATUSES]
    out = outcomes.groupBy(*keys).agg(*counts, F.count_if(F.col("category").isNull()).alias("unknown"), F.count("*").alias("total"))
    rate = score_of(F.col("killed"), F.col("survived"))
    return out.withColumn("score", rate).withColumn("below", (F.col("killed") + F.col("survived") == 0) | (F.col("score") < floor))


def violations(stats: DataFrame, floor: float = FLOOR, key: str = "report") -> DataFrame:
    """(report, metric, actual, limit) of counts of each report with `unexecuted`: mutants that weren't run, a kill rate below the floor, and outcomes that say nothing."""
    rate = score_of(F.col("killed"), F.col("survived"))
    low = (F.col("killed") + F.col("survived") == 0) | (rate < floor)
    row = lambda metric, actual, limit, bad: F.when(bad, F.struct(F.lit(metric).alias("metric"), actual.cast("double").alias("actual"), F.lit(limit).cast("double").alias("limit")))
    some = lambda metric, n: row(metric, n, 0.0, n > 0)
    missing = F.coalesce(F.col("unexecuted"), F.lit(0))
    found = F.array_compact(
        F.array(
            some("Mutation Unexecuted Mutants", missing), row("Mutation Kill Rate", rate, floor, low), some("Mutation Timeouts", F.col("timeout")), some("Mutation Compile Errors", F.col("compile_error")),
            some("Mutation Runner Errors", F.col("runner_error")), some("Mutation Unviable Mutants", F.greatest(F.col("unviable") - missing, F.lit(0))),
        )
    )
    return stats.select(key, F.explode(found).alias("x")).select(key, "x.*")


def evaluated(reports: DataFrame, id_col: str = "report", json_col: str = "body", floor: float = FLOOR) -> tuple[DataFrame, DataFrame]:
    """Violations of valid reports, and (report, problem) of the others."""
    stats = stats_of(reports, id_col, json_col)
    missing = unexecuted(reports, id_col, json_col).groupBy("report").agg(F.count("*").alias("unexecuted"))
    return violations(stats.where("problem is null").join(missing, "report", "left"), floor), stats.where("problem is not null").select("report", "problem")
