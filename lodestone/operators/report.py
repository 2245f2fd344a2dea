"""Reports of findings: one table for all categories, its rule stream, filters, totals, comparison and texts.

A report is a table of findings with these columns; a category leaves those
that it has no use for null:

    category, file, line, column, end_line, file_b, line_b, end_line_b, metric,
    identity, message, recommendation, actual, limit, tokens, blocking, exit_code

`metric` is the metric, kind or step; `identity` the token, function, rule,
fingerprint or command.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.lineage import running

FINDING = (
    "category string, file string, line long, column long, end_line long, file_b string, line_b long, end_line_b long, metric string, identity string, "
    "message string, recommendation string, actual double, limit double, tokens long, blocking boolean, exit_code int"
)
# Categories in order of the report, stable ids of rules by metric, kind or step.
CATEGORIES = ("budget", "suppression", "complexity", "invariant", "clone", "coverage", "mutation", "specialist", "orchestration")
RULES = {
    "complexity": {
        "Cyclomatic Complexity": "HG-COMPLEXITY-CYCLOMATIC", "Parameter Count": "HG-COMPLEXITY-PARAMETERS", "Function Lines": "HG-COMPLEXITY-FUNCTION-LINES",
        "Nesting Depth": "HG-COMPLEXITY-NESTING", "Statement Count": "HG-COMPLEXITY-STATEMENTS",
    },
    "invariant": {"Disallowed Import": "HG-INVARIANT-DISALLOWED-IMPORT", "Disallowed Call": "HG-INVARIANT-DISALLOWED-CALL", "Disallowed Token": "HG-INVARIANT-DISALLOWED-TOKEN"},
    "coverage": {
        "Coverage Count Overflow": "HG-COVERAGE-COUNT-OVERFLOW", "Global Line Coverage": "HG-COVERAGE-GLOBAL-LINES", "Global Function Coverage": "HG-COVERAGE-GLOBAL-FUNCTIONS",
        "Global Branch Coverage": "HG-COVERAGE-GLOBAL-BRANCHES", "Missing Source Coverage": "HG-COVERAGE-MISSING-SOURCE", "Missing Critical Path": "HG-COVERAGE-MISSING-CRITICAL-PATH",
        "Critical Path 100% Coverage": "HG-COVERAGE-CRITICAL-PATH", "Missing Diff Coverage": "HG-COVERAGE-MISSING-DIFF", "Diff Line Coverage": "HG-COVERAGE-DIFF-LINES",
    },
    "mutation": {
        "Mutation Kill Rate": "HG-MUTATION-KILL-RATE", "Mutation Timeouts": "HG-MUTATION-TIMEOUTS", "Mutation Compile Errors": "HG-MUTATION-COMPILE-ERRORS",
        "Mutation Runner Errors": "HG-MUTATION-RUNNER-ERRORS", "Mutation Unviable Mutants": "HG-MUTATION-UNVIABLE", "Mutation Unexecuted Mutants": "HG-MUTATION-UNEXECUTED",
    },
    "orchestration": {
        "format_check": "HG-ORCHESTRATION-FORMAT-CHECK", "format": "HG-ORCHESTRATION-FORMAT", "lint": "HG-ORCHESTRATION-LINT", "test": "HG-ORCHESTRATION-TEST",
        "generated-freshness": "HG-ORCHESTRATION-GENERATED-FRESHNESS", "coverage-diff": "HG-ORCHESTRATION-COVERAGE-DIFF", "coverage-report": "HG-ORCHESTRATION-COVERAGE-REPORT",
        "coverage-source-classification": "HG-ORCHESTRATION-COVERAGE-SOURCE-CLASSIFICATION", "read-clone-index": "HG-ORCHESTRATION-READ-CLONE-INDEX", "clone-index": "HG-ORCHESTRATION-CLONE-INDEX",
        "read-source": "HG-ORCHESTRATION-READ-SOURCE", "parse-source": "HG-ORCHESTRATION-PARSE-SOURCE", "classify-source": "HG-ORCHESTRATION-CLASSIFY-SOURCE",
        "unsupported-source": "HG-ORCHESTRATION-UNSUPPORTED-SOURCE", "mutation-report": "HG-ORCHESTRATION-MUTATION-REPORT", "mutation-scope": "HG-ORCHESTRATION-MUTATION-SCOPE", "legacy-ratchet": "HG-ORCHESTRATION-LEGACY-RATCHET",
    },
}
FALLBACKS = {"complexity": "HG-COMPLEXITY-UNKNOWN-METRIC", "invariant": "HG-INVARIANT-UNKNOWN-KIND", "coverage": "HG-COVERAGE-UNKNOWN-METRIC", "mutation": "HG-MUTATION-UNKNOWN-METRIC", "orchestration": "HG-ORCHESTRATION-UNKNOWN-STEP"}
MISSING_COVERAGE = ("Missing Source Coverage", "Missing Diff Coverage", "Missing Critical Path", "Coverage Count Overflow")
INCOMPLETE_MUTATION = ("Mutation Unexecuted Mutants", "Mutation Timeouts", "Mutation Compile Errors", "Mutation Runner Errors", "Mutation Unviable Mutants")
ENGINE_NAMES = {
    "complexity": "complexity", "budget": "budget", "file-budget": "budget", "file-budgets": "budget", "suppression": "suppression", "suppressions": "suppression", "anti-gaming": "suppression",
    "invariant": "invariant", "invariants": "invariant", "clone": "clone", "clones": "clone", "coverage": "coverage", "mutation": "mutation", "mutation-report": "mutation",
    "orchestration": "orchestration", "tool": "orchestration", "specialist": "specialist", "clippy": "specialist", "rustc": "specialist",
}
RECORD_ENGINES = {"budget": "file-budget", "suppression": "anti-gaming", "complexity": "complexity", "invariant": "invariants", "clone": "clones", "specialist": "specialist", "coverage": "coverage", "mutation": "mutation", "orchestration": "orchestration"}
SOURCE_STEPS = ("unsupported-source", "classify-source", "read-source", "parse-source")

#: What to do about a finding that doesn't say it itself.
ADVICE = {
    "budget": "Look at code and comments apart and split the file where its parts belong together; keep the limit.",
    "suppression": "Take the directive out and mend what it hides.",
    "complexity": "Split the function into smaller ones with the same behaviour.",
    "invariant": "Change the target so that the rule of the architecture holds.",
    "clone": "Move the repeated logic to one place with the same behaviour.",
    "coverage": "Produce the coverage again and test what isn't covered.",
    "mutation": "Mend the evidence and add tests of meaning for what survived.",
    "specialist": "Resolve what the tool reports at this place.",
    "orchestration": "Mend the failing step before the gate is accepted.",
}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for p in pairs.items() for x in p))


def rank(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), category)


def rule_id(category: Column, metric: Column, identity: Column) -> Column:
    """The stable id of a finding's rule; a tool's own rule for the tool's findings."""
    out = (
        F.when((category == "budget") & (metric == "File Byte Size"), "HG-BUDGET-FILE-BYTE-SIZE")
        .when((category == "budget") & metric.rlike(r"(?s)^Physical Lines \(\..*\)$"), "HG-BUDGET-PHYSICAL-LINES")
        .when(category == "budget", "HG-BUDGET-UNKNOWN-METRIC")
        .when(category == "suppression", "HG-SUPPRESSION-FORBIDDEN")
        .when(category == "clone", "HG-CLONE-DUPLICATE-BLOCK")
        .when(category == "specialist", identity)
    )
    for name, ids in RULES.items():
        out = out.when(category == name, F.coalesce(F.try_element_at(_map(ids), metric), F.lit(FALLBACKS[name])))
    return out


def counted(category: Column, blocking: Column) -> Column:
    """Whether a finding counts: of the tools' findings only those that block."""
    return (category != "specialist") | F.coalesce(blocking, F.lit(False))


def rule_stream(findings: DataFrame) -> DataFrame:
    """(cat_rank, rule_id, category, message, locations, recommendation) of all blocking findings.

    A clone has two locations, a step has one only where it is about a source
    file, and a line of 0 is none.
    """
    line = lambda c: F.when(F.col(c) > 0, F.col(c))
    place = lambda f, a, b, col=None: F.struct(F.col(f).alias("file"), a.alias("line"), (F.lit(None).cast("long") if col is None else col).alias("column"), b.alias("end_line"))
    none = F.lit(None).cast("long")
    cat = F.col("category")
    locations = (
        F.when(cat == "clone", F.array(place("file", line("line"), line("end_line")), place("file_b", line("line_b"), line("end_line_b"))))
        .when(cat.isin("complexity"), F.array(place("file", line("line"), line("end_line"))))
        .when(cat.isin("suppression", "invariant"), F.array(place("file", line("line"), none)))
        .when(cat == "specialist", F.array(place("file", F.col("line"), F.col("end_line"))))
        .when((cat == "orchestration") & F.col("metric").isin(*SOURCE_STEPS), F.array(place("identity", F.when(F.col("metric") == "parse-source", line("line")), none, F.when(F.col("metric") == "parse-source", F.col("column")))))
        .when(cat == "orchestration", F.array().cast("array<struct<file: string, line: bigint, column: bigint, end_line: bigint>>"))
        .otherwise(F.array(place("file", none, none)))
    )
    said = F.when((cat == "orchestration") & (F.trim(F.coalesce("message", F.lit(""))) == ""), F.concat(F.lit("Step `"), "metric", F.lit("` failed."))).otherwise(F.col("message"))
    advice = F.coalesce(F.when(F.trim("recommendation") != "", F.col("recommendation")), F.try_element_at(_map(ADVICE), cat))
    rows = findings.where(counted(cat, F.col("blocking")))
    return rows.select(rank(cat).cast("int").alias("cat_rank"), rule_id(cat, F.col("metric"), F.col("identity")).alias("rule_id"), cat, said.alias("message"), locations.alias("locations"), advice.alias("recommendation"))


def failure_stream(stream: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """Rules that tell of missing evidence rather than of code, with those that a report was saved with."""
    failing = [RULES["mutation"][m] for m in INCOMPLETE_MUTATION]
    out = stream.where((F.col("category") == "orchestration") | F.col("rule_id").startswith("HG-COVERAGE-MISSING-") | F.col("rule_id").isin(*failing))
    if saved is None:
        return out
    columns = [c for c in out.columns if c != "cat_rank"]
    new = saved.select(*columns).distinct().join(out.select(*(F.col(c).alias(f"_{c}") for c in columns)), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns], "left_anti")
    return out.unionByName(new.withColumn("cat_rank", rank(F.col("category")).cast("int")))


def by_engine(findings: DataFrame, engine: str) -> DataFrame:
    """Findings of the category that an engine's name, in any case and with _ or -, stands for."""
    name = ENGINE_NAMES.get(engine.lower().replace("_", "-"))
    if name is None:
        raise ValueError(f"unknown engine {engine!r}; use complexity, budget, suppression, invariant, clones, coverage, mutation, orchestration, or specialist")
    return findings.where(F.col("category") == name)


def by_metric(findings: DataFrame, metric: str) -> DataFrame:
    """Findings whose metric, or a tool's rule, has the text in it, in any case; categories without metrics leave."""
    value = F.when(F.col("category") == "specialist", F.col("identity")).otherwise(F.col("metric"))
    return findings.where(F.col("category").isin("budget", "complexity", "coverage", "mutation", "specialist") & F.contains(F.lower(value), F.lit(metric.lower())))


def _files(findings: DataFrame) -> Column:
    return F.when(F.col("category") == "clone", F.array("file", "file_b")).otherwise(F.array("file"))


def by_top_files(findings: DataFrame, top: int) -> DataFrame:
    """Findings of the files with most of them; a clone counts for both of its files, steps leave."""
    rows = findings.where("category <> 'orchestration'")
    ranked = rows.select(F.explode(_files(rows)).alias("file")).groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.split("file", "/")).limit(top)
    # At most `top` rows.
    best = F.broadcast(ranked.select(F.col("file").alias("_top")))
    return rows.join(best, F.array_contains(_files(rows), F.col("_top")), "left_semi")


def order_columns() -> list[Column]:
    """The report's order: categories, then each category's own columns; paths compare part by part."""
    parts = lambda c: F.split(c, "/")
    cat = F.col("category")
    place = F.when(cat.isin("budget", "coverage", "mutation"), F.lit(None)).otherwise(F.col("line"))
    first = F.when(cat == "orchestration", F.array("metric")).otherwise(parts("file"))
    return [
        rank(cat), first.asc_nulls_first(), F.when(cat == "coverage", F.col("identity")).asc_nulls_first(), place.asc_nulls_first(), F.when(cat.isin("complexity", "specialist"), F.col("column")).asc_nulls_first(), F.when(cat.isin("complexity", "clone"), F.col("end_line")).asc_nulls_first(),
        F.when(cat == "clone", parts("file_b")).asc_nulls_first(), F.when(cat == "clone", F.col("line_b")).asc_nulls_first(), F.when(cat == "clone", F.col("end_line_b")).asc_nulls_first(),
        F.col("identity").asc_nulls_first(), F.col("metric").asc_nulls_first(), F.col("message").asc_nulls_first(), F.col("line").asc_nulls_first(),
    ]


def displayed(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """Findings in the report's order, cut at a limit that all categories share; with a limit, tools' findings that don't block leave."""
    if limit is None:
        return findings.orderBy(*order_columns())
    return findings.where(counted(F.col("category"), F.col("blocking"))).orderBy(*order_columns()).limit(limit)


def counters(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """One row: all findings that count, those shown under a limit, and those left out."""
    total = findings.agg(F.count_if(counted(F.col("category"), F.col("blocking"))).alias("total"))
    shown = F.col("total") if limit is None else F.least("total", F.lit(limit).cast("long"))
    return total.select("total", shown.alias("shown"), (F.col("total") - shown).alias("omitted"))


def totals(findings: DataFrame) -> DataFrame:
    """One row: findings, those about code, and those that tell of missing evidence."""
    cat, metric = F.col("category"), F.col("metric")
    blockers = F.count_if((cat == "orchestration") | ((cat == "coverage") & metric.isin(*MISSING_COVERAGE)) | ((cat == "mutation") & metric.isin(*INCOMPLETE_MUTATION)))
    out = findings.agg(F.count_if(counted(cat, F.col("blocking"))).alias("total"), blockers.alias("blockers"))
    return out.select("total", (F.col("total") - F.col("blockers")).alias("code"), "blockers")


def summary(findings: DataFrame, files_scanned: int, functions_analyzed: int) -> DataFrame:
    """The one-row rollup of a report."""
    cat, metric = F.col("category"), F.col("metric")
    of = lambda c: F.count_if(cat == c)
    blockers = F.count_if((cat == "orchestration") | ((cat == "coverage") & metric.isin(*MISSING_COVERAGE)) | ((cat == "mutation") & metric.isin(*INCOMPLETE_MUTATION)))
    rows = findings.agg(
        F.count_if(counted(cat, F.col("blocking"))).alias("total_errors"), blockers.alias("analysis_blockers"), of("clone").alias("clones"), of("complexity").alias("complexity"),
        F.count_distinct(F.when(cat == "complexity", F.struct("file", "line", "column", "end_line", "identity"))).alias("function_review_targets"), of("budget").alias("file_budgets"), of("suppression").alias("suppressions"),
        of("invariant").alias("architecture"), of("coverage").alias("coverage"), of("mutation").alias("mutation"), of("orchestration").alias("tool"), F.count_if((cat == "specialist") & F.col("blocking")).alias("specialist_findings"),
    )
    sided = findings.where("category not in ('mutation', 'orchestration')").where(counted(cat, F.col("blocking")))
    files = sided.select(F.explode(_files(sided)).alias("f")).agg(F.count_distinct("f").alias("files_with_violations"))
    # Two tables of one row.
    out = rows.crossJoin(files)
    return out.select("*", (F.col("total_errors") - F.col("analysis_blockers")).alias("code_findings"), F.col("complexity").alias("ast_violations"), F.lit(files_scanned).cast("long").alias("files_scanned"), F.lit(functions_analyzed).cast("long").alias("functions_analyzed"), (F.col("total_errors") == 0).alias("passed"))


def as_json(rows: DataFrame, name: str = "body") -> DataFrame:
    """Each row as one JSON object."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(name))


def summary_text(rollup: DataFrame) -> DataFrame:
    """(body) of the rollup as three lines."""
    s = lambda c: F.col(c).cast("string")
    first = F.concat(F.lit("Summary: "), s("total_errors"), F.lit(" errors ("), s("code_findings"), F.lit(" code findings across "), s("files_with_violations"), F.lit(" files, "), s("analysis_blockers"), F.lit(" analysis blockers; "), s("clones"), F.lit(" clones, "), s("ast_violations"), F.lit(" AST violations)"))
    second = F.concat(F.lit("Scanned: "), s("files_scanned"), F.lit(" files, "), s("functions_analyzed"), F.lit(" functions"))
    names = (("code_findings", "code_findings"), ("analysis_blockers", "analysis_blockers"), ("clones", "clones"), ("complexity", "complexity"), ("file-budget", "file_budgets"), ("anti-gaming", "suppressions"), ("architecture", "architecture"), ("coverage", "coverage"), ("mutation", "mutation"), ("tool", "tool"))
    third = F.concat(F.lit("Breakdown: "), F.concat_ws(", ", *(F.concat(F.lit(f"{n}="), s(c)) for n, c in names)))
    return rollup.select(F.concat_ws("\n", first, second, third).alias("body"))


def function_reviews(findings: DataFrame) -> DataFrame:
    """(file, line, column, end_line, identity, metrics) of each function with findings, its metrics in order of their names."""
    rows = findings.where("category = 'complexity'")
    whole = lambda c: F.format_string("%.0f", F.bround(c))
    shown = F.struct("metric", F.concat_ws("", "metric", F.lit(" "), whole(F.col("actual")), F.lit("/"), whole(F.col("limit"))).alias("text"))
    return rows.groupBy("file", "line", "column", "end_line", "identity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["text"]), "; ").alias("metrics"))


def compact_rows(findings: DataFrame) -> DataFrame:
    """(cat_rank, title, target): a row per function review and per other finding."""
    cat = F.col("category")
    one = lambda x: F.format_string("%.1f", x)
    at = F.concat_ws(":", "file", F.col("line").cast("string"))
    span = lambda f, a, b: F.concat(F.col(f), F.lit(":"), F.col(a).cast("string"), F.lit("-"), F.col(b).cast("string"))
    lines_ = F.col("end_line") - F.col("line") + 1
    title = (
        F.when(cat == "suppression", F.concat(F.lit("error[anti-gaming]: forbidden `"), "identity", F.lit("`")))
        .when(cat == "budget", F.concat(F.lit("error[file-budget]: "), "metric", F.lit(" is "), T.number(F.col("actual")), F.lit(" (limit: "), T.number(F.col("limit")), F.lit(")")))
        .when(cat == "invariant", F.concat(F.lit("error[architecture]: ["), "identity", F.lit("] "), F.coalesce("message", F.lit(""))))
        .when(cat == "clone", F.concat(F.lit("error[clone]: duplicate ("), lines_.cast("string"), F.lit(" lines, ~"), F.col("tokens").cast("string"), F.lit(" tokens)")))
        .when(cat == "coverage", F.concat(F.lit("error[coverage]: "), "metric", F.lit(" is "), one("actual"), F.lit(" (required: "), one("limit"), F.lit(")")))
        .when(cat == "mutation", F.concat(F.lit("error[mutation]: "), "metric", F.lit(" is "), one("actual"), F.lit("% (required: "), one("limit"), F.lit("%)")))
        .when(cat == "specialist", F.concat(F.when(F.col("blocking"), "error").otherwise("warning"), F.lit("["), "identity", F.lit("]: "), F.coalesce("message", F.lit(""))))
        .otherwise(F.concat(F.lit("error[tool]: `"), "identity", F.lit("` failed")))
    )
    target = (
        F.when(cat.isin("suppression", "invariant"), at)
        .when(cat == "clone", F.concat(span("file", "line", "end_line"), F.lit(" matches "), span("file_b", "line_b", "end_line_b")))
        .when(cat == "specialist", F.concat_ws(":", "file", F.col("line").cast("string"), F.col("column").cast("string")))
        .when(cat == "orchestration", F.concat(F.lit("["), "metric", F.lit("] `"), "identity", F.lit("`")))
        .otherwise(F.col("file"))
    )
    rows = findings.where("category <> 'complexity'").select(rank(cat).cast("int").alias("cat_rank"), title.alias("title"), target.alias("target"))
    reviews = function_reviews(findings)
    reviewed = reviews.select(F.lit(CATEGORIES.index("complexity") + 1).alias("cat_rank"), F.concat(F.lit("error[complexity]: `"), "identity", F.lit("`: "), "metrics").alias("title"), F.concat_ws(":", "file", F.col("line").cast("string"), F.col("column").cast("string")).alias("target"))
    return rows.unionByName(reviewed)


def scan_metrics(functions: DataFrame) -> DataFrame:
    """(line) of text for each function (path, start_line, name, cyclomatic, parameters, lines, nesting, statements)."""
    s = lambda c: F.col(c).cast("string")
    named = F.concat_ws(", ", *(F.concat(F.lit(f"{c}="), s(c)) for c in ("cyclomatic", "parameters", "lines", "nesting", "statements")))
    return functions.select(F.concat(F.lit("  "), "path", F.lit(":"), s("start_line"), F.lit(" "), "name", F.lit(": "), named).alias("line"))


def finding_records(findings: DataFrame) -> DataFrame:
    """Distinct (engine, file, line, identity) by which reports are compared; a budget's or coverage's line doesn't count."""
    cat = F.col("category")
    rows = findings.where(counted(cat, F.col("blocking")))
    joined = lambda *c: F.concat_ws(":", *(F.coalesce(x.cast("string"), F.lit("")) for x in c))
    identity = (
        F.when(cat.isin("budget", "mutation"), F.col("metric"))
        .when(cat.isin("complexity", "coverage"), joined(F.col("identity"), F.col("metric")))
        .when(cat == "clone", joined(F.col("identity"), F.col("file_b"), F.concat(F.col("line_b").cast("string"), F.lit("-"), F.col("end_line_b").cast("string")), F.col("tokens")))
        .otherwise(F.col("identity"))
    )
    line = F.when(cat.isin("suppression", "complexity", "invariant", "clone", "specialist"), F.col("line"))
    return rows.select(F.try_element_at(_map(RECORD_ENGINES), cat).alias("engine"), F.when(cat == "orchestration", F.col("metric")).otherwise(F.col("file")).alias("file"), line.alias("line"), identity.alias("identity")).distinct()


PLAN = "struct<policy_sha256: string, mode: string, paths: array<string>, command: string, root: string, engines: array<struct<id: string, enabled: boolean, selected: boolean, required_evidence: array<string>, state: string>>>"


def differences(runs: DataFrame) -> DataFrame:
    """What makes two runs incomparable: rows with plans `before` and `after` (null where a report has none) and files_before, files_after get scope_differences, config_differences and equivalent."""
    b, a = F.col("before"), F.col("after")
    both = b.isNotNull() & a.isNotNull()
    scope = lambda p: F.array_sort(F.transform(p["engines"], lambda e: F.struct(e["id"].alias("id"), e["enabled"].alias("enabled"), e["selected"].alias("selected"), e["required_evidence"].alias("evidence"))))
    unfinished = lambda p: F.coalesce(F.exists(p["engines"], lambda e: e["selected"] & e["state"].isin("incomplete", "skipped")), F.lit(False))
    unlike = lambda x, y: ~x.eqNullSafe(y)
    scopes = F.array(
        F.when(~both, F.lit("execution metadata is missing")),
        F.when(both & (unlike(b["mode"], a["mode"]) | unlike(b["paths"], a["paths"])), F.lit("scope changed")),
        F.when(both & (unlike(b["command"], a["command"]) | unlike(b["root"], a["root"])), F.lit("command or root changed")),
        F.when(both & unlike(scope(b), scope(a)), F.lit("engines or required evidence changed")),
        F.when(both & ((b["mode"] == "diff") | (a["mode"] == "diff")), F.lit("diff reports have no complete inventory")),
        F.when(both & (unfinished(b) | unfinished(a)), F.lit("selected evidence is incomplete or skipped")),
        F.when(unlike(F.col("files_before"), F.col("files_after")), F.lit("files scanned changed")),
    )
    configs = F.array(F.when(both & unlike(b["policy_sha256"], a["policy_sha256"]), F.lit("policy changed")))
    out = runs.withColumn("scope_differences", F.array_compact(scopes)).withColumn("config_differences", F.array_compact(configs))
    return out.withColumn("equivalent", (F.size("scope_differences") == 0) & (F.size("config_differences") == 0))


def omitted_requirements(engines: DataFrame) -> DataFrame:
    """Engines (id, enabled, selected) that a policy asks for and a run left out."""
    return engines.where("enabled and not selected")


def reconciled(engines: DataFrame, seen: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Engines with the worst state that was observed (engine, state, reason, seq) of each selected one, and the first reason of an incomplete one."""
    from .findings import STATES

    order = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    worst = seen.groupBy(*by, F.col("engine").alias("id")).agg(F.max_by("state", order).alias("_state"), F.min_by("reason", F.when(F.col("state") == "incomplete", F.col("seq"))).alias("_reason"))
    rows = engines.join(worst, [*by, "id"], "left")
    found = F.col("selected") & F.col("_state").isNotNull()
    reason = F.when(found, F.when(F.col("_state") == "incomplete", F.coalesce("_reason", F.lit("required evidence could not be fully evaluated")))).otherwise(F.col("reason"))
    return rows.select(*by, "id", "enabled", "selected", F.when(found, F.col("_state")).otherwise(F.col("state")).alias("state"), reason.alias("reason"))


def verdicts(findings: DataFrame, engines: DataFrame) -> DataFrame:
    """(passed, incomplete, accepted, exit_code) of a run of the whole repository; accepted: passed, all selected engines completed and none left out."""
    f = findings.agg(
        F.count_if(counted(F.col("category"), F.col("blocking"))).alias("total"),
        F.coalesce(F.bool_or(((F.col("category") == "coverage") & F.col("metric").isin(*MISSING_COVERAGE)) | ((F.col("category") == "mutation") & F.col("metric").isin(*INCOMPLETE_MUTATION)) | ((F.col("category") == "orchestration") & (F.col("exit_code").isNull() | F.col("exit_code").isin(126, 127)))), F.lit(False)).alias("incomplete"),
    )
    e = engines.agg(F.coalesce(F.bool_and(~F.col("selected") | F.col("state").isin("completed", "cached")), F.lit(True)).alias("complete"), F.coalesce(F.bool_or(F.col("enabled") & ~F.col("selected")), F.lit(False)).alias("partial"))
    # Two tables of one row.
    rows = f.crossJoin(e)
    passed = F.col("total") == 0
    return rows.select(passed.alias("passed"), "incomplete", (passed & F.col("complete") & ~F.col("partial") & ~F.col("incomplete")).alias("accepted"), F.when(F.col("incomplete"), 2).when(~passed, 1).otherwise(0).alias("exit_code"))


LINES, CHARS, BYTES = 8, 240, 64 << 10


def excerpts(locations: DataFrame, sources: DataFrame, order: str = "seq") -> DataFrame:
    """(seq, file, first_line, lines, truncated): source lines of locations (seq, file, line, end_line), as far as they are in bounds.

    A location shows eight lines of 240 characters at most, control characters
    as escapes, and all locations together, in order, 64 KB; a location that
    begins beyond that shows nothing. Sizes are summed in ranges of the order, so
    no task sees all locations. One without a line shows the file's first.
    """
    rows = locations.join(sources.select(F.col("path").alias("file"), T.lines(F.col("text")).alias("all")), "file")
    n, start = F.size("all"), F.coalesce("line", F.lit(1))
    wanted = F.when(F.col("line").isNull(), n).otherwise(F.coalesce("end_line", F.col("line")))
    last = F.least(start + LINES - 1, n, wanted)
    rows = rows.where((n > 0) & (start > 0) & (start <= n) & (wanted >= start))
    rows = rows.select(order, "file", start.alias("first_line"), F.slice("all", start.cast("int"), (last - start + 1).cast("int")).alias("raw"), (wanted > last).alias("cut"))
    shown = F.transform("raw", lambda x: T.visible(x))
    rows = rows.withColumn("lines", F.transform(shown, lambda x: F.left(x, F.lit(CHARS)))).withColumn("cut", F.col("cut") | F.exists(shown, lambda x: F.length(x) > CHARS))
    size = F.aggregate(F.transform("lines", lambda x: F.octet_length(x)), F.lit(0), lambda a, x: a + x)
    rows = running(rows.withColumn("_size", size), order, "_size", "_before").where(F.col("_before") < BYTES)
    fits = F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("t"), F.aggregate(F.slice("lines", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + F.octet_length(y)).alias("to"))), lambda x: F.col("_before") + x["to"] <= BYTES)
    kept = F.transform(fits, lambda x: x["t"])
    return rows.select(order, "file", F.col("first_line").cast("long").alias("first_line"), kept.alias("lines"), (F.col("cut") | (F.size(kept) < F.size("lines"))).alias("truncated")).where(F.size("lines") > 0)


def captured(sources: DataFrame, stream: DataFrame) -> DataFrame:
    """Sources (path, ...) that a location of the rule stream names."""
    needed = stream.select(F.explode("locations").alias("l")).select(F.col("l.file").alias("path")).distinct()
    return sources.join(needed, "path", "left_semi")


def measurements(stream: DataFrame, findings: DataFrame) -> DataFrame:
    """(rule_id, file, line, actual, limit): the measured values of displayed rules, found again by rule, place and message."""
    at = F.get("locations", F.lit(0))
    shown = stream.select("rule_id", "message", at["file"].alias("file"), at["line"].alias("line")).distinct()
    f = findings.select(rule_id(F.col("category"), F.col("metric"), F.col("identity")).alias("_rule"), F.col("message").alias("_message"), F.col("file").alias("_file"), F.when(F.col("line") > 0, F.col("line")).alias("_line"), "category", "actual", "limit").where("actual is not null")
    line = F.when(F.col("category").isin("complexity", "suppression", "invariant", "clone", "specialist"), F.col("_line"))
    same = (F.col("rule_id") == F.col("_rule")) & F.col("file").eqNullSafe(F.col("_file")) & F.col("message").eqNullSafe(F.col("_message")) & F.col("line").eqNullSafe(line)
    return shown.join(f, same).select("rule_id", "file", "line", "actual", "limit")


def producer_failures(runs: DataFrame, coverage: bool, mutation: bool) -> DataFrame:
    """(step, target, message, blocking) of failed producers (name, kind, status, report, detail): one row for each enabled kind of evidence that the run was to give, both where it has no kind."""
    kinds = [k for k, on in (("coverage", coverage), ("mutation", mutation)) if on]
    rows = runs.where("status = 'failed'").withColumn("_kind", F.explode(F.array(*map(F.lit, kinds)).cast("array<string>")))
    said = F.concat(F.lit("producer configuration `"), "name", F.lit("` failed: "), F.coalesce("detail", F.lit("unknown execution failure")))
    return rows.where(F.col("kind").isNull() | (F.col("kind") == F.col("_kind"))).select(F.concat("_kind", F.lit("-report")).alias("step"), F.col("report").alias("target"), said.alias("message"), F.lit(True).alias("blocking"))
