"""Policies by file role: what applies to a file, how severe its findings are, and which limits hold."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .files import PARSED_EXTENSIONS, RETIRED_EXTENSIONS, SOURCE_EXTENSIONS

ROLES = ("source", "test", "generated", "fixture", "vendor", "migration", "config", "documentation", "unknown")
POLICY_ROLES = ("source", "test", "generated", "fixture", "migration")
# Roles to which each kind of analysis applies.
APPLIES = {
    "complexity": ("source", "test"),
    "clones": ("source", "test", "fixture"),
    "safety": ("source", "test", "fixture", "migration", "config"),
    "mutation": ("source",),
    "invariants": ("source", "test"),
}
FUNCTION_LIMITS = ("max_cyclomatic", "max_parameters", "max_function_lines", "max_statements", "max_nesting_depth")


@dataclass(frozen=True)
class RolePolicy:
    """What a role overrides; None leaves the gate's value."""

    severity: str | None = None
    file_size_severity: str | None = None
    function_size_severity: str | None = None
    max_bytes: int | None = None
    max_lines: int | None = None
    max_cyclomatic: int | None = None
    max_parameters: int | None = None
    max_function_lines: int | None = None
    max_statements: int | None = None
    max_nesting_depth: int | None = None
    clone_enabled: bool | None = None
    clone_severity: str | None = None
    clone_min_lines: int | None = None
    clone_min_tokens: int | None = None
    clone_block_min_lines: int | None = None
    clone_block_min_tokens: int | None = None
    mutation_target: bool | None = None


@dataclass(frozen=True)
class Policy:
    """A gate's values and its roles' overrides. Line limits are by extension, with "default" for the rest."""

    strict: bool = True
    enforce_roles: bool = True
    max_bytes: int | None = None
    max_lines: dict[str, int] = field(default_factory=dict)
    max_cyclomatic: int | None = None
    max_parameters: int | None = None
    max_function_lines: int | None = None
    max_statements: int | None = None
    max_nesting_depth: int | None = None
    clones: bool = True
    clone_min_lines: int = 5
    clone_min_tokens: int = 50
    suppressions: bool = True
    invariants: bool = True
    roles: dict[str, RolePolicy] = field(default_factory=dict)

    def of(self, role: str) -> RolePolicy:
        return self.roles.get(role, RolePolicy()) if role in POLICY_ROLES else RolePolicy()


def overridden(policy: Policy, **roles: dict) -> Policy:
    """The policy with further overrides of some roles; fields that aren't given stay."""
    return replace(policy, roles={r: replace(policy.of(r), **roles.get(r, {})) for r in POLICY_ROLES})


_KINDS = {"str | None": "string", "int | None": "long", "bool | None": "boolean"}


def dimension(spark: SparkSession, policy: Policy) -> DataFrame:
    """One row per role with what applies to it and the limits that hold; nine rows, so it may be sent to every executor."""
    rows = []
    for r in ROLES:
        p = policy.of(r)
        lines = {**policy.max_lines} if p.max_lines is None else {**dict.fromkeys(policy.max_lines, p.max_lines), "default": p.max_lines}
        enabled = policy.clones if p.clone_enabled is None else p.clone_enabled
        limits = [getattr(policy, n) if getattr(p, n) is None else getattr(p, n) for n in FUNCTION_LIMITS]
        rows.append((
            r, p.severity or ("error" if policy.strict else "warning"), p.file_size_severity, p.function_size_severity, p.clone_severity, p.clone_block_min_lines, p.clone_block_min_tokens, policy.max_bytes if p.max_bytes is None else p.max_bytes, lines, *limits,
            enabled and (r in APPLIES["clones"] or p.clone_enabled is True) and r in POLICY_ROLES, policy.clone_min_lines if p.clone_min_lines is None else p.clone_min_lines, policy.clone_min_tokens if p.clone_min_tokens is None else p.clone_min_tokens,
            r in APPLIES["complexity"], r in APPLIES["safety"], r in APPLIES["mutation"] and p.mutation_target is not False, r in APPLIES["invariants"],
        ))
    limits = ", ".join(f"{n} long" for n in FUNCTION_LIMITS)
    return spark.createDataFrame(
        rows, f"role string, severity string, file_size_severity string, function_size_severity string, clone_severity string, clone_block_min_lines long, clone_block_min_tokens long, max_bytes long, max_lines map<string,long>, {limits}, clones boolean, clone_min_lines long, clone_min_tokens long, complexity boolean, safety boolean, mutation boolean, invariants boolean"
    )


def with_role(rows: DataFrame, dim: DataFrame, *columns: str) -> DataFrame:
    return rows.join(F.broadcast(dim.select("role", *columns)), "role")


def applicable(files: DataFrame, dim: DataFrame) -> DataFrame:
    """(path, role, analysis) of every analysis that a file gets; complexity needs a parser."""
    rows = with_role(files, dim, "complexity", "clones", "safety", "mutation", "invariants")
    parsed = F.lower(T.extension_of(F.col("path"))).isin(*PARSED_EXTENSIONS)
    runs = {"complexity": F.col("complexity") & parsed, "clones": F.col("clones"), "safety": F.col("safety"), "mutation": F.col("mutation"), "invariants": F.col("invariants")}
    return rows.select("path", "role", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in runs.items())))).alias("analysis"))


def file_findings(files: DataFrame, dim: DataFrame) -> DataFrame:
    """(path, role, metric, actual, limit) of files (path, role, text) above the byte or line limits of their role; safety roles only."""
    rows = with_role(files, dim, "max_bytes", "max_lines", "safety").where("safety")
    ext = T.extension_of(F.col("path"))
    limit = F.coalesce(F.try_element_at("max_lines", ext), F.try_element_at("max_lines", F.lit("default")))
    found = F.array(
        F.struct(F.lit("File Byte Size").alias("metric"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("actual"), F.col("max_bytes").alias("limit")),
        F.struct(F.concat(F.lit("Physical Lines (."), ext, F.lit(")")).alias("metric"), F.size(T.lines(F.col("text"))).cast("long").alias("actual"), limit.alias("limit")),
    )
    return rows.select("path", "role", F.explode(found).alias("x")).select("path", "role", "x.*").where("actual > limit")


def function_findings(functions: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, role, metric, actual, limit) of functions (keys, role, cyclomatic, parameters, lines, statements, nesting) above their role's ceilings, metric by metric."""
    rows = with_role(functions, dim, *FUNCTION_LIMITS, "complexity").where("complexity")
    pairs = (("Cyclomatic Complexity", "cyclomatic", "max_cyclomatic"), ("Parameter Count", "parameters", "max_parameters"), ("Function Lines", "lines", "max_function_lines"), ("Nesting Depth", "nesting", "max_nesting_depth"), ("Statement Count", "statements", "max_statements"))
    found = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("actual"), F.col(limit).cast("double").alias("limit")) for m, c, limit in pairs))
    return rows.select(*keys, "role", F.explode(found).alias("x")).select(*keys, "role", "x.*").where("actual > limit")


def severity_of(category: Column, metric: Column, lines: Column, tokens: Column) -> Column:
    """The severity of a finding by category; columns of the dimension must be there. A clone below the blocking size is a warning where it would be an error."""
    clone = F.coalesce("clone_severity", "severity")
    small = F.coalesce(lines < F.col("clone_block_min_lines"), F.lit(False)) | F.coalesce(tokens < F.col("clone_block_min_tokens"), F.lit(False))
    return (
        F.when(category == "budget", F.coalesce("file_size_severity", "severity"))
        .when((category == "complexity") & metric.isin("Function Lines", "Statement Count"), F.coalesce("function_size_severity", "severity"))
        .when(category == "clone", F.when((clone == "error") & small, "warning").otherwise(clone))
        .otherwise(F.col("severity"))
    )


def routed(findings: DataFrame, dim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings (role, category, metric, lines, tokens, ...) as blocking ones and as advisories; ignored ones leave. Both keep all columns and get `severity`."""
    rows = with_role(findings, dim, "severity", "file_size_severity", "function_size_severity", "clone_severity", "clone_block_min_lines", "clone_block_min_tokens")
    level = severity_of(F.col("category"), F.col("metric"), F.col("lines"), F.col("tokens"))
    rows = rows.select(*findings.columns, level.alias("severity"))
    return rows.where("severity = 'error'"), rows.where("severity = 'warning'")


# The engine that a step's evidence belongs to.
STEP_ENGINES = {
    "clone-index": "clones", "read-clone-index": "clones",
    "coverage-report": "coverage", "coverage-diff": "coverage", "coverage-source-classification": "coverage",
    "mutation-report": "mutation_report", "mutation-scope": "mutation_report",
    "generated-freshness": "generated_freshness", "legacy-ratchet": "legacy_ratchet",
    "format_check": "format_check", "lint": "lint", "test": "tests", "typecheck": "typecheck",
}
STATIC_ENGINES = ("file_budgets", "suppressions", "complexity", "invariants", "clones")
#: What to do about missing evidence, by the engine that lacks it.
REMEDIES = {
    "coverage": "Produce coverage of the current source again and name the report in the policy.",
    "mutation_report": "Run the mutation tests on the current source again and name the report in the policy.",
    "legacy_ratchet": "Name a reference that exists and whose history is there.",
    "clones": "Make the files of the clone index readable and report capacity failures; don't leave source out.",
}
OTHER_REMEDY = "Make the source readable and valid before the gate is accepted."


def _mapped(pairs: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in pairs.items() for x in p)), key), F.lit(other))


def engine_of(step: Column) -> Column:
    return _mapped(STEP_ENGINES, step, "complexity")


def evidence_failures(failures: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Missing evidence (step, target, message, blocking) as blocking rows without an exit code, as advisories, and as observations (engine, state, reason).

    Source that can't be read or has no role leaves every static engine incomplete.
    """
    engine = engine_of(F.col("step"))
    rows = failures.where("blocking").select("step", F.col("target").alias("command"), F.lit(None).cast("int").alias("exit_code"), F.col("message").alias("output"), _mapped(REMEDIES, engine, OTHER_REMEDY).alias("recommendation"))
    said = failures.where(~F.col("blocking")).select(F.concat("step", F.lit(" for `"), "target", F.lit("`: "), "message").alias("advisory"))
    many = F.when(F.col("step").isin("read-source", "classify-source"), F.array(*map(F.lit, STATIC_ENGINES))).otherwise(F.array(engine))
    seen = failures.select(F.explode(many).alias("engine"), F.lit("incomplete").alias("state"), F.concat("step", F.lit(": "), "target", F.lit(": "), "message").alias("reason"))
    return rows, said, seen


def classification_gaps(files: DataFrame, policy: Policy, dim: DataFrame) -> DataFrame:
    """(path, step, outcome) of files (path, role) that an analysis can't cover; outcome is blocker, advisory, or ignored by the severity of the role.

    Retired source blocks, a file without a role does if roles are enforced, and
    source or migrations without a parser are told by the severity of their role,
    but inventoried source always as an advisory, and so are migrations that are
    ignored on purpose.
    """
    rows = with_role(files, dim, "severity")
    ext = F.lower(T.extension_of(F.col("path")))
    known, parsed = ext.isin(*SOURCE_EXTENSIONS), ext.isin(*PARSED_EXTENSIONS)
    retired = ext.isin(*RETIRED_EXTENSIONS) & F.col("role").isin("source", "test", "migration", "unknown")
    by_severity = F.when(F.col("severity") == "error", "blocker").when(F.col("severity") == "warning", "advisory").otherwise("ignored")
    gap = lambda step, outcome: F.struct(F.lit(step).alias("step"), outcome.alias("outcome"))
    x = (
        F.when(retired, gap("unsupported-source", F.lit("blocker")))
        .when((F.col("role") == "unknown") & F.lit(policy.enforce_roles), gap("classify-source", F.lit("blocker")))
        .when((F.col("role") == "source") & ~parsed & known, gap("inventory-source", F.lit("advisory")))
        .when((F.col("role") == "source") & ~parsed, gap("unsupported-source", by_severity))
        .when((F.col("role") == "migration") & ~parsed & known & (F.col("severity") == "ignore"), gap("unsupported-source", F.lit("advisory")))
        .when((F.col("role") == "migration") & ~parsed, gap("unsupported-source", by_severity))
    )
    return rows.select("path", "role", x.alias("x")).where("x is not null and x.outcome <> 'ignored'").select("path", "role", "x.step", "x.outcome")


def observations(files: DataFrame, policy: Policy, dim: DataFrame, run: str | None = None) -> DataFrame:
    """(engine, state) that the files (path, role) of a run complete, once each; of each run where the files name theirs."""
    rows = with_role(files, dim, "complexity", "safety", "invariants")
    parsed = F.lower(T.extension_of(F.col("path"))).isin(*PARSED_EXTENSIONS)
    ran = {"file_budgets": F.col("safety"), "suppressions": F.col("safety") & F.lit(policy.suppressions), "invariants": F.col("invariants") & F.lit(policy.invariants), "complexity": F.col("complexity") & parsed}
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in ran.items())))
    return rows.select(*([run] if run else []), F.explode(found).alias("engine")).distinct().withColumn("state", F.lit("completed"))


def advisories(counts: DataFrame) -> DataFrame:
    """(advisory) that the counts of a run (files, excluded, generated, diff, scoped) call for."""
    noun = F.when(F.col("excluded") == 1, "file").otherwise("files")
    empty = F.when(F.col("scoped"), "no matching source files detected for the given path(s).").when(F.col("diff"), "no git-modified source files detected to check.").otherwise("no matching source files detected.")
    said = F.array_compact(F.array(
        F.when(F.col("files") == 0, empty),
        F.when(F.col("excluded") > 0, F.concat_ws(" ", F.col("excluded").cast("string"), noun, F.lit("excluded from file budget checks by the policy."))),
        F.when(F.col("generated") > 0, F.concat(F.lit("Classified "), F.col("generated").cast("string"), F.lit(" generated file(s); inventoried without handwritten complexity or clone debt."))),
    ))
    keys = [c for c in counts.columns if c not in ("files", "excluded", "generated", "diff", "scoped")]
    return counts.select(*keys, F.explode(said).alias("advisory"))


KINDS = ("policy", "format", "lint", "tests", "typecheck")


def selects(chosen: list[str], kind: str) -> bool:
    """Whether a run does a kind of check; none chosen means all."""
    if bad := [c for c in chosen if c not in KINDS]:
        raise ValueError(f"unknown checks: {bad}")
    return not chosen or kind in chosen


def scope_advisory(chosen: list[str]) -> str:
    left = [k for k in KINDS if not selects(chosen, k)]
    return f"Partial check: omitted {', '.join(left)}. This doesn't establish complete acceptance." if left else "All configured requirements were requested; see the states of the engines."


def field_names() -> list[str]:
    return [f.name for f in fields(RolePolicy)]
