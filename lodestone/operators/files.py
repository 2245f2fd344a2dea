"""File roles, budgets and severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Directory and file conventions of the roles.
VENDOR_DIRS = ("node_modules", "target", "dist", "build", "vendor", ".venv", "venv", "__pycache__")
LOCKFILES = ("pnpm-lock.yaml", "package-lock.json", "yarn.lock", "cargo.lock", "bun.lock", "bun.lockb")
SOURCE_EXTENSIONS = (
    "rs", "js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts", "py", "css", "mdx", "sql", "json",
    "jsonc", "graphql", "gql", "snap", "toml", "yaml", "yml", "lock", "lockb",
)
PARSED_EXTENSIONS = ("rs", "js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts", "py")
RETIRED_EXTENSIONS = ("go",)


def _in_dir(path: Column, *names: str) -> Column:
    return path.rlike("(^|/)(" + "|".join(n.replace(".", r"\.") for n in names) + ")/")


def _token(name: Column, *tokens: str) -> Column:
    """A part between two dots of the name equals a token."""
    parts = F.split(name, r"\.")
    return F.arrays_overlap(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), F.array(*map(F.lit, tokens)))


def role(path: Column) -> Column:
    """The role of a normalised path; the first convention that holds decides."""
    name, ext = T.name_of(path), T.extension_of(path)
    suffix = T.suffix_of(name)
    return (
        F.when(_in_dir(path, *VENDOR_DIRS), "vendor")
        .when(name.isin(*LOCKFILES), "generated")
        .when(_in_dir(path, "__generated__", "generated", "gen") | _token(name, "generated", "gen") | name.isin("database.types.ts", "schema.gen.ts"), "generated")
        .when(_in_dir(path, "__fixtures__", "fixtures", "__snapshots__", "snapshots") | _token(name, "fixture", "fixtures") | (suffix == "snap"), "fixture")
        .when(_in_dir(path, "tests", "test", "__tests__", "__mocks__", "mocks", "stories") | _token(name, "test", "spec", "stories", "mock") | name.rlike(r"^(tests|.*[_-]tests)\.rs$"), "test")
        .when(_in_dir(path, "migrations", "migration") | name.isin("seed.sql", "seed.ts") | name.rlike(r"\.(migration|seed)\.sql$"), "migration")
        .when(_in_dir(path, "config", "configs") | _token(name, "config") | (name.rlike(r"^\..+rc\.[^.]+$") & suffix.isin(*SOURCE_EXTENSIONS)) | suffix.isin("json", "jsonc", "toml", "yaml", "yml"), "config")
        .when(suffix == "mdx", "documentation")
        .when(ext.isin(*SOURCE_EXTENSIONS, *RETIRED_EXTENSIONS), "source")
        .otherwise("unknown")
    )


def classify(files: DataFrame, rules: list[tuple[str, str]] = (), path_col: str = "path") -> DataFrame:
    """Adds `role`: vendor directories, then the first custom (glob, role) that matches the path or what follows one of its slashes, then the conventions."""
    path = T.normal_path(F.col(path_col))
    parts = F.split(path, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    out = F.when(_in_dir(path, *VENDOR_DIRS), "vendor")
    for glob, kind in rules:
        pattern = T.glob_to_regex(glob.lower())
        out = out.when(F.exists(suffixes, lambda s: s.rlike(pattern)), kind)  # noqa: B023
    return files.withColumn("role", out.otherwise(role(path)))


def file_budgets(files: DataFrame, max_bytes: int, max_lines: dict[str, int], exclude: list[str] = (), path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, metric, actual, limit) of files above the byte budget or the line budget of their extension or `default`."""
    path = F.col(path_col)
    excluded = F.lit(False)
    for glob in exclude:
        excluded = excluded | path.rlike(T.glob_to_regex(glob))
    ext = T.extension_of(path)
    limits = F.create_map(*(F.lit(x) for pair in max_lines.items() for x in pair))
    limit = F.coalesce(F.try_element_at(limits, ext), F.try_element_at(limits, F.lit("default")))
    found = F.array(
        F.struct(F.lit("File Byte Size").alias("metric"), F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("actual"), F.lit(max_bytes).cast("long").alias("limit")),
        F.struct(F.concat(F.lit("Physical Lines (."), ext, F.lit(")")).alias("metric"), F.size(T.lines(F.col(text_col))).cast("long").alias("actual"), limit.cast("long").alias("limit")),
    )
    return files.where(~excluded).select(path.alias("path"), F.explode(found).alias("x")).select("path", "x.*").where("actual > limit")


def size_breakdown(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, lines, blank, filled) of each file."""
    all_lines = T.lines(F.col(text_col))
    rows = files.select(F.col(path_col).alias("path"), all_lines.alias("l"))
    blank = F.size(F.filter("l", lambda x: F.trim(F.translate(x, "\t\r", "  ")) == ""))
    return rows.select("path", F.size("l").cast("long").alias("lines"), blank.cast("long").alias("blank"), (F.size("l") - blank).cast("long").alias("filled"))


def route(findings: DataFrame, severities: dict[str, str], strict: bool, role_col: str = "role") -> DataFrame:
    """Adds `severity` and drops what is ignored; roles without a severity of their own are errors if strict, else warnings."""
    known = F.create_map(*(F.lit(x) for pair in severities.items() for x in pair))
    out = findings.withColumn("severity", F.coalesce(F.try_element_at(known, F.col(role_col)), F.lit("error" if strict else "warning")))
    return out.where("severity <> 'ignore'")
