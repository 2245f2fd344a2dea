"""Line rules: suppressions and architecture invariants."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Suppression instructions in order of precedence.
SUPPRESSIONS = (
    r"@ts-ignore",
    r"@ts-expect-error",
    r"@ts-nocheck",
    r"eslint-disable",
    r"eslint-next-line",
    r"oxlint-disable",
    r"biome-ignore",
    r"prettier-ignore",
    r"#\[allow\(",
    r"#\[expect\(",
    r"#\!\[allow\(",
    r"mutants::skip",
    r"coverage\(off\)",
    r"c8\s+ignore",
    r"istanbul\s+ignore",
    r"v8\s+ignore",
    r"istanbul\s+ignore\s+(next|if|else)",
    r"sonarlint-disable",
    r"nosonar",
    r"(?i)\bnoqa\b",
    r"(?i)pragma:\s*no\s*(cover|branch)",
    r"type:\s*ignore",
    r"(pylint|ruff):\s*(disable|noqa)",
)


def explode_lines(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line_no, line), line numbers from 1."""
    rows = files.select(F.col(path_col).alias("path"), F.posexplode(T.lines(F.col(text_col))).alias("n", "line"))
    return rows.select("path", (F.col("n") + 1).cast("long").alias("line_no"), "line")


def suppressions(files: DataFrame, tokens: tuple[str, ...] = (), patterns: tuple[str, ...] = SUPPRESSIONS, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line_no, token, line): for each line the first pattern, in order, whose first match stands in a comment or attribute.

    Literal tokens are tried, in order and by the same rules, if no pattern
    matches. A match inside a string never counts; an attribute counts at the
    start of a statement, and anything else that doesn't begin with # in a comment.
    """
    both = [*patterns, *(rf"\Q{t}\E" for t in tokens)]
    # One pass decides for nearly all lines; hits are judged pattern by pattern, up to the first that counts.
    rows = explode_lines(files, path_col, text_col).where(F.col("line").rlike("|".join(f"(?:{p})" for p in both))).withColumn("line", T.strip(F.col("line")))

    def judged(pattern: str):
        token = F.regexp_substr("line", F.lit(pattern))
        before = F.substring(F.col("line"), F.lit(1), F.regexp_instr("line", F.lit(pattern)) - 1)
        statement = (T.strip(before) == "") | T.strip(before).rlike(r"[;{}]$") | before.contains("//") | before.contains("#[")
        comment = before.rlike(r"//|/\*|#") | F.col("line").contains("/*") | before.rlike(r"^\s*\*") | F.col("line").rlike(r"^(//|\*)")
        fine = F.when(token.rlike(r"^#!?\["), statement).otherwise(~T.inside_string(before) & (token.startswith("#") | comment))
        return F.when(F.col("line").rlike(pattern), F.when(fine, token))

    return rows.withColumn("token", F.coalesce(*map(judged, both))).where("token is not null").select("path", "line_no", "token", "line")


@dataclass(frozen=True)
class Invariant:
    """Files that match `source` and not `exclude` may not import, call or name these."""

    name: str
    source: str
    exclude: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    calls: tuple[str, ...] = ()
    tokens: tuple[str, ...] = ()
    message: str = ""

    def covers(self, path: Column) -> Column:
        out = path.rlike(T.glob_to_regex(self.source))
        for glob in self.exclude:
            out = out & ~path.rlike(T.glob_to_regex(glob))
        return out


# What counts as an import; the group is what is imported.
_IMPORTS = (r"""(?:import|from)\s+['"]([^'"]+)['"]""", r"""(?:require|import)\s*\(\s*['"]([^'"]+)['"]\s*\)""", r"""\buse\s+([^;]+);""")


def import_candidates(name: Column) -> Column:
    """The spellings by which an import is matched: what braces or commas list, then the whole."""
    base = T.strip(F.regexp_replace(T.strip(name), ",+$", ""))
    head = T.strip(F.substring_index(base, "{", 1))
    inner = F.regexp_replace(F.regexp_extract(base, r"(?s)\{(.*)$", 1), r"\}+$", "")
    parts = F.filter(F.transform(F.split(inner, ","), lambda p: F.regexp_replace(T.strip(p), r"^[ '\"]+|[ '\"]+$", "")), lambda p: p != "")
    listed = F.filter(F.transform(F.split(base, ","), lambda p: T.strip(p)), lambda p: (p != "") & (p != base))
    more = F.when(base.contains("{"), F.transform(parts, lambda p: F.concat(head, p))).when(base.contains(","), listed).otherwise(F.array().cast("array<string>"))
    return F.when(base == "", F.array().cast("array<string>")).otherwise(F.concat(more, F.array(base)))


def as_path(name: Column) -> Column:
    """A module path with :: as a file path; no file is looked for."""
    bare = F.regexp_replace(T.strip(name), r"^(?:crate::)*(?:self::)*(?:super::)*", "")
    return F.translate(F.replace(bare, F.lit("::"), F.lit("/")), "{}* '\"", "")


def imports_of(line: Column) -> Column:
    """Imported names of a line, pattern after pattern; a match that begins inside a string is none."""
    def of(p: str) -> Column:
        names, whole, gaps = F.regexp_extract_all(line, F.lit(p), F.lit(1)), F.regexp_extract_all(line, F.lit(p), F.lit(0)), F.split(line, p, -1)
        earlier = lambda i: F.array_join(F.zip_with(F.slice(gaps, F.lit(1), i), F.slice(whole, F.lit(1), i), lambda x, y: F.concat(x, y)), "")
        each = F.transform(names, lambda n, i: F.when(~T.inside_string(F.concat(earlier(i), F.get(gaps, i))), T.strip(n)))
        return F.filter(each, lambda n: n.isNotNull() & (n != ""))

    return F.flatten(F.array(*map(of, _IMPORTS)))


def invariants(files: DataFrame, rules: list[Invariant], path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line_no, rule, kind, target) of each violation; kinds are import, call and token.

    Comments leave first, which a // or # inside a string doesn't begin. A call
    or token counts once a line, an import by the first of its spellings that is
    forbidden, as written or as a path.
    """
    rows = explode_lines(files, path_col, text_col)
    rows = rows.withColumn("code", T.strip(T.without_comment(F.col("line")))).where((F.col("code") != "") & ~F.col("code").rlike(r"^(//|#|/\*)"))
    quoted = lambda name: r"\b" + "".join("\\" + c if not c.isalnum() and c != "_" else c for c in name)
    hit = lambda kind, target: F.struct(F.lit(kind).alias("kind"), target.alias("target"))
    none = F.array().cast("array<struct<kind: string, target: string>>")
    out = None
    for r in rules:
        arrays = []
        if r.imports:
            forbidden = "|".join(f"(?:{T.glob_to_regex(g)})" for g in r.imports)
            bad = F.transform(imports_of(F.col("code")), lambda n: F.try_element_at(F.filter(import_candidates(n), lambda c: c.rlike(forbidden) | as_path(c).rlike(forbidden)), F.lit(1)))  # noqa: B023
            arrays.append(F.transform(F.filter(bad, lambda c: c.isNotNull()), lambda c: hit("import", c)))
        for kind, names, tail in (("call", r.calls, r"\s*\("), ("token", r.tokens, r"\b")):
            arrays += [F.when(F.col("code").rlike(quoted(n) + tail), F.array(hit(kind, F.lit(n)))).otherwise(none) for n in names]
        if not arrays:
            continue
        found = rows.where(r.covers(F.col("path"))).select("path", "line_no", F.lit(r.name).alias("rule"), F.explode(F.concat(*arrays)).alias("x")).select("path", "line_no", "rule", "x.*")
        out = found if out is None else out.unionByName(found)
    return rows.select("path", "line_no", F.lit("").alias("rule"), F.lit("").alias("kind"), F.lit("").alias("target")).where("false") if out is None else out


def _python_imports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, text in zip(pdf["path"], pdf["text"]):
            try:
                tree = ast.parse(text or "")
            except (SyntaxError, ValueError, RecursionError):
                continue
            for node in ast.walk(tree):
                if isinstance(node, ast.Import):
                    rows += [(path, node.lineno, a.name) for a in node.names]
                elif isinstance(node, ast.ImportFrom):
                    module = "." * node.level + (node.module or "")
                    rows.append((path, node.lineno, module))
                    rows += [(path, node.lineno, module + ("" if module.endswith(".") else ".") + a.name) for a in node.names if a.name != "*"]
        yield pd.DataFrame(rows, columns=["path", "line_no", "target"])


def python_imports(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line_no, target) of the modules and names that Python sources import, from the grammar: also in parentheses, with other names and relative."""
    rows = files.where(F.col(path_col).endswith(".py")).select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    return rows.mapInPandas(_python_imports, "path string, line_no long, target string")


def python_import_violations(files: DataFrame, rules: list[Invariant], path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line_no, rule, kind, target) of forbidden imports of Python sources."""
    rows = python_imports(files, path_col, text_col)
    out = rows.select("path", "line_no", F.lit("").alias("rule"), F.lit("import").alias("kind"), "target").where("false")
    for r in rules:
        if r.imports:
            forbidden = "|".join(f"(?:{T.glob_to_regex(g)})" for g in r.imports)
            out = out.union(rows.where(r.covers(F.col("path")) & F.col("target").rlike(forbidden)).select("path", "line_no", F.lit(r.name), F.lit("import"), "target"))
    return out
