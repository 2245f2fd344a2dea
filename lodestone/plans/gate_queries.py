"""Queries of policies, rules, code, coverage, evidence and ratchets over projections of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clones, code, coverage, evidence, files, ratchet, roles, rules, structure
from ..operators.report import FINDING
from ..sources import policy
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


# Roles -------------------------------------------------------------------

_POLICY = policy.as_policy(policy.load("[gate]\npreset = 'balanced'\nenforce_classified_sources = true\n[budgets.files]\nmax_bytes = 2000\n[budgets.files.max_lines]\nts = 12\n[roles.test]\nmax_lines = 5\nmax_parameters = 3\n[roles.fixture]\nseverity = 'ignore'\n"))
_ROLE = "CASE doc_id % 9 WHEN 0 THEN 'source' WHEN 1 THEN 'test' WHEN 2 THEN 'generated' WHEN 3 THEN 'fixture' WHEN 4 THEN 'vendor' WHEN 5 THEN 'migration' WHEN 6 THEN 'config' WHEN 7 THEN 'documentation' ELSE 'unknown' END"
_EXT = "CASE doc_id % 5 WHEN 0 THEN 'ts' WHEN 1 THEN 'sql' WHEN 2 THEN 'go' WHEN 3 THEN 'py' ELSE 'txt' END"
_DOCS = {"path": f"'f' || doc_id || '.' || {_EXT}", "role": _ROLE, "text": "text", "doc_id": "doc_id"}
_DOCS_SQL = sql("documents", {**_DOCS, "ext": _EXT})


@query(
    "role_applicability",
    f"""SELECT path, role, unnest(CASE role WHEN 'source' THEN CASE WHEN ext IN ('ts', 'py') THEN ['complexity', 'clones', 'safety', 'mutation', 'invariants'] ELSE ['clones', 'safety', 'mutation', 'invariants'] END WHEN 'test' THEN CASE WHEN ext IN ('ts', 'py') THEN ['complexity', 'clones', 'safety', 'invariants'] ELSE ['clones', 'safety', 'invariants'] END
    WHEN 'fixture' THEN ['clones', 'safety'] WHEN 'migration' THEN ['safety'] WHEN 'config' THEN ['safety'] ELSE [] END) AS analysis FROM {_DOCS_SQL}""",
)
def role_applicability(spark, d):
    return roles.applicable(projected(spark, d, "documents", _DOCS), roles.dimension(spark, _POLICY))


_LINES = r"CASE WHEN coalesce(text, '') = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '\n\z', ''), '\r?\n') END"
_SAFE = "('source', 'test', 'fixture', 'migration', 'config')"


@query(
    "role_file_budgets",
    f"""WITH f AS (SELECT path, role, ext, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS b, CAST(len({_LINES}) AS BIGINT) AS n, CAST(CASE WHEN role = 'test' THEN 5 WHEN ext = 'ts' THEN 12 ELSE 500 END AS BIGINT) AS m FROM {_DOCS_SQL} WHERE role IN {_SAFE})
    SELECT path, role, 'File Byte Size' AS metric, b AS actual, CAST(2000 AS BIGINT) AS max_allowed FROM f WHERE b > 2000 UNION ALL SELECT path, role, 'Physical Lines (.' || ext || ')', n, m FROM f WHERE n > m""",
)
def role_file_budgets(spark, d):
    return roles.file_findings(projected(spark, d, "documents", _DOCS), roles.dimension(spark, _POLICY)).withColumnRenamed("limit", "max_allowed")


_FN = {"fn": "l_orderkey * 10 + l_linenumber", "role": "CASE l_linenumber % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'test' ELSE 'config' END", "cyclomatic": "CAST(l_quantity AS BIGINT)", "parameters": "l_linenumber", "lines": "CAST(l_quantity AS BIGINT) * 4", "statements": "CAST(l_quantity AS BIGINT) * 2", "nesting": "l_suppkey % 9"}


@query(
    "role_function_budgets",
    f"WITH f AS {sql('lineitem', _FN)}, u AS (SELECT fn, role, unnest(['Cyclomatic Complexity', 'Parameter Count', 'Function Lines', 'Nesting Depth', 'Statement Count']) AS metric, unnest([cyclomatic, parameters, lines, nesting, statements]) AS a, unnest([15, CASE role WHEN 'test' THEN 3 ELSE 6 END, 120, 6, 50]) AS m FROM f WHERE role IN ('source', 'test')) SELECT fn, role, metric, CAST(a AS DOUBLE) AS actual, CAST(m AS DOUBLE) AS max_allowed FROM u WHERE a > m",
)
def role_function_budgets(spark, d):
    return roles.function_findings(projected(spark, d, "lineitem", _FN), roles.dimension(spark, _POLICY), ["fn"]).withColumnRenamed("limit", "max_allowed")


_FOUND = {
    "id": "event_id", "role": _ROLE.replace("doc_id", "event_id"), "category": "CASE event_id % 4 WHEN 0 THEN 'budget' WHEN 1 THEN 'complexity' WHEN 2 THEN 'clone' ELSE 'invariant' END",
    "metric": "CASE WHEN event_id % 8 = 1 THEN 'Function Lines' ELSE 'Parameter Count' END", "lines": "event_id % 40", "tokens": "event_id % 400",
}


@query(
    "severity_by_category",
    f"""WITH f AS {sql('events', _FOUND)}, s AS (SELECT *, CASE WHEN role = 'generated' OR role = 'fixture' THEN 'ignore' WHEN role = 'test' AND (category IN ('budget', 'clone') OR (category = 'complexity' AND metric = 'Function Lines')) THEN 'warning' WHEN role = 'source' AND category = 'clone' AND (lines < 15 OR tokens < 150) THEN 'warning' ELSE 'error' END AS severity FROM f)
    SELECT role, category, severity, count(*) AS n FROM s WHERE severity <> 'ignore' GROUP BY 1, 2, 3""",
)
def severity_by_category(spark, d):
    blocking, advice = roles.routed(projected(spark, d, "events", _FOUND), roles.dimension(spark, _POLICY))
    return blocking.union(advice).groupBy("role", "category", "severity").agg(F.count("*").alias("n"))


@query(
    "classification_gaps",
    f"""SELECT * FROM (SELECT path, role, CASE WHEN ext = 'go' AND role IN ('source', 'test', 'migration', 'unknown') THEN 'unsupported-source' WHEN role = 'unknown' THEN 'classify-source' WHEN role = 'source' AND ext = 'sql' THEN 'inventory-source' WHEN role IN ('source', 'migration') AND ext NOT IN ('ts', 'py') THEN 'unsupported-source' END AS step,
    CASE WHEN ext = 'go' OR role = 'unknown' THEN 'blocker' WHEN role = 'source' AND ext = 'sql' THEN 'advisory' ELSE 'blocker' END AS outcome FROM {_DOCS_SQL}) WHERE step IS NOT NULL""",
)
def classification_gaps(spark, d):
    return roles.classification_gaps(projected(spark, d, "documents", _DOCS), _POLICY, roles.dimension(spark, _POLICY))


@query(
    "role_observations",
    f"""SELECT DISTINCT run, unnest(CASE WHEN role IN ('source', 'test') AND ext IN ('ts', 'py') THEN ['file_budgets', 'suppressions', 'invariants', 'complexity'] WHEN role IN ('source', 'test') THEN ['file_budgets', 'suppressions', 'invariants'] WHEN role IN {_SAFE} THEN ['file_budgets', 'suppressions'] ELSE [] END) AS engine, 'completed' AS state
    FROM (SELECT *, doc_id % 45 AS run FROM {_DOCS_SQL})""",
)
def role_observations(spark, d):
    """What 45 runs over parts of the documents complete."""
    files = projected(spark, d, "documents", _DOCS).withColumn("run", F.col("doc_id") % 45)
    return roles.observations(files, _POLICY, roles.dimension(spark, _POLICY), "run")


_STEP = "CASE event_id % 5 WHEN 0 THEN 'coverage-diff' WHEN 1 THEN 'read-source' WHEN 2 THEN 'lint' WHEN 3 THEN 'mutation-scope' ELSE 'other' END"
_FAILED = {"step": _STEP, "target": "'t' || user_id", "message": "event_type", "blocking": "event_id % 2 = 0"}


@query(
    "evidence_failures",
    f"""WITH f AS {sql('events', _FAILED)}, o AS (SELECT unnest(CASE step WHEN 'coverage-diff' THEN ['coverage'] WHEN 'read-source' THEN ['file_budgets', 'suppressions', 'complexity', 'invariants', 'clones'] WHEN 'lint' THEN ['lint'] WHEN 'mutation-scope' THEN ['mutation_report'] ELSE ['complexity'] END) AS engine, step FROM f)
    SELECT 'observed ' || engine AS what, count(*) AS n FROM o GROUP BY 1 UNION ALL SELECT 'blocking ' || step, count(*) FROM f WHERE blocking GROUP BY 1 UNION ALL SELECT 'advisory ' || step || ' for', count(*) FROM f WHERE NOT blocking GROUP BY step""",
)
def evidence_failures(spark, d):
    rows, said, seen = roles.evidence_failures(projected(spark, d, "events", _FAILED))
    what = seen.select(F.concat(F.lit("observed "), "engine").alias("what")).union(rows.where("exit_code is null and length(recommendation) > 0").select(F.concat(F.lit("blocking "), "step"))).union(said.select(F.concat(F.lit("advisory "), F.substring_index("advisory", " `", 1))))
    return what.groupBy("what").agg(F.count("*").alias("n"))


_RUN = {"run": "o_orderkey", "files": "o_orderkey % 3", "excluded": "o_orderkey % 4", "generated": "o_orderkey % 2", "diff": "o_orderkey % 5 = 0", "scoped": "o_orderkey % 7 = 0"}


@query(
    "run_advisories",
    f"""WITH r AS {sql('orders', _RUN)} SELECT run, CASE WHEN scoped THEN 'no matching source files detected for the given path(s).' WHEN diff THEN 'no git-modified source files detected to check.' ELSE 'no matching source files detected.' END AS advisory FROM r WHERE files = 0
    UNION ALL SELECT run, excluded || CASE WHEN excluded = 1 THEN ' file' ELSE ' files' END || ' excluded from file budget checks by the policy.' FROM r WHERE excluded > 0 UNION ALL SELECT run, 'Classified 1 generated file(s); inventoried without handwritten complexity or clone debt.' FROM r WHERE generated = 1""",
)
def run_advisories(spark, d):
    return roles.advisories(projected(spark, d, "orders", _RUN))


@query("role_extensions", "SELECT name, role, count(*) AS n FROM (SELECT (['.toml', 'a/.json', '.eslintrc.txt', '.eslintrc.js', 'a.go', 'x.snap', '.mdx', 'b/.snap'])[page_id % 8 + 1] AS name, (['config', 'config', 'unknown', 'config', 'source', 'fixture', 'documentation', 'fixture'])[page_id % 8 + 1] AS role FROM pages) GROUP BY 1, 2")
def role_extensions(spark, d):
    names = (".toml", "a/.json", ".eslintrc.txt", ".eslintrc.js", "a.go", "x.snap", ".mdx", "b/.snap")
    p = table(spark, d, "pages").select(F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % 8 + 1).cast("int")).alias("name"))
    return files.classify(p, path_col="name").groupBy("name", "role").agg(F.count("*").alias("n"))


_PRESET_ROWS = "(VALUES ('strict-agent', 'source', 32768, 5, 50), ('strict-agent', 'test', 32768, 8, 80), ('balanced', 'source', 65536, 8, 80), ('balanced', 'test', 65536, 12, 120), ('legacy-migration', 'config', 65536, 8, 80), ('strict-agent', 'config', 32768, 5, 50)) t(preset, role, max_bytes, clone_min_lines, clone_min_tokens)"


@query(
    "preset_limits",
    f"""WITH f AS (SELECT role, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS b, len({_LINES}) AS n, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM {_DOCS_SQL})
    SELECT preset, role, count(*) AS files, count(*) FILTER (b > max_bytes) AS large, count(*) FILTER (n >= clone_min_lines AND w >= clone_min_tokens) AS searched FROM f JOIN {_PRESET_ROWS} USING (role) GROUP BY 1, 2""",
)
def preset_limits(spark, d):
    """How many documents of a role each preset finds too large, and long enough to hold a clone."""
    out = None
    for name in policy.PRESETS[:3]:
        dim = roles.dimension(spark, policy.as_policy(policy.validated(policy.preset(name)))).withColumn("preset", F.lit(name))
        out = dim if out is None else out.unionByName(dim)
    kept = out.where("role in ('source', 'test') and preset <> 'legacy-migration' or role = 'config' and preset <> 'balanced'")
    f = projected(spark, d, "documents", _DOCS).select("role", F.octet_length(F.coalesce("text", F.lit(""))).alias("b"), F.size(T.lines(F.col("text"))).alias("n"), F.size(clones.word_tokens(F.col("text"))).alias("w"))
    return f.join(F.broadcast(kept), "role").groupBy("preset", "role").agg(F.count("*").alias("files"), F.count_if(F.expr("b > max_bytes")).alias("large"), F.count_if(F.expr("n >= clone_min_lines and w >= clone_min_tokens")).alias("searched"))


# Rules and code ----------------------------------------------------------


@query("forbidden_tokens", r"SELECT doc_id AS path, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '\n\z', ''), '\r?\n')) AS line FROM documents WHERE text <> '') WHERE contains(line, 'tion') GROUP BY 1")
def forbidden_tokens(spark, d):
    marked = F.regexp_replace("text", r"(?m)^(?=.*tion)", "// TODO-X ")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.regexp_replace(F.translate(marked, "'\"\\#*", ""), r"@ts-ignore|noqa", "").alias("text"))
    return rules.suppressions(docs, tokens=("TODO-X",)).groupBy("path").agg(F.count("*").alias("n"))


_TOKENS = (
    "@ts-ignore", "@ts-expect-error", "@ts-nocheck", "eslint-disable", "eslint-next-line", "oxlint-disable", "biome-ignore", "prettier-ignore", "#[allow(", "#[expect(", "#![allow(", "mutants::skip", "coverage(off)", "c8 ignore", "istanbul ignore",
    "v8 ignore", "istanbul ignore next", "sonarlint-disable", "nosonar", "NoQA", "pragma: no cover", "type: ignore", "pylint: disable",
)


@query(
    "suppression_patterns",
    "WITH t AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in _TOKENS) + "]) AS token, unnest(range(23)) AS i), r AS (SELECT CASE i WHEN 16 THEN 'istanbul ignore' ELSE token END AS token, i, p_partkey, p_partkey % 4 AS c FROM t, part) SELECT token, c, count(*) AS n FROM r WHERE CASE c WHEN 0 THEN i NOT IN (8, 9, 10) OR true WHEN 1 THEN i IN (8, 9, 10) WHEN 2 THEN i IN (8, 9, 10) ELSE i IN (8, 9, 10) OR true END GROUP BY 1, 2",
)
def suppression_patterns(spark, d):
    """Every pattern behind a comment mark, as a whole line, in a string, and behind code and a comment mark."""
    line = lambda t: F.element_at(F.array(F.lit(f"// {t} x"), F.lit(f"{t} x"), F.lit(f'x = "// {t}"'), F.lit(f"a(); // {t}")), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.concat_ws("\n", *map(line, _TOKENS)).alias("text"))
    return rules.suppressions(rows).select("token", (F.col("path") % 4).alias("c")).groupBy("token", "c").agg(F.count("*").alias("n"))


_IMPORTING = (
    ('import x from "db/pool"', "db/pool"), ("use crate::db::{pool, other::x};", "crate::db::pool"), ("const a = require('db/x'); // no", "db/x"), ('let s = "use crate::db::pool;"', None), ("// import y from 'db/pool'", None),
    ("use self::db::pool;", "self::db::pool"), ("import('ui/a')", None), ("use std::fmt;", None), ("call(' // '); import z from 'db/q'", "db/q"),
)


@query("invariant_imports", "SELECT p_partkey % 9 AS kind, CAST(p_partkey AS VARCHAR) || '.ts' AS path, ([" + ", ".join("NULL" if t is None else f"'{t}'" for _, t in _IMPORTING) + "])[p_partkey % 9 + 1] AS target FROM part WHERE p_partkey % 9 NOT IN (3, 4, 6, 7)")
def invariant_imports(spark, d):
    text = F.element_at(F.array(*(F.lit(x) for x, _ in _IMPORTING)), (F.col("p_partkey") % 9 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"), text.alias("text"))
    found = rules.invariants(rows, [rules.Invariant("layers", "**", imports=("db/*",))])
    return found.select((F.substring_index("path", ".", 1).cast("long") % 9).alias("kind"), "path", "target")


@query("import_candidates", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a::b|a::c|a::{b, c}' WHEN 1 THEN 'x|y|x, y' ELSE 'm/' || p_partkey END AS names, CASE p_partkey % 3 WHEN 0 THEN 'a/b, c' WHEN 1 THEN 'x,y' ELSE 'm/' || p_partkey END AS as_path FROM part")
def import_candidates(spark, d):
    name = F.element_at(F.array(F.lit("a::{b, c}"), F.lit("x, y"), F.concat(F.lit("m/"), F.col("p_partkey").cast("string"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    path = F.when(F.col("p_partkey") % 3 == 0, F.lit("crate::a::b, c")).otherwise(name)
    shown = F.when(F.col("p_partkey") % 3 == 0, F.replace(rules.as_path(path), F.lit(","), F.lit(", "))).otherwise(rules.as_path(path))
    return table(spark, d, "part").select("p_partkey", F.array_join(rules.import_candidates(name), "|").alias("names"), shown.alias("as_path"))


@query("python_imports", "SELECT 'm' || p_partkey || '.py' AS path, unnest([1, 2, 2, 2, 3]::BIGINT[]) AS line_no, unnest(['os.path' || p_partkey, '.b', '.b.c', '.b.e', '..x']) AS target FROM part")
def python_imports(spark, d):
    k = F.col("p_partkey").cast("string")
    rows = table(spark, d, "part").select(F.concat(F.lit("m"), k, F.lit(".py")).alias("path"), F.concat(F.lit("import os.path"), k, F.lit(" as p\nfrom .b import (c as q, e)\ntext = 'import z'\n")).alias("text"))
    found = rules.python_imports(rows)
    more = rules.python_imports(rows.withColumn("text", F.lit("\n\nfrom .. import x\n"))).where("target = '..x'")
    return found.union(more)


@query("python_import_rule", "SELECT 'm' || p_partkey || '.py' AS path, CAST(1 AS BIGINT) AS line_no, 'r' AS rule, 'import' AS kind, 'db.pool' || p_partkey AS target FROM part WHERE p_partkey % 2 = 0")
def python_import_rule(spark, d):
    k = F.col("p_partkey").cast("string")
    rows = table(spark, d, "part").select(F.concat(F.lit("m"), k, F.lit(".py")).alias("path"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "from db import pool").otherwise("import ui"), k).alias("text"))
    return rules.python_import_violations(rows, [rules.Invariant("r", "m*.py", imports=("db.*",))])


_COMMENTED = (
    ("a(); // b", "a(); "), ('x("//"); y', 'x("//"); y'), ("foo();// t", "foo();"), ("# all", ""), ("a # b", "a "), ("a#b", "a#b"), ("#[attr] x", "#[attr] x"), ("`//` + 1 // z", "`//` + 1 "), ("'it\\'s // in' // out", "'it\\'s // in' "), ("a / b", "a / b"),
)


@query("comments_cut", "SELECT p_partkey, ([" + ", ".join("'" + b.replace("'", "''") + "'" for _, b in _COMMENTED) + f"])[p_partkey % {len(_COMMENTED)} + 1] AS code FROM part")
def comments_cut(spark, d):
    line = F.element_at(F.array(*(F.lit(a) for a, _ in _COMMENTED)), (F.col("p_partkey") % len(_COMMENTED) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.without_comment(line).alias("code"))


_CODE = "/* a\n/* b */ c\n*/ let x = 1; // y\n}\n\n  // z\n'a\nb'\n# h\n#[attr]\nr#\"s\n\"# ;\n(),;\ncall()"
_CODE_LINES = (3, 7, 8, 10, 11, 12, 14)


@query("code_lines", "SELECT p_partkey AS path, CAST(unnest(" + str(list(_CODE_LINES)) + ") AS BIGINT) AS line FROM part UNION ALL SELECT p_partkey, 15 FROM part WHERE p_partkey % 2 = 0")
def code_lines(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.concat(F.lit(_CODE), F.when(F.col("p_partkey") % 2 == 0, "\nmore").otherwise("\n--- sql")).alias("text"))
    return code.code_lines(rows.withColumn("path", F.col("path").cast("string"))).select(F.col("path").cast("long").alias("path"), "line")


_TYPED = (
    ("a.css", ".x{}", True), ("a.ts", "// c\nexport interface A { x: number }\ntype B = string | number;\n", True), ("b.ts", "import type { A } from './a'\nexport type { A }\ndeclare const q: number\n", True), ("c.ts", "interface A { x: 1 }\nconst y = 2\n", False),
    ("d.tsx", "export type X =\n  | 'a'\n  | 'b'\n", True), ("e.py", "x = 1", False), ("f.ts", "interface {", False), ("g.js", "", False), ("h.ts", "", True),
)


@query("not_executable", "SELECT p_partkey, ([" + ", ".join(str(r).lower() for _, _, r in _TYPED) + f"])[p_partkey % {len(_TYPED)} + 1] AS not_executable FROM part")
def not_executable(spark, d):
    pick = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in _TYPED)), (F.col("p_partkey") % len(_TYPED) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", code.not_executable(pick(0), pick(1)).alias("not_executable"))


@query("shell_words", "SELECT p_partkey, ['run', p_name, '--brand=' || string_split(p_brand, ' ')[1]] || string_split(p_brand, ' ')[2:] || ['it''s', p_type, '', 'x ' || p_size] AS words FROM part")
def shell_words(spark, d):
    q, k = F.lit("'"), lambda c: F.col(c).cast("string")
    command = F.concat(F.lit('run "'), "p_name", F.lit('" --brand='), "p_brand", F.lit(" it\\'s "), q, "p_type", q, F.lit(" '' x\\ "), k("p_size"))
    return table(spark, d, "part").select("p_partkey", code.shell_words(command).alias("words"))


_CFG = {"k": "p_partkey", "predicate": """CASE p_partkey % 8 WHEN 0 THEN 'all(test, feature = "' || p_name || '")' WHEN 1 THEN 'any(test, target_os = "' || p_type || '")' WHEN 2 THEN 'not(any(not(test), feature = "' || p_brand || '"))' WHEN 3 THEN 'all(not(test), unix, size_' || p_size || ')'
    WHEN 4 THEN 'any(all(test, s' || p_size || '), test)' WHEN 5 THEN 'size_' || p_size WHEN 6 THEN 'all(test, any(a' || p_size || ', not(test)' ELSE 'all(any(test), not(not(all(test, b::c' || p_size || '))))' END"""}


@query("cfg_predicates", f"SELECT k, k % 8 IN (0, 2, 4, 7) AS test_only FROM {sql('part', _CFG)}")
def cfg_predicates(spark, d):
    return projected(spark, d, "part", _CFG).select("k", code.requires_test(F.col("predicate")).alias("test_only"))


_OFFSETS = {"doc_id": "doc_id", "text": "text", "n": "doc_id % 7 + 1", "c": "n_chars % 70 + 1"}


@query(
    "span_offsets",
    f"""WITH x AS (SELECT *, string_split(text, chr(10)) AS l FROM {sql('documents', _OFFSETS)})
    SELECT doc_id, CASE WHEN n <= len(l) AND length(replace(l[n], chr(13), '')) >= c - 1 THEN CAST(coalesce(list_sum(list_transform(l[1:n - 1], lambda t: octet_length(encode(t)) + 1)), 0) AS BIGINT) + octet_length(encode(substr(l[n], 1, c - 1))) END AS at FROM x""",
)
def span_offsets(spark, d):
    """A place in each document, in some beyond its lines."""
    x = projected(spark, d, "documents", _OFFSETS)
    return x.select("doc_id", code.byte_offset(F.col("text"), F.col("n"), F.col("c")).alias("at"))


@query("branch_words", "SELECT kind, words, count(*) AS n FROM (SELECT (['if_statement', 'match_arm', 'elif_clause', '&&', 'call_expression'])[p_partkey % 5 + 1] AS kind, (['conditional branch (`if`)', 'pattern match arm (`match`)', 'branching construct', 'boolean operator `&&`', NULL])[p_partkey % 5 + 1] AS words FROM part) GROUP BY 1, 2")
def branch_words(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("if_statement", "match_arm", "elif_clause", "&&", "call_expression"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(kind.alias("kind"), code.branch_words(kind).alias("words")).groupBy("kind", "words").agg(F.count("*").alias("n"))


# Globs and paths of columns: a folder and a name of one part against a pattern of the same.
_GLOBBED = {"k": "p_partkey", "path": "'src/d' || p_size % 9 || '/' || p_name || '.ts'", "pattern": "CASE p_partkey % 4 WHEN 0 THEN 'src/**/*' || p_size % 10 || '.ts' WHEN 1 THEN 'src/d?/*.t[!x' || p_size || ']' WHEN 2 THEN '**/d' || p_partkey % 9 || '/*' ELSE 'src/d[0-' || p_size % 5 || ']/**' END", "size": "p_size", "name": "p_name"}


@query(
    "glob_matches",
    f"SELECT k, pattern, CASE k % 4 WHEN 0 THEN name LIKE '%' || size % 10 WHEN 1 THEN true WHEN 2 THEN size % 9 = k % 9 ELSE size % 9 <= size % 5 END AS hit FROM {sql('part', _GLOBBED)}",
)
def glob_matches(spark, d):
    x = projected(spark, d, "part", _GLOBBED)
    return x.select("k", "pattern", F.regexp_like("path", F.concat(F.lit("^"), T.glob_pattern(F.col("pattern")), F.lit("$"))).alias("hit"))


_MESSY = {"k": "p_partkey", "path": "CASE p_partkey % 6 WHEN 0 THEN '/r/src/./' || p_name || '.ts' WHEN 1 THEN 'd' || p_size || '/../../' || p_name WHEN 2 THEN './b' || p_size || '//' || p_name WHEN 3 THEN '/other/' || p_name WHEN 4 THEN p_size || '/../' || p_name || '/b.ts' ELSE '../' || p_name END", "name": "p_name", "size": "p_size"}


@query(
    "paths_normalised",
    f"""SELECT k, CASE k % 6 WHEN 0 THEN 'src/' || name || '.ts' WHEN 2 THEN 'b' || size || '/' || name WHEN 4 THEN name || '/b.ts' END AS in_repository,
    CASE k % 6 WHEN 0 THEN '/r/src/' || name || '.ts' WHEN 2 THEN 'b' || size || '/' || name WHEN 3 THEN '/other/' || name WHEN 4 THEN name || '/b.ts' ELSE name END AS in_report FROM {sql('part', _MESSY)}""",
)
def paths_normalised(spark, d):
    p = projected(spark, d, "part", _MESSY)
    return p.select("k", coverage.repository_key(F.col("path"), "/r").alias("in_repository"), T.record_key(F.col("path")).alias("in_report"))


_PYTHON = "@d\ndef choose(a, /, b=1, *args, flag=True, **kw):\n    if a and b:\n        return 1\n    elif b:\n        return 2\n    else:\n        if a:\n            pass\n    try:\n        x = [i for i in kw if i if b]\n    except E:\n        pass\n\nclass A:\n    def inner{k}(self):\n        return lambda q: q if q else 0\n"


@query("python_functions", "SELECT 'p' || p_partkey || '.py' AS path, CASE i WHEN 0 THEN 'choose' WHEN 1 THEN 'inner' || p_partkey ELSE 'lambda' END AS name, CAST([2, 16, 17][i + 1] AS BIGINT) AS start_line, CAST([5, 1, 1][i + 1] AS BIGINT) AS parameters, CAST([9, 1, 2][i + 1] AS BIGINT) AS cyclomatic, CAST([2, 0, 1][i + 1] AS BIGINT) AS nesting, CAST([9, 2, 0][i + 1] AS BIGINT) AS statements FROM part, range(3) t(i)")
def python_functions(spark, d):
    k = F.col("p_partkey").cast("string")
    rows = table(spark, d, "part").select(F.concat(F.lit("p"), k, F.lit(".py")).alias("path"), F.replace(F.lit(_PYTHON), F.lit("{k}"), k).alias("text"))
    return structure.python_functions(rows).select("path", "name", "start_line", "parameters", "cyclomatic", "nesting", "statements")


@query("python_syntax_errors", "SELECT p_partkey, CAST(2 AS BIGINT) AS error_line FROM part")
def python_syntax_errors(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit("x = 1\ndef "), F.col("p_partkey").cast("string"), F.lit("(\n")).alias("text"))
    return structure.python_functions(rows).select(F.col("path").cast("long").alias("p_partkey"), "error_line")


_RUST = r'''pub(crate) async fn choose<T: A<B>>(a: &'a str, (b, c): (i32, Map<K, V>), f: fn(i32) -> i32) -> Option<T> where T: X {
    let x = if a && b || c { 1 } else if d { 2 } else { 3 };
    // if comment
    match x {
        1 | 2 if y && z => return None,
        _ => { for i in 0..3 { if i == '{' as i32 { continue; } } }
    }
    let s = r#"if "quoted" {"#;
    fn inner(q: u8) { loop { break; } }
    items.iter().filter(|x| x.a || x.b).map(|&x| x).collect()
}
trait T { fn sig(&self); fn dflt(&self, a: u8,) -> u8 { a } }
'''
_SCRIPT = r'''export async function load(a, { b, c } = {}, ...rest) {
  if (a && b) { return 1 } else if (c) { x() } else { if (d) y() }
  for (let i = 0; i < 3; i++) { console.log(`t ${a ? `${b}` : c} {`) }
  for (const k of rest) z(k)
  try { w() } catch (e) { throw e } finally { v() }
  switch (a) { case 1: f(); break; default: g() }
  const h = (q?: number): string => q ? 'a' : /[/}]/.test(q)
  const o = { m(x) { return x || 1 }, n: function () { } }
  return h
}
class A extends B { static async go(p: T = {}): Promise<void> { await p ?? 1 } get v() { return 1 } field = x => x * 2 }
type F = (a: number) => void
const one = async x => { await x }
'''


@query(
    "source_functions",
    "WITH r(name, start_line, parameters, cyclomatic, nesting, statements) AS (VALUES ('choose', 1, 3, 12, 4, 6), ('inner', 9, 1, 2, 1, 2), ('dflt', 12, 2, 1, 0, 0)), "
    "t(name, start_line, parameters, cyclomatic, nesting, statements) AS (VALUES ('load', 1, 3, 10, 2, 23), ('h', 7, 1, 2, 1, 0), ('m', 8, 1, 2, 0, 2), ('anonymous', 8, 0, 1, 0, 0), ('go', 11, 1, 1, 0, 2), ('v', 11, 0, 1, 0, 2), ('anonymous', 11, 1, 1, 0, 0), ('one', 13, 1, 1, 0, 1)) "
    "SELECT path, name, CAST(start_line AS BIGINT) AS start_line, CAST(parameters AS BIGINT) AS parameters, CAST(cyclomatic AS BIGINT) AS cyclomatic, CAST(nesting AS BIGINT) AS nesting, CAST(statements AS BIGINT) AS statements, error FROM ("
    "SELECT 'p' || p_partkey || '.rs' AS path, r.*, NULL AS error FROM part, r WHERE p_partkey % 3 = 0 UNION ALL SELECT 'p' || p_partkey || '.TS', t.*, NULL FROM part, t WHERE p_partkey % 3 = 1 UNION ALL SELECT 'p' || p_partkey || '.js', NULL, NULL, NULL, NULL, NULL, NULL, 'bracket without an end' FROM part WHERE p_partkey % 3 = 2)",
)
def source_functions(spark, d):
    n = F.col("p_partkey") % 3
    path = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.when(n == 0, ".rs").when(n == 1, ".TS").otherwise(".js"))
    text = F.when(n == 0, _RUST).when(n == 1, _SCRIPT).otherwise("function f( {")
    rows = table(spark, d, "part").select(path.alias("path"), text.alias("text"))
    return structure.functions(rows).select("path", "name", "start_line", "parameters", "cyclomatic", "nesting", "statements", "error")


# Clones ------------------------------------------------------------------

_SOURCE = 'import { a } from "x"\nuse std::{\n  fmt,\n};\n// c\nlet v{k} = "s" + 3.5e2; // t\ntype A = string |\n  number;\nimport("y")\n#[attr]\nfn f() { g(`q`) }\n'
_STREAM = "let v{k} = _STR_ + _LIT_ ; import ( _STR_ ) fn f ( ) { g ( _STR_ ) }"


@query("clone_code_tokens", f"SELECT 'f' || p_partkey AS stream, replace('{_STREAM}', '{{k}}', CAST(p_partkey AS VARCHAR)) AS tokens, CAST(11 AS BIGINT) AS last FROM part")
def clone_code_tokens(spark, d):
    k = F.col("p_partkey").cast("string")
    rows = table(spark, d, "part").select(F.concat(F.lit("f"), k).alias("path"), F.replace(F.lit(_SOURCE), F.lit("{k}"), k).alias("text"))
    return clones.code_streams(rows).select("stream", F.array_join("tokens", " ").alias("tokens"), F.array_max("lines").alias("last"))


def _streams(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("stream"), clones.word_tokens(F.col("text")).alias("tokens"), F.expr(_ROLE).alias("role"))


def _span_sql(k: int, where: str, extra: str = "") -> str:
    return rf"""t AS (SELECT doc_id AS stream{extra}, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE {where}),
    win AS (SELECT stream{extra and ', role'}, i - 1 AS i, md5(array_to_string(list_slice(w, i, i + {k} - 1), chr(31))) AS h FROM t, LATERAL (SELECT unnest(range(1, len(w) - {k} + 2)) AS i) WHERE len(w) >= {k}),
    m AS (SELECT {extra and 'a.role, '}a.stream AS a, a.i AS ai, b.stream AS b, b.i AS bi FROM win a JOIN win b USING (h{extra and ', role'}) WHERE a.stream < b.stream OR (a.stream = b.stream AND b.i >= a.i + {k})),
    g AS (SELECT *, bi - ai AS diagonal, ai - row_number() OVER (PARTITION BY a, b, bi - ai ORDER BY ai) AS island FROM m),
    spans AS (SELECT {extra and 'role, '}a, b, min(ai) AS a_start, min(bi) AS b_start, max(ai) - min(ai) + {k} AS tokens FROM g GROUP BY a, b, diagonal, island{extra and ', role'})"""


@query("clone_roles", f"WITH {_span_sql(60, _ROLE + chr(32) + 'IN (' + chr(39) + 'source' + chr(39) + ')')}, {_span_sql(90, _ROLE + chr(32) + 'IN (' + chr(39) + 'test' + chr(39) + ')').replace('t AS', 't2 AS', 1).replace('FROM t,', 'FROM t2,').replace('win AS', 'win2 AS').replace('win a', 'win2 a').replace('win b', 'win2 b').replace('m AS', 'm2 AS', 1).replace('FROM m)', 'FROM m2)').replace('g AS', 'g2 AS', 1).replace('FROM g ', 'FROM g2 ').replace('spans AS', 'spans2 AS')} SELECT 'source' AS role, * FROM spans UNION ALL SELECT 'test', * FROM spans2")
def clone_roles(spark, d):
    own = policy.as_policy(policy.load("[clones]\nenabled = true\n[roles.source]\nclone_min_tokens = 60\n[roles.test]\nclone_min_tokens = 90\n[roles.fixture]\nclone_enabled = false\n"))
    return clones.by_role(_streams(spark, d), roles.dimension(spark, own))


@query("clone_touching", f"WITH {_span_sql(50, 'true')} SELECT * FROM spans WHERE a % 7 = 0 OR b % 7 = 0")
def clone_touching(spark, d):
    found = clones.spans(clones.windows(_streams(spark, d).select("stream", "tokens"), 50), 50)
    return clones.touching(found, table(spark, d, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("path")))


@query("clone_capacity", rf"WITH w AS (SELECT regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), n AS (SELECT count(*) AS n FROM (SELECT list_slice(w, i, i + 2) AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i) WHERE len(w) >= 3) GROUP BY g) SELECT * FROM (SELECT 'clone-index' AS step, CASE WHEN max(n) > 8 THEN 'more than 8 windows of one hash' END AS message FROM n UNION ALL SELECT 'clone-index', CASE WHEN sum(n * (n - 1) / 2) > 100 THEN 'more than 100 matches' END FROM n) WHERE message IS NOT NULL")
def clone_capacity(spark, d):
    return clones.capacity_failures(clones.windows(_streams(spark, d), 3), 8, 100)


@query("clone_input_order", "SELECT path, row_number() OVER (ORDER BY NOT changed, f, n) - 1 AS rank FROM (SELECT 'd' || doc_id % 10 || '/' || doc_id AS path, 'd' || doc_id % 10 AS f, CAST(doc_id AS VARCHAR) AS n, doc_id % 4 = 0 AS changed FROM documents)")
def clone_input_order(spark, d):
    rows = table(spark, d, "documents").select(F.expr("'d' || doc_id % 10 || '/' || doc_id").alias("path"), (F.col("doc_id") % 4 == 0).alias("changed"))
    return clones.input_order(rows).select("path", "rank")


# Coverage ----------------------------------------------------------------

_REC = {"file": "CASE WHEN l_partkey % 4 = 0 THEN './p/' || l_partkey || '.ts' ELSE '/r/p/' || l_partkey || '.ts' END", "k": "l_partkey", "n": "l_linenumber", "q": "l_quantity"}


def _records(spark, d):
    rows = projected(spark, d, "lineitem", _REC).groupBy("file").agg(F.count("*").alias("lines_found"), F.count_if(F.col("q") > 25).alias("lines_hit"))
    zero = F.lit(0).cast("long")
    rows = rows.select("file", "lines_found", "lines_hit", *(zero.alias(c) for c in ("functions_found", "functions_hit", "branches_found", "branches_hit")))
    # Every seventh part is in the report under two spellings.
    return rows.union(rows.where(F.col("file").rlike(r"/\d*7\.ts$")).withColumn("file", F.concat(F.lit("p/../"), F.regexp_extract("file", r"(p/\d+\.ts)$", 1))))


# No line item has a part of every fifth file, whose number is beyond all parts; every eleventh lies outside of the repository.
_PART_FILE = {"k": "CASE WHEN p_partkey % 5 = 0 THEN p_partkey + 900000000 ELSE p_partkey END", "out": "p_partkey % 11 = 0", "critical": "p_partkey % 40 IN (3, 7, 15)"}


def _part_files(spark, d):
    return projected(spark, d, "part", _PART_FILE).withColumn("file", F.concat(F.lit("p/"), F.col("k").cast("string"), F.lit(".ts")))


def _inventory(spark, d):
    return _part_files(spark, d).select(F.when(F.col("out"), "../out.ts").otherwise(F.col("file")).alias("file"))


_HAS = "(SELECT DISTINCT l_partkey AS k FROM lineitem)"
_SOURCES = f"SELECT 'p/' || p.k || '.ts' AS source, CASE WHEN h.k IS NULL THEN 'absent' WHEN p.k % 10 = 7 THEN 'ambiguous' END AS reason FROM {sql('part', _PART_FILE)} p LEFT JOIN {_HAS} h ON h.k = p.k WHERE NOT out UNION ALL SELECT '../out.ts', 'outside'"


@query("coverage_source_records", _SOURCES)
def coverage_source_records(spark, d):
    return coverage.source_records(_inventory(spark, d), _records(spark, d), "/r").select("source", "reason")


@query(
    "coverage_evaluated",
    f"""WITH s AS ({_SOURCES}), r AS (SELECT l_partkey AS k, count(*) AS f, count(*) FILTER (l_quantity > 25) AS h FROM lineitem GROUP BY 1), t AS (SELECT sum(h) * 100.0 / sum(f) AS pct FROM r JOIN s ON s.source = 'p/' || k || '.ts' WHERE reason IS NULL),
    c AS (SELECT k FROM {sql('part', _PART_FILE)} WHERE critical)
    SELECT source AS file, 'Missing Source Coverage' AS metric, CAST(0 AS DOUBLE) AS actual, CAST(99 AS DOUBLE) AS floor_value FROM s WHERE reason IS NOT NULL UNION ALL SELECT 'workspace', 'Global Line Coverage', round(pct, 6), 99 FROM t WHERE pct < 99
    UNION ALL SELECT 'p/' || c.k || '.ts', CASE WHEN r.k IS NULL OR c.k % 10 = 7 THEN 'Missing Critical Path' ELSE 'Critical Path 100% Coverage' END, CASE WHEN r.k IS NULL OR c.k % 10 = 7 THEN 0 ELSE round(h * 100.0 / f, 6) END, 100 FROM c LEFT JOIN r ON r.k = c.k WHERE r.k IS NULL OR c.k % 10 = 7 OR h < f""",
)
def coverage_evaluated(spark, d):
    critical = _part_files(spark, d).where("critical").select("file")
    out = coverage.evaluated(_records(spark, d), _inventory(spark, d), critical, "/r", line=99.0)
    return out.select("file", "metric", F.round("actual", 6).alias("actual"), F.col("limit").alias("floor_value"))


@query("coverage_overflow", "SELECT 'Coverage Count Overflow' AS metric, CAST(0 AS DOUBLE) AS actual, CAST(0 AS DOUBLE) AS floor_value")
def coverage_overflow(spark, d):
    big = table(spark, d, "part").select(F.lit((1 << 62) + 5).alias("lines_found"), *(F.lit(1).cast("long").alias(c) for c in ("lines_hit", "functions_found", "functions_hit", "branches_found", "branches_hit")))
    return coverage.floor_findings(coverage.all_totals(big), 90.0, 90.0, 90.0).withColumnRenamed("limit", "floor_value")


@query("coverage_unmeasured_functions", f"SELECT 'p/' || p.k || '.ts' AS file FROM {sql('part', _PART_FILE)} p LEFT JOIN {_HAS} h ON h.k = p.k WHERE h.k IS NULL OR p.k % 10 = 7")
def coverage_unmeasured_functions(spark, d):
    f = _part_files(spark, d).select("file")
    return coverage.functions_without_records(f.union(f), _records(spark, d), "/r")


@query("coverage_compatible", "SELECT 'src/p/' || p_partkey || '.ts' AS changed, CASE WHEN p_partkey % 2 = 0 THEN 'p/' || p_partkey || '.ts' ELSE '/w/src/p/' || p_partkey || '.ts' END AS file FROM part WHERE p_partkey % 3 > 0")
def coverage_compatible(spark, d):
    k = F.col("p_partkey").cast("string")
    p = table(spark, d, "part")
    records = p.select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("p/"), k, F.lit(".ts"))).otherwise(F.concat(F.lit("/w/src/p/"), k, F.lit(".ts"))).alias("file")).union(p.where("p_partkey % 3 = 0").select(F.concat(F.lit("./src/p/"), k, F.lit(".ts"))))
    return coverage.compatible_record(p.select(F.concat(F.lit("src/p/"), k, F.lit(".ts")).alias("file")), records)


@query("coverage_changed_code", "SELECT 'f' || p_partkey || '.ts' AS file, CAST(unnest([3, 8, 99]) AS BIGINT) AS line FROM part WHERE p_partkey % 3 = 0")
def coverage_changed_code(spark, d):
    p = table(spark, d, "part")
    path = F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 1, ".sql").otherwise(".ts"))
    role = F.when(F.col("p_partkey") % 3 == 2, "test").otherwise("source")
    changes = p.select(path.alias("file"), F.explode(F.array(*(F.lit(x).cast("long") for x in (2, 3, 4, 6, 8, 99)))).alias("line"))
    return coverage.changed_code(changes, p.select(path.alias("path"), role.alias("role"), F.lit(_CODE).alias("text")))


@query("coverage_sources", "SELECT 'f' || p_partkey || (['.rs', '.ts', '.css', '.py'])[p_partkey % 4 + 1] AS path FROM part WHERE p_partkey % 5 > 0 AND (p_partkey % 4 IN (1, 3) OR (p_partkey % 4 = 0 AND p_partkey % 8 = 0))")
def coverage_sources(spark, d):
    p = table(spark, d, "part")
    path = F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.element_at(F.array(*map(F.lit, (".rs", ".ts", ".css", ".py"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    rows = p.select(path.alias("path"), F.when(F.col("p_partkey") % 5 == 0, "test").otherwise("source").alias("role"), F.lit("const x = 1").alias("text"))
    functions = p.where("p_partkey % 4 = 0").select(path.alias("file"), (F.col("p_partkey") % 8 > 0).alias("test_only"))
    return coverage.coverage_sources(rows, functions)


# Evidence ----------------------------------------------------------------


@query("partition_sources", "SELECT (['rust', 'web', 'web'])[p_partkey % 3 + 1] AS partition, (['core/', 'web/', 'web/'])[p_partkey % 3 + 1] || p_partkey || (['.rs', '.ts', '.py'])[p_partkey % 3 + 1] AS path, p_partkey % 3 < 2 AS supported FROM part")
def partition_sources(spark, d):
    k, n = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 3 + 1).cast("int")
    path = F.concat(F.element_at(F.array(*map(F.lit, ("core/", "web/", "web/"))), n), k, F.element_at(F.array(*map(F.lit, (".rs", ".ts", ".py"))), n))
    rows = table(spark, d, "part").select(path.alias("path"), F.lit("source").alias("role"), F.lit("x = 1").alias("text"))
    inventory = evidence.source_inventory(rows, rows.select(F.col("path").alias("file"), F.lit(False).alias("test_only")))
    return evidence.partition_sources(inventory, {"rust": ("cargo-llvm-cov", ["core/**"]), "web": ("vitest", ["web/**"])})


@query(
    "plan_differences",
    "SELECT problem, count(*) AS n FROM (SELECT CASE l_linenumber WHEN 1 THEN 'left out' WHEN 2 THEN 'added' WHEN 3 THEN 'reported twice' END AS problem FROM lineitem UNION ALL SELECT 'source differs' FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT DISTINCT 'unplanned file' FROM lineitem WHERE l_linenumber = 2) WHERE problem IS NOT NULL GROUP BY 1",
)
def plan_differences(spark, d):
    li = table(spark, d, "lineitem")
    f, i = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    planned = li.where("l_linenumber <> 2").select(f.alias("file"), i.alias("id"))
    reported = li.where("l_linenumber > 2").select(f.alias("file"), i.alias("id")).union(li.where("l_linenumber = 2").select(F.lit("elsewhere"), i)).union(li.where("l_linenumber = 3").select(f, i))
    p = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file"), F.col("p_partkey").alias("k"))
    sources = p.select("file", F.lit("s").alias("sha256"))
    return evidence.plan_differences(planned, reported, sources, p.select("file", F.when(F.col("k") % 4 > 0, "s").otherwise("t").alias("sha256"))).groupBy("problem").agg(F.count("*").alias("n"))


@query("mutation_scope", "SELECT 'f' || p_partkey || CASE WHEN p_partkey % 5 = 1 THEN '.sql' ELSE '.ts' END AS file, CASE WHEN p_partkey % 5 = 0 THEN 'outside the inputs' ELSE 'outside the source scope' END AS problem FROM part WHERE p_partkey % 5 IN (0, 1, 2)")
def mutation_scope(spark, d):
    p = table(spark, d, "part")
    path = F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 5 == 1, ".sql").otherwise(".ts"))
    known = p.select(path.alias("path"), F.when(F.col("p_partkey") % 5 == 2, "test").otherwise("source").alias("role"))
    return evidence.mutation_scope(known.select(F.col("path").alias("file")), p.where("p_partkey % 5 > 0").select(path.alias("file")), known, roles.dimension(spark, _POLICY))


_SPAN = {"file": "l_suppkey", "start": "l_partkey * 10", "stop": "l_partkey * 10 + l_linenumber"}
_RANGE = {"file": "ps % 100 + 1", "start": "ps * 25", "stop": "ps * 25 + 12"}


@query("test_spans", f"WITH s AS {sql('lineitem', _SPAN)}, r AS (SELECT s_suppkey % 100 + 1 AS file, s_suppkey * 25 AS start, s_suppkey * 25 + 12 AS stop FROM supplier) SELECT s.*, s.file % 7 = 0 OR EXISTS (SELECT 1 FROM r WHERE r.file = s.file AND r.start < s.stop AND s.start < r.stop) AS test FROM s")
def test_spans(spark, d):
    s = table(spark, d, "supplier")
    ranges = s.select((F.col("s_suppkey") % 100 + 1).alias("file"), (F.col("s_suppkey") * 25).alias("start"), (F.col("s_suppkey") * 25 + 12).alias("stop"))
    tests = s.where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("path"), F.lit("test").alias("role"))
    return evidence.test_spans(projected(spark, d, "lineitem", _SPAN), tests, ranges)


# Disjoint test ranges of documents: at most one in each 200 bytes.
_TESTED = {"file": "l_partkey % 300", "cell": "l_orderkey % 20", "start": "l_orderkey % 20 * 200 + l_linenumber * 7", "stop": "l_orderkey % 20 * 200 + l_linenumber * 7 + l_suppkey % 130", "keep": "l_suppkey % 7 = 3"}


@query(
    "line_roles",
    f"""WITH r AS (SELECT file, cell, start AS a, stop AS b FROM {sql('lineitem', _TESTED)} WHERE keep AND start < stop QUALIFY row_number() OVER (PARTITION BY file, cell ORDER BY start, stop) = 1),
    l AS (SELECT doc_id AS file, unnest(string_split(coalesce(text, ''), chr(10))) AS t, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line FROM documents),
    p AS (SELECT *, coalesce(sum(octet_length(encode(t)) + 1) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, octet_length(encode(t)) AS n FROM l),
    c AS (SELECT p.file, line, sum(least(s + n, b) - greatest(s, a)) AS covered FROM p JOIN r ON p.file = r.file AND a < s + n AND b > s GROUP BY 1, 2)
    SELECT p.file, p.line, CASE WHEN covered IS NULL THEN false WHEN covered >= n THEN true END AS test FROM p LEFT JOIN c ON c.file = p.file AND c.line = p.line""",
)
def line_roles(spark, d):
    r = projected(spark, d, "lineitem", _TESTED).where("keep and start < stop").groupBy("file", "cell").agg(F.min(F.struct("start", "stop")).alias("r")).select("file", "r.start", "r.stop")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "t"))
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    lines = texts.withColumn("start", F.coalesce(F.sum(F.octet_length("t") + 1).over(before), F.lit(0)))
    return evidence.line_roles(lines.select("file", (F.col("n") + 1).cast("long").alias("line"), "start", (F.col("start") + F.octet_length("t")).alias("stop")), r)


@query("ownership_roles", "SELECT p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN 'config' WHEN p_partkey % 4 = 2 AND p_partkey % 5 > 0 THEN 'test' ELSE 'source' END AS role FROM part")
def ownership_roles(spark, d):
    p = table(spark, d, "part")
    known = p.select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 3 == 0, "config").otherwise("source").alias("role"))
    return evidence.ownership(known, p.select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 4).alias("mask")), p.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("path")))


_CHECKED = {"receipt": "o_orderkey", "kind": "CASE WHEN o_orderkey % 2 = 0 THEN 'mutation' ELSE 'coverage' END", "exit_code": "CASE o_orderkey % 5 WHEN 0 THEN 2 ELSE 0 END", "cleaned": "o_orderkey % 7 > 0", "schema": "CASE o_orderkey % 11 WHEN 0 THEN 1 ELSE 2 END", "runtime": "CASE o_orderkey % 13 WHEN 0 THEN 'x' ELSE 'y' END"}


@query("receipts", f"WITH r AS {sql('orders', _CHECKED)}, p AS (SELECT receipt, CASE WHEN NOT cleaned THEN 'cleanup' WHEN exit_code = 2 AND kind = 'coverage' THEN 'exit_code' WHEN schema = 1 THEN 'schema' END AS problem, runtime FROM r) SELECT receipt, problem, problem IS NULL AND runtime = 'y' AS reusable FROM p")
def receipts(spark, d):
    r = projected(spark, d, "orders", _CHECKED)
    for c in ("root", "command", "report_sha256", "inputs_sha256", "partition"):
        r = r.withColumn(c, F.lit("v")).withColumn(f"wanted_{c}", F.lit("v"))
    r = r.withColumn("wanted_schema", F.lit(2)).withColumn("wanted_kind", F.col("kind")).withColumnRenamed("runtime", "runtime_sha256").withColumn("wanted_runtime_sha256", F.lit("y"))
    good = evidence.reusable(r).withColumn("reusable", F.lit(True))
    return r.select("receipt").join(evidence.receipt_problems(r), "receipt", "left").join(good, "receipt", "left").select("receipt", "problem", F.coalesce("reusable", F.lit(False)).alias("reusable"))


# Ratchets ----------------------------------------------------------------

_KIND = "CASE l_linenumber % 5 WHEN 0 THEN 'budget' WHEN 1 THEN 'suppression' WHEN 2 THEN 'complexity' WHEN 3 THEN 'invariant' ELSE 'clone' END"
_DEBT = {
    "ord": "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 20000000 + CAST(round(l_extendedprice * 100) AS BIGINT)", "category": _KIND, "file": "'f' || l_suppkey", "line": "l_linenumber * 3", "end_line": "l_linenumber * 3 + 2", "file_b": "CASE WHEN l_linenumber % 5 = 4 THEN 'g' || l_suppkey % 3 WHEN l_linenumber % 5 = 3 THEN 'x' END",
    "line_b": "CASE WHEN l_linenumber % 5 = 4 THEN 50 END", "end_line_b": "CASE WHEN l_linenumber % 5 = 4 THEN 52 END", "metric": "'m'", "identity": "l_returnflag", "actual": "CAST(l_quantity AS DOUBLE)", "content": "'  a   b'", "half": "l_orderkey % 2",
}


#: The order of `ord` without its product, which leaves 64 bits at order 576,461, in SQL too; for queries that don't return it.
_PARTED = "struct(l_orderkey * 8 + l_linenumber AS line, l_partkey AS part, CAST(round(l_extendedprice * 100) AS BIGINT) AS price)"


#: `ord` in 38 digits, which hold it for all orders, parts and prices of 64 bits that its product is made for.
_LONG = "((CAST(l_orderkey AS DECIMAL(38, 0)) * 8 + l_linenumber) * 100000 + l_partkey) * 20000000 + CAST(round(l_extendedprice * 100) AS BIGINT)"


def _ord(spark, d) -> str:
    """`ord` as a number of 64 bits where all of the table are, as in SQL, and of 38 digits where one isn't, for which SQL has no result."""
    rows = table(spark, d, "lineitem").selectExpr(f"CAST({_LONG} AS DECIMAL(38, 0)) AS n").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    least, most = rows.first()
    fits = most is None or (least >= -(1 << 63) and most < 1 << 63)
    return _DEBT["ord"] if fits else f"CAST({_LONG} AS DECIMAL(38, 0))"


def _debt(spark, d, order: str | None = None):
    rows = projected(spark, d, "lineitem", _DEBT | {"ord": order or _ord(spark, d)})
    more = {n: t for n, t in (x.split(" ", 1) for x in FINDING.split(", ")) if n not in _DEBT}
    rows = rows.withColumns({n: F.lit(None).cast(t) for n, t in more.items()})
    return rows.where("half = 1").drop("half"), rows.where("half = 0").drop("half")


# Changed files come from suppliers, changed lines from orders and customers, renames from suppliers: f4 was f5, which was f6, and so on in tens.
_CHANGED_FILES = ("supplier", {"file": "'f' || s_suppkey", "keep": "s_suppkey % 11 = 1"})
_CHANGED_LINES = (
    ("orders", {"file": "'f' || o_custkey % 97", "line": "o_orderkey % 23", "keep": "o_orderkey % 5 = 3 AND o_custkey % 97 % 3 > 0"}),
    ("customer", {"file": "'g' || c_custkey % 3", "line": "40 + c_custkey % 12", "keep": "c_custkey % 6 = 1"}),
)
_RENAMES = ("supplier", {"new": "'f' || s_suppkey", "old": "'f' || (s_suppkey + 1)", "keep": "s_suppkey % 10 IN (4, 5)"})


def _changes(spark, d):
    kept = lambda t: projected(spark, d, *t).where("keep").drop("keep")
    lines = kept(_CHANGED_LINES[0]).union(kept(_CHANGED_LINES[1]))
    return kept(_CHANGED_FILES), lines, kept(_RENAMES)


_CHANGES_SQL = f"""cl AS (SELECT DISTINCT file, line FROM (SELECT file, line FROM {sql(*_CHANGED_LINES[0])} WHERE keep UNION ALL SELECT file, line FROM {sql(*_CHANGED_LINES[1])} WHERE keep)),
    alone AS (SELECT file FROM {sql(*_CHANGED_FILES)} WHERE keep), cf AS (SELECT file FROM alone UNION SELECT file FROM cl),
    d AS (SELECT *, CASE l_suppkey % 10 WHEN 4 THEN 'f' || (l_suppkey + 2) WHEN 5 THEN 'f' || (l_suppkey + 1) ELSE file END AS now FROM {sql('lineitem', {**_DEBT, 'l_suppkey': 'l_suppkey'})}),
    x AS (SELECT *, CASE category WHEN 'budget' THEN file IN (FROM cf) WHEN 'complexity' THEN EXISTS (FROM cl WHERE cl.file = d.file AND cl.line BETWEEN d.line AND greatest(d.line, d.end_line))
    WHEN 'clone' THEN EXISTS (FROM cl WHERE cl.file = d.file AND cl.line BETWEEN d.line AND d.end_line) OR EXISTS (FROM cl WHERE cl.file = d.file_b AND cl.line BETWEEN d.line_b AND d.end_line_b)
    ELSE EXISTS (FROM cl WHERE cl.file = d.file AND cl.line = d.line) END AS touched FROM d)"""


@query("attribution_touched", f"WITH {_CHANGES_SQL} SELECT ord, touched FROM x WHERE half = 1")
def attribution_touched(spark, d):
    cur, _ = _debt(spark, d)
    files, lines, _ = _changes(spark, d)
    return ratchet.touched(cur, files, lines).select("ord", "touched")


@query(
    "ratchet_counted",
    f"""WITH {_CHANGES_SQL}, c AS (SELECT ord, category, row_number() OVER (PARTITION BY category, CASE category WHEN 'clone' THEN least(now, file_b) ELSE now END, CASE category WHEN 'suppression' THEN NULL WHEN 'clone' THEN greatest(now, file_b) ELSE file_b END, identity ORDER BY ord) AS r, now, file_b, identity FROM x WHERE half = 1 AND NOT touched AND category IN ('suppression', 'invariant', 'clone')),
    b AS (SELECT category, file AS now, file_b, identity, count(*) AS had FROM x WHERE half = 0 GROUP BY ALL) SELECT ord, r <= coalesce(had, 0) AS grandfathered FROM c LEFT JOIN b ON c.category = b.category AND c.now = b.now AND c.identity = b.identity AND (c.file_b IS NOT DISTINCT FROM b.file_b)""",
)
def ratchet_counted(spark, d):
    cur, base = (x.where("category in ('suppression', 'invariant', 'clone')") for x in _debt(spark, d))
    return ratchet.apply(cur, base, *_changes(spark, d)).where("not touched").select("ord", "grandfathered")


#: Each finding in order takes the first of the values that are left, ascending, that isn't below its own.
_PARK = """list_reduce(cars, lambda acc, x: {'spots': CASE WHEN len(list_filter(acc.spots, lambda s: s < x.v)) < len(acc.spots) THEN list_concat(acc.spots[:len(list_filter(acc.spots, lambda s: s < x.v))], acc.spots[len(list_filter(acc.spots, lambda s: s < x.v)) + 2:]) ELSE acc.spots END,
 'done': list_append(acc.done, {'ord': x.ord, 'had': acc.spots[len(list_filter(acc.spots, lambda s: s < x.v)) + 1]})}, {'spots': spots, 'done': CAST([] AS STRUCT(ord BIGINT, had DOUBLE)[])})"""


@query(
    "ratchet_valued",
    f"""WITH {_CHANGES_SQL}, k AS (SELECT *, CASE category WHEN 'budget' THEN 'm' ELSE identity || 'm' END AS what FROM x WHERE category IN ('budget', 'complexity')),
    cars AS (SELECT category, now AS file, what, list({{'ord': ord, 'v': actual}} ORDER BY ord) AS cars FROM k WHERE half = 1 AND NOT touched GROUP BY ALL),
    spots AS (SELECT category, file, what, list(actual ORDER BY actual) AS spots FROM k WHERE half = 0 GROUP BY ALL),
    parked AS (SELECT unnest({_PARK}.done) AS p FROM cars JOIN spots USING (category, file, what)),
    had AS (SELECT p.ord AS ord, p.had IS NOT NULL AS had FROM parked)
    SELECT k.ord, touched, coalesce(had, false) AS grandfathered FROM k LEFT JOIN had ON k.ord = had.ord WHERE half = 1""",
)
def ratchet_valued(spark, d):
    """Budgets and functions, several of one key: who gets which value depends on the order."""
    cur, base = (x.where("category in ('budget', 'complexity')") for x in _debt(spark, d))
    return ratchet.apply(cur, base, *_changes(spark, d)).select("ord", "touched", "grandfathered")


@query(
    "ratchet_summary",
    f"""WITH {_CHANGES_SQL}, c AS (SELECT category, row_number() OVER (PARTITION BY category, CASE category WHEN 'clone' THEN least(now, file_b) ELSE now END, CASE category WHEN 'suppression' THEN NULL WHEN 'clone' THEN greatest(now, file_b) ELSE file_b END, identity ORDER BY ord) AS r, now, file_b, identity FROM x WHERE half = 1 AND NOT touched AND category IN ('suppression', 'invariant', 'clone')),
    b AS (SELECT category, file AS now, file_b, identity, count(*) AS had FROM x WHERE half = 0 GROUP BY ALL), g AS (SELECT count(*) FILTER (r <= coalesce(had, 0)) AS g FROM c LEFT JOIN b ON c.category = b.category AND c.now = b.now AND c.identity = b.identity AND (c.file_b IS NOT DISTINCT FROM b.file_b)),
    n AS (SELECT count(*) AS n FROM x WHERE half = 1 AND category IN ('suppression', 'invariant', 'clone')) SELECT g AS grandfathered, n - g AS retained FROM g, n""",
)
def ratchet_summary(spark, d):
    """Of counted findings, how many the baseline excuses."""
    cur, base = _debt(spark, d, _PARTED)
    out = ratchet.apply(cur, base, *_changes(spark, d))
    return ratchet.summary(out.where("category in ('suppression', 'invariant', 'clone')"))


@query(
    "ratchet_hot_key",
    f"""WITH o AS (SELECT o_orderkey AS ord, o_orderkey % 2 AS half, CAST(o_totalprice AS DOUBLE) AS v, CASE WHEN o_custkey % 3 = 0 THEN 'hot' ELSE o_orderpriority END AS key FROM orders),
    cars AS (SELECT key, list({{'ord': ord, 'v': v}} ORDER BY ord) AS cars FROM o WHERE half = 1 GROUP BY key), spots AS (SELECT key, list(v ORDER BY v) AS spots FROM o WHERE half = 0 GROUP BY key)
    SELECT p.ord AS ord, p.had IS NOT NULL AS grandfathered, p.had AS baseline_value FROM (SELECT unnest({_PARK}.done) AS p FROM cars JOIN spots USING (key))""",
)
def ratchet_hot_key(spark, d):
    """Six keys for all orders, of which one has a third: keys that are halved until their parts are small."""
    rows = projected(spark, d, "orders", {"ord": "o_orderkey", "half": "o_orderkey % 2", "v": "CAST(o_totalprice AS DOUBLE)", "key": "CASE WHEN o_custkey % 3 = 0 THEN 'hot' ELSE o_orderpriority END"})
    return ratchet.numeric(rows.where("half = 1"), rows.where("half = 0"), ["key"], "v", "ord").select("ord", "grandfathered", "baseline_value")


@query(
    "retained_context",
    f"""WITH {_CHANGES_SQL}, isle AS (SELECT file, min(line) AS a, max(line) AS b FROM (SELECT file, line, line - row_number() OVER (PARTITION BY file ORDER BY line) AS g FROM cl) GROUP BY file, g),
    one AS (SELECT file, min(line) AS line FROM cl GROUP BY file),
    part AS (SELECT ord, 0 AS n, x.file, greatest(a, line) AS a, least(b, end_line) AS b FROM x JOIN isle ON x.file = isle.file AND a <= end_line AND b >= line WHERE category = 'clone' UNION ALL SELECT ord, 1, x.file_b, greatest(a, line_b), least(b, end_line_b) FROM x JOIN isle ON x.file_b = isle.file AND a <= end_line_b AND b >= line_b WHERE category = 'clone'),
    side AS (SELECT ord, n, '`' || file || '`:' || string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS t FROM part GROUP BY ord, n, file),
    parts AS (SELECT ord, coalesce(s.n, o.n) AS n, coalesce(s.t, '`' || o.file || '`') AS t FROM side s FULL JOIN (SELECT ord, 0 AS n, file FROM x WHERE category = 'clone' AND file IN (FROM alone) UNION ALL SELECT ord, 1, file_b FROM x WHERE category = 'clone' AND file_b IN (FROM alone)) o USING (ord, n)),
    text AS (SELECT ord, 'changed clone ranges: ' || string_agg(t, ', ' ORDER BY n) AS t FROM parts GROUP BY ord)
    SELECT x.ord, CASE category WHEN 'budget' THEN CASE WHEN one.line IS NOT NULL THEN 'changed file `' || x.file || '` at line ' || one.line WHEN x.file IN (FROM alone) THEN 'changed file `' || x.file || '`' END
    WHEN 'clone' THEN text.t ELSE 'changed hunk `' || x.file || '`:' || CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END END AS context
    FROM x LEFT JOIN one ON one.file = x.file LEFT JOIN text ON text.ord = x.ord LEFT JOIN isle ON isle.file = x.file AND x.line BETWEEN a AND b WHERE half = 1""",
)
def retained_context(spark, d):
    cur, _ = _debt(spark, d)
    files, lines, _ = _changes(spark, d)
    return ratchet.with_context(cur, files, lines).select("ord", F.nullif(F.regexp_extract("message", r"^\[(.*)\]$", 1), F.lit("")).alias("context"))


@query("rename_cycles", "SELECT c_custkey AS path, CASE c_custkey % 5 WHEN 4 THEN c_custkey - 4 ELSE c_custkey END AS origin FROM customer WHERE c_custkey % 5 <> 3")
def rename_cycles(spark, d):
    """In each five: 0, 1 and 2 on a cycle, 4 leading into it at 0, and 3 not renamed."""
    n = F.col("c_custkey")
    old = F.when(n % 5 < 2, n + 1).when(n % 5 == 2, n - 2).when(n % 5 == 4, n - 4)
    return ratchet.lineage(table(spark, d, "customer").select(n.alias("new"), old.alias("old")))
