"""Queries of reports over findings that are a projection of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import report
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


_CAT = "CASE event_id % 9 WHEN 0 THEN 'budget' WHEN 1 THEN 'suppression' WHEN 2 THEN 'complexity' WHEN 3 THEN 'invariant' WHEN 4 THEN 'clone' WHEN 5 THEN 'coverage' WHEN 6 THEN 'mutation' WHEN 7 THEN 'specialist' ELSE 'orchestration' END"
_RANKED = "CASE category WHEN 'budget' THEN 1 WHEN 'suppression' THEN 2 WHEN 'complexity' THEN 3 WHEN 'invariant' THEN 4 WHEN 'clone' THEN 5 WHEN 'coverage' THEN 6 WHEN 'mutation' THEN 7 WHEN 'specialist' THEN 8 ELSE 9 END"
_ODD = "event_id % 2 = 1"
_FINDINGS = {
    "category": _CAT,
    "file": "'src/f' || event_id % 37 || '.ts'",
    "line": "event_id % 40",
    "column": "CASE WHEN event_id % 9 = 2 THEN event_id % 5 END",
    "end_line": "event_id % 40 + event_id % 3",
    "file_b": "CASE WHEN event_id % 9 = 4 THEN 'src/g' || event_id % 11 || '.ts' END",
    "line_b": "CASE WHEN event_id % 9 = 4 THEN event_id % 20 + 1 END",
    "end_line_b": "CASE WHEN event_id % 9 = 4 THEN event_id % 20 + 9 END",
    "metric": f"CASE event_id % 9 WHEN 0 THEN CASE WHEN {_ODD} THEN 'File Byte Size' ELSE 'Physical Lines (.ts)' END WHEN 2 THEN CASE WHEN {_ODD} THEN 'Cyclomatic Complexity' ELSE 'Other' END WHEN 3 THEN CASE WHEN {_ODD} THEN 'Disallowed Call' ELSE 'Disallowed Import' END "
    f"WHEN 5 THEN CASE WHEN {_ODD} THEN 'Missing Diff Coverage' ELSE 'Global Line Coverage' END WHEN 6 THEN CASE WHEN {_ODD} THEN 'Mutation Timeouts' ELSE 'Mutation Kill Rate' END WHEN 8 THEN CASE WHEN {_ODD} THEN 'read-source' ELSE 'lint' END END",
    "identity": "CASE event_id % 9 WHEN 7 THEN 'clippy::' || event_type WHEN 8 THEN 'cmd ' || event_id % 3 WHEN 5 THEN NULL ELSE 'n' || event_id % 6 END",
    "message": "CASE WHEN event_id % 10 = 0 THEN ' ' ELSE 'said ' || event_id % 4 END",
    "recommendation": "CASE WHEN event_id % 4 = 0 THEN 'do it' WHEN event_id % 4 = 1 THEN '' END",
    "actual": "CAST(event_id % 50 AS DOUBLE)",
    "limit": "CAST(10 AS DOUBLE)",
    "tokens": "CASE WHEN event_id % 9 = 4 THEN event_id % 90 END",
    "blocking": "CASE WHEN event_id % 9 = 7 THEN event_type <> 'view' END",
    "exit_code": "CASE WHEN event_id % 9 = 8 THEN CASE WHEN event_id % 18 = 8 THEN 127 ELSE 1 END END",
}
_F = sql("events", _FINDINGS)
_COUNTS = "(category <> 'specialist' OR blocking)"


def _findings(spark, d):
    rows = projected(spark, d, "events", _FINDINGS)
    longs = ("line", "column", "end_line", "line_b", "end_line_b", "tokens")
    return rows.withColumns({c: F.col(f"`{c}`").cast("long") for c in longs})


_RULE = "CASE category WHEN 'budget' THEN CASE metric WHEN 'File Byte Size' THEN 'HG-BUDGET-FILE-BYTE-SIZE' ELSE 'HG-BUDGET-PHYSICAL-LINES' END WHEN 'suppression' THEN 'HG-SUPPRESSION-FORBIDDEN' WHEN 'complexity' THEN CASE metric WHEN 'Other' THEN 'HG-COMPLEXITY-UNKNOWN-METRIC' ELSE 'HG-COMPLEXITY-CYCLOMATIC' END WHEN 'invariant' THEN CASE metric WHEN 'Disallowed Call' THEN 'HG-INVARIANT-DISALLOWED-CALL' ELSE 'HG-INVARIANT-DISALLOWED-IMPORT' END WHEN 'clone' THEN 'HG-CLONE-DUPLICATE-BLOCK' WHEN 'coverage' THEN CASE metric WHEN 'Missing Diff Coverage' THEN 'HG-COVERAGE-MISSING-DIFF' ELSE 'HG-COVERAGE-GLOBAL-LINES' END WHEN 'mutation' THEN CASE metric WHEN 'Mutation Timeouts' THEN 'HG-MUTATION-TIMEOUTS' ELSE 'HG-MUTATION-KILL-RATE' END WHEN 'specialist' THEN identity ELSE CASE metric WHEN 'lint' THEN 'HG-ORCHESTRATION-LINT' ELSE 'HG-ORCHESTRATION-READ-SOURCE' END END"
_PLACES = """CASE WHEN category = 'clone' THEN 2 WHEN category = 'orchestration' AND metric = 'lint' THEN 0 ELSE 1 END"""
_FIRST = "CASE category WHEN 'orchestration' THEN CASE metric WHEN 'lint' THEN NULL ELSE identity END ELSE file END"
_LINE = "CASE WHEN category IN ('suppression', 'complexity', 'invariant', 'clone') THEN nullif(line, 0) WHEN category = 'specialist' THEN line END"
_STREAM = f"SELECT {_RANKED} AS cat_rank, {_RULE} AS rule_id, category, CASE WHEN category = 'orchestration' AND message = ' ' THEN 'Step `' || metric || '` failed.' ELSE message END AS message, {_PLACES} AS places, {_FIRST} AS first_file, {_LINE} AS first_line, CASE WHEN recommendation = 'do it' THEN 'own' ELSE 'general' END AS advice FROM {_F} WHERE {_COUNTS}"


def _shown(stream):
    at = F.get("locations", F.lit(0))
    return stream.select("cat_rank", "rule_id", "category", "message", F.size("locations").alias("places"), at["file"].alias("first_file"), at["line"].alias("first_line"), F.when(F.col("recommendation") == "do it", "own").when(F.length("recommendation") > 20, "general").alias("advice"))


@query("rule_stream", f"SELECT *, count(*) AS n FROM ({_STREAM}) GROUP BY ALL")
def rule_stream(spark, d):
    return _shown(report.rule_stream(_findings(spark, d))).groupBy("cat_rank", "rule_id", "category", "message", "places", "first_file", "first_line", "advice").agg(F.count("*").alias("n"))


@query("failure_stream", f"SELECT rule_id, count(*) AS n FROM ({_STREAM}) WHERE category = 'orchestration' OR rule_id IN ('HG-COVERAGE-MISSING-DIFF', 'HG-MUTATION-TIMEOUTS') GROUP BY 1 UNION ALL SELECT 'HG-SAVED', 1")
def failure_stream(spark, d):
    stream = report.rule_stream(_findings(spark, d))
    kept = stream.where("rule_id = 'HG-ORCHESTRATION-LINT'").drop("cat_rank").orderBy("message").limit(1)
    saved = kept.union(kept.withColumn("rule_id", F.lit("HG-SAVED"))).union(kept.withColumn("rule_id", F.lit("HG-SAVED")))
    return report.failure_stream(stream, saved).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("filter_engine", f"SELECT 'Anti_Gaming' AS engine, category, count(*) AS n FROM {_F} WHERE category = 'suppression' GROUP BY 2 UNION ALL SELECT 'clippy', category, count(*) FROM {_F} WHERE category = 'specialist' GROUP BY 2 UNION ALL SELECT 'file-budgets', category, count(*) FROM {_F} WHERE category = 'budget' GROUP BY 2")
def filter_engine(spark, d):
    f, out = _findings(spark, d), None
    for name in ("Anti_Gaming", "clippy", "file-budgets"):
        part = report.by_engine(f, name).groupBy("category").agg(F.count("*").alias("n")).select(F.lit(name).alias("engine"), "category", "n")
        out = part if out is None else out.union(part)
    return out


@query("filter_metric", f"SELECT category, metric, count(*) AS n FROM {_F} WHERE category IN ('budget', 'complexity', 'coverage', 'mutation') AND contains(lower(metric), 'ti') OR category = 'specialist' AND contains(identity, 'ti') GROUP BY 1, 2")
def filter_metric(spark, d):
    return report.by_metric(_findings(spark, d), "TI").groupBy("category", "metric").agg(F.count("*").alias("n"))


@query("filter_top", f"WITH f AS {_F}, t AS (SELECT x FROM (SELECT unnest(CASE category WHEN 'clone' THEN [file, file_b] ELSE [file] END) AS x FROM f WHERE category <> 'orchestration') GROUP BY x ORDER BY count(*) DESC, x LIMIT 3) SELECT category, count(*) AS n FROM f WHERE category <> 'orchestration' AND (file IN (FROM t) OR coalesce(file_b IN (FROM t), false)) GROUP BY 1")
def filter_top(spark, d):
    return report.by_top_files(_findings(spark, d), 3).groupBy("category").agg(F.count("*").alias("n"))


_BLOCKER = "(category = 'orchestration' OR metric IN ('Missing Diff Coverage', 'Mutation Timeouts'))"


@query("report_totals", f"SELECT count(*) FILTER ({_COUNTS}) AS total, count(*) FILTER ({_COUNTS}) - count(*) FILTER ({_BLOCKER}) AS code, count(*) FILTER ({_BLOCKER}) AS blockers FROM {_F}")
def report_totals(spark, d):
    return report.totals(_findings(spark, d))


def _of(c: str) -> str:
    return f"count(*) FILTER (category = '{c}')"


_SUMMARY = f"""SELECT count(*) FILTER ({_COUNTS}) AS total_errors, count(*) FILTER ({_BLOCKER}) AS analysis_blockers, {_of('clone')} AS clones, {_of('complexity')} AS complexity, count(DISTINCT CASE WHEN category = 'complexity' THEN {{'f': file, 'l': line, 'c': "column", 'e': end_line, 'i': identity}} END) AS function_review_targets,
    {_of('budget')} AS file_budgets, {_of('suppression')} AS suppressions, {_of('invariant')} AS architecture, {_of('coverage')} AS coverage, {_of('mutation')} AS mutation, {_of('orchestration')} AS tool, count(*) FILTER (category = 'specialist' AND blocking) AS specialist_findings,
    (SELECT count(DISTINCT x) FROM (SELECT unnest(CASE category WHEN 'clone' THEN [file, file_b] ELSE [file] END) AS x FROM {_F} WHERE category NOT IN ('mutation', 'orchestration') AND {_COUNTS})) AS files_with_violations, count(*) FILTER ({_COUNTS}) - count(*) FILTER ({_BLOCKER}) AS code_findings,
    {_of('complexity')} AS ast_violations, CAST(7 AS BIGINT) AS files_scanned, CAST(8 AS BIGINT) AS functions_analyzed, count(*) FILTER ({_COUNTS}) = 0 AS passed FROM {_F}"""


@query("report_summary", _SUMMARY)
def report_summary(spark, d):
    return report.summary(_findings(spark, d), 7, 8)


@query("summary_json", f"""SELECT total_errors, clones, passed FROM ({_SUMMARY})""")
def summary_json(spark, d):
    body = report.as_json(report.summary(_findings(spark, d), 7, 8))
    return body.select(F.from_json("body", "total_errors long, clones long, passed boolean").alias("r")).select("r.*")


@query("summary_text", f"""SELECT 'Summary: ' || total_errors || ' errors (' || code_findings || ' code findings across ' || files_with_violations || ' files, ' || analysis_blockers || ' analysis blockers; ' || clones || ' clones, ' || ast_violations || ' AST violations)' || chr(10) || 'Scanned: 7 files, 8 functions' || chr(10) || 'Breakdown: code_findings=' || code_findings || ', analysis_blockers=' || analysis_blockers || ', clones=' || clones || ', complexity=' || complexity || ', file-budget=' || file_budgets || ', anti-gaming=' || suppressions || ', architecture=' || architecture || ', coverage=' || coverage || ', mutation=' || mutation || ', tool=' || tool AS body FROM ({_SUMMARY})""")
def summary_text(spark, d):
    return report.summary_text(report.summary(_findings(spark, d), 7, 8))


@query("report_json", f"""SELECT category, count(*) AS n, sum(line) AS lines FROM {_F} GROUP BY 1""")
def report_json(spark, d):
    f = _findings(spark, d)
    back = report.as_json(f).select(F.from_json("body", f.schema).alias("r")).select("r.*")
    return back.groupBy("category").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


_TITLE = """CASE category WHEN 'suppression' THEN 'error[anti-gaming]: forbidden `' || identity || '`' WHEN 'budget' THEN 'error[file-budget]: ' || metric || ' is ' || CAST(actual AS BIGINT) || ' (limit: 10)' WHEN 'invariant' THEN 'error[architecture]: [' || identity || '] ' || message WHEN 'clone' THEN 'error[clone]: duplicate (' || (end_line - line + 1) || ' lines, ~' || tokens || ' tokens)'
    WHEN 'coverage' THEN 'error[coverage]: ' || metric || ' is ' || CAST(actual AS BIGINT) || '.0 (required: 10.0)' WHEN 'mutation' THEN 'error[mutation]: ' || metric || ' is ' || CAST(actual AS BIGINT) || '.0% (required: 10.0%)' WHEN 'specialist' THEN CASE WHEN blocking THEN 'error' ELSE 'warning' END || '[' || identity || ']: ' || message ELSE 'error[tool]: `' || identity || '` failed' END"""
_TARGET = "CASE category WHEN 'suppression' THEN file || ':' || line WHEN 'invariant' THEN file || ':' || line WHEN 'clone' THEN file || ':' || line || '-' || end_line || ' matches ' || file_b || ':' || line_b || '-' || end_line_b WHEN 'specialist' THEN file || ':' || line WHEN 'orchestration' THEN '[' || metric || '] `' || identity || '`' ELSE file END"
_REVIEWS = """SELECT 3 AS cat_rank, 'error[complexity]: `' || identity || '`: ' || string_agg(metric || ' ' || CAST(actual AS BIGINT) || '/10', '; ' ORDER BY metric, metric || ' ' || CAST(actual AS BIGINT) || '/10') AS title, file || ':' || line || ':' || "column" AS target FROM """ + _F + """ WHERE category = 'complexity' GROUP BY file, line, "column", end_line, identity"""


@query("compact_rows", f"SELECT cat_rank, title, target, count(*) AS n FROM (SELECT {_RANKED} AS cat_rank, {_TITLE} AS title, {_TARGET} AS target FROM {_F} WHERE category <> 'complexity' UNION ALL {_REVIEWS}) GROUP BY ALL")
def compact_rows(spark, d):
    return report.compact_rows(_findings(spark, d)).groupBy("cat_rank", "title", "target").agg(F.count("*").alias("n"))


@query("function_review_rows", """SELECT file, line, "column" AS col, end_line, identity, count(*) AS n FROM """ + _F + """ WHERE category = 'complexity' GROUP BY ALL""")
def function_review_rows(spark, d):
    r = report.function_reviews(_findings(spark, d))
    return r.select("file", "line", F.col("column").alias("col"), "end_line", "identity", F.size(F.split("metrics", "; ")).cast("long").alias("n"))


@query("scan_metrics", "SELECT '  p' || l_partkey || '.ts:' || l_linenumber || ' f: cyclomatic=' || l_linenumber || ', parameters=2, lines=' || CAST(l_quantity AS BIGINT) || ', nesting=0, statements=9' AS line FROM lineitem")
def scan_metrics(spark, d):
    rows = projected(spark, d, "lineitem", {"path": "'p' || l_partkey || '.ts'", "start_line": "l_linenumber", "name": "'f'", "cyclomatic": "l_linenumber", "parameters": "2", "lines": "CAST(l_quantity AS BIGINT)", "nesting": "0", "statements": "9"})
    return report.scan_metrics(rows)


@query(
    "finding_records",
    f"""SELECT engine, count(*) AS n FROM (SELECT DISTINCT CASE category WHEN 'budget' THEN 'file-budget' WHEN 'suppression' THEN 'anti-gaming' WHEN 'invariant' THEN 'invariants' WHEN 'clone' THEN 'clones' ELSE category END AS engine, CASE category WHEN 'orchestration' THEN metric ELSE file END AS file, CASE WHEN category IN ('suppression', 'complexity', 'invariant', 'clone', 'specialist') THEN line END AS line,
    CASE WHEN category IN ('budget', 'mutation') THEN metric WHEN category IN ('complexity', 'coverage') THEN coalesce(identity, '') || ':' || metric WHEN category = 'clone' THEN identity || ':' || file_b || ':' || line_b || '-' || end_line_b || ':' || tokens ELSE identity END AS identity FROM {_F} WHERE {_COUNTS}) GROUP BY 1""",
)
def finding_records(spark, d):
    return report.finding_records(_findings(spark, d)).groupBy("engine").agg(F.count("*").alias("n"))


_ORDERED = f"""SELECT {_RANKED} AS r, CASE category WHEN 'orchestration' THEN [metric] ELSE string_split(file, '/') END AS f, CASE WHEN category = 'coverage' THEN identity END AS cv, CASE WHEN category NOT IN ('budget', 'coverage', 'mutation') THEN line END AS l, CASE WHEN category IN ('complexity', 'specialist') THEN "column" END AS c, CASE WHEN category IN ('complexity', 'clone') THEN end_line END AS e,
    CASE WHEN category = 'clone' THEN string_split(file_b, '/') END AS fb, CASE WHEN category = 'clone' THEN line_b END AS lb, CASE WHEN category = 'clone' THEN end_line_b END AS eb, identity, metric, message, category, file, line FROM {_F} WHERE {_COUNTS}"""


@query("display_order", f"SELECT category, file, line, identity, metric, message FROM ({_ORDERED}) ORDER BY r, f NULLS FIRST, cv NULLS FIRST, l NULLS FIRST, c NULLS FIRST, e NULLS FIRST, fb NULLS FIRST, lb NULLS FIRST, eb NULLS FIRST, identity NULLS FIRST, metric NULLS FIRST, message NULLS FIRST, line NULLS FIRST LIMIT 60")
def display_order(spark, d):
    return report.displayed(_findings(spark, d), 60).select("category", "file", "line", "identity", "metric", "message")


@query("diagnostic_counters", f"SELECT count(*) AS total, least(count(*), 60) AS shown, count(*) - least(count(*), 60) AS omitted FROM {_F} WHERE {_COUNTS}")
def diagnostic_counters(spark, d):
    return report.counters(_findings(spark, d), 60)


_MADE = {"run": "o_custkey", "a": "o_orderkey % 3", "b": "o_orderkey % 4", "c": "o_orderkey % 5", "k": "o_orderkey"}


@query(
    "comparability",
    f"""WITH r AS {sql('orders', _MADE)} SELECT k, list_filter([CASE WHEN c = 4 THEN 'execution metadata is missing' END, CASE WHEN c < 4 AND a = 1 THEN 'scope changed' END, CASE WHEN c < 4 AND b = 2 THEN 'command or root changed' END, CASE WHEN c < 4 AND b = 3 THEN 'engines or required evidence changed' END, CASE WHEN c < 4 AND a = 1 THEN 'diff reports have no complete inventory' END,
    CASE WHEN c = 3 THEN 'selected evidence is incomplete or skipped' END, CASE WHEN a = 2 THEN 'files scanned changed' END], lambda x: x IS NOT NULL) AS scope_differences, list_filter([CASE WHEN c = 2 THEN 'policy changed' END], lambda x: x IS NOT NULL) AS config_differences, a = 0 AND b < 2 AND c < 2 AS equivalent FROM r""",
)
def comparability(spark, d):
    r = projected(spark, d, "orders", _MADE)

    def plan(after: bool):
        pick = lambda c, x, y: F.when(F.lit(after) & c, F.lit(x)).otherwise(F.lit(y))
        engine = F.struct(F.lit("clones").alias("id"), F.lit(True).alias("enabled"), pick(F.col("b") == 3, False, True).alias("selected"), F.array(F.lit("e")).alias("required_evidence"), F.lit("completed").alias("state"))
        other = F.struct(F.lit("lint").alias("id"), F.lit(True).alias("enabled"), F.lit(True).alias("selected"), F.array(F.lit("e")).alias("required_evidence"), pick(F.col("c") == 3, "skipped", "completed").alias("state"))
        body = F.struct(pick(F.col("c") == 2, "x", "y").alias("policy_sha256"), pick(F.col("a") == 1, "diff", "repository").alias("mode"), F.array().cast("array<string>").alias("paths"), pick(F.col("b") == 2, "scan", "check").alias("command"), F.lit("/r").alias("root"), F.array(engine, other).alias("engines"))
        return F.when(F.col("c") < 4, body) if after else body

    rows = r.select("k", plan(False).alias("before"), plan(True).alias("after"), F.lit(5).alias("files_before"), F.when(F.col("a") == 2, 6).otherwise(5).alias("files_after"))
    return report.differences(rows).select("k", "scope_differences", "config_differences", "equivalent")


_PLANNED = {"run": "o_custkey", "id": "(CASE o_orderkey % 2 WHEN 0 THEN 'a' ELSE 'b' END) || o_orderkey", "enabled": "o_orderkey % 3 > 0", "selected": "o_orderkey % 3 > 0 AND o_orderkey % 5 > 0", "state": "'skipped'", "reason": "'before'"}


@query("omitted_requirements", "SELECT o_custkey AS run, count(*) AS n FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 5 = 0 GROUP BY 1")
def omitted_requirements(spark, d):
    return report.omitted_requirements(projected(spark, d, "orders", _PLANNED)).groupBy("run").agg(F.count("*").alias("n"))


@query(
    "engine_reconcile",
    """WITH s AS (SELECT o_custkey AS run, (CASE o_orderkey % 2 WHEN 0 THEN 'a' ELSE 'b' END) || o_orderkey AS id, o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 AS selected, max(['disabled', 'skipped', 'cached', 'completed', 'failed', 'incomplete'][(l_partkey + l_linenumber) % 6 + 1]) AS x, max((l_partkey + l_linenumber) % 6) AS worst, min(CASE WHEN (l_partkey + l_linenumber) % 6 = 5 THEN l_linenumber END) AS first FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)
    SELECT run, id, CASE WHEN selected AND worst IS NOT NULL THEN ['disabled', 'skipped', 'cached', 'completed', 'failed', 'incomplete'][worst + 1] ELSE 'skipped' END AS state, CASE WHEN selected AND worst IS NOT NULL THEN CASE WHEN worst = 5 THEN 'line ' || first END ELSE 'before' END AS reason FROM s""",
)
def engine_reconcile(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    state = F.element_at(F.array(*map(F.lit, ("disabled", "skipped", "cached", "completed", "failed", "incomplete"))), ((F.col("l_partkey") + F.col("l_linenumber")) % 6 + 1).cast("int"))
    seen = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("run"), F.expr("(CASE o_orderkey % 2 WHEN 0 THEN 'a' ELSE 'b' END) || o_orderkey").alias("engine"), state.alias("state"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("reason"), F.col("l_linenumber").alias("seq"))
    return report.reconciled(projected(spark, d, "orders", _PLANNED), seen, ("run",)).select("run", "id", "state", "reason")


@query("verdict_accepted", f"SELECT count(*) FILTER ({_COUNTS}) = 0 AS passed, coalesce(bool_or(metric IN ('Missing Diff Coverage', 'Mutation Timeouts') OR exit_code = 127), false) AS incomplete, false AS accepted, CAST(2 AS INTEGER) AS exit_code FROM {_F}")
def verdict_accepted(spark, d):
    engines = spark.createDataFrame([("a", True, True, "completed"), ("b", True, False, "skipped")], "id string, enabled boolean, selected boolean, state string")
    return report.verdicts(_findings(spark, d), engines)


@query(
    "source_excerpts",
    r"""WITH l AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\n\z', ''), '\r?\n') AS a FROM documents WHERE text <> ''), x AS (SELECT doc_id, list_transform(a[2:least(9, len(a))], lambda t: replace(replace(t, chr(9), '\t'), chr(13), '\r')) AS v, len(a) < 9 AS short FROM l WHERE len(a) >= 2),
    y AS (SELECT doc_id, list_transform(v, lambda t: left(t, 240)) AS s, short OR len(list_filter(v, lambda t: len(t) > 240)) > 0 AS cut FROM x), b AS (SELECT *, list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[1:i], lambda t: octet_length(encode(t))))) AS sums FROM y),
    z AS (SELECT *, coalesce(sum(sums[-1]) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b), k AS (SELECT *, len(list_filter(sums, lambda n: before + n <= 65536)) AS n FROM z WHERE before < 65536)
    SELECT doc_id AS seq, CAST(2 AS BIGINT) AS first_line, md5(array_to_string(s[1:n], chr(10))) AS lines, cut OR n < len(s) AS truncated FROM k WHERE n > 0""",
)
def source_excerpts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    at = docs.select(F.col("doc_id").alias("seq"), F.col("path").alias("file"), F.lit(2).cast("long").alias("line"), F.lit(9).cast("long").alias("end_line"))
    out = report.excerpts(at, docs.select("path", "text"))
    return out.select("seq", "first_line", F.md5(F.array_join("lines", "\n")).alias("lines"), "truncated")


@query("captured_sources", f"SELECT p_partkey, 'src/f' || p_partkey || '.ts' AS path FROM part WHERE 'src/f' || p_partkey || '.ts' IN (SELECT file FROM {_F} WHERE category <> 'orchestration' AND {_COUNTS})")
def captured_sources(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"))
    return report.captured(p, report.rule_stream(_findings(spark, d)))


@query(
    "measurements",
    f"""WITH f AS (SELECT *, {_RULE} AS rule_id, {_LINE} AS shown FROM {_F}), s AS (SELECT DISTINCT rule_id, file, shown, message FROM f WHERE {_COUNTS} AND category <> 'orchestration'), m AS (SELECT s.rule_id, s.file, s.shown AS line, f.actual FROM s JOIN f ON f.rule_id = s.rule_id AND f.file = s.file AND f.message = s.message AND s.shown IS NOT DISTINCT FROM CASE WHEN f.category IN ('suppression', 'complexity', 'invariant', 'clone', 'specialist') THEN nullif(f.line, 0) END)
    SELECT rule_id, count(*) AS n, sum(actual) AS total FROM m GROUP BY 1""",
)
def measurements(spark, d):
    f = _findings(spark, d)
    return report.measurements(report.rule_stream(f), f).groupBy("rule_id").agg(F.count("*").alias("n"), F.sum("actual").alias("total"))


_RUNS = {"name": "'p' || event_id", "kind": "CASE event_id % 3 WHEN 0 THEN 'coverage' WHEN 1 THEN 'mutation' END", "status": "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END", "report": "'r' || event_id", "detail": "CASE WHEN event_id % 2 = 0 THEN 'why' END"}


@query("producer_failures", f"SELECT k || '-report' AS step, report AS target, 'producer configuration `' || name || '` failed: ' || coalesce(detail, 'unknown execution failure') AS message, true AS blocking FROM {sql('events', _RUNS)}, (VALUES ('coverage'), ('mutation')) v(k) WHERE status = 'failed' AND (kind IS NULL OR kind = k)")
def producer_failures(spark, d):
    return report.producer_failures(projected(spark, d, "events", _RUNS), True, True)


_AT = {"id": "event_id", "file": "'a.ts'", "line": "CASE WHEN event_id % 4 > 0 THEN event_id % 9 END", "col": "CASE WHEN event_id % 4 = 1 THEN 3 END", "stop": "event_id % 9 + event_id % 2"}


@query("locations_formatted", f"SELECT id, CASE WHEN line IS NULL THEN file WHEN col IS NOT NULL THEN file || ':' || line || ':' || col WHEN stop > line THEN file || ':' || line || '-' || stop ELSE file || ':' || line END AS place FROM {sql('events', _AT)}")
def locations_formatted(spark, d):
    return projected(spark, d, "events", _AT).select("id", T.location(F.col("file"), F.col("line"), F.col("col"), F.col("stop")).alias("place"))


@query("controls_visible", r"SELECT event_id, 'a\tb\r' || chr(92) || 'u{1B}' || chr(92) || 'u{A}é' || event_id AS shown FROM events")
def controls_visible(spark, d):
    return table(spark, d, "events").select("event_id", T.visible(F.concat(F.lit("a\tb\r\x1b\né"), F.col("event_id").cast("string"))).alias("shown"))


@query("short_texts", r"SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN repeat('y', 240) || '…' ELSE '' END AS short FROM events")
def short_texts(spark, d):
    text = F.element_at(F.array(F.lit("\n  \n x \nz"), F.lit("y" * 300), F.lit(" \n")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.short_text(text).alias("short"))


@query("numbers_formatted", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '5' WHEN 1 THEN '2.5' WHEN 2 THEN '0.333' ELSE '100' END AS shown FROM events")
def numbers_formatted(spark, d):
    x = F.element_at(F.array(*map(F.lit, (5.0, 2.5, 1 / 3, 100.0))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.number(x).alias("shown"))
