"""Queries of the engine by key, with the SQL that a reference database runs for the same rows.

The driver's tables hold no source code, so each operator works on a
deterministic projection of them. Queries read their whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clones, coverage, files, findings, mutation, ratchet, rules
from . import clone_queries, gate_queries, history_queries, report_queries, source_queries, stream_queries, tree_queries
from .tables import table

FLAGSHIP = "clone_spans"
K = 50
_LINES = r"CASE WHEN coalesce(text, '') = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '\n\z', ''), '\r?\n') END"


def doc_files(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))).alias("path"), "text")


DOC_PATH = "source || '/' || doc_id || '.' || lang"


def file_budget_bytes(spark, d):
    out = files.file_budgets(doc_files(spark, d), 2048, {"default": 1 << 30})
    return out.select("path", "metric", "actual", F.col("limit").alias("max_allowed"))


def file_budget_lines(spark, d):
    out = files.file_budgets(doc_files(spark, d), 1 << 40, {"en": 20, "de": 15, "default": 10}, exclude=["src3/**"])
    return out.select("path", "metric", "actual", F.col("limit").alias("max_allowed"))


def line_size_breakdown(spark, d):
    return files.size_breakdown(doc_files(spark, d))


_PATH_CASE = (
    ("node_modules/p/index.js", "src/tests/a.ts", "src/a.test.ts", "db/migrations/x.sql", "gen/api.ts", "pkg/yarn.lock", "a/fixtures/b.json", "src/config/app.ts", "docs/guide.mdx", "src/main.rs", "notes/readme.txt", "src/test.ts", "web/.eslintrc.js", "src/x_tests.rs"),
    ("vendor", "test", "test", "migration", "generated", "generated", "fixture", "config", "documentation", "source", "unknown", "source", "config", "test"),
)


def _synthetic_path(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _PATH_CASE[0])), (key % len(_PATH_CASE[0]) + 1).cast("int"))


def role_classification(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("./"), _synthetic_path(F.col("page_id"))).alias("path"))
    return files.classify(p).groupBy("role").agg(F.count("*").alias("n_files"))


def custom_rule_first_match(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("/", F.lower("p_brand"), F.regexp_replace("p_type", " ", "_")).alias("path"))
    p = p.withColumn("path", F.concat("path", F.lit(".ts")))
    return files.classify(p, [("*steel*", "fixture"), ("brand#1*/**", "test"), ("*copper.ts", "generated")]).groupBy("role").agg(F.count("*").alias("n_files"))


def severity_routing(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("role"))
    return files.route(e, {"error": "error", "view": "ignore", "click": "warning"}, strict=True).groupBy("role", "severity").agg(F.count("*").alias("n"))


def suppression_scan(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.regexp_replace("html", "<script", "\n// eslint-disable <script").alias("text"))
    return rules.suppressions(p).groupBy("path", "token").agg(F.count("*").alias("n"))


def invariant_scan(spark, d):
    p = table(spark, d, "pages").select(F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    rule = rules.Invariant("pages", "web/**", exclude=("web/1.html",), calls=("track",), tokens=("script",))
    return rules.invariants(p, [rule]).groupBy("path", "kind", "target").agg(F.count("*").alias("n"))


def _streams(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("stream"), clones.word_tokens(F.col("text")).alias("tokens"))


def clone_windows(spark, d):
    return clones.windows(_streams(spark, d), K).groupBy("stream").agg(F.count("*").alias("windows"), F.count_distinct("h").alias("distinct_windows"))


def clone_spans(spark, d):
    return clones.spans(clones.windows(_streams(spark, d), K), K)


def clone_files(spark, d):
    return clones.streams_in_spans(clones.windows(_streams(spark, d), K), K).agg(F.count("*").alias("files"))


def clone_hash_capacity(spark, d):
    return clones.over_capacity(clones.windows(_streams(spark, d), 3, digest=True), 8)


def clone_fingerprint(spark, d):
    return table(spark, d, "benchmark").select("item_id", clones.fingerprint(clones.word_tokens(F.col("text"))).alias("fingerprint"))


def _da(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("line"), (F.col("l_quantity") > 25).cast("long").alias("hits")).groupBy("file", "line").agg(F.max("hits").alias("hits"))


DA = "(SELECT l_suppkey AS file, l_orderkey AS line, max(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS hits FROM lineitem GROUP BY ALL)"


def coverage_floors(spark, d):
    return coverage.floors(coverage.totals(_da(spark, d)), 60.0).select("found", "hit", F.round("pct", 6).alias("pct"), "below")


def coverage_missing_source(spark, d):
    records = table(spark, d, "lineitem").select((F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")).alias("file"))
    return coverage.missing_sources(table(spark, d, "part").select((F.col("p_partkey") * 2).alias("file")), records)


def coverage_critical(spark, d):
    paths = table(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("file"))
    return coverage.critical(paths, coverage.totals(_da(spark, d))).select("file", "finding", F.round("pct", 6).alias("pct"))


def _changes(spark, d) -> DataFrame:
    return table(spark, d, "orders").select((F.col("o_custkey") % 10 + 1).alias("file"), F.col("o_orderkey").alias("line"))


CHANGES = "(SELECT DISTINCT o_custkey % 10 + 1 AS file, o_orderkey AS line FROM orders)"


def _changed(strict: bool):
    def run(spark, d):
        return coverage.changed(_changes(spark, d), _da(spark, d), strict).withColumn("pct", F.round("pct", 6)).withColumn("lines", F.md5("lines"))

    return run


def coverage_production_only(spark, d):
    tests = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("line"))
    return coverage.production_only(_da(spark, d), tests)


def mutation_score(spark, d):
    kinds = F.create_map(*(F.lit(x) for pair in (("signup", " Killed "), ("view", "Survived"), ("error", "Compile-Error"), ("click", "NoCoverage"), ("purchase", "Timed Out")) for x in pair))
    e = table(spark, d, "events").select((F.col("user_id") % 7).alias("report"), mutation.status(F.element_at(kinds, F.col("event_type"))).alias("category"))
    return mutation.score(e, "report").withColumn("score", F.round("score", 6))


def mutation_json_stryker(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("report")).agg(F.collect_list(F.struct(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "click", "Survived").otherwise("Killed").alias("status"))).alias("mutants"))
    j = e.select("report", F.to_json(F.struct(F.create_map(F.lit("a.ts"), F.struct("mutants")).alias("files"))).alias("body"))
    return mutation.stryker(j, "report", "body").groupBy("report", "file", "category").agg(F.count("*").alias("n"))


def _halves(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")


def ratchet_multiset(spark, d):
    base, cur = _halves(spark, d)
    return ratchet.multiset(cur, base, ["user_id", "event_type"], "event_id").select("event_id", "grandfathered")


def ratchet_numeric(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("actual"))
    cur = o.groupBy("file").agg(F.max("ord").alias("ord"), F.max_by("actual", "ord").alias("actual"))
    base = o.groupBy("file").agg(F.min("ord").alias("ord"), F.min_by("actual", "ord").alias("actual"))
    return ratchet.numeric(cur, base, ["file"], "actual", "ord").select("file", "ord", "actual", "grandfathered")


def attribution_range(spark, d):
    f = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("file"), F.col("l_orderkey").alias("first"), (F.col("l_orderkey") + F.col("l_linenumber") % 3).alias("last"), "l_linenumber")
    c = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("file"), F.col("o_orderkey").alias("line"))
    return ratchet.touched_ranges(f, c)


def hunk_ranges(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("file"), (F.datediff("ts", F.lit("1970-01-01"))).cast("long").alias("line"))
    return ratchet.hunks(e)


def rename_closure(spark, d):
    c = table(spark, d, "customer").where("c_custkey > 1")
    return ratchet.lineage(c.select(F.col("c_custkey").alias("new"), F.floor(F.col("c_custkey") / 2).cast("long").alias("old")))


def module_reachability(spark, d):
    p = table(spark, d, "part")
    src = F.when(F.col("p_partkey") % 5 == 0, -1).otherwise(F.floor(F.col("p_partkey") / 2)).cast("long")
    edges = p.select(src.alias("src"), F.col("p_partkey").alias("dst"))
    seeds = p.where("p_partkey in (1, 3, 7)").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") == 3, 2).otherwise(1).alias("mask"))
    return ratchet.reach(edges, seeds)


def report_compare(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 50).alias("line"), F.col("o_orderpriority").alias("identity"), "o_orderstatus")
    return findings.compare(o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus <> 'O'"), ["file", "line", "identity"])


def report_compare_text(spark, d):
    """The comparison of two sets of orders as lines; regions stand for what differs in scope."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("engine"), F.col("o_custkey").cast("string").alias("file"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 50).alias("line"), F.col("o_orderpriority").alias("identity"), F.col("o_orderkey").alias("k"))
    before, after = o.where("k % 4 > 0"), o.where("k % 4 < 3")
    both = before.select(F.lit("before").alias("side")).union(after.select(F.lit("after")))
    verdicts = both.groupBy("side").agg((F.count("*") == 0).alias("passed"), F.count("*").alias("errors"))
    differences = table(spark, d, "region").select(F.concat(F.lit("scope of "), "r_name").alias("text"))
    return findings.comparison_lines(findings.compare(before, after, ["engine", "file", "line", "identity"]), verdicts, differences, "a.json", "b.json")


def _events(spark, d):
    return table(spark, d, "events")


def top_files(spark, d):
    return findings.top_files(_events(spark, d), "user_id")


def top_files_filter(spark, d):
    return findings.of_top_files(_events(spark, d), "user_id").select("event_id", "user_id")


def function_reviews(spark, d):
    li = table(spark, d, "lineitem")
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_suppkey"].cast("string"))), ",")
    return li.groupBy("l_orderkey", "l_partkey").agg(items.alias("metrics"), F.count("*").alias("n"))


def grouped_advisories(spark, d):
    c = table(spark, d, "conversations")
    return findings.grouped_advisories(c, F.concat_ws(" ", "role", (F.length("text") % 5).cast("string")), "message", "conv_id")


def engine_states(spark, d):
    n = F.when((F.col("event_type") == "error") & (F.col("event_id") % 13 >= 5), 0).otherwise(F.col("event_id") % 13 % 6)
    state = F.element_at(F.array(*map(F.lit, findings.STATES)), (n + 1).cast("int"))
    return findings.engine_states(_events(spark, d).select(F.col("user_id").alias("engine"), state.alias("state")), "engine", "state")


def verdict(spark, d):
    e = _events(spark, d).withColumn("severity", F.when(F.col("event_type") == "error", "error").otherwise("warning"))
    return findings.verdict(e, "severity", F.col("value").isNull())


def summary_rollup(spark, d):
    e = _events(spark, d)
    return e.agg(F.count("*").alias("total"), F.count_distinct("user_id").alias("files"), *(F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in ("signup", "view", "error", "click", "purchase")))


def canonical_order_limit(spark, d):
    e = _events(spark, d).select("event_type", "user_id", "event_id")
    return findings.canonical(e, ["event_type", "user_id", "event_id"], 100)


def complexity_unpivot(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("cyclomatic"), F.count("*").alias("parameters"), F.max("l_quantity").alias("lines"), F.count_distinct("l_suppkey").alias("depth"), F.max("l_linenumber").alias("statements"))
    return findings.budgets_unpivot(m, ["l_orderkey"], {"cyclomatic": 200, "parameters": 5, "lines": 48, "depth": 6, "statements": 6}).select("l_orderkey", "metric", "actual", F.col("limit").alias("max_allowed"))


def contributors_top5(spark, d):
    return findings.contributors(table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_quantity").alias("q")), ["l_suppkey"], "l_orderkey", "q")


def tool_dedup(spark, d):
    e = _events(spark, d)
    return findings.deduplicated(e.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["user_id", "day"], "event_type", "event_id")


def input_identity_diff(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    y = table(spark, d, "documents").select((F.col("doc_id") + 1).alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return findings.identity_diff(x, y, "doc_id", "digest")


def partition_cover(spark, d):
    parts = table(spark, d, "lineitem").select((F.col("l_suppkey") % 3).alias("part"), (F.col("l_partkey") * 3).alias("source"))
    return findings.partition_cover(parts, table(spark, d, "part").select((F.col("p_partkey") * 2).alias("source")), "part", "source")


_WINDOWS = r"""t AS (SELECT doc_id AS stream, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT stream, i - 1 AS i, md5(array_to_string(list_slice(w, i, i + {k} - 1), chr(31))) AS h FROM t, LATERAL (SELECT unnest(range(1, len(w) - {k} + 2)) AS i) WHERE len(w) >= {k})"""
_SPANS = (
    _WINDOWS.format(k=K)
    + f""", m AS (SELECT a.stream AS a, a.i AS ai, b.stream AS b, b.i AS bi FROM win a JOIN win b USING (h) WHERE a.stream < b.stream OR (a.stream = b.stream AND b.i >= a.i + {K})),
g AS (SELECT *, bi - ai AS diagonal, ai - row_number() OVER (PARTITION BY a, b, bi - ai ORDER BY ai) AS island FROM m),
spans AS (SELECT a, b, min(ai) AS a_start, min(bi) AS b_start, max(ai) - min(ai) + {K} AS tokens FROM g GROUP BY a, b, diagonal, island)"""
)
_CASES = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_PATH_CASE[1]))


def _changed_sql(strict: bool) -> str:
    join = "LEFT JOIN" if strict else "JOIN"
    return f"""SELECT file, covered, uncovered, missing, round(CASE WHEN covered + uncovered + missing = 0 THEN 0.0 ELSE covered / (covered + uncovered + missing) * 100 END, 6) AS pct, md5(l) AS lines FROM (
    SELECT file, count(*) FILTER (hits > 0) AS covered, count(*) FILTER (hits = 0) AS uncovered, count(*) FILTER (hits IS NULL) AS missing, coalesce(string_agg(CASE WHEN hits = 0 THEN CAST(line AS VARCHAR) END, ', ' ORDER BY line), '') AS l
    FROM {CHANGES} {join} {DA} USING (file, line) GROUP BY file)"""


QUERIES = {
    "file_budget_bytes": file_budget_bytes,
    "file_budget_lines": file_budget_lines,
    "line_size_breakdown": line_size_breakdown,
    "role_classification": role_classification,
    "custom_rule_first_match": custom_rule_first_match,
    "severity_routing": severity_routing,
    "suppression_scan": suppression_scan,
    "invariant_scan": invariant_scan,
    "clone_windows": clone_windows,
    "clone_spans": clone_spans,
    "clone_files": clone_files,
    "clone_hash_capacity": clone_hash_capacity,
    "clone_fingerprint": clone_fingerprint,
    "coverage_floors": coverage_floors,
    "coverage_missing_source": coverage_missing_source,
    "coverage_critical": coverage_critical,
    "coverage_diff_strict": _changed(True),
    "coverage_diff_legacy": _changed(False),
    "coverage_production_only": coverage_production_only,
    "mutation_score": mutation_score,
    "mutation_json_stryker": mutation_json_stryker,
    "ratchet_multiset": ratchet_multiset,
    "ratchet_numeric": ratchet_numeric,
    "attribution_range": attribution_range,
    "hunk_ranges": hunk_ranges,
    "rename_closure": rename_closure,
    "module_reachability": module_reachability,
    "report_compare": report_compare,
    "report_compare_text": report_compare_text,
    "top_files": top_files,
    "top_files_filter": top_files_filter,
    "function_reviews": function_reviews,
    "grouped_advisories": grouped_advisories,
    "engine_states": engine_states,
    "verdict": verdict,
    "summary_rollup": summary_rollup,
    "canonical_order_limit": canonical_order_limit,
    "complexity_unpivot": complexity_unpivot,
    "contributors_top5": contributors_top5,
    "tool_dedup": tool_dedup,
    "input_identity_diff": input_identity_diff,
    "partition_cover": partition_cover,
}

ORACLES: dict[str, str] = {
    "file_budget_bytes": f"SELECT {DOC_PATH} AS path, 'File Byte Size' AS metric, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS actual, CAST(2048 AS BIGINT) AS max_allowed FROM documents WHERE octet_length(encode(coalesce(text, ''))) > 2048",
    "file_budget_lines": f"SELECT path, 'Physical Lines (.' || lang || ')' AS metric, n AS actual, lim AS max_allowed FROM (SELECT {DOC_PATH} AS path, lang, CAST(len({_LINES}) AS BIGINT) AS n, CAST(CASE lang WHEN 'en' THEN 20 WHEN 'de' THEN 15 ELSE 10 END AS BIGINT) AS lim FROM documents WHERE source <> 'src3') WHERE n > lim",
    "line_size_breakdown": rf"SELECT path, CAST(len(l) AS BIGINT) AS lines, CAST(len(list_filter(l, lambda x: regexp_full_match(x, '[ \t\r]*'))) AS BIGINT) AS blank, CAST(len(list_filter(l, lambda x: NOT regexp_full_match(x, '[ \t\r]*'))) AS BIGINT) AS filled FROM (SELECT {DOC_PATH} AS path, {_LINES} AS l FROM documents)",
    "role_classification": f"SELECT role, count(*) AS n_files FROM (SELECT CASE page_id % {len(_PATH_CASE[0])} {_CASES} END AS role FROM pages) GROUP BY role",
    "custom_rule_first_match": "SELECT role, count(*) AS n_files FROM (SELECT CASE WHEN lower(p_type) LIKE '%steel%' THEN 'fixture' WHEN lower(p_brand) LIKE 'brand#1%' THEN 'test' WHEN lower(p_type) LIKE '%copper' THEN 'generated' ELSE 'source' END AS role FROM part) GROUP BY role",
    "severity_routing": "SELECT role, severity, count(*) AS n FROM (SELECT event_type AS role, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'ignore' WHEN 'click' THEN 'warning' ELSE 'error' END AS severity FROM events) WHERE severity <> 'ignore' GROUP BY ALL",
    "suppression_scan": r"SELECT CAST(page_id AS VARCHAR) AS path, 'eslint-disable' AS token, CAST((len(html) - len(replace(html, '<script', ''))) // 7 AS BIGINT) AS n FROM pages WHERE contains(html, '<script')",
    "invariant_scan": r"""WITH l AS (SELECT 'web/' || page_id || '.html' AS path, regexp_replace(unnest(CASE WHEN coalesce(html, '') = '' THEN [] ELSE regexp_split_to_array(regexp_replace(html, '\n\z', ''), '\r?\n') END), '(^|\s)(//|#(?:[^\[!]|$|![^\[])).*$', '') AS line FROM pages WHERE page_id <> 1)
        SELECT path, 'call' AS kind, 'track' AS target, count(*) AS n FROM l WHERE regexp_matches(line, '\btrack\s*\(') GROUP BY path UNION ALL SELECT path, 'token', 'script', count(*) FROM l WHERE regexp_matches(line, '\bscript\b') GROUP BY path""",
    "clone_windows": f"WITH {_WINDOWS.format(k=K)} SELECT stream, count(*) AS windows, count(DISTINCT h) AS distinct_windows FROM win GROUP BY stream",
    "clone_spans": f"WITH {_SPANS} SELECT * FROM spans",
    "clone_files": f"WITH {_SPANS} SELECT count(DISTINCT f) AS files FROM (SELECT a AS f FROM spans UNION ALL SELECT b FROM spans)",
    "clone_fingerprint": r"""WITH b AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
    h AS (SELECT item_id, hex(encode('clone-v1')) || array_to_string(list_transform(w, lambda t: lpad(printf('%X', octet_length(encode(t))), 16, '0') || hex(encode(t))), '') AS h FROM b),
    o AS (SELECT item_id, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS HUGEINT)) AS o FROM h)
    SELECT item_id, lower(lpad(to_hex(CAST(list_reduce(o, lambda s, c: xor(s, c) * 1099511628211 % 18446744073709551616, CAST(14695981039346656037 AS HUGEINT)) AS UBIGINT)), 16, '0')) AS fingerprint FROM o""",
    "clone_hash_capacity": f"WITH {_WINDOWS.format(k=3)} SELECT h, count(*) AS n FROM win GROUP BY h HAVING count(*) > 8",
    "coverage_floors": f"SELECT found, hit, round(hit / found * 100, 6) AS pct, hit / found * 100 < 60 AS below FROM (SELECT count(*) AS found, count(*) FILTER (hits > 0) AS hit FROM {DA})",
    "coverage_missing_source": "SELECT file, CASE WHEN n IS NULL THEN 'absent' ELSE 'ambiguous' END AS reason FROM (SELECT DISTINCT p_partkey * 2 AS file FROM part) LEFT JOIN (SELECT l_partkey * 100 + CAST(l_quantity AS BIGINT) AS file, count(*) AS n FROM lineitem GROUP BY 1) USING (file) WHERE n IS NULL OR n > 1",
    "coverage_critical": f"SELECT file, CASE WHEN found IS NULL THEN 'Missing Critical Path' ELSE 'Critical Path 100% Coverage' END AS finding, round(hit / found * 100, 6) AS pct FROM (SELECT DISTINCT s_suppkey * 2 AS file FROM supplier) LEFT JOIN (SELECT file, count(*) AS found, count(*) FILTER (hits > 0) AS hit FROM {DA} GROUP BY file) USING (file) WHERE found IS NULL OR hit < found",
    "coverage_diff_strict": _changed_sql(True),
    "coverage_diff_legacy": _changed_sql(False),
    "coverage_production_only": f"SELECT file, count(*) AS found, count(*) FILTER (hits > 0) AS hit FROM {DA} c WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey = c.file AND l_orderkey = c.line) GROUP BY file",
    "mutation_score": "SELECT user_id % 7 AS report, count(*) FILTER (event_type = 'signup') AS killed, count(*) FILTER (event_type = 'view') AS survived, count(*) FILTER (event_type = 'purchase') AS timeout, count(*) FILTER (event_type = 'error') AS compile_error, CAST(0 AS BIGINT) AS runner_error, CAST(0 AS BIGINT) AS equivalent, count(*) FILTER (event_type = 'click') AS unviable, CAST(0 AS BIGINT) AS unknown, count(*) AS total, round(coalesce(killed * 100.0 / nullif(killed + survived, 0), 0), 6) AS score, killed + survived = 0 OR coalesce(killed * 100.0 / nullif(killed + survived, 0), 0) < 85 AS below FROM events GROUP BY 1",
    "mutation_json_stryker": "SELECT user_id AS report, 'a.ts' AS file, CASE event_type WHEN 'click' THEN 'survived' ELSE 'killed' END AS category, count(*) AS n FROM events GROUP BY ALL",
    "ratchet_multiset": "WITH b AS (SELECT user_id, event_type, count(*) AS had FROM events WHERE event_id % 2 = 0 GROUP BY ALL) SELECT event_id, row_number() OVER (PARTITION BY e.user_id, e.event_type ORDER BY event_id) <= coalesce(had, 0) AS grandfathered FROM events e LEFT JOIN b ON e.user_id IS NOT DISTINCT FROM b.user_id AND e.event_type = b.event_type WHERE event_id % 2 = 1",
    "ratchet_numeric": "WITH c AS (SELECT o_custkey AS file, max(o_orderkey) AS ord, arg_max(o_totalprice, o_orderkey) AS actual, arg_min(o_totalprice, o_orderkey) AS base FROM orders GROUP BY 1) SELECT file, ord, actual, actual <= base AS grandfathered FROM c",
    "attribution_range": "WITH f AS (SELECT l_suppkey % 10 AS file, l_orderkey AS first, l_orderkey + l_linenumber % 3 AS last, l_linenumber FROM lineitem) SELECT * FROM f WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey % 10 = f.file AND o_orderkey BETWEEN f.first AND f.last)",
    "hunk_ranges": "WITH e AS (SELECT DISTINCT user_id AS file, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS line FROM events), g AS (SELECT *, line - row_number() OVER (PARTITION BY file ORDER BY line) AS island FROM e) SELECT file, min(line) AS first, max(line) AS last FROM g GROUP BY file, island",
    "rename_closure": "SELECT c_custkey AS path, CAST(1 AS BIGINT) AS origin FROM customer WHERE c_custkey > 1",
    "module_reachability": "WITH RECURSIVE e AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_partkey // 2 END AS src, p_partkey AS dst FROM part), r AS (SELECT p_partkey AS node, CAST(CASE WHEN p_partkey = 3 THEN 2 ELSE 1 END AS BIGINT) AS mask FROM part WHERE p_partkey IN (1, 3, 7) UNION SELECT e.dst, r.mask FROM r JOIN e ON e.src = r.node) SELECT node, bit_or(mask) AS mask FROM r GROUP BY node",
    "report_compare": "WITH o AS (SELECT o_custkey AS file, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 50 END AS line, o_orderpriority AS identity, o_orderstatus AS s FROM orders), b AS (SELECT DISTINCT file, line, identity FROM o WHERE s <> 'F'), a AS (SELECT DISTINCT file, line, identity FROM o WHERE s <> 'O') SELECT *, 'retained' AS change FROM (SELECT * FROM b INTERSECT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'added' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
    "report_compare_text": """WITH o AS (SELECT o_orderstatus AS engine, CAST(o_custkey AS VARCHAR) AS file, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 50 END AS line, o_orderpriority AS identity, o_orderkey AS k FROM orders),
    b AS (SELECT DISTINCT engine, file, line, identity FROM o WHERE k % 4 > 0), a AS (SELECT DISTINCT engine, file, line, identity FROM o WHERE k % 4 < 3), r AS (SELECT * FROM b EXCEPT SELECT * FROM a), n AS (SELECT * FROM a EXCEPT SELECT * FROM b),
    f AS (SELECT 7 AS section, * FROM r UNION ALL SELECT 9, * FROM n), e AS (SELECT count(*) FILTER (k % 4 > 0) AS eb, count(*) FILTER (k % 4 < 3) AS ea FROM o), c AS (SELECT (SELECT count(*) FROM n) AS na, (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM b) - (SELECT count(*) FROM r) AS nk)
    SELECT 0 AS section, CAST(0 AS BIGINT) AS nth, 'report compare: a.json vs b.json' AS text UNION ALL SELECT 1, 0, repeat('-', 70) UNION ALL SELECT 2, 0, 'verdict: before: FAIL (' || eb || ' errors) -> after: FAIL (' || ea || ' errors)' FROM e UNION ALL SELECT 3, 0, 'diff: +' || na || ' added, -' || nr || ' removed, ' || nk || ' retained' FROM c
    UNION ALL SELECT 4, 0, 'warning: Non-equivalent comparison' UNION ALL SELECT 5, row_number() OVER (ORDER BY r_name), '  - scope of ' || r_name FROM region UNION ALL SELECT 6, 0, 'Removed findings (-' || nr || '):' FROM c UNION ALL SELECT 8, 0, 'New findings (+' || na || '):' FROM c
    UNION ALL SELECT section, row_number() OVER (PARTITION BY section ORDER BY engine, file, line NULLS FIRST, identity), '  - [' || engine || '] ' || file || coalesce(':' || line, '') || ': ' || identity FROM f""",
    "top_files": "SELECT user_id AS file, count(*) AS findings FROM events GROUP BY 1 ORDER BY findings DESC, file LIMIT 10",
    "top_files_filter": "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10))",
    "function_reviews": "SELECT l_orderkey, l_partkey, string_agg(l_linenumber || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_suppkey) AS metrics, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "grouped_advisories": "SELECT message, sum(c)::BIGINT AS n, array_to_string(list_sort(list(DISTINCT conv_id))[1:3], ', ') AS locations FROM (SELECT role || ' ' || length(text) % 5 AS message, conv_id, 1 AS c FROM conversations) GROUP BY message",
    "engine_states": "SELECT user_id AS engine, (['disabled', 'skipped', 'cached', 'completed', 'failed', 'incomplete'])[max(CASE WHEN event_type = 'error' AND event_id % 13 >= 5 THEN 0 ELSE event_id % 13 % 6 END) + 1] AS state FROM events GROUP BY 1",
    "verdict": "SELECT blocking, total, incomplete, blocking = 0 AND NOT incomplete AS passed, CAST(CASE WHEN incomplete THEN 2 WHEN blocking > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM (SELECT count(*) FILTER (event_type = 'error') AS blocking, count(*) AS total, coalesce(bool_or(value IS NULL), false) AS incomplete FROM events)",
    "summary_rollup": "SELECT count(*) AS total, count(DISTINCT user_id) AS files, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS n_{t}" for t in ("signup", "view", "error", "click", "purchase")) + " FROM events",
    "canonical_order_limit": "SELECT event_type, user_id, event_id FROM events ORDER BY event_type, user_id, event_id LIMIT 100",
    "complexity_unpivot": "WITH m AS (SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS cyclomatic, CAST(count(*) AS DOUBLE) AS parameters, CAST(max(l_quantity) AS DOUBLE) AS lines, CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS depth, CAST(max(l_linenumber) AS DOUBLE) AS statements FROM lineitem GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT l_orderkey, '{m}' AS metric, {m} AS actual, CAST({v} AS DOUBLE) AS max_allowed FROM m WHERE {m} > {v}" for m, v in (("cyclomatic", 200), ("parameters", 5), ("lines", 48), ("depth", 6), ("statements", 6))),
    "contributors_top5": "WITH q AS (SELECT l_suppkey, l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_orderkey) AS n FROM q) SELECT l_suppkey, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY n) AS lines FROM r WHERE n <= 5 GROUP BY 1",
    "tool_dedup": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS targets, min(event_id) AS first_seen FROM events GROUP BY 1, 2",
    "input_identity_diff": "WITH b AS (SELECT doc_id, sha256(coalesce(text, '')) AS before FROM documents), a AS (SELECT doc_id + 1 AS doc_id, sha256(coalesce(text, '')) AS after FROM documents) SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, before, after FROM b FULL JOIN a ON b.doc_id = a.doc_id WHERE before IS DISTINCT FROM after",
    "partition_cover": "WITH c AS (SELECT l_partkey * 3 AS source, count(DISTINCT l_suppkey % 3) AS n FROM lineitem GROUP BY 1), s AS (SELECT DISTINCT p_partkey * 2 AS source, true AS known FROM part), j AS (SELECT coalesce(c.source, s.source) AS source, CASE WHEN n IS NULL THEN 'uncovered' WHEN known IS NULL THEN 'unknown' WHEN n > 1 THEN 'overlap' END AS problem FROM s FULL JOIN c ON s.source = c.source) SELECT * FROM j WHERE problem IS NOT NULL",
}

for _part in (clone_queries, history_queries, tree_queries, stream_queries, source_queries, gate_queries, report_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
