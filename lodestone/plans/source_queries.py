"""Queries of sources: changes, files, LCOV, compilers and mutation reports made of the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mutation
from ..sources import lcov, repository, tools
from . import lineage
from .tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _events(spark, d):
    """Events, of which those without a user make a report of their own, -1."""
    return table(spark, d, "events").withColumn("user_id", F.coalesce("user_id", F.lit(-1)))


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def _joined(rows, key: str, order: str, text, by: str):
    """Texts of the rows of a key, in order, as one."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x["t"]), by).alias("text"))


# Changes -----------------------------------------------------------------


def _status(spark, d):
    k = F.col("o_orderkey").cast("string")
    rec = F.element_at(F.array(F.concat(F.lit(" M a/"), k, F.lit(".ts")), F.concat(F.lit("?? b/"), k, F.lit(".py")), F.concat(F.lit("R  new/"), k, F.lit(".rs\x00old/"), k, F.lit(".rs")), F.concat(F.lit(" D gone/"), k, F.lit(".ts"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    texts = _joined(table(spark, d, "orders"), "o_custkey", "o_orderkey", F.concat(rec, F.lit("\x00")), "")
    return repository.porcelain(texts, "o_custkey")


_STATUS = "SELECT o_custkey AS report, CASE o_orderkey % 4 WHEN 0 THEN ' M' WHEN 1 THEN '??' WHEN 2 THEN 'R ' ELSE ' D' END AS marker, CASE o_orderkey % 4 WHEN 0 THEN 'a/' || o_orderkey || '.ts' WHEN 1 THEN 'b/' || o_orderkey || '.py' WHEN 2 THEN 'new/' || o_orderkey || '.rs' ELSE 'gone/' || o_orderkey || '.ts' END AS path, CASE WHEN o_orderkey % 4 = 2 THEN 'old/' || o_orderkey || '.rs' END AS old, CAST(NULL AS VARCHAR) AS problem FROM orders"


@query("status_porcelain", _STATUS)
def status_porcelain(spark, d):
    return _status(spark, d)


@query("changed_paths", f"SELECT report, path, marker = '??' AS untracked FROM ({_STATUS}) WHERE marker <> ' D'")
def changed_paths(spark, d):
    return repository.changed_paths(_status(spark, d))


@query(
    "name_status",
    "SELECT o_custkey AS report, CASE o_orderkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'R' WHEN 2 THEN 'C' ELSE 'A' END AS marker, CASE o_orderkey % 4 WHEN 1 THEN 'old/' || o_orderkey || '.rs' WHEN 2 THEN 'x/' || o_orderkey || '.py' END AS old, CASE o_orderkey % 4 WHEN 0 THEN 'a/' || o_orderkey || '.ts' WHEN 1 THEN 'new/' || o_orderkey || '.rs' WHEN 2 THEN 'y/' || o_orderkey || '.py' ELSE 'node_modules/' || o_orderkey || '.js' END AS path, o_orderkey % 4 = 1 AS lineage, CAST(NULL AS VARCHAR) AS problem FROM orders",
)
def name_status(spark, d):
    k = F.col("o_orderkey").cast("string")
    rec = F.element_at(F.array(F.concat(F.lit("M\x00a/"), k, F.lit(".ts\x00")), F.concat(F.lit("R100\x00old/"), k, F.lit(".rs\x00new/"), k, F.lit(".rs\x00")), F.concat(F.lit("C075\x00x/"), k, F.lit(".py\x00y/"), k, F.lit(".py\x00")), F.concat(F.lit("A\x00node_modules/"), k, F.lit(".js\x00"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return repository.name_status(_joined(table(spark, d, "orders"), "o_custkey", "o_orderkey", rec, ""), "o_custkey")


@query("diff_lines", "SELECT l_orderkey AS diff, 'f' || l_suppkey || '.ts' AS file, CAST(unnest(range(l_linenumber * 10, l_linenumber * 11)) AS BIGINT) AS line FROM lineitem")
def diff_lines(spark, d):
    f, n = F.concat(F.lit("f"), F.col("l_suppkey").cast("string"), F.lit(".ts")), F.col("l_linenumber")
    one = F.concat(F.lit("diff --git a/"), f, F.lit(" b/"), f, F.lit("\n--- a/"), f, F.lit("\n+++ b/"), f, F.lit("\n@@ -1 +"), (n * 10).cast("string"), F.lit(","), n.cast("string"), F.lit(" @@\n+++ b/other.ts\n--- a/other.ts\n-z\n@@ -9,2 +3,0 @@\n-q\n"))
    return repository.changed_lines(_joined(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", one, "").withColumnRenamed("l_orderkey", "diff"))


@query("quoted_paths", "SELECT c_custkey, c_name || chr(9) || 'é' AS path, CAST(NULL AS VARCHAR) AS problem FROM customer UNION ALL SELECT -c_custkey, NULL, 'octal escape above 255' FROM customer")
def quoted_paths(spark, d):
    c = table(spark, d, "customer")
    raw = F.concat(F.lit('"'), F.replace("c_name", F.lit("0"), F.lit("\\060")), F.lit('\\t\\303\\251"'))
    rows = c.select("c_custkey", raw.alias("raw")).union(c.select(-F.col("c_custkey"), F.lit('"a\\777"')))
    return rows.select("c_custkey", repository.unquoted_path("raw").alias("x")).select("c_custkey", "x.path", "x.problem")


_DOC = "source || '/' || doc_id || '.' || lang"
_LINES = r"CASE WHEN coalesce(text, '') = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '\n\z', ''), '\r?\n') END"


@query("untracked_lines", f"SELECT {_DOC} AS file, CAST(len(l) AS BIGINT) AS n, CAST(len(l) AS BIGINT) AS last FROM (SELECT *, {_LINES} AS l FROM documents) WHERE len(l) > 0")
def untracked_lines(spark, d):
    files = table(spark, d, "documents").select(F.expr(_DOC).alias("path"), "text")
    return repository.untracked_lines(files).groupBy("file").agg(F.count("*").alias("n"), F.max("line").alias("last"))


def _raw_files(spark, d):
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return table(spark, d, "documents").select("doc_id", F.expr("'d' || doc_id % 10 || '/' || doc_id || '.ts'").alias("path"), F.when(F.col("doc_id") % 3 == 0, F.concat(body, F.unhex(F.lit("FF")))).otherwise(body).alias("content"))


_FILE = "'d' || doc_id % 10 || '/' || doc_id || '.ts'"


@query("undecodable_changes", f"SELECT {_FILE} AS path FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 1")
def undecodable_changes(spark, d):
    files = _raw_files(spark, d)
    return repository.undecodable(files.select("path", "content"), files.select("path", (F.col("doc_id") % 2 == 0).alias("untracked")))


@query("source_snapshot", f"SELECT row_number() OVER (ORDER BY 'd' || doc_id % 10, doc_id || '.ts') - 1 AS id, {_FILE} AS path, CASE WHEN doc_id % 3 > 0 THEN md5(coalesce(text, '')) END AS digest, CASE WHEN doc_id % 3 = 0 THEN 'not UTF-8' END AS read_error FROM documents")
def source_snapshot(spark, d):
    files = _raw_files(spark, d).select("path", "content")
    return repository.snapshot(files.union(files)).select("id", "path", F.md5("text").alias("digest"), "read_error")


def _filters(spark):
    return spark.createDataFrame([("./d3", False), ("d5/15.ts", True), ("new/x.ts", True), ("d4/", False)], "filter string, is_file boolean")


_SCOPED = f"SELECT path FROM (SELECT {_FILE} AS path FROM documents) WHERE path LIKE 'd3/%' OR path LIKE 'd4/%' OR path = 'd5/15.ts' UNION SELECT 'd5/15.ts' UNION SELECT 'new/x.ts'"


@query("path_scope", _SCOPED)
def path_scope(spark, d):
    return repository.scoped(_raw_files(spark, d), _filters(spark))


@query("scope_selection", f"WITH s AS ({_SCOPED}), f AS (SELECT {_FILE} AS path FROM documents WHERE doc_id % 4 = 0 UNION SELECT path FROM s) SELECT path, path IN (SELECT {_FILE} FROM documents WHERE doc_id % 6 = 0) AS excluded FROM f")
def scope_selection(spark, d):
    files = _raw_files(spark, d)
    chosen, out = repository.selected(files.where("doc_id % 4 = 0"), files, _filters(spark), files.where("doc_id % 6 = 0"), True)
    return chosen.join(out.withColumn("excluded", F.lit(True)), "path", "left").select("path", F.coalesce("excluded", F.lit(False)).alias("excluded"))


@query("input_digests", "SELECT 'src/' || doc_id AS path, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE doc_id % 5 > 0 AND doc_id <> 7")
def input_digests(spark, d):
    path = F.expr("CASE WHEN doc_id % 5 = 0 THEN 'a/target/' || doc_id ELSE 'src/' || doc_id END")
    files = table(spark, d, "documents").select(path.alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return repository.input_digests(files, ["src/7"])


@query("ignored_paths", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true ELSE false END AS ignored FROM part")
def ignored_paths(spark, d):
    k = F.col("p_partkey").cast("string")
    path = F.element_at(F.array(F.concat(F.lit("a/b/"), k, F.lit(".log")), F.concat(F.lit("a/keep"), k, F.lit(".log")), F.concat(F.lit("top/"), k, F.lit("/x.ts")), F.concat(F.lit("a/top/"), k, F.lit(".ts")), F.concat(F.lit("docs/q/"), k, F.lit("/x.md")), F.concat(F.lit("src/"), k, F.lit(".ts"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", repository.ignored(path, ["# notes", "*.log", "!keep*.log", "/top/", "docs/**/x.md", ""]).alias("ignored"))


_REPORT = "array<struct<path: string, line: int>>"


@query("report_round_trip", "SELECT user_id AS report, CAST(NULL AS BOOLEAN) AS passed, CAST(NULL AS BIGINT) AS n, 'malformed' AS problem FROM (SELECT * REPLACE (coalesce(user_id, -1) AS user_id) FROM events) WHERE user_id % 5 = 0 GROUP BY 1 UNION ALL SELECT user_id, user_id % 5 = 1, count(*), CASE user_id % 5 WHEN 1 THEN 'passed with findings' WHEN 2 THEN 'unknown version' END FROM (SELECT * REPLACE (coalesce(user_id, -1) AS user_id) FROM events) WHERE user_id % 5 > 0 GROUP BY 1")
def report_round_trip(spark, d):
    e = _events(spark, d)
    r = e.groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("file"), F.col("event_id").alias("line"))).alias("findings"))
    body = F.to_json(F.struct(F.when(F.col("user_id") % 5 == 2, 2).otherwise(1).alias("schema_version"), (F.col("user_id") % 5 == 1).alias("passed"), "findings"))
    texts = r.select(F.col("user_id").alias("report"), F.when(F.col("user_id") % 5 == 0, "{broken").otherwise(body).alias("body"))
    return repository.parsed_reports(texts, "file: string, line: long").select("report", "passed", F.size("findings").cast("long").alias("n"), "problem")


# LCOV --------------------------------------------------------------------

_RECORD = """SF:./src/{k}/../{k}/{n}.ts
FN:1,f{n}
FN:2,5,g,{n}
FNDA:{q},f{n}
FNDA:0,g,{n}
FNF:2
FNH:1
DA:1,{q}
DA:2,{e}
BRDA:1,0,a,b,-
BRDA:2,0,c,{e}
BRF:2
BRH:{e}
LF:2
LH:{h}
end_of_record
"""


def _dealt(rows, key: str):
    """The rows in as many parts as are configured, also where they are few bytes, since texts are made of them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _lcov_texts(spark, d, record: str = _RECORD):
    """(report, text): a report for each order. Numbers are gathered by order, and texts made of them there, so that no text is shuffled."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("q"))
    rows = _dealt(li, "report").groupBy("report").agg(F.array_sort(F.collect_list(F.struct("n", "q"))).alias("items"))

    def body(x):
        e = x["n"] % 2
        named = {"{k}": F.col("report"), "{n}": x["n"], "{q}": x["q"], "{e}": e, "{h}": e + 1}
        return F.concat(*(named[t].cast("string") if t in named else F.lit(t) for t in re.split(r"(\{[knqeh]\})", record) if t))

    return rows.select("report", F.concat(F.lit("TN:t\n"), F.array_join(F.transform("items", body), "")).alias("text"))


def _lcov(spark, d, record: str = _RECORD):
    return lcov.entries(_lcov_texts(spark, d, record))


_SF = "'./src/' || l_orderkey || '/../' || l_orderkey || '/' || l_linenumber || '.ts'"
_Q = "CAST(l_quantity AS BIGINT)"
_E = "CAST(l_linenumber % 2 AS BIGINT)"


@query("lcov_lines", f"SELECT l_orderkey AS report, 'src/' || l_orderkey || '/' || l_linenumber || '.ts' AS file, CAST(1 AS BIGINT) AS line, {_Q} AS hits FROM lineitem UNION ALL SELECT l_orderkey, 'src/' || l_orderkey || '/' || l_linenumber || '.ts', 2, {_E} FROM lineitem")
def lcov_lines(spark, d):
    return lcov.line_hits(_lcov(spark, d)).select("report", T.record_key(F.col("file")).alias("file"), "line", "hits")


@query("lcov_functions", f"SELECT l_orderkey AS report, {_SF} AS file, 'f' || l_linenumber AS name, CAST(1 AS BIGINT) AS line, {_Q} AS hits FROM lineitem UNION ALL SELECT l_orderkey, {_SF}, 'g,' || l_linenumber, 2, 0 FROM lineitem")
def lcov_functions(spark, d):
    return lcov.functions(_lcov(spark, d)).select("report", "file", "name", "line", "hits")


@query("lcov_branches", f"SELECT l_orderkey AS report, {_SF} AS file, CAST(1 AS BIGINT) AS line, '0' AS block, 'a,b' AS branch, CAST(NULL AS BIGINT) AS taken FROM lineitem UNION ALL SELECT l_orderkey, {_SF}, 2, '0', 'c', {_E} FROM lineitem")
def lcov_branches(spark, d):
    return lcov.branches(_lcov(spark, d)).drop("record")


@query("lcov_records", f"SELECT l_orderkey AS report, {_SF} AS file, CAST(2 AS BIGINT) AS lines_found, {_E} + 1 AS lines_hit, CAST(2 AS BIGINT) AS functions_found, CAST(1 AS BIGINT) AS functions_hit, CAST(2 AS BIGINT) AS branches_found, {_E} AS branches_hit FROM lineitem")
def lcov_records(spark, d):
    return lcov.records(_lcov(spark, d)).drop("record")


def _lcov_files(spark, d, parts: int) -> str:
    """All of lineitem as LCOV files in a new folder that executors share."""
    folder = lineage.fresh_folder(spark, "lcov")
    text = "SF:./src/{k}/{n}.ts\nFNF:2\nFNH:1\nDA:1,{q}\nDA:2,{e}\nBRF:2\nBRH:{e}\nLF:2\nLH:{h}\nend_of_record"
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), (F.col("l_linenumber") % 2).alias("e"))
    row = F.lit(text)
    for name, c in (("{k}", F.col("l_orderkey")), ("{n}", F.col("l_linenumber")), ("{q}", F.col("q")), ("{e}", F.col("e")), ("{h}", F.col("e") + 1)):
        row = F.replace(row, F.lit(name), c.cast("string"))
    li.select(row.alias("value")).repartition(parts).write.text(folder)
    return folder


@query("lcov_report_files", f"SELECT './src/' || l_orderkey || '/' || l_linenumber || '.ts' AS file, CAST(2 AS BIGINT) AS lines_found, {_E} + 1 AS lines_hit, CAST(2 AS BIGINT) AS functions_found, CAST(1 AS BIGINT) AS functions_hit, CAST(2 AS BIGINT) AS branches_found, {_E} AS branches_hit FROM lineitem")
def lcov_report_files(spark, d):
    """Reports in files, whose splits are read apart."""
    return lcov.records(lcov.read_reports(spark, _lcov_files(spark, d, 4))).drop("report", "record")


_GENERIC = "SF:src/{k}/{n}.rs\nFN:1,f<i32>\nFN:1,f<i64>\nFN:9,h\nFNDA:{e},f<i32>\nFNDA:1,f<i64>\nFNDA:0,h\nFNF:2\nFNH:1\nDA:1,1\nDA:9,0\nLF:2\nLH:1\nend_of_record\n"


@query("lcov_function_projection", "SELECT l_orderkey AS report, CAST(l_linenumber - 1 AS BIGINT) AS record, CAST(x AS BIGINT) AS line, x = 1 AS hit FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS l_linenumber FROM lineitem), (VALUES (1), (9)) v(x)")
def lcov_function_projection(spark, d):
    return lcov.function_projection(_lcov(spark, d, _GENERIC))


@query("lcov_production", f"SELECT l_orderkey AS report, {_SF} AS file, CAST(1 AS BIGINT) AS lines_found, CAST(1 AS BIGINT) AS lines_hit, CAST(1 AS BIGINT) AS functions_found, CAST(1 AS BIGINT) AS functions_hit, CAST(1 AS BIGINT) AS branches_found, CAST(0 AS BIGINT) AS branches_hit, CAST(NULL AS VARCHAR) AS problem FROM lineitem WHERE l_linenumber > 2 UNION ALL SELECT l_orderkey, {_SF}, 2, {_E} + 1, 2, 1, 2, {_E}, NULL FROM lineitem WHERE l_linenumber <= 2")
def lcov_production(spark, d):
    found = lcov.record_rows(_lcov_texts(spark, d))
    tests = table(spark, d, "lineitem").where("l_linenumber > 2").select(F.expr(_SF).alias("file"), F.lit(2).cast("long").alias("line"))
    return lcov.production(found, tests).drop("record")


_FAULTS = ("LH:1\n", "DA:2,0\n", "FOO:1\n", "", "FNDA:0,z\n", "MCDC:1\n", "DA:0,1\n")
_FOUND = ("duplicate counter", "duplicate line", "unknown tag", None, "functions and their hits disagree", "unsupported tag", "malformed line")


@query("lcov_problems", "SELECT l_orderkey AS report, CASE l_linenumber % 7 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_FOUND) if p) + " END AS problem, count(*) AS n FROM lineitem WHERE l_linenumber % 7 <> 3 GROUP BY 1, 2")
def lcov_problems(spark, d):
    li = table(spark, d, "lineitem")
    parts = ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    rows = _dealt(li.select(F.col("l_orderkey").alias("report"), *parts), "report").groupBy("report").agg(F.collect_list(F.struct(*parts)).alias("items"))

    def body(x):
        fault = F.element_at(F.array(*map(F.lit, _FAULTS)), (x["l_linenumber"] % 7 + 1).cast("int"))
        return F.concat(F.lit("SF:"), F.concat_ws("/", *(x[c].cast("string") for c in parts)), F.lit("\nFN:1,f\nFNDA:1,f\nFNF:1\nFNH:1\nDA:1,1\nDA:2,0\nLF:2\nLH:1\n"), fault, F.lit("end_of_record\n"))

    # Records are in order of their lines, then of their texts.
    items = F.array_sort(F.transform("items", lambda x: F.struct(x["l_linenumber"].alias("o"), body(x).alias("t"))))
    found = lcov.record_rows(rows.select("report", F.array_join(F.transform(items, lambda x: x["t"]), "").alias("text")))
    return lcov.problems(found).groupBy("report", "problem").agg(F.count("*").alias("n"))


@query("lcov_union", "SELECT 'src/' || l_partkey || '/' || l_linenumber || '.ts' AS file, count(DISTINCT l_orderkey) AS reports FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def lcov_union(spark, d):
    li = table(spark, d, "lineitem")
    text = F.concat(F.lit("SF:src/"), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit(".ts\nDA:1,1\nLF:1\nLH:1\nend_of_record\n"))
    found = lcov.entries(_joined(li, "l_orderkey", "l_linenumber", text, "").withColumnRenamed("l_orderkey", "report"))
    return lcov.union_of(found)[1]


@query(
    "python_native_zeros",
    "SELECT p_partkey AS report, CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE CAST(0 AS BIGINT) END AS lf, CAST(0 AS BIGINT) AS fnf, CAST(2 AS BIGINT) AS brf, CASE p_partkey % 3 WHEN 1 THEN 'omitted lf/lh that isn''t empty' WHEN 2 THEN 'no branch execution' END AS problem FROM part",
)
def python_native_zeros(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("report"))
    found = lcov.entries(p.select("report", F.lit("SF:a.py\nBRF:2\nBRH:1\nend_of_record\n").alias("text")))
    region = F.struct(F.struct(F.lit(0).alias("num_statements"), F.lit(0).alias("covered_lines")).alias("summary"))
    n = F.when(F.col("report") % 3 == 1, 4).otherwise(0)
    summary = F.struct(n.alias("num_statements"), F.lit(0).alias("covered_lines"), F.lit(2).alias("num_branches"), F.lit(1).alias("covered_branches"))
    body = F.to_json(F.struct(F.struct((F.col("report") % 3 != 2).alias("branch_coverage")).alias("meta"), F.create_map(F.lit("a.py"), F.struct(summary.alias("summary"), F.create_map(F.lit("f"), region).alias("functions"))).alias("files")))
    filled, bad = lcov.with_native_zeros(found, lcov.native_counters(p.select("report", body.alias("body"))))
    return filled.join(bad.select("report", "problem"), "report", "left").select("report", "lf", "fnf", "brf", "problem")


# Compilers ---------------------------------------------------------------


def _messages(spark, d):
    e = _events(spark, d)
    kind = F.col("event_type")
    span = F.struct(F.lit(True).alias("is_primary"), F.concat(F.lit("src/"), kind, F.lit(".rs")).alias("file_name"), (F.col("event_id") % 3).alias("line_start"), F.lit(1).alias("column_start"), (F.col("event_id") % 3 + 1).alias("line_end"))
    message = F.struct(F.when(kind == "error", "error").when(kind == "view", "note").otherwise("warning").alias("level"), F.lit("said").alias("message"), F.struct(F.when(kind == "click", "clippy::x").otherwise("E1").alias("code")).alias("code"), F.array(span).alias("spans"), F.lit('a "quoted" text').alias("rendered"))
    body = F.to_json(F.struct(F.lit("compiler-message").alias("reason"), F.lit("p 1").alias("package_id"), F.struct(F.concat(F.lit("t"), (F.col("event_id") % 2).cast("string")).alias("name")).alias("target"), message.alias("message")))
    ends = e.groupBy("user_id").agg((F.max("event_id") + 1).alias("seq")).where("user_id % 4 > 0").select("user_id", "seq", F.lit('{"reason":"build-finished","success":true}').alias("line"))
    chatter = e.groupBy("user_id").agg((F.min("event_id") - 1).alias("seq")).select("user_id", "seq", F.lit('{"reason":"compiler-artifact","x":1}').alias("line"))
    return e.select("user_id", F.col("event_id").alias("seq"), body.alias("line")).union(ends).union(chatter)


@query(
    "compiler_messages",
    """SELECT user_id, CASE event_type WHEN 'click' THEN 'clippy' ELSE 'rustc' END AS tool, CASE event_type WHEN 'click' THEN 'clippy::x' ELSE 'E1' END AS rule, CASE event_type WHEN 'error' THEN 'error' ELSE 'warning' END AS level, 'src/' || event_type || '.rs' AS file, event_id % 3 AS line,
    min(event_id) AS seq, string_agg(DISTINCT '{"name":"t' || event_id % 2 || '"}', ',' ORDER BY '{"name":"t' || event_id % 2 || '"}') AS targets, event_type = 'error' AS blocking FROM (SELECT * REPLACE (coalesce(user_id, -1) AS user_id) FROM events) WHERE event_type <> 'view' GROUP BY user_id, event_type, event_id % 3""",
)
def compiler_messages(spark, d):
    kept, _ = tools.bounded(_messages(spark, d), ["user_id"])
    found, _ = tools.messages(kept, ["user_id"])
    return found.select("user_id", "tool", "rule", "level", "file", "line", "seq", F.array_join("targets", ",").alias("targets"), "blocking")


@query("compiler_streams", "SELECT user_id, user_id % 4 > 0 AS complete, CASE WHEN user_id % 4 > 0 THEN true END AS success, false AS truncated, count(*) + CASE WHEN user_id % 4 > 0 THEN 1 ELSE 0 END AS n FROM (SELECT * REPLACE (coalesce(user_id, -1) AS user_id) FROM events) GROUP BY user_id")
def compiler_streams(spark, d):
    kept, cut = tools.bounded(_messages(spark, d), ["user_id"])
    _, state = tools.messages(kept, ["user_id"])
    n = kept.where(~F.contains("line", F.lit('"rendered"')) & ~F.contains("line", F.lit("compiler-artifact"))).groupBy("user_id").agg(F.count("*").alias("n"))
    return state.join(cut, "user_id").join(n, "user_id")


# Mutation reports --------------------------------------------------------

_KINDS = ("signup", "view", "error", "click", "purchase")


def _by_user(spark, d, *columns):
    return _events(spark, d).groupBy(F.col("user_id").alias("report")).agg(*columns)


def _n(kind: str) -> str:
    return f"count(*) FILTER (event_type = '{kind}')"


@query(
    "mutation_stryker_stats",
    f"SELECT user_id AS report, {_n('signup')} AS killed, {_n('view')} AS survived, {_n('purchase')} AS timeout, {_n('error')} AS compile_error, {_n('click')} AS unviable, count(*) AS total, CASE WHEN user_id % 3 = 0 THEN 'declared total differs' END AS problem FROM (SELECT * REPLACE (coalesce(user_id, -1) AS user_id) FROM events) GROUP BY 1",
)
def mutation_stryker_stats(spark, d):
    return mutation.stryker_stats(_stryker(spark, d)).select("report", "killed", "survived", "timeout", "compile_error", "unviable", "total", "problem")


def _stryker(spark, d):
    said = F.create_map(*(F.lit(x) for p in zip(_KINDS, (" Killed", "Survived", "Compilation-Error", "No Coverage", "Timed/Out")) for x in p))
    m = F.struct(F.col("event_id").cast("string").alias("id"), F.element_at(said, F.col("event_type")).alias("status"), F.struct(F.struct((F.col("event_id") % 9).alias("line"), F.when(F.col("event_id") % 2 == 0, 4).alias("column")).alias("start")).alias("location"))
    rows = _by_user(spark, d, F.collect_list(m).alias("mutants"), F.count("*").alias("n"))
    body = F.to_json(F.struct(F.create_map(F.lit("a.ts"), F.struct("mutants")).alias("files"), F.when(F.col("report") % 3 == 0, F.col("n") + 1).when(F.col("report") % 3 == 1, F.col("n")).alias("total")))
    return rows.select("report", body.alias("body"))


@query("mutation_unexecuted", "SELECT user_id AS report, 'a.ts:' || event_id % 9 || ':' || CASE WHEN event_id % 2 = 0 THEN '4' ELSE '?' END || ' (mutant ' || event_id || ', No Coverage)' AS place FROM (SELECT * REPLACE (coalesce(user_id, -1) AS user_id) FROM events) WHERE event_type = 'click'")
def mutation_unexecuted(spark, d):
    return mutation.unexecuted(_stryker(spark, d))


_VIOLATIONS = f"""WITH s AS (SELECT user_id AS report, {_n('signup')} AS k, {_n('view')} AS v, {_n('purchase')} AS t, {_n('error')} AS c, {_n('click')} AS u FROM (SELECT * REPLACE (coalesce(user_id, -1) AS user_id) FROM events) WHERE user_id % 3 > 0 GROUP BY 1)
SELECT report, 'Mutation Unexecuted Mutants' AS metric, CAST(u AS DOUBLE) AS actual, CAST(0 AS DOUBLE) AS floor_value FROM s WHERE u > 0 UNION ALL SELECT report, 'Mutation Timeouts', t, 0 FROM s WHERE t > 0 UNION ALL SELECT report, 'Mutation Compile Errors', c, 0 FROM s WHERE c > 0
UNION ALL SELECT report, 'Mutation Kill Rate', round(coalesce(k * 100.0 / nullif(k + v, 0), 0), 6), 85 FROM s WHERE k + v = 0 OR k * 100.0 / (k + v) < 85"""


@query("mutation_violations", _VIOLATIONS)
def mutation_violations(spark, d):
    return mutation.evaluated(_stryker(spark, d))[0].select("report", "metric", F.round("actual", 6).alias("actual"), F.col("limit").alias("floor_value"))


def _cargo(spark, d):
    e = _events(spark, d)
    kind = F.when(F.col("event_type") == "error", "purchase").otherwise(F.col("event_type"))
    phase = lambda name, status, argv: F.struct(F.lit(name).alias("phase"), status.alias("process_status"), F.array(*map(F.lit, argv)).alias("argv"))
    text = F.create_map(*(F.lit(x) for p in (("signup", "CaughtMutant"), ("view", "MissedMutant"), ("click", "Unviable"), ("purchase", "Timeout")) for x in p))
    # Statuses are texts or objects; the quotes around objects are taken out again below.
    failed = F.lit('{@Failure@:101}')
    built = F.when(kind == "click", failed).otherwise("Success")
    tested = F.when(kind == "signup", failed).when(kind == "purchase", "Timeout").otherwise("Success")
    phases = F.when(kind == "click", F.array(phase("Build", built, ["cargo", "build"]))).otherwise(F.array(phase("Build", built, ["cargo", "build"]), phase("Test", tested, ["cargo", "test"])))
    o = F.struct(F.concat(F.lit('{@Mutant@:{@id@:'), F.col("event_id").cast("string"), F.lit("}}")).alias("scenario"), F.element_at(text, kind).alias("summary"), phases.alias("phase_results"))
    rows = e.groupBy(F.col("user_id").alias("report")).agg(F.collect_list(o).alias("m"), *(F.count_if(kind == k).alias(k) for k in ("signup", "view", "click", "purchase")), F.count("*").alias("n"))
    base = F.array(F.struct(F.lit("Baseline").alias("scenario"), F.lit("Success").alias("summary"), F.array(phase("Build", F.lit("Success"), ["cargo", "build"]), phase("Test", F.lit("Success"), ["cargo", "test"])).alias("phase_results")))
    body = F.to_json(F.struct(F.lit("25.1").alias("cargo_mutants_version"), F.lit("t").alias("end_time"), F.concat(F.when(F.col("report") % 5 == 4, F.array().cast("array<struct<scenario:string,summary:string,phase_results:array<struct<phase:string,process_status:string,argv:array<string>>>>>")).otherwise(base), "m").alias("outcomes"), F.col("n").alias("total_mutants"), F.col("signup").alias("caught"), (F.col("view") + F.when(F.col("report") % 5 == 3, 1).otherwise(0)).alias("missed"), F.col("purchase").alias("timeout"), F.col("click").alias("unviable"), F.lit(0).alias("success")))
    return rows.select("report", F.regexp_replace(F.regexp_replace(body, r'"(\{@[^"]*\})"', "$1"), "@", '"').alias("body"))


@query(
    "mutation_cargo_stats",
    f"SELECT user_id AS report, {_n('signup')} AS killed, {_n('view')} AS survived, count(*) FILTER (event_type IN ('purchase', 'error')) AS timeout, {_n('click')} AS unviable, count(*) AS total, CASE user_id % 5 WHEN 3 THEN 'declared counters differ' WHEN 4 THEN 'no baseline that passed' END AS problem FROM (SELECT * REPLACE (coalesce(user_id, -1) AS user_id) FROM events) GROUP BY 1",
)
def mutation_cargo_stats(spark, d):
    return mutation.cargo_stats(_cargo(spark, d)).select("report", "killed", "survived", "timeout", "unviable", "total", "problem")


def _generic(spark, d):
    rows = _by_user(spark, d, *(F.count_if(F.col("event_type") == k).alias(k) for k in _KINDS))
    n = lambda k: F.col(k).cast("string")
    more = F.element_at(F.array(F.lit(""), F.lit(',"total":0'), F.lit(',"skipped":3'), F.lit(',"final_status":"x"'), F.lit(',"note":"x"')), (F.col("report") % 5 + 1).cast("int"))
    return rows.select("report", F.concat(F.lit('{"killed":'), n("signup"), F.lit(',"survived":'), n("view"), F.lit(',"timeout":'), n("purchase"), more, F.lit("}")).alias("body"))


@query(
    "mutation_generic_stats",
    f"SELECT *, CASE WHEN r = 1 AND total > 0 THEN 'declared total differs' WHEN r IN (2, 3) THEN 'unknown outcome' WHEN total = 0 THEN 'no mutants' END AS problem FROM (SELECT user_id AS report, user_id % 5 AS r, {_n('signup')} AS killed, {_n('view')} AS survived, {_n('purchase')} AS timeout, count(*) FILTER (event_type IN ('signup', 'view', 'purchase')) AS total FROM (SELECT * REPLACE (coalesce(user_id, -1) AS user_id) FROM events) GROUP BY 1, 2)",
)
def mutation_generic_stats(spark, d):
    return mutation.generic_stats(_generic(spark, d)).select("report", (F.col("report") % 5).alias("r"), "killed", "survived", "timeout", "total", "problem")


@query("mutation_formats", "SELECT format, count(*) AS n FROM (SELECT DISTINCT user_id, CASE user_id % 4 WHEN 0 THEN 'stryker' WHEN 1 THEN 'cargo' WHEN 2 THEN 'generic' ELSE 'invalid' END AS format FROM (SELECT * REPLACE (coalesce(user_id, -1) AS user_id) FROM events)) GROUP BY 1")
def mutation_formats(spark, d):
    rows = _events(spark, d).select(F.col("user_id").alias("report")).distinct()
    body = F.element_at(F.array(F.lit('{"files":{"a.ts":{"mutants":[{"id":"1","status":"killed"}]}}}'), F.lit('{"outcomes":[]}'), F.lit('{"killed":1}'), F.lit("[1")), (F.col("report") % 4 + 1).cast("int"))
    return mutation.stats_of(rows.select("report", body.alias("body"))).groupBy("format").agg(F.count("*").alias("n"))


@query(
    "mutation_statuses",
    "SELECT status, category, count(*) AS n FROM (SELECT event_id, (['Killed', 'CAUGHT', 'missed', ' timed out', 'Compilation Error', 'compileerror', 'RunnerError', 'error', 'Equivalent', 'not-covered', 'Not/Run', 'pending', 'detected', 'build_failed'])[event_id % 14 + 1] AS status, (['killed', 'killed', 'survived', 'timeout', 'compile_error', 'compile_error', 'runner_error', 'runner_error', 'equivalent', 'unviable', 'unviable', 'unviable', NULL, NULL])[event_id % 14 + 1] AS category FROM events) GROUP BY 1, 2",
)
def mutation_statuses(spark, d):
    said = ("Killed", "CAUGHT", "missed", " timed out", "Compilation Error", "compileerror", "RunnerError", "error", "Equivalent", "not-covered", "Not/Run", "pending", "detected", "build_failed")
    e = table(spark, d, "events").select(F.element_at(F.array(*map(F.lit, said)), (F.col("event_id") % 14 + 1).cast("int")).alias("status"))
    return e.select("status", mutation.status(F.col("status")).alias("category")).groupBy("status", "category").agg(F.count("*").alias("n"))
