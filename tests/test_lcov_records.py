"""Records read as rows, against their entries read one by one."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans import source_queries
from lodestone.sources import lcov

SF = "/root/testdata/sf0.001"
LINES = (
    "TN:", "TN:t", "VER:1", "VER: ", "SF:a.ts", "SF: b.ts ", "SF:", "SF", "DA:1,1", "DA:1,0", "DA:2,+3", "DA: 3 , 4 ,x", "DA:0,1", "DA:1", "DA:1,2,3,4", "DA:1,", "DA:5,9223372036854775807", "DA:5,9223372036854775808", "DA:00000000000000000000007,1", "DA:٣,1",
    "DA:1,1\r2", "DA:1, 1", "DA", "FN:1,f", "FN:3,f", "FN:1,5,g", "FN:5,1,g", "FN:0,f", "FN:1", "FN:1,", "FN:1,5", "FN:2,x,y", "FN:1,h<i, j>", "FNDA:0,f", "FNDA:2,f", "FNDA:1,5,g", "FNDA:1,g", "FNDA:,g", "FNDA:1,h<i, j>", "FNF:1", "FNF:2", "FNF:x", "FNH:1", "FNH:0",
    "BRDA:1,0,0,1", "BRDA:1,0,0,-", "BRDA:1,0,a,b,2", "BRDA:0,0,0,5", "BRDA:1,0,-,1", "BRDA:1,0,,1", "BRDA:1,0,1", "BRDA:1,0,0,x", "BRDA:+2, 0 , 0 ,1", "BRF:1", "BRH:1", "LF:2", "LF:1", "LH:1", "LH:", "MCDC:1", "FNL:1", "FOO:1", "12:3", "a b", "# note", "", "  ", "end_of_record", " end_of_record ", "end_of_recordX",
)


def reports():
    r = random.Random(5)
    out = [(i, r.choice(["\n", "\r\n"]).join(r.choice(LINES) for _ in range(r.randrange(1, 60)))) for i in range(250)]
    return [*out, (900, ""), (901, None), (902, "\n\n"), (903, "end_of_record"), (904, "TN:\n")]


def test_numbers_of_records_equal_those_of_entries(spark):
    rows = spark.createDataFrame(reports(), "report long, text string").repartition(3)
    got = {(r.report, r.record): r for r in lcov.record_rows(rows).select("report", "record", "file", lcov._read(F.col("piece")).alias("x")).collect()}
    found = lcov.entries(rows).localCheckpoint()
    want, tags = defaultdict(Counter), defaultdict(list)
    for r in found.orderBy("seq").collect():
        tags[r.report, r.record].append((r.tag, r.rest))
        assert got[r.report, r.record].file == r.file
    assert tags.keys() == got.keys() and len(got) > 400
    marks = defaultdict(Counter)
    lines, forks = defaultdict(set), defaultdict(set)
    for r in lcov.line_hits(found).collect():
        at = r.report, r.record
        want[at].update(da=1, da_bad=r.line is None, da_hit=(r.hits or 0) > 0)
        if r.line is not None:
            lines[at].add(r.line)
            marks[at][r.line, 1, r.hits > 0] += 1
    for r in lcov.branches(found).collect():
        at = r.report, r.record
        want[at].update(br=1, br_bad=r.line is None, br_hit=(r.taken or 0) > 0, br_twice=(r.line, r.block, r.branch) in forks[at])
        forks[at].add((r.line, r.block, r.branch))
        if r.line is not None:
            marks[at][r.line, 2, (r.taken or 0) > 0] += 1
    for r in lcov.functions(found).collect():
        at = r.report, r.record
        want[at].update(fn=r.declared > 0, fn_lone=(r.declared > 0) != (r.called > 0), fn_bad=r.bad, fn_hit=r.called > 0 and r.hits > 0, fn_twice=max(r.declared - 1, 0) + max(r.called - 1, 0))
        if r.declared:
            marks[at][r.line, 4, False] += 1
    for r in lcov.function_projection(found).collect():
        want[r.report, r.record].update(told=1, told_hit=r.hit)
        marks[r.report, r.record][r.line, 3, r.hit] += 1
    counters = {(r.report, r.record): r for r in lcov.counters(found).collect()}
    for at, r in got.items():
        named = Counter(t for t, _ in tags[at])
        first = lambda f: next((i for i, (t, _) in enumerate(tags[at]) if f(t)), None)
        last = lambda f: max((i for i, (t, _) in enumerate(tags[at]) if f(t)), default=None)
        want[at].update(sf=named["SF"], ends=named["end_of_record"], ver=named["VER"], odd=named["MCDC"] + named["FNL"], unknown=sum(n for t, n in named.items() if t not in (*lcov.TAGS, *lcov.UNSUPPORTED)), real=sum(n for t, n in named.items() if t not in ("TN", "")))
        want[at].update(da_lines=len(lines[at]), twice=sum(max(named[t] - 1, 0) for t in lcov.COUNTERS), empty_sf=sum(t == "SF" and not x.strip(" ") for t, x in tags[at]), empty_ver=sum(t == "VER" and not x.strip(" ") for t, x in tags[at]))
        want[at].update(bad_counts=sum(t in lcov.COUNTERS and not x.isdigit() for t, x in tags[at]))
        whole = dict(want[at]) | {t.lower(): counters[at][t.lower()] if at in counters else None for t in lcov.COUNTERS}
        whole |= {"sf_at": first(lambda t: t == "SF"), "metric_at": first(lambda t: t not in ("SF", "TN", "VER", "end_of_record")), "tn_at": last(lambda t: t == "TN"), "ver_at": last(lambda t: t == "VER")}
        x = r.x.asDict()
        assert Counter((m.line, m.kind, m.hit) for m in x.pop("marks")) == marks[at], at
        assert {k: v for k, v in x.items() if v != whole.get(k, 0)} == {}, (at, tags[at])


def test_rows_and_entries_have_the_same_problems_and_production(spark):
    rows = spark.createDataFrame(reports(), "report long, text string")
    tests = spark.createDataFrame([("a.ts", 1), ("a.ts", 1), ("a.ts", 3), ("b.ts", 5), (None, 1), ("a.ts", None)], "file string, line long")
    shown = lambda df: sorted(map(tuple, df.collect()), key=str)
    found, whole = lcov.entries(rows), lcov.record_rows(rows)
    assert shown(lcov.problems(found)) == shown(lcov.problems(whole))
    assert shown(lcov.production(found, tests)) == shown(lcov.production(whole, tests)) != []


def test_production_leaves_out_test_lines(spark):
    text = "SF:a.ts\nFN:1,f\nFN:9,t\nFNDA:1,f\nFNDA:4,t\nFNF:2\nFNH:2\nDA:1,1\nDA:2,0\nDA:9,4\nDA:10,0\nDA:10,2\nBRDA:1,0,0,1\nBRDA:9,0,0,1\nBRDA:9,0,1,-\nBRF:3\nBRH:2\nLF:4\nLH:2\nend_of_record\nSF:b.ts\nDA:9,1\nLF:1\nLH:1\nend_of_record\n"
    rows = spark.createDataFrame([("r", text)], "report string, text string")
    tests = spark.createDataFrame([("a.ts", 9), ("a.ts", 10), ("a.ts", 11)], "file string, line long")
    got = lcov.production(lcov.record_rows(rows), tests).orderBy("file").drop("report", "record").collect()
    assert [tuple(r) for r in got] == [("a.ts", 1, 0, 1, 1, 1, 1, None), ("b.ts", 1, 1, 0, 0, 0, 0, None)]


@pytest.mark.parametrize("name, most", [("lcov_production", 3), ("lcov_problems", 3)])
def test_reports_are_read_once(spark, name, most):
    """Texts are made and read in one place, and nothing is shuffled by line."""
    plan = source_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Exchange ") <= most, plan


def test_keys_of_paths(spark):
    want = {"a/b.ts": "a/b.ts", "./a/../b": "b", "a//b": "a/b", "/a/./b": "/a/b", "../a": "a", "a\\b": "a/b", "a/..": "", "": "", ".": "", "a.b/..c/.d": "a.b/..c/.d", "a/": "a", "/": "/", "a/...": "a/..."}
    rows = spark.createDataFrame([(k,) for k in want] + [(None,)], "path string")
    assert {r.path: r.key for r in rows.select("path", T.record_key(F.col("path")).alias("key")).collect()} == want | {None: None}
