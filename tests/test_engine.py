"""The engine's operators on small cases and, query by query, against SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from lodestone.functions import text as T
from lodestone.operators import clones, coverage, files, findings, mutation, ratchet, rules, structure
from lodestone.plans import catalogue, gate_queries
from lodestone.sources import lcov, repository
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, sql, name):
    got = catalogue.QUERIES[name](spark, SF).toArrow()
    cur = sql.execute(catalogue.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(got.column_names)
    want = sorted(repr(tuple(r[names.index(c)] for c in got.column_names)) for r in cur.fetchall())
    assert sorted(repr(r) for r in zip(*(got[c].to_pylist() for c in got.column_names))) == want


def test_every_query_runs(spark):
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert catalogue.FLAGSHIP in catalogue.QUERIES


def test_lines(spark):
    cases = {"": [], "a\n": ["a"], "a\n\n": ["a", ""], "\n": [""], "a\r\nb": ["a", "b"], None: []}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.lines(F.col("t")).alias("l"))
    assert {r.t: r.l for r in df.collect()} == cases


@pytest.mark.parametrize(("glob", "path", "hit"), [("src/**", "src/a/b.ts", True), ("*.ts", "a/b.ts", True), ("**/x.rs", "x.rs", True), ("a/{b,c}.py", "a/c.py", True), ("a/[!b].py", "a/b.py", False), ("a.py", "axpy", False)])
def test_globs(spark, glob, path, hit):
    assert spark.range(1).select(F.lit(path).rlike(T.glob_to_regex(glob)).alias("x")).first().x is hit


def test_roles(spark):
    cases = {"src/button.test.tsx": "test", "config/tests/button.ts": "test", "supabase/seed.ts": "migration", "src/test.ts": "source", "tests": "unknown", "dist/x.js": "vendor", "a/Cargo.lock": "generated", "x/.prettierrc.js": "config", "README": "unknown", "./SRC\\A.RS": "source"}
    df = files.classify(spark.createDataFrame([(p,) for p in cases], "path string"))
    assert {r.path: r.role for r in df.collect()} == cases


def test_suppressions(spark):
    text = "// @ts-ignore\n/* eslint-disable */\nx = '// eslint-disable'\n#[allow(dead_code)]\nx = 1  # noqa\ny: int  # type: ignore\nz  # pragma: no cover\nlabel = 'noqa'\n# pylint: disable=x"
    got = rules.suppressions(spark.createDataFrame([("a", text), ("b", None)], "path string, text string")).orderBy("line_no").collect()
    assert [(r.line_no, r.token) for r in got] == [(1, "@ts-ignore"), (2, "eslint-disable"), (4, "#[allow("), (5, "noqa"), (6, "type: ignore"), (7, "pragma: no cover"), (9, "pylint: disable")]


def test_invariants(spark):
    text = 'import x from "db/pool"\nfetch("/a")\n// fetch(1)\nprefetch(2)\nuse(token)'
    rule = rules.Invariant("ui", "src/**", imports=("db/**",), calls=("fetch",), tokens=("token",))
    got = rules.invariants(spark.createDataFrame([("src/a.ts", text), ("lib/a.ts", text)], "path string, text string"), [rule]).orderBy("line_no").collect()
    assert [(r.path, r.line_no, r.kind, r.target) for r in got] == [("src/a.ts", 1, "import", "db/pool"), ("src/a.ts", 2, "call", "fetch"), ("src/a.ts", 5, "token", "token")]


def test_clone_spans_and_tokens(spark):
    body = [f"t{i}" for i in range(30)]
    rows = [("a", ["x", *body, "y"]), ("b", ["z", "w", *body]), ("c", ["q"])]
    found = clones.windows(spark.createDataFrame(rows, "stream string, tokens array<string>"), 10)
    assert [tuple(r) for r in clones.spans(found, 10).collect()] == [("a", "b", 1, 2, 30)]
    df = spark.range(1).select(clones.code_tokens(F.lit("let x1 = 'a b' + 3.5e2; y")).alias("a"), clones.code_tokens(F.lit("  // no")).alias("b")).first()
    assert df.a == ["let", "x1", "=", "_STR_", "+", "_LIT_", ";", "y"]
    assert df.b == []


def test_fingerprint(spark):
    def fnv(tokens, tag="clone-v1"):
        h = 0xCBF29CE484222325
        for b in tag.encode() + b"".join(len(t.encode()).to_bytes(8, "big") + t.encode() for t in tokens):
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    for tokens in (["a"], ["fn", "é", "_LIT_"], ["x" * 40]):
        got = spark.createDataFrame([(tokens,)], "t array<string>").select(clones.fingerprint(F.col("t")).alias("f")).first().f
        assert got == fnv(tokens)


def test_lcov(spark):
    good = "TN:\nSF:src/a.ts\nFN:1,f\nFNDA:2,f\nDA:1,0,AAAA\nDA:3,1\nBRDA:3,0,a,b,-\nFNF:1\nFNH:1\nBRF:1\nBRH:0\nLF:2\nLH:1\nend_of_record\nSF:src/b.ts\nDA:1,5\nLF:1\nLH:1\nend_of_record\n"
    bad = "SF:x\nDA:1,1\nDA:1,2\nLF:1\nFNL:1\nfoo:1\n"
    found = lcov.entries(spark.createDataFrame([("g", good), ("b", bad)], "report string, text string"))
    hits = lcov.line_hits(found.where("report = 'g'"))
    assert sorted((r.file, r.line, r.hits) for r in hits.collect()) == [("src/a.ts", 1, 0), ("src/a.ts", 3, 1), ("src/b.ts", 1, 5)]
    assert [(r.branch, r.taken) for r in lcov.branches(found).collect()] == [("a,b", None)]
    assert sorted((r.file, r.lf, r.lh) for r in lcov.counters(found.where("report = 'g'")).collect()) == [("src/a.ts", 2, 1), ("src/b.ts", 1, 1)]
    wrong = lcov.problems(found).collect()
    assert {r.report for r in wrong} == {"b"}
    assert {r.problem for r in wrong} == {"unterminated record", "unsupported tag", "unknown tag", "duplicate line", "unpaired line counters"}
    assert coverage.floors(coverage.totals(hits), 95.0).first().below


def test_diff_and_status(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,3 +2 @@\n-a\n+b\n@@ -9,0 +12,2 @@\n+c\n+d\n--- a/y\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-q\n"
    got = repository.changed_lines(spark.createDataFrame([(1, diff)], "diff long, text string")).collect()
    assert sorted((r.file, r.line) for r in got) == [("x", 2), ("x", 12), ("x", 13)]
    status = spark.createDataFrame([("?? n.py\x00R  new.py\x00old.py\x00 M z.py\x00",)], "text string")
    assert [tuple(r)[1:] for r in repository.porcelain(status).collect()] == [("??", "n.py", None, None), ("R ", "new.py", "old.py", None), (" M", "z.py", None, None)]
    odd = spark.createDataFrame([("R  n1\x00?? b\x00",), ("R  n2\x00o2\x00x\x00?? ../up\x00",)], "text string")
    assert sorted((tuple(r)[1:] for r in repository.porcelain(odd).collect()), key=str) == sorted([("R ", "n1", "?? b", None), ("R ", "n2", "o2", None), (None, None, None, "malformed record"), ("??", "../up", None, "path outside the repository")], key=str)
    inside = spark.createDataFrame([(1, "diff --git a/q b/q\n--- a/q\n+++ b/q\n@@ -1 +7 @@\n+++ inc\n@@ -9 +0,2 @@\n@@ bad\n")], "diff long, text string")
    got = repository.hunks(inside).collect()
    assert [(r.file, r.start, r["count"], r.problem) for r in got] == [("q", 7, 1, None), ("q", None, None, "lines from 0 on"), ("q", None, None, "malformed hunk header")]


def test_walk_and_report(spark, tmp_path):
    (tmp_path / "r/node_modules/p").mkdir(parents=True)
    (tmp_path / "r/node_modules/p/x.js").write_text("x")
    (tmp_path / "r/a.py").write_text("é\n")
    (tmp_path / "r/b.bin").write_bytes(b"\xff\xfe")
    got = {r.path: r for r in repository.walk(spark, str(tmp_path / "r"), exclude=["*.bin"], extensions=None).collect()}
    assert set(got) == {"a.py", "b.bin"}
    assert (got["a.py"].text, got["b.bin"].read_error, got["b.bin"].excluded) == ("é\n", "not UTF-8", True)
    repository.save_report(spark.createDataFrame([("a", 1)], "file string, line int"), str(tmp_path / "out"))
    assert repository.read_report(spark, str(tmp_path / "out"), "file string, line int").collect() == [("a", 1)]


def test_touched_ranges_of_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    f = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_suppkey % 10 AS file", "l_orderkey AS first", "l_orderkey + l_linenumber % 3 AS last", "l_linenumber")
    c = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey % 10 AS file", "o_orderkey AS line")
    odd = [(1, 5, 5, 0), (1, 5, 5, 0), (1, 9, None, 1), (1, None, 9, 2), (None, 1, 9, 3), (1, 7, 3, 4), (2, -900, 900, 5), (2, 0, 90000, 6), (2, 100001, 1 << 60, 7), (3, 255, 256, 8), (3, -1, 0, 9), (3, 257, 511, 10)]
    lines = [(1, 5), (1, 5), (1, 9), (1, 7), (1, None), (None, 3), (2, 100000), (2, -900), (3, 256), (3, 512), (4, 1)]
    small = (spark.createDataFrame(odd, "file long, first long, last long, l_linenumber long"), spark.createDataFrame(lines, "file long, line long"))
    for found, changed in ((f, c), small):
        at = {(r.file, r.line) for r in changed.collect()} - {(None, 3)}
        inside = lambda r: r.file is not None and r.first is not None and any(k == r.file and n is not None and r.first <= n <= max(r.first, r.last or r.first) for k, n in at)
        out = ratchet.touched_ranges(found, changed)
        assert out.columns == found.columns
        assert sorted(map(str, out.collect())) == sorted(str(r) for r in found.collect() if inside(r))


def test_touched_ranges_compare_no_pairs_of_a_file(spark):
    found = spark.range(400000).selectExpr("1 AS file", "id * 10 AS first", "id * 10 + 4 AS last")
    changed = spark.range(400000).selectExpr("1 AS file", "id * 10 + 7 AS line")
    plan = ratchet.touched_ranges(found, changed)._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("Join", 1)[1].split("\n", 1)[0]
    assert ratchet.touched_ranges(found, changed).isEmpty()


def test_numeric_ratchet_uses_up_the_baseline(spark):
    cur = spark.createDataFrame([("f", 1, 10.0), ("f", 2, 9.0), ("f", 3, 1.0), ("g", 4, 1.0)], "file string, ord long, actual double")
    base = spark.createDataFrame([("f", 10.0), ("f", 5.0)], "file string, actual double")
    got = {r.ord: r.grandfathered for r in ratchet.numeric(cur, base, ["file"], "actual", "ord").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_lineage_and_reach_end_on_cycles(spark):
    renames = spark.createDataFrame([("c", "b"), ("b", "a"), ("z", "z")], "new string, old string")
    assert {tuple(r) for r in ratchet.lineage(renames).collect()} == {("c", "a"), ("b", "a")}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 3)], "src long, dst long")
    seeds = spark.createDataFrame([(1, 1), (5, 2)], "node long, mask long")
    assert {tuple(r) for r in ratchet.reach(edges, seeds).collect()} == {(1, 3), (2, 3), (3, 3), (5, 2)}


def test_reach_plans_do_not_grow_with_rounds(spark, monkeypatch):
    """What the optimizer knows of derived edges is not taken from round to round."""
    edges = spark.range(1, 1500).selectExpr("CASE WHEN id % 50 = 0 THEN -1 ELSE cast(floor(id / 2) AS long) END AS src", "id AS dst")
    keep = "stored" if hasattr(ratchet, "stored") else "cut"
    written, sizes = getattr(ratchet, keep), []
    monkeypatch.setattr(ratchet, keep, lambda df: sizes.append(len(df._jdf.queryExecution().optimizedPlan().constraints().toString())) or written(df))
    assert ratchet.reach(edges, spark.createDataFrame([(1, 1)], "node long, mask long")).where("mask = 1").count() > 900
    assert len(sizes) > 10 and max(sizes[3:]) < 1000, sizes


def test_mutation_status_and_score(spark):
    df = spark.createDataFrame([(" Killed ",), ("no-coverage",), ("Timed Out",), ("bogus",)], "s string").select(mutation.status(F.col("s")).alias("c"))
    assert [r.c for r in df.collect()] == ["killed", "unviable", "timeout", None]
    s = mutation.score(spark.createDataFrame([(1, "killed"), (1, "survived"), (2, "timeout")], "r long, category string"), "r").orderBy("r").collect()
    assert [(r.score, r.below) for r in s] == [(50.0, True), (0.0, True)]


def test_python_functions(spark):
    code = "def choose(a, /, b=1, *args, flag=True, **kw):\n    if a and b:\n        return 1\n    elif b:\n        return 2\n    else:\n        return 3\n\ndef worker(x):\n    def nested(y):\n        return y if y else 0\n    return [i for i in x if i]\n"
    got = structure.python_functions(spark.createDataFrame([("a.py", code), ("b.py", "def ("), ("c.py", None)], "path string, text string")).collect()
    rows = {r.name: r for r in got if r.name}
    assert (rows["choose"].parameters, rows["choose"].cyclomatic, rows["choose"].nesting) == (5, 4, 1)
    assert (rows["worker"].cyclomatic, rows["nested"].cyclomatic) == (3, 2)
    assert [r.path for r in got if r.error] == ["b.py"]


def test_verdict_of_no_findings(spark):
    none = spark.createDataFrame([], "severity string, gone boolean")
    r = findings.verdict(none, "severity", F.col("gone")).first()
    assert (r.blocking, r.total, r.incomplete, r.passed, r.exit_code) == (0, 0, False, True, 0)


def test_incremental_scan(spark, tmp_path):
    from lodestone.streaming.incremental import scan_new

    spark.createDataFrame([("a", "// @ts-ignore")], "path string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, text string").parquet(str(tmp_path / "in"))
    scan_new(stream, rules.suppressions, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.path, r.token) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", "@ts-ignore")]


def test_walk_filters_and_order(spark, tmp_path):
    for name in ("b/x.ts", "b-c/y.ts", "a.ts", ".hidden/z.ts", "c.txt", "gen/out.ts", "gen/keep.ts", "target/t.rs", "old.go"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = [r.path for r in repository.walk(spark, str(tmp_path), ignore=["gen/*", "!gen/keep.ts"]).collect()]
    assert got == ["a.ts", "b/x.ts", "b-c/y.ts", "gen/keep.ts", "old.go"]


def test_policies():
    from lodestone.sources import policy

    base = policy.load(None)
    assert base["budgets"]["files"]["max_lines"]["rs"] == 499
    assert policy.load("[budgets.files]\nmax_lines = {}\n")["budgets"]["files"]["max_lines"] == {}
    assert policy.identity(base) == policy.identity(policy.merged(base, {}))
    assert policy.load("[coverage]\nmin_line_percent = 50\n")["coverage"]["min_function_percent"] == 95.0
    for bad in ("[gate]\nx = 1", "[budgets.files]\nmax_bytes = 0", "[coverage]\nmin_line_percent = 101", "[roles.test]\nmutation_target = true", "[budgets.files.max_lines]\ngo = 3", "[roles.source]\nseverity = 'loud'", "[legacy]\nratchet = true\nreference_branch = ' '"):
        with pytest.raises(ValueError):
            policy.load(bad)
    assert policy.detect(["package.json", "pnpm-lock.yaml"], {"lint": "x"}) == ("javascript", {"lint": "pnpm run lint"})
    assert policy.detect(["Cargo.toml", "package.json"])[0] == "ambiguous"
    roots = policy.cargo_roots('[package]\nautobenches = false\n[[test]]\npath = "it/a.rs"\n', ["src/lib.rs", "src/main.rs", "src/bin/x.rs", "it/a.rs", "tests/t.rs", "benches/b.rs", "build.rs", "src/other.rs"])
    assert roots == {"src/lib.rs": 1, "src/main.rs": 1, "src/bin/x.rs": 1, "it/a.rs": 2, "tests/t.rs": 2, "build.rs": 1}


def test_valued_ratchet_walks_in_order(spark):
    """Against a walk in order, over all orders of a customer as findings of one key."""
    rows = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_custkey % 40 AS file", "o_orderkey AS ord", "o_totalprice AS actual", "o_orderkey % 2 AS half").collect()
    got = ratchet.numeric(spark.createDataFrame([r[:3] for r in rows if r.half], "file long, ord long, actual double"), spark.createDataFrame([(r.file, r.actual) for r in rows if not r.half], "file long, actual double"), ["file"], "actual", "ord").collect()
    rest = {}
    for r in rows:
        if not r.half:
            rest.setdefault(r.file, []).append(r.actual)
    want = {}
    for r in sorted((r for r in rows if r.half), key=lambda r: r.ord):
        fits = sorted(v for v in rest.get(r.file, []) if v >= r.actual)
        want[r.ord] = bool(fits)
        if fits:
            rest[r.file].remove(fits[0])
    assert {r.ord: r.grandfathered for r in got} == want
    assert 0 < sum(want.values()) < len(want)


def test_ratchet_keys_that_are_null(spark):
    cur = spark.createDataFrame([("f", None, 1), ("f", None, 2), (None, 3, 3)], "file string, line long, ord long")
    base = spark.createDataFrame([("f", None), (None, 3)], "file string, line long")
    assert {r.ord: r.grandfathered for r in ratchet.multiset(cur, base, ["file", "line"], "ord").collect()} == {1: True, 2: False, 3: True}
    nums = ratchet.numeric(cur.withColumn("v", F.lit(2.0)), base.withColumn("v", F.lit(2.0)), ["file", "line"], "v", "ord")
    assert {r.ord: r.grandfathered for r in nums.collect()} == {1: True, 2: False, 3: True}


def test_lineage_of_three(spark):
    renames = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("t", "b"), ("u", "t"), ("y", "x"), ("y", "w")], "new string, old string")
    assert {tuple(r) for r in ratchet.lineage(renames).collect()} == {("a", "a"), ("b", "b"), ("c", "c"), ("t", "b"), ("u", "b"), ("y", "w")}


def test_clone_spans_equal_islands_of_matches(spark):
    """Begins and ends give the same spans as all matches, on streams that repeat themselves."""
    import random

    r = random.Random(2)
    rows = [(i, [r.choice("ab") for _ in range(r.randint(0, 40))]) for i in range(12)]
    found = clones.windows(spark.createDataFrame(rows, "stream long, tokens array<string>"), 4)
    at = {(m.a, m.b, m.ai, m.bi) for m in clones.matches(found, 4).collect()}
    begins = {m for m in at if (m[0], m[1], m[2] - 1, m[3] - 1) not in at}
    want = set()
    for a, b, i, j in begins:
        n = 0
        while (a, b, i + n, j + n) in at:
            n += 1
        want.add((a, b, i, j, n + 3))
    assert {tuple(x) for x in clones.spans(found, 4).collect()} == want
    assert want


def test_functions_of_braces():
    from lodestone.operators import braces

    rows = {r[1]: r for r in braces.functions_of("a.rs", "fn a(x: &'static str, c: char) -> bool { x == \"}\" && c == '{' || /* if */ true }\nfn b<F: Fn(i32, u8) -> u8>(f: F) { let _ = |z| z; }\n")}
    assert [rows["a"][i] for i in (6, 7, 8, 9)] == [2, 3, 0, 0]
    assert [rows["b"][i] for i in (6, 7, 8, 9)] == [1, 1, 0, 1]
    rows = {r[1]: r for r in braces.functions_of("a.js", "const f = function* () {}\nlet g = (a, b = [1, 2]) => a ? b : a ?? /\\/{/.test(b)\nfunction h() { label: while (1) break label }\n")}
    assert set(rows) == {"g", "h"}
    assert [rows["g"][i] for i in (6, 7, 8, 9)] == [2, 2, 1, 0]
    assert [rows["h"][i] for i in (6, 7, 8, 9)] == [0, 2, 1, 4]
    assert braces.functions_of("a.rs", "fn a() { /* }") == [("a.rs", *[None] * 9, "comment without an end", 1, 10)]
    assert braces.functions_of("a.js", None) == []


def _parked(cars, spots):
    """Each finding in order takes the least value left that isn't below its own."""
    rest, out = {}, []
    for k, v in spots:
        if v is not None and v == v:
            rest.setdefault(k, []).append(v)
    for k, o, v in sorted(cars, key=lambda c: c[1]):
        fits = sorted(x for x in rest.get(k, []) if v is not None and x >= v)
        if fits:
            rest[k].remove(fits[0])
        out.append((o, fits[0] if fits else None))
    return out


@pytest.mark.parametrize("fold", [1, 2, 8, 64])
def test_numeric_ratchet_of_hot_keys(spark, monkeypatch, fold):
    import random

    monkeypatch.setattr(ratchet, "FOLD", fold)
    r = random.Random(fold)
    value = lambda: r.choice([None, float("nan"), float(r.randrange(6)), r.random() * 9])
    keys = [None, "a", "hot", "hot", "hot", "only current"]
    cars = [(r.choice(keys), i, value()) for i in r.sample(range(1000), 300)]
    spots = [(r.choice([None, "a", "hot", "hot", "only baseline"]), value()) for _ in range(260)]
    got = ratchet.numeric(spark.createDataFrame(cars, "k string, o long, v double"), spark.createDataFrame(spots, "k string, v double"), ["k"], "v", "o")
    assert sorted((x.o, x.baseline_value) for x in got.collect()) == _parked(cars, spots)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert all(x.grandfathered == (x.baseline_value is not None) for x in got.collect())


def test_numeric_ratchet_of_nothing(spark):
    none, one = spark.createDataFrame([], "k string, o long, v double"), spark.createDataFrame([("k", 1, 2.0)], "k string, o long, v double")
    assert ratchet.numeric(none, one, ["k"], "v", "o").collect() == []
    assert [r.grandfathered for r in ratchet.numeric(one, none, ["k"], "v", "o").collect()] == [False]


def test_ratchet_summary_of_great_order_numbers(spark, tmp_path):
    """Orders from 900,000 on: the numbers of findings are those of the same orders counted from 0."""
    for name in ("lineitem", "orders", "customer", "supplier"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "lineitem":
            rows = rows.withColumn("l_orderkey", F.col("l_orderkey") + 900_000)
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    one = gate_queries.QUERIES["ratchet_summary"]
    assert one(spark, str(tmp_path)).collect() == one(spark, "/root/testdata/sf0.001").collect()
