"""Ignore rules of many folders against a walk with an independent matcher, and against git where it is there."""

from __future__ import annotations

import random
import shutil
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources import repository

RULES = "folder string, rank int, nth int, pattern string"


def rows_of(rules):
    return [(folder, rank, n, line) for (folder, rank), lines in rules.items() for n, line in enumerate(lines)]


def judged(spark, paths, rules):
    df = repository.ignored_by(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(rows_of(rules), RULES))
    return {r.path: r.ignored for r in df.collect()}


@pytest.mark.parametrize(
    ("glob", "hits", "misses"),
    [
        ("*.ts", ["a.ts", ".ts"], ["a/b.ts", "a.tsx", "axts"]),
        ("a?c", ["abc"], ["ac", "a/c"]),
        ("**/x", ["x", "a/x", "a/b/x"], ["ax", "x/a"]),
        ("a/**", ["a/b", "a/b/c"], ["a", "b/a/c"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["ab", "a/xb"]),
        ("[!ab]c", ["xc"], ["ac", "c"]),
        ("[a-c].(x)+", ["b.(x)+"], ["d.(x)+", "bx(x)+"]),
        (r"\*\[x", ["*[x"], ["a[x", r"\*[x"]),
        ("a{b}$^|", ["a{b}$^|"], ["ab"]),
    ],
)
def test_globs_in_columns(spark, glob, hits, misses):
    df = spark.createDataFrame([(glob, p) for p in hits + misses], "g string, p string")
    got = {r.p: r.x for r in df.select("p", F.regexp_like("p", F.concat(F.lit("^"), T.glob_pattern(F.col("g")), F.lit("$"))).alias("x")).collect()}
    assert got == dict.fromkeys(hits, True) | dict.fromkeys(misses, False)


def test_an_unclosed_class_is_no_pattern(spark):
    assert spark.createDataFrame([("a[b",), ("a\\[b",)], "g string").select(T.glob_pattern(F.col("g")).alias("x")).where("x is null").count() == 1
    assert judged(spark, ["a[b", "ab"], {("", repository.GITIGNORE): ["a[b"]}) == {"a[b": False, "ab": False}


def test_folders_ranks_and_order(spark):
    rules = {
        ("", repository.GLOBAL): ["*.tmp", "keep.log"],
        ("", repository.GITIGNORE): ["# note", "", "*.log   ", "!keep.log", "build/", "/top.txt", "deep/only.txt"],
        ("a", repository.GITIGNORE): ["!x.log", "b/"],
        ("a/b", repository.GITIGNORE): ["!*"],
        ("c", repository.IGNORE): ["!y.log"],
        ("c", repository.GITIGNORE): ["y.log"],
        ("d", repository.GITIGNORE): ["*", "!*/", "!k*.txt"],
    }
    want = {
        "x.log": True, "keep.log": False, "a/x.log": False, "a/z.log": True, "a/b/x.log": True, "a/b/fine.txt": True, "c/y.log": False, "z.tmp": True, "build/o.js": True, "src/build/o.js": True, "build": False,
        "top.txt": True, "a/top.txt": False, "deep/only.txt": True, "a/deep/only.txt": False, "d/other.txt": True, "d/e/k1.txt": False, "d/e/z.txt": True, "plain.txt": False,
    }
    assert judged(spark, list(want), rules) == want


def tree(seed):
    r = random.Random(seed)
    folders = [""]
    for _ in range(25):
        folders.append((r.choice(folders) + "/" + r.choice(["a", "b", "build", "lib"])).lstrip("/"))
    folders = sorted(set(folders))
    paths = sorted({(f + "/" + r.choice(["x.ts", "y.log", "k.txt", "a.b", "z1.rs", "z2.rs", "READ ME"])).lstrip("/") for f in folders for _ in range(4)})
    lines = ["*.log", "!y.log", "build/", "/a", "z?.rs", "!z1.rs", "lib/*.ts", "**/k.txt", "a/**", "!*/", "*", "[x-y].*", "# no", "READ\\ ME", "b", "!b/", "z[!1].rs"]
    return paths, {f: [r.choice(lines) for _ in range(r.randrange(1, 5))] for f in r.sample(folders, 9)}


@pytest.mark.skipif(shutil.which("git") is None, reason="no git")
@pytest.mark.parametrize("seed", range(4))
def test_rules_equal_those_of_git(spark, tmp_path, seed):
    paths, ignores = tree(seed)
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        if not (tmp_path / p).is_dir():
            (tmp_path / p).write_text("x")
    paths = [p for p in paths if (tmp_path / p).is_file()]
    for f, lines in ignores.items():
        (tmp_path / f / ".gitignore").write_text("\n".join(lines) + "\n")
    out = subprocess.run(["git", "-c", "core.excludesFile=", "-C", str(tmp_path), "ls-files", "-z", "--others", "--exclude-standard"], capture_output=True, check=True).stdout.decode().split("\0")
    files = spark.createDataFrame([(f"{f}/.gitignore".lstrip("/"), "\n".join(lines) + "\n") for f, lines in ignores.items()], "path string, text string")
    got = repository.ignored_by(spark.createDataFrame([(p,) for p in paths], "path string"), repository.ignore_rules(files))
    assert {r.path for r in got.where("not ignored").collect()} == set(out) & set(paths)


def test_repeated_lines_of_a_folder_are_tried_once(spark):
    """Of 20,000 lines of two patterns the last of each decides; 3,000 files are done in seconds, not 60 million tries."""
    lines = spark.range(20000).selectExpr("'' AS folder", f"{repository.GITIGNORE} AS rank", "int(id) AS nth", "CASE id % 3 WHEN 0 THEN '*.a' WHEN 1 THEN '!*.a' ELSE '*.b' END AS pattern")
    files = spark.range(3000).selectExpr("concat('x', id, if(id % 2 = 0, '.a', '.b')) AS path")
    began = time.time()
    found = repository.ignored_by(files, lines.where("nth < 19998")).groupBy(F.right("path", F.lit(1)).alias("k"), "ignored").count().collect()
    assert {(r.k, r.ignored, r["count"]) for r in found} == {("a", False, 1500), ("b", True, 1500)}
    assert time.time() - began < 20
