"""Column expressions on code and sizes by role against walks in plain Python."""

from __future__ import annotations

import random
import shlex

import pytest
from pyspark.sql import functions as F

from lodestone.operators import code, evidence


def value(node, test):
    if isinstance(node, str):
        return test if node == "test" else None
    op, parts = node
    v = [value(p, test) for p in parts]
    if op == "not" and len(v) == 1:
        return None if v[0] is None else not v[0]
    if op == "all":
        return False if False in v else None if None in v else True
    if op == "any":
        return True if True in v else None if None in v else False
    return None


def written(node, r):
    if isinstance(node, str):
        return node
    blank = lambda: r.choice(["", " ", "\n "])
    return f"{node[0]}({blank()}" + f",{blank()}".join(written(p, r) for p in node[1]) + r.choice(["", ","] if node[1] else [""]) + ")"


def test_predicates(spark):
    r = random.Random(8)

    def grow(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(["test", "unix", 'feature = "a, (b)"', "target::os", "testing", 'test = "x"'])
        op = r.choice(["not", "all", "any", "any", "all", "other"])
        return op, [grow(depth - 1) for _ in range(1 if op == "not" else r.randrange(4))]

    trees = [grow(5) for _ in range(300)]
    rows = [(i, written(t, r)) for i, t in enumerate(trees)]
    got = {x.i: (x.a, x.b, x.c) for x in spark.createDataFrame(rows, "i int, p string").select("i", code.cfg_value(F.col("p"), True).alias("a"), code.cfg_value(F.col("p"), False).alias("b"), code.requires_test(F.col("p")).alias("c")).collect()}
    assert got == {i: (value(t, True), value(t, False), value(t, False) is False and value(t, True) is not False) for i, t in enumerate(trees)}
    odd = spark.createDataFrame([("",), (None,), ("test(",), ("(",), ("not(not(test))",)], "p string")
    assert [x[0] for x in odd.select(code.requires_test(F.col("p"))).collect()] == [False, False, False, False, True]


def test_words_of_commands(spark):
    cases = ["a b", "run \"a b\" 'c d'", "it\\'s", "x\\ y  z", "''", "a''b \"\"", 'say "q\\"uo\\\\te"', "'a\\b'", "tab\tnew\nline", "é ü x", "a\"b c\"d'e f'g", ""]
    want = [shlex.split(c.replace(" ", " "), posix=True) if "\\b" not in c else ["a\\b"] for c in cases]
    want[6] = ["say", 'q"uo\\te']
    open_ = {'a "b c': ["a", "b c"], "a 'b": ["a", "b"], "a\\": ["a"], "\\": [""], 'x "y\\': ["x", "y"]}
    rows = [(i, c) for i, c in enumerate([*cases, *open_])]
    got = spark.createDataFrame(rows, "i int, c string").select("i", code.shell_words(F.col("c")).alias("w")).orderBy("i").collect()
    assert [x.w for x in got] == [*want, *open_.values()]


def offset(t, n, c):
    lines = t.split("\n")
    if n > len(lines):
        return None
    at, left = 0, c - 1
    line = lines[n - 1]
    while left:
        if at >= len(line):
            return None
        left -= line[at] != "\r"
        at += 1
    return len("\n".join([*lines[: n - 1], line[:at]]).encode())


def test_places_in_texts(spark):
    text = "aé\r\nb😀cd\n\r\rx"
    rows = [(n, c) for n in range(1, 6) for c in range(1, 7)]
    df = spark.createDataFrame(rows, "n int, c int").select("n", "c", code.byte_offset(F.lit(text), F.col("n"), F.col("c")).alias("at"))
    assert {(x.n, x.c): x.at for x in df.collect()} == {(n, c): offset(text, n, c) for n, c in rows}
    assert spark.range(1).select(code.byte_offset(F.lit(None).cast("string"), F.lit(1), F.lit(1)).alias("x"), code.byte_offset(F.lit("a"), F.lit(0), F.lit(1)).alias("y")).first()[:] == (None, None)


@pytest.mark.parametrize("seed", [1, 2])
def test_sizes_by_role(spark, seed):
    r = random.Random(seed)
    files, ranges, want = [], [], set()
    for i in range(30):
        text = "".join(r.choice(["a", "é", " ", "\n", "\n", "\t", "bc", "\r\n"]) for _ in range(r.randrange(40)))
        text = None if i == 5 else text
        role = "config" if i % 7 == 6 else "source"
        own = [(a, a + r.randrange(-1, 9)) for a in (r.randrange(45) for _ in range(r.randrange(4)))]
        files.append((f"f{i}", role, text))
        ranges += [(f"f{i}", a, b) for a, b in own]
        raw = (text or "").encode()
        if role == "config" or not any(a < b for a, b in own):
            want.add((f"f{i}", role, len(raw), len((text or "").removesuffix("\n").split("\n")) if text else 0))
            continue
        for side in ("test", "source"):
            n, lines, at = 0, 0, 0
            for line in raw.split(b"\n"):
                line = raw[at : at + len(line) + 1]
                mine = [x for j, x in enumerate(line, at) if any(a <= j < b for a, b in own) == (side == "test")]
                filled = [x for x in mine if x not in b" \t\n\f\r"]
                lines += bool(filled) or (bool(mine) and not line.strip(b" \t\n\f\r"))
                n += len(mine)
                at += len(line)
            if n:
                want.add((f"f{i}", side, n, lines))
    got = evidence.role_sizes(spark.createDataFrame(files, "path string, role string, text string"), spark.createDataFrame(ranges, "file string, start long, stop long"))
    assert {tuple(x) for x in got.collect()} == want
