"""Merge bases and baselines against walks over random histories."""

from __future__ import annotations

import random

import pytest

from lodestone.sources import history

COMMITS = "commit string, parents array<string>"


def histories(seed, n=70):
    r = random.Random(seed)
    name = lambda i: f"c{i:03}"
    rows = []
    for i in range(n):
        if i < 2 or r.random() < 0.04:
            parents = []
        else:
            parents = [name(i - 1 if r.random() < 0.6 else r.randrange(max(0, i - 12), i))]
            parents += [name(r.randrange(i)) for _ in range(r.choice([0, 0, 0, 1, 1, 2]))]
        rows.append((name(i), [p for k, p in enumerate(parents) if p not in parents[:k]]))
    return rows


def ancestors(parents, c):
    seen, todo = set(), [c]
    while todo:
        x = todo.pop()
        if x in parents and x not in seen:
            seen.add(x)
            todo += parents[x]
    return seen


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_bases_of_random_histories(spark, seed):
    rows = histories(seed)
    parents = dict(rows)
    r = random.Random(seed)
    names = [*parents, "missing"]
    pairs = [(i, r.choice(names), r.choice(names)) for i in range(60)] + [(99, "c010", "c010")]
    rows = rows + rows[:5] + [("c002", [*parents["c002"], "c002"]) if len(parents["c002"]) < 1 else ("c002", parents["c002"]), ("odd", ["gone"]), (None, ["c001"])]
    parents["odd"] = ["gone"]
    got = {}
    for x in history.merge_bases(spark.createDataFrame(rows, COMMITS), spark.createDataFrame(pairs, "pair long, head string, reference string")).collect():
        got.setdefault(x.pair, set()).add(x.base)
    want = {}
    for i, a, b in pairs:
        common = ancestors(parents, a) & ancestors(parents, b)
        best = {c for c in common if not any(c in ancestors(parents, d) for d in common - {c})}
        if best:
            want[i] = best
    assert got == want and len(want) > 30
    one = {x.pair: (x.base, x.problem) for x in history.merge_base(spark.createDataFrame(rows, COMMITS), spark.createDataFrame(pairs, "pair long, head string, reference string")).collect()}
    assert one == {i: (max(want[i]), None) if i in want else (None, "no merge base") for i, *_ in pairs}


def test_crossed_merges_have_two_bases(spark):
    rows = [("r", []), ("a", ["r"]), ("b", ["r"]), ("x", ["a", "b"]), ("y", ["b", "a"]), ("z", ["y"])]
    got = history.merge_bases(spark.createDataFrame(rows, COMMITS), spark.createDataFrame([(1, "x", "z"), (2, "x", "a"), (3, "a", "b")], "pair long, head string, reference string"))
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b"), (2, "a"), (3, "r")]


def test_long_chains_take_few_rounds(spark):
    rows = spark.range(5000).selectExpr("id AS commit", "CASE WHEN id > 0 THEN array(id - 1) ELSE array() END AS parents")
    places, exits = history.chains(rows)
    assert places.select("chain").distinct().count() == 1 and exits.isEmpty()
    assert {(r.commit, r.pos) for r in places.where("commit in (0, 4999)").collect()} == {(0, -4999), (4999, 0)}


def test_a_cycle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(history, "ROUNDS", 6)
    with pytest.raises(ValueError, match="cycle"):
        history.chains(spark.createDataFrame([("a", ["b"]), ("b", ["a"])], COMMITS))


@pytest.mark.parametrize("seed", [4, 5])
def test_baselines_of_random_histories(spark, seed):
    rows = histories(seed)
    r = random.Random(seed)
    files = ["src/a.rs", "b.py", "notes.txt", "node_modules/x.js", "lib/c.ts", "gone.go"]
    deltas = [(c, r.choice(files), r.choice([None, "x", "y", "bad", "lost"])) for c, _ in rows for _ in range(r.randrange(3))]
    deltas = [d for k, d in enumerate(deltas) if (d[0], d[1]) not in {x[:2] for x in deltas[:k]}]
    blobs = {"x": b"one", "y": "zwei é".encode(), "bad": b"\xff\xfe"}
    wanted = r.sample([c for c, _ in rows], 12)
    got = history.baseline(spark.createDataFrame(rows, COMMITS), spark.createDataFrame(deltas, "commit string, path string, blob string"), spark.createDataFrame(list(blobs.items()), "blob string, content binary"), spark.createDataFrame([(w,) for w in wanted], "commit string"))
    parents, want = dict(rows), set()
    for w in wanted:
        way, c = [], w
        while c is not None:
            way.append(c)
            c = parents[c][0] if parents[c] else None
        tree = {}
        for c in reversed(way):
            tree |= {p: b for x, p, b in deltas if x == c}
        for p, b in tree.items():
            if b and p in ("src/a.rs", "b.py", "lib/c.ts", "gone.go"):
                text = {"x": "one", "y": "zwei é"}.get(b)
                want.add((w, p, text, {"bad": "not UTF-8", "lost": "missing blob"}.get(b)))
    inventory = {r.path for r in got.collect()}
    assert {tuple(x) for x in got.collect()} == {x for x in want if x[1] in inventory} and {"src/a.rs", "lib/c.ts"} <= inventory and "notes.txt" not in inventory


def test_short_branches_leave_a_long_line_whole(spark):
    """Every tenth commit goes past the one before it and two in a row do at times; the greatest child is then a dead end."""
    parent = "id - CASE WHEN id % 100 IN (50, 51) THEN 2 ELSE 1 END"
    rows = spark.range(2000).selectExpr("id AS commit", f"CASE WHEN id > 1 THEN array({parent}) ELSE array() END AS parents")
    places, _ = history.chains(rows)
    assert places.groupBy("chain").count().agg({"count": "max"}).first()[0] > 1900


def test_exits_lead_to_other_chains(spark):
    rows = spark.range(300).selectExpr("id AS commit", "CASE WHEN id > 5 THEN array(id - 1, id - 5) WHEN id > 0 THEN array(id - 1) ELSE array() END AS parents")
    _, exits = history.chains(rows)
    assert exits.isEmpty()


def test_equal_numbers_of_lines_take_the_greater_blob(spark):
    commits = spark.createDataFrame([(0, []), (1, [0])], "commit long, parents array<long>")
    deltas = spark.createDataFrame([(1, "a.rs", 9), (1, "a.rs", 10), (0, "b.rs", 1), (1, "b.rs", None)], "commit long, path string, blob long")
    wanted = spark.createDataFrame([(0,), (1,)], "commit long")
    assert {tuple(r) for r in history.trees(commits, deltas, wanted).collect()} == {(1, "a.rs", 10), (0, "b.rs", 1)}


def test_trees_of_all_commits_of_a_chain(spark):
    rows = spark.range(400).selectExpr("id AS commit", "CASE WHEN id > 0 THEN array(id - 1) ELSE array() END AS parents")
    deltas = spark.range(400).selectExpr("id AS commit", "'a.rs' AS path", "id AS blob")
    found = history.trees(rows, deltas, rows.select("commit"))
    assert {(r.commit, r.blob) for r in found.collect()} == {(i, i) for i in range(400)}
