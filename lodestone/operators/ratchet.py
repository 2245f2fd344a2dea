"""Baseline ratchets, attribution and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, ranked, stored

#: Lines of a file that are looked at together.
BUCKET = 256


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> list:
    """Equality of keys, nulls being equal, where the right side has them as _0, _1, ..."""
    return [left[k].eqNullSafe(right[f"_{i}"]) for i, k in enumerate(keys)]


def _renamed(rows: DataFrame, keys: list[str], *more) -> DataFrame:
    return rows.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), *more)


def multiset(current: DataFrame, baseline: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds `grandfathered`: the first findings of a key, in order, as many as the baseline has of it. Null keys are equal.

    A hot key is ranked in parts, so it meets in no single task.
    """
    had = _renamed(baseline.groupBy(*keys).agg(F.count("*").alias("had")), keys, "had")
    rows = ranked(current, keys, order, "_rank")
    out = rows.join(had, _same(rows, had, keys), "left")
    return out.select(*current.columns, (F.col("_rank") <= F.coalesce("had", F.lit(0))).alias("grandfathered"))


#: Findings of a key that one fold works through; a key of more is halved until its parts are that small.
FOLD = 64


def _taken(cars: DataFrame, spots: DataFrame) -> DataFrame:
    """Adds `taken` to spots (k, node, v, id): whether some car (k, node, v, id) of its node parks there, each in the first free spot not below its own value.

    Which spots are taken doesn't depend on the order of the cars. Read by
    value, a car opens a bracket and a spot closes one, and a spot stays free
    where the running sum falls below all earlier ones. Sums and minima are made
    within ranges of a checkpointed dealing and then over ranges, so the rows of
    a key never meet in one task.
    """
    both = cars.select("k", "node", "v", F.lit(0).alias("side"), "id").unionByName(spots.select("k", "node", "v", F.lit(1).alias("side"), "id"))
    dealt = cut(both.repartitionByRange("k", "node", "v", "side", "id").withColumn("part", F.spark_partition_id()))
    by = Window.partitionBy("part", "k", "node").orderBy("v", "side", "id")
    walked = dealt.withColumn("s", F.sum(1 - 2 * F.col("side")).over(by)).withColumn("low", F.min("s").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    ends = walked.groupBy("k", "node", "part").agg(F.sum(1 - 2 * F.col("side")).alias("total"), F.min("s").alias("least"))
    # A key has a row here for each range that it spans.
    earlier = Window.partitionBy("k", "node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    ends = ends.withColumn("before", F.min(F.col("base") + F.col("least")).over(earlier)).select("k", "node", "part", "base", "before")
    met = walked.where("side = 1").join(ends, ["k", "node", "part"])
    free = F.col("s") + F.col("base") < F.least(F.lit(0), "before", F.col("low") + F.col("base"))
    return met.select("k", "node", "v", "id", (~free).alias("taken"))


def numeric(current: DataFrame, baseline: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Adds `grandfathered` and `baseline_value`: each finding of a key, in order, uses up the least baseline value that isn't below its own. Null keys are equal.

    Findings that come earlier take the same values as a set, however they come,
    so a key with many findings is halved by order: the values that the first
    half takes are known without knowing who takes which, and the second half
    has the rest. After as many halvings as the largest key needs, parts of
    `FOLD` findings are worked through one by one, all with built-in functions.
    A value that is null or not a number is never grandfathered and grants nothing.
    """
    named = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    number = F.col(value).cast("double")
    rows = ranked(current.withColumn("_key", named), ["_key"], order, "_rank")
    usable = number.isNotNull() & ~F.isnan(number)
    cars = cut(rows.where(usable).select(F.col("_key").alias("k"), F.lit(0).cast("long").alias("node"), number.alias("v"), F.col("_rank").cast("long").alias("id")))
    spots = baseline.where(usable).select(named.alias("k"), F.lit(0).cast("long").alias("node"), number.alias("v"), F.monotonically_increasing_id().alias("id"))
    spots = cut(_taken(cars, cut(spots)).where("taken").drop("taken"))
    most = cars.agg(F.max("id")).first()[0] or 0
    size = FOLD
    while size < most:
        size *= 2
    while size > FOLD:
        half = size // 2
        place = F.floor((F.col("id") - 1) / half)
        several = cars.groupBy("k").agg(F.max("id").alias("n")).where(F.col("n") > half).select("k")
        part = lambda df, how: df.join(several, "k", how)
        first = part(cars, "left_semi").withColumn("node", place).where(place % 2 == 0).withColumn("node", F.floor(place / 2))
        met = _taken(first, part(spots, "left_semi")).withColumn("node", F.col("node") * 2 + F.when(F.col("taken"), 0).otherwise(1)).drop("taken")
        spots = cut(met.unionByName(part(spots, "left_anti")))
        size = half
    cars = cars.withColumn("node", F.floor((F.col("id") - 1) / FOLD))
    lists = cars.groupBy("k", "node").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("cars"))
    left = spots.groupBy("k", "node").agg(F.sort_array(F.collect_list("v")).alias("spots"))

    def park(state, car):
        below = F.size(F.filter(state.spots, lambda s: s < car.v))
        fits = below < F.size(state.spots)
        rest = F.concat(F.slice(state.spots, F.lit(1), below), F.slice(state.spots, below + 2, F.size(state.spots)))
        had = F.when(fits, F.get(state.spots, below))
        return F.struct(F.when(fits, rest).otherwise(state.spots).alias("spots"), F.concat(state.done, F.array(F.struct(car.id.alias("_rank"), had.alias("baseline_value")))).alias("done"))

    none = F.array().cast("array<struct<_rank: long, baseline_value: double>>")
    folded = lists.join(left, ["k", "node"]).select("k", F.explode(F.aggregate("cars", F.struct(F.col("spots"), none.alias("done")), park).getField("done")).alias("x"))
    found = folded.select(F.col("k").alias("_key"), "x._rank", "x.baseline_value").where("baseline_value is not null")
    return rows.join(found, ["_key", "_rank"], "left").select(*current.columns, F.col("baseline_value").isNotNull().alias("grandfathered"), "baseline_value")


def touched(findings: DataFrame, changed_files: DataFrame, changed_lines: DataFrame) -> DataFrame:
    """Adds `touched` to findings of a report (`report.FINDING` and ord): a budget by its file, suppressions and invariants by their line, functions and clones by a line in their range, a clone on either side.

    changed_files: (file); changed_lines: (file, line). A file with changed
    lines is changed.
    """
    files = changed_files.select("file").union(changed_lines.select("file")).distinct()
    whole = findings.where("category = 'budget'").join(files, "file", "left_semi").select("ord")
    category, line = F.col("category"), F.col("line")
    span = lambda f, a, b: F.struct(F.col(f).alias("file"), a.cast("long").alias("first"), b.cast("long").alias("last"))
    side = lambda f, a, b: F.when(F.col(a) <= F.col(b), span(f, F.col(a), F.col(b)))
    ranges = (
        F.when(category.isin("suppression", "invariant"), F.array(span("file", line, line)))
        .when(category == "complexity", F.array(span("file", line, F.greatest("line", "end_line"))))
        .when(category == "clone", F.array_compact(F.array(side("file", "line", "end_line"), side("file_b", "line_b", "end_line_b"))))
    )
    spans = findings.select("ord", F.explode(ranges).alias("_r")).select("ord", "_r.*")
    hit = touched_ranges(spans, changed_lines.select("file", "line").distinct()).select("ord")
    found = whole.union(hit).distinct().withColumn("_t", F.lit(True))
    return findings.join(found, "ord", "left").select(*findings.columns, F.coalesce("_t", F.lit(False)).alias("touched"))


def apply(current: DataFrame, baseline: DataFrame, changed_files: DataFrame, changed_lines: DataFrame, renames: DataFrame) -> DataFrame:
    """Adds `touched` and `grandfathered` to current findings (`report.FINDING`, ord and content, the line's text): debt that the baseline has too and no change touches.

    Budgets and functions may not have grown; suppressions, invariants and clones
    are counted. Current paths are followed back to their oldest names. Coverage,
    mutation and steps are never grandfathered, nor clones without a fingerprint.
    """
    rows = touched(current, changed_files, changed_lines)
    origin = lineage(renames)
    for c in ("file", "file_b"):
        rows = rows.join(origin.select(F.col("path").alias(c), F.col("origin").alias(f"_o_{c}")), c, "left").withColumn(f"_o_{c}", F.coalesce(f"_o_{c}", c))
    base = baseline.withColumn("_o_file", F.col("file")).withColumn("_o_file_b", F.col("file_b"))
    text = F.trim(F.regexp_replace("content", r"(?U)\s+", " "))
    low, high = F.least("_o_file", "_o_file_b"), F.greatest("_o_file", "_o_file_b")
    key = (
        F.when(F.col("category") == "budget", F.array("_o_file", "metric"))
        .when(F.col("category") == "complexity", F.array("_o_file", "identity", "metric"))
        .when(F.col("category") == "suppression", F.array(F.col("_o_file"), F.col("identity"), text))
        .when(F.col("category") == "invariant", F.array(F.col("_o_file"), F.col("identity"), F.col("metric"), F.col("file_b"), text))
        .when((F.col("category") == "clone") & (F.coalesce("identity", F.lit("")) != ""), F.array(low, high, F.col("identity")))
    )
    # What numbers and counts need is read many times, and so is made once; texts and places aren't among it.
    keyed = lambda df, *more: stored(df.where(key.isNotNull()).select(F.to_json(F.struct("category", key.alias("k"))).alias("_key"), "category", "actual", *more))
    cur, old = keyed(rows.where("not touched"), "ord"), keyed(base)
    by_value, by_count = F.col("category").isin("budget", "complexity"), F.col("category").isin("suppression", "invariant", "clone")
    flags = numeric(cur.where(by_value).select("_key", "ord", "actual"), old.where(by_value).select("_key", "actual"), ["_key"], "actual", "ord").select("ord", "grandfathered")
    flags = flags.union(multiset(cur.where(by_count).select("_key", "ord"), old.where(by_count).select("_key"), ["_key"], "ord").select("ord", "grandfathered"))
    return rows.join(flags, "ord", "left").select(*current.columns, "touched", F.coalesce("grandfathered", F.lit(False)).alias("grandfathered"))


def summary(applied: DataFrame) -> DataFrame:
    """(grandfathered, retained) of a ratchet's findings."""
    return applied.agg(F.count_if("grandfathered").alias("grandfathered"), F.count_if(~F.col("grandfathered")).alias("retained"))


def _range(a: Column, b: Column) -> Column:
    return F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string")))


def with_context(findings: DataFrame, changed_files: DataFrame, changed_lines: DataFrame) -> DataFrame:
    """Appends to messages of retained findings (with ord) what changed around them, once: the file, the run of changed lines, or the changed parts of a clone's sides."""
    lines = changed_lines.select("file", "line").distinct()
    runs = hunks(lines)
    first = lines.groupBy("file").agg(F.min("line").alias("_first"))
    files = changed_files.select("file").distinct().withColumn("_changed", F.lit(True))
    by_file = findings.where("category in ('budget', 'coverage', 'mutation')").join(first, "file", "left").join(files, "file", "left")
    said = F.when(F.col("_first").isNotNull(), F.concat(F.lit("changed file `"), "file", F.lit("` at line "), F.col("_first").cast("string"))).when(F.col("_changed"), F.concat(F.lit("changed file `"), "file", F.lit("`")))
    out = by_file.select("ord", said.alias("_context"))
    # A changed line lies in one run; each run is dealt to the buckets of lines that it spans.
    spread = lambda df, a, b: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor(F.col(b) / BUCKET))))
    dealt = spread(runs.select("file", F.col("first").alias("_a"), F.col("last").alias("_b")), "_a", "_b")
    at = findings.where("category in ('suppression', 'complexity', 'invariant')").withColumn("_bucket", F.floor(F.col("line") / BUCKET)).join(dealt, ["file", "_bucket"]).where(F.col("line").between(F.col("_a"), F.col("_b")))
    out = out.union(at.select("ord", F.concat(F.lit("changed hunk `"), "file", F.lit("`:"), _range(F.col("_a"), F.col("_b")))))
    parts = None
    for n, (f, a, b) in enumerate((("file", "line", "end_line"), ("file_b", "line_b", "end_line_b"))):
        side = findings.where("category = 'clone'").select("ord", F.lit(n).alias("_n"), F.col(f).alias("file"), F.col(a).alias("_x"), F.col(b).alias("_y"))
        met = spread(side.where("_x <= _y"), "_x", "_y").join(dealt, ["file", "_bucket"]).where("_a <= _y and _b >= _x").select("ord", "_n", F.greatest("_a", "_x").alias("_a"), F.least("_b", "_y").alias("_b")).distinct()
        shown = met.groupBy("ord", "_n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_a", "_b"))), lambda r: _range(r["_a"], r["_b"])), ",").alias("_ranges"))
        one = side.join(shown, ["ord", "_n"], "left").join(files, "file", "left")
        text = F.when(F.col("_ranges").isNotNull(), F.concat(F.lit("`"), "file", F.lit("`:"), "_ranges")).when(F.col("_changed"), F.concat(F.lit("`"), "file", F.lit("`")))
        one = one.select("ord", "_n", text.alias("_text")).where("_text is not null")
        parts = one if parts is None else parts.union(one)
    both = parts.groupBy("ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_text"))), lambda x: x["_text"]), ", ").alias("_text"))
    out = out.union(both.select("ord", F.concat(F.lit("changed clone ranges: "), "_text"))).where("_context is not null")
    rows = findings.join(out, "ord", "left")
    add = F.col("_context").isNotNull() & ~F.coalesce(F.contains("message", F.lit("[changed ")), F.lit(False))
    message = F.when(add, F.concat(F.when(F.coalesce("message", F.lit("")) == "", "").otherwise(F.concat("message", F.lit(" "))), F.lit("["), "_context", F.lit("]"))).otherwise(F.col("message"))
    return rows.select(*(message.alias(c) if c == "message" else c for c in findings.columns))


def touched_ranges(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """Findings (file, first, last) with a changed line (file, line) inside.

    A range meets the changed lines of the bucket in which it begins and the
    first one behind that bucket, not all lines of its file.
    """
    bucket = lambda c: F.floor(F.col(c) / BUCKET).alias("_bucket")
    lines = changes.select("file", bucket("line"), F.col("line").alias("_line"))
    begins = findings.select("file", bucket("first"), F.lit(None).alias("_line")).distinct()
    marks = lines.unionByName(begins).groupBy("file", "_bucket").agg(F.collect_set("_line").alias("_lines"))
    behind = Window.partitionBy("file").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("_next", F.min(F.array_min("_lines")).over(behind))
    last = F.greatest("first", "last")
    met = findings.select("*", bucket("first")).join(marks, ["file", "_bucket"])
    return met.where(F.exists("_lines", lambda x: x.between(F.col("first"), last)) | (F.col("_next") <= last)).select(*findings.columns)


def hunks(changes: DataFrame) -> DataFrame:
    """Maximal runs of consecutive changed lines: (file, first, last)."""
    by = Window.partitionBy("file").orderBy("line")
    rows = changes.select("file", "line").distinct().withColumn("island", F.col("line") - F.row_number().over(by))
    return rows.groupBy("file", "island").agg(F.min("line").alias("first"), F.max("line").alias("last")).select("file", "first", "last")


def lineage(renames: DataFrame) -> DataFrame:
    """(new, old) to (path, origin): the oldest name of each new path. Names on a cycle lead back to themselves, and those that run into one to where they meet it; of two old names the lesser counts.

    Pointer doubling, twice where there are cycles: after as many steps as there
    are names, what walks on is on a cycle, and cycles are cut there.
    """
    steps = cut(renames.where("new <> old").groupBy(F.col("new").alias("path")).agg(F.min("old").alias("origin")))
    rounds = steps.count().bit_length() + 1
    ends = lambda: steps.select("origin").join(steps.select(F.col("path").alias("origin")), "origin", "left_anti").distinct()
    jump = _doubled(steps, rounds)
    walking = jump.join(ends(), "origin", "left_anti")
    if walking.isEmpty():
        return jump
    on_cycle = cut(walking.select(F.col("origin").alias("path")).distinct())
    straight = steps.join(on_cycle, "path", "left_anti")
    return _doubled(cut(straight), rounds).union(on_cycle.select("path", F.col("path").alias("origin")))


def _doubled(steps: DataFrame, rounds: int) -> DataFrame:
    """(path, origin) after two to the power of `rounds` steps, or fewer where all have come to an end."""
    jump = steps
    for _ in range(rounds):
        further = jump.select(F.col("path").alias("origin"), F.col("origin").alias("further"))
        met = cut(jump.join(further, "origin", "left").select("path", F.coalesce("further", "origin").alias("origin"), F.col("further").isNotNull().alias("went")))
        jump = met.select("path", "origin")
        if met.where("went").isEmpty():
            break
    return jump


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, mask): bits of all seeds (node, mask) that reach a node along edges (src, dst).

    Each round moves only the bits that the last one added; a visited pair of
    node and bit never comes again, so cycles end.
    """
    bits = F.explode(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: F.getbit(F.col("mask").cast("long"), b) == 1))
    new = stored(seeds.select(F.col("node").cast("long").alias("node"), bits.alias("bit")).distinct())
    seen, rounds = new, 0
    steps = stored(edges.select(F.col("src").cast("long").alias("node"), F.col("dst").cast("long").alias("dst")).distinct())
    while not new.isEmpty():
        new = stored(new.join(steps, "node").select(F.col("dst").alias("node"), "bit").distinct().join(seen, ["node", "bit"], "left_anti"))
        seen, rounds = seen.union(new), rounds + 1
        if rounds % 8 == 0:
            seen = stored(seen)
    return seen.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
