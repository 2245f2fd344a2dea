"""Evidence of coverage and mutation: which sources it has to cover, and whether it does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .code import not_executable
from .files import PARSED_EXTENSIONS

# Extensions that each producer of evidence supports.
PRODUCERS = {
    "cargo-llvm-cov": ("rs",),
    "cargo-mutants": ("rs",),
    "pytest": ("py",),
    "vitest": ("js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts"),
    "stryker": ("js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts"),
}


def source_inventory(files: DataFrame, functions: DataFrame) -> DataFrame:
    """(path) of source files (path, role, text) that can run; of Rust those with a function (file, test_only) outside of tests."""
    rows = files.where("role = 'source'").where(~not_executable(F.col("path"), F.col("text")))
    rust = T.extension_of(F.col("path")) == "rs"
    own = functions.where(~F.coalesce("test_only", F.lit(False))).select(F.col("file").alias("path")).distinct()
    return rows.where(~rust).select("path").union(rows.where(rust).select("path").join(own, "path", "left_semi")).distinct()


def partition_sources(inventory: DataFrame, partitions: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """(partition, path, supported) of the inventory (path) by partitions of a producer and globs; supported: whether the producer reads the extension."""
    out = None
    for name, (producer, globs) in partitions.items():
        hit = F.col("path").rlike("|".join(f"(?:{T.glob_to_regex(g)})" for g in globs)) if globs else F.lit(False)
        part = inventory.where(hit).select(F.lit(name).alias("partition"), "path", T.extension_of(F.col("path")).isin(*PRODUCERS[producer]).alias("supported"))
        out = part if out is None else out.unionByName(part)
    return inventory.select(F.lit("").alias("partition"), "path", F.lit(True).alias("supported")).where("false") if out is None else out


def plan_differences(planned: DataFrame, reported: DataFrame, sources: DataFrame, inputs: DataFrame) -> DataFrame:
    """(problem, file, id): mutants (file, id) that only the plan or only the report has, or that the report has twice; sources (file, sha256) that aren't the bound inputs; and reported files that nobody planned."""
    key = ["file", "id"]
    twice = reported.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("reported twice").alias("problem"), *key)
    row = lambda problem, df: df.select(F.lit(problem).alias("problem"), "file", "id")
    none = F.lit(None).cast(planned.schema["id"].dataType)
    left_out = row("left out", planned.join(reported, key, "left_anti"))
    added = row("added", reported.distinct().join(planned, key, "left_anti"))
    unplanned = row("unplanned file", reported.select("file").distinct().join(sources, "file", "left_anti").withColumn("id", none))
    bound = inputs.select(F.col("file"), F.col("sha256").alias("_sha"))
    moved = row("source differs", sources.join(bound, "file", "left").where(~F.col("sha256").eqNullSafe(F.col("_sha"))).withColumn("id", none))
    return twice.union(left_out).union(added).union(unplanned).union(moved)


def mutation_scope(mutated: DataFrame, inputs: DataFrame, files: DataFrame, roles: DataFrame) -> DataFrame:
    """(file, problem) of mutated files (file) that aren't inputs (file), or aren't source that may be mutated; files: (path, role); roles: the policy's dimension."""
    names = mutated.select("file").distinct()
    known = inputs.select("file").distinct().withColumn("_in", F.lit(True))
    of = files.select(F.col("path").alias("file"), "role").join(F.broadcast(roles.select("role", "mutation")), "role")
    rows = names.join(known, "file", "left").join(of, "file", "left")
    parsed = F.lower(T.extension_of(F.col("file"))).isin(*PARSED_EXTENSIONS)
    problem = F.when(F.col("_in").isNull(), "outside the inputs").when(~F.coalesce("mutation", F.lit(False)) | ~parsed, "outside the source scope")
    return rows.select("file", problem.alias("problem")).where("problem is not null")


#: Bytes of a file that are looked at together.
BUCKET = 4096


def overlapping(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Spans (file, start, stop) that a range (file, start, stop) overlaps, ends being outside of both; rows as they are.

    Both are dealt to the buckets that they touch, so only neighbours meet.
    """
    deal = lambda df: df.where("start < stop").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("stop") - 1) / BUCKET))))
    r = deal(ranges.select("file", "start", "stop")).select("file", "_bucket", F.col("start").alias("_a"), F.col("stop").alias("_b"))
    hit = deal(spans).join(r, ["file", "_bucket"]).where("_a < stop and _b > start").select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(spans.columns))).distinct()
    return spans.join(hit, [spans[c].eqNullSafe(hit[f"_{i}"]) for i, c in enumerate(spans.columns)], "left_semi")


def test_spans(spans: DataFrame, files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds `test` to spans (file, start, stop): in a test file (path, role), or overlapping a test range."""
    tests = files.where("role = 'test'").select(F.col("path").alias("file")).distinct().withColumn("_whole", F.lit(True))
    hit = overlapping(spans, ranges).distinct().withColumn("_part", F.lit(True))
    rows = spans.join(tests, "file", "left")
    same = [rows[c].eqNullSafe(hit[c]) for c in spans.columns]
    return rows.join(hit, same, "left").select(*(rows[c] for c in spans.columns), F.coalesce(rows["_whole"], hit["_part"], F.lit(False)).alias("test"))


PRODUCTION, TEST = 1, 2


def ownership(files: DataFrame, reach: DataFrame, custom: DataFrame) -> DataFrame:
    """(path, role) of files (path, role): source that only tests reach (node, mask) is test, unless a custom rule (path) gave its role."""
    own = custom.select("path").distinct().withColumn("_custom", F.lit(True))
    rows = files.join(reach.select(F.col("node").alias("path"), "mask"), "path", "left").join(own, "path", "left")
    moved = (F.col("role") == "source") & (F.col("mask") == TEST) & F.col("_custom").isNull()
    return rows.select("path", F.when(moved, "test").otherwise(F.col("role")).alias("role"))


def line_roles(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, line, test) of lines (file, line, start, stop in bytes): true if test ranges cover all of it that isn't blank, false if they touch nothing, null between."""
    deal = lambda df, a, b: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / BUCKET))))
    r = deal(ranges.where("start < stop").select("file", F.col("start").alias("_a"), F.col("stop").alias("_b")), "_a", "_b")
    met = deal(lines, "start", "stop").join(r, ["file", "_bucket"]).where("_a < stop and _b > start").select("file", "line", "start", "stop", "_a", "_b").distinct()
    # Ranges of a file are disjoint, so the covered bytes of a line add up.
    inside = met.groupBy("file", "line").agg(F.sum(F.least("stop", "_b") - F.greatest("start", "_a")).alias("_covered"))
    size = F.col("stop") - F.col("start")
    return lines.join(inside, ["file", "line"], "left").select("file", "line", F.when(F.col("_covered").isNull(), False).when(F.col("_covered") >= size, True).alias("test"))


def role_sizes(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, role, bytes, lines) of files (path, role, text), where test ranges (file, start, stop in bytes) of a source are sized apart from the rest.

    A sweep over a file's line starts and range ends, in order of bytes, keeps
    the number of open ranges; what lies between two of them belongs to one line
    and one side. A line counts for a side that has a byte of it that isn't
    white space, and for each side that has some of it if it is blank. A side
    without bytes has no row; files of other roles and without ranges keep
    their whole size. Nothing pairs lines with ranges, and ranges may overlap.
    """
    sized = files.select("path", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("total", F.octet_length("text").cast("long"))
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("step")), F.struct(F.col("stop").alias("pos"), F.lit(-1).alias("step")))
    marks = ranges.where("start < stop").select(F.col("file").alias("path"), F.explode(ends).alias("e")).select("path", F.greatest(F.col("e.pos"), F.lit(0)).cast("long").alias("pos"), "e.step")
    split = sized.where("role = 'source'").join(marks.select("path").distinct(), "path", "left_semi")
    whole = sized.join(split.select("path"), "path", "left_anti").select("path", "role", F.col("total").alias("bytes"), F.size(T.lines(F.col("text"))).cast("long").alias("lines"))
    lines = split.select("path", "total", F.posexplode(F.split("text", "\n")).alias("n", "body"))
    by = Window.partitionBy("path")
    length = F.octet_length("body") + 1
    lines = lines.withColumn("pos", F.coalesce(F.sum(length).over(by.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = lines.select("path", "pos", F.lit(0).alias("step"), "n", "body", "pos", "total").toDF("path", "pos", "step", "n", "body", "first", "total")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    both = starts.unionByName(marks.join(split.select("path"), "path", "left_semi").select("path", "pos", "step", none("n", "int"), none("body", "string"), none("first", "long"), none("total", "long")))
    along = by.orderBy("pos", "step", F.col("n").asc_nulls_first())
    last = lambda c: F.last(c, ignorenulls=True).over(along)
    stop = F.least(F.coalesce(F.lead("pos").over(along), F.lit(1 << 62)), F.max("total").over(by))
    swept = both.select("path", "pos", stop.alias("stop"), (F.sum("step").over(along) > 0).alias("test"), last("n").alias("n"), last("body").alias("body"), last("first").alias("first")).where("stop > pos")
    part = F.decode(F.expr("substring(encode(body, 'UTF-8'), int(pos - first) + 1, int(stop - pos))"), "ISO-8859-1")
    pieces = swept.select("path", "n", "test", (F.col("stop") - F.col("pos")).alias("bytes"), part.rlike("[^ \\t\\n\\f\\r]").alias("filled"))
    of = pieces.groupBy("path", "n").agg(F.bool_or("filled").alias("any"), *(x for t in (True, False) for x in (F.sum(F.when(F.col("test") == t, F.col("bytes"))).alias(f"bytes_{t}"), F.bool_or(F.col("filled") & (F.col("test") == t)).alias(f"filled_{t}"))))
    side = lambda t, role: F.struct(F.lit(role).alias("role"), F.col(f"bytes_{t}").alias("bytes"), (F.col(f"filled_{t}") | (~F.col("any") & F.col(f"bytes_{t}").isNotNull())).alias("counts"))
    each = of.select("path", F.explode(F.array(side(True, "test"), side(False, "source"))).alias("s")).select("path", "s.*").where("bytes is not null")
    apart = each.groupBy("path", "role").agg(F.sum("bytes").alias("bytes"), F.count_if("counts").alias("lines"))
    return whole.unionByName(apart)


def receipt_problems(receipts: DataFrame) -> DataFrame:
    """(receipt, problem) of receipts against what they are held to: rows with each value and its wanted_ counterpart; the first that differs counts."""
    names = ("root", "schema", "kind", "command", "report_sha256", "inputs_sha256", "partition")
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(~F.col(n).eqNullSafe(F.col(f"wanted_{n}")), n).otherwise(out)
    allowed = F.col("exit_code").isin(0) | ((F.col("kind") == "mutation") & F.col("exit_code").isin(2, 3))
    problem = F.when(~F.coalesce(F.col("cleaned"), F.lit(False)), "cleanup").when(~F.coalesce(allowed, F.lit(False)), "exit_code").otherwise(out)
    return receipts.select("receipt", problem.alias("problem")).where("problem is not null")


def reusable(receipts: DataFrame) -> DataFrame:
    """Receipts (receipt) whose bound inputs are those of the current run; the others are produced again."""
    bad = receipt_problems(receipts)
    same = receipts.where(F.col("runtime_sha256").eqNullSafe(F.col("wanted_runtime_sha256")))
    return same.join(bad, "receipt", "left_anti").select("receipt")


def is_partial(columns: dict[str, Column]) -> Column:
    """Whether a run leaves something out: another command, a scope, or engines that are asked for and not selected."""
    return (columns["command"] != "check") | (columns["mode"] != "repository") | F.exists(columns["engines"], lambda e: e["enabled"] & ~e["selected"])
