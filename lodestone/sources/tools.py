"""Messages of compilers and linters as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE_LIMIT, TOTAL_LIMIT = 1 << 20, 4 << 20
_SPAN = "struct<is_primary: boolean, file_name: string, line_start: long, column_start: long, line_end: long>"
_RECORD = f"struct<reason: string, success: boolean, package_id: string, target: string, message: struct<level: string, message: string, code: struct<code: string>, spans: array<{_SPAN}>>>"


def bounded(lines: DataFrame, keys: list[str], seq: str = "seq", line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Lines of streams without build chatter and rendered texts, as far as each stream's bounds go, and (keys, truncated).

    A line above `LINE_LIMIT` bytes leaves and so does each one that would make
    what is kept of its stream longer than `TOTAL_LIMIT`; both mark the stream.
    A stream is one tool's run, so what is kept of it has a bound.
    """
    reason = F.get_json_object(line, "$.reason")
    long = F.octet_length(line) > LINE_LIMIT
    chatter = F.coalesce(reason.isin("compiler-artifact", "build-script-executed"), F.lit(False))
    rows = lines.where(F.coalesce(F.length(line), F.lit(0)) > 0).where(long | ~chatter)
    value = r'"rendered":(?:null|"(?:[^"\\]|\\.)*+")'
    rows = rows.withColumn("_long", long).withColumn("_text", F.when(reason.isNotNull(), F.regexp_replace(line, rf",{value}(?=[}}])|{value},?", "")).otherwise(F.col(line)))
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("kept"))
    size = lambda x: F.octet_length(x["t"]) + 1
    step = lambda s, x: F.struct(F.when(~x["long"] & (s["used"] + size(x) <= TOTAL_LIMIT), s["used"] + size(x)).otherwise(s["used"]).alias("used"), F.concat(s["kept"], F.array(~x["long"] & (s["used"] + size(x) <= TOTAL_LIMIT))).alias("kept"))
    by = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("_long").alias("long"), F.when(~F.col("_long"), F.col("_text")).otherwise("").alias("t")))).alias("x"))
    by = by.withColumn("kept", F.aggregate("x", state, step)["kept"])
    out = by.select(*keys, F.explode(F.arrays_zip("x", "kept")).alias("z")).where("z.kept").select(*keys, F.col("z.x.s").alias(seq), F.col("z.x.t").alias(line))
    return out, by.select(*keys, F.exists("kept", lambda k: ~k).alias("truncated"))


def messages(lines: DataFrame, keys: list[str], root: str = "", seq: str = "seq", line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Findings of compiler messages in streams of JSON lines, and (keys, complete, success) of each stream.

    Errors and warnings with a primary place count. The same rule, package,
    place, message and level is one finding with all its targets, kept where it
    was seen first. A stream is complete if every line could be read, none was
    cut off and the build's end is told.
    """
    rows = lines.select(*keys, seq, F.col(line).alias("l"), F.from_json(line, _RECORD).alias("r"))
    json = F.col("l").startswith("{")
    bad = json & F.get_json_object("l", "$").isNull()
    state = rows.groupBy(*keys).agg((F.count_if(bad | F.contains("l", F.lit("[output truncated"))) == 0).alias("_fine"), F.max_by("r.success", F.when(F.col("r.reason") == "build-finished", F.col(seq))).alias("success"))
    m = rows.where(json & (F.col("r.reason") == "compiler-message") & F.col("r.message.level").isin("error", "warning"))
    m = m.withColumn("p", F.try_element_at(F.filter("r.message.spans", lambda s: s["is_primary"]), F.lit(1))).where("p.file_name is not null")
    rule = F.coalesce("r.message.code.code", F.lit("rustc"))
    file = F.when(F.col("p.file_name").startswith("/"), F.col("p.file_name")).otherwise(F.concat(F.lit(root.rstrip("/") + "/" if root else ""), F.col("p.file_name")))
    columns = {
        "tool": F.when(rule.startswith("clippy::"), "clippy").otherwise("rustc"), "rule": rule, "level": F.col("r.message.level"), "message": F.coalesce("r.message.message", F.lit("")), "file": file,
        "line": F.coalesce("p.line_start", F.lit(0)), "column": F.coalesce("p.column_start", F.lit(0)), "package_id": F.coalesce("r.package_id", F.lit("")),
    }
    m = m.select(*keys, seq, *(c.alias(n) for n, c in columns.items()), F.coalesce("p.line_end", F.lit(0)).alias("end_line"), F.col("r.target").alias("target"))
    found = m.groupBy(*keys, *columns).agg(F.min(seq).alias(seq), F.min_by("end_line", seq).alias("end_line"), F.array_sort(F.collect_set("target")).alias("targets"))
    return found.withColumn("blocking", F.col("level") == "error"), state.select(*keys, (F.col("_fine") & F.col("success").isNotNull()).alias("complete"), "success")


def first_of(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of each key that comes first."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).where("_n = 1").drop("_n")


def as_findings(found: DataFrame) -> DataFrame:
    """Compiler findings as rows of a report."""
    null = lambda t: F.lit(None).cast(t)
    values: dict[str, Column] = {
        "category": F.lit("specialist"), "file": F.col("file"), "line": F.col("line"), "column": F.col("column"), "end_line": F.col("end_line"), "file_b": null("string"), "line_b": null("long"), "end_line_b": null("long"), "metric": null("string"),
        "identity": F.col("rule"), "message": F.col("message"), "recommendation": null("string"), "actual": null("double"), "limit": null("double"), "tokens": null("long"), "blocking": F.col("blocking"), "exit_code": null("int"),
    }
    return found.select(*(c.alias(n) for n, c in values.items()))
