"""LCOV reports as tables."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Tags of the format; those of the second line aren't supported and are findings.
TAGS = ("TN", "VER", "SF", "DA", "LF", "LH", "FN", "FNDA", "FNF", "FNH", "BRDA", "BRF", "BRH", "end_of_record")
UNSUPPORTED = ("FNL", "FNA", "MCDC", "MRF", "MRH")
COUNTERS = ("LF", "LH", "FNF", "FNH", "BRF", "BRH")
RECORD = ["report", "record"]


END = "end_of_record"


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _pieces(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., i, n, piece): the lines between the ends of records, of rows with a text; blank lines and comments are left out."""
    text = F.col("text")
    # Nothing is left out of texts without blanks, comments and empty lines.
    plain = _ascii(text) & ~text.rlike(r"[\t\x0B\f\r #]") & ~text.contains("\n\n") & ~text.startswith("\n")
    whole = F.when(text.endswith("\n"), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    kept = F.filter(F.transform(T.lines(text), T.strip), lambda x: (x != "") & ~x.startswith("#"))
    cut = F.split(F.concat(F.lit("\n"), F.when(plain, whole).otherwise(F.array_join(kept, "\n"))), rf"\n{END}(?=\n|$)", -1)
    rows = rows.select(*keys, F.explode(F.array(cut)).alias("cut"))
    return rows.select(*keys, F.size("cut").alias("n"), F.posexplode("cut").alias("i", "piece")).withColumn("piece", F.substr("piece", F.lit(2)))


def _file() -> Column:
    found = T.strip(F.regexp_extract("piece", r"(?:^|\n)SF:([^\n]*)", 1))
    return F.when(found != "", found).alias("file")


def _tagged(rows: DataFrame) -> DataFrame:
    """(report, seq, record, tag, rest) of rows (report, record, file, piece)."""
    each = rows.select("report", "record", "file", F.posexplode(F.split("piece", "\n")).alias("seq", "line"))
    tag = F.regexp_extract("line", r"^([A-Za-z_]+)(?::|$)", 1)
    return each.select("report", "record", "file", F.col("seq").cast("long").alias("seq"), tag.alias("tag"), F.regexp_extract("line", r"^[A-Za-z_]+:(.*)$", 1).alias("rest"))


def _bodies(reports: DataFrame, report_col: str, text_col: str) -> DataFrame:
    """(report, record, file, piece): the records of reports that are rows, cut and numbered inside each report's array, so order needs no shuffle."""
    rows = _pieces(reports.select(F.col(report_col).alias("report"), F.col(text_col).alias("text")), ["report"])
    ended = F.col("i") < F.col("n") - 1
    rows = rows.where(ended | (F.col("piece") != "") | (F.col("n") == 1))
    body = F.when(~ended, F.col("piece")).when(F.col("piece") == "", END).otherwise(F.concat("piece", F.lit(f"\n{END}")))
    return rows.select("report", F.col("i").cast("long").alias("record"), _file(), body.alias("piece"))


def entries(reports: DataFrame, report_col: str = "report", text_col: str = "text") -> DataFrame:
    """(report, seq, record, tag, rest): each line with the number of its record and that record's file.

    For reports that are rows. `read_reports` reads large files.
    """
    return _tagged(_bodies(reports, report_col, text_col))


def record_rows(reports: DataFrame, report_col: str = "report", text_col: str = "text") -> DataFrame:
    """(report, record, file, piece): the same as a row for each record with its lines as one text; `production` and `problems` take either."""
    return _bodies(reports, report_col, text_col)


def _whole(found: DataFrame) -> DataFrame:
    """Entries as `record_rows`, which stay as they are."""
    if "piece" in found.columns:
        return found
    line = F.when(F.col("tag") == "", "").otherwise(F.concat_ws(":", "tag", "rest"))
    each = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return found.groupBy(*RECORD).agg(F.max("file").alias("file"), F.array_join(F.transform(each, lambda x: x["line"]), "\n").alias("piece"))


def read_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same of report files, with their paths as `report`, where one file is read by as many tasks as it has splits.

    Splits are cut at the ends of records. A record's number is made of where
    its split begins and how many records the task had before, fewer than a
    split has bytes, so numbers of a file are distinct and ascend, with gaps,
    without a shuffle. The last record of a file has no end of its own only if
    text follows the last end; such ends, one row for each record, meet the last
    records of the files. A file without
    lines gives one row without a tag.
    """
    meta = lambda c: F.col(f"_metadata.{c}")
    chunks = spark.read.option("lineSep", f"\n{END}").text(paths)
    found_in = chunks.inputFiles()
    ordinal = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    chunks = chunks.select(meta("file_path").alias("report"), meta("file_block_start").alias("start"), (meta("file_block_start") + ordinal).alias("base"), (meta("file_block_start") + meta("file_block_length") >= meta("file_size")).alias("late"), F.col("value").alias("text"))
    # Ends that stand behind blanks are found within a chunk, of which they make several records.
    rows = _pieces(chunks, ["report", "start", "base", "late"]).select("report", "start", (F.col("base") * (1 << 20) + F.col("i")).alias("record"), "late", (F.col("i") < F.col("n") - 1).alias("ended"), _file(), "piece")
    inner = F.when(F.col("ended"), F.when(F.col("piece") == "", END).otherwise(F.concat("piece", F.lit(f"\n{END}")))).otherwise(F.col("piece"))
    found = _tagged(rows.where("ended or piece <> ''").select("report", "record", "file", inner.alias("piece")))
    only = (F.count("*") == 1) & (F.max("piece") == "") & (F.max("start") == 0)
    last = rows.where("late").groupBy("report").agg(F.max("record").alias("record"), only.alias("blank"))
    size = F.when(F.col("piece") == "", 0).otherwise(F.size(F.split("piece", "\n"))).cast("long")
    ends = rows.where("not ended").select("report", size.alias("seq"), "record", "file").join(last, RECORD, "left_anti")
    # Spark skips files without a byte; their names are known from the listing.
    listed = spark.createDataFrame([(f,) for f in found_in], "report string")
    plain = lambda df: df.withColumn("_plain", F.regexp_replace("report", "^([A-Za-z]+):/+", "$1:/"))
    none = plain(listed).join(plain(last.where("not blank")).select("_plain"), "_plain", "left_anti")
    none = none.select("report", F.lit(0).cast("long").alias("record"), F.lit(None).cast("string").alias("file"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("tag"), F.lit("").alias("rest"))
    return found.unionByName(ends.select("report", "record", "file", "seq", F.lit(END).alias("tag"), F.lit("").alias("rest"))).unionByName(none)


def _count(x: Column) -> Column:
    """A whole number of digits only; null otherwise, also beyond 64 bits."""
    trimmed = F.trim(x)
    return F.when(trimmed.rlike(r"^\+?[0-9]+$"), trimmed.try_cast("long"))


def line_hits(found: DataFrame) -> DataFrame:
    """(report, record, file, line, hits) of DA entries; what isn't two or three fields, a line from 1 on and a count has a null line."""
    parts = F.split("rest", ",")
    line, hits = _count(F.get(parts, F.lit(0))), _count(F.get(parts, F.lit(1)))
    ok = F.size(parts).between(2, 3) & F.forall(parts, lambda x: F.trim(x) != "") & (line > 0) & hits.isNotNull()
    return found.where("tag = 'DA'").select("report", "record", "file", F.when(ok, line).alias("line"), F.when(ok, hits).alias("hits"))


_BREAKS = re.compile("[\r\x85\u2028\u2029]")
_WORD = re.compile("[A-Za-z_]+")
_TAG = {t: i for i, t in enumerate((*TAGS, *UNSUPPORTED, "a word", ""))}
_DA, _BR, _TOLD, _FN = 1, 2, 3, 4
_PLACES = ("sf_at", "metric_at", "tn_at", "ver_at")
_NUMBERS = (
    *(t.lower() for t in COUNTERS), *_PLACES, "bad_counts", "twice", "sf", "ends", "odd", "unknown", "real", "ver", "empty_sf", "empty_ver",
    "da", "da_lines", "da_bad", "da_hit", "fn", "fn_lone", "fn_twice", "fn_bad", "fn_hit", "br", "br_bad", "br_twice", "br_hit", "told", "told_hit",
)
_READ = f"struct<{', '.join(f'{n}: long' for n in _NUMBERS)}, marks: array<struct<line: long, kind: int, hit: boolean>>>"


def _number(x: str) -> int:
    """`_count` of a text, -1 for null."""
    x = x.strip(" ")
    digits = x[1:] if x.startswith("+") else x
    if not (digits.isascii() and digits.isdigit()):
        return -1
    digits = digits.lstrip("0") or "0"
    return int(digits) if len(digits) < 20 and int(digits) < 1 << 63 else -1


def _read_line(text: str) -> tuple:
    """(tag, n, hit, name) of a line: its number, the line that it is about if it has one, -1 where that can't be read; whether it was hit, or is empty; a function's name or a branch's line and names, None where they can't be read."""
    tag, _, rest = text.partition(":")
    if _BREAKS.search(rest):
        rest = ""
    p = rest.split(",")
    n, hit, name = -1, False, None
    if tag == "DA":
        if len(p) in (2, 3) and all(f.strip(" ") for f in p) and _number(p[0]) > 0 and _number(p[1]) >= 0:
            n, hit = _number(p[0]), _number(p[1]) > 0
    elif tag == "BRDA":
        p = [f.strip(" ") for f in p] if len(p) > 3 else [""] * 4
        taken = _number(p[-1])
        hit = taken > 0
        if _number(p[0]) > 0 and not {"", "-"} & set(p[1:-1]) and (taken >= 0 or p[-1] == "-"):
            n = _number(p[0])
        name = (n, p[1], ",".join(rest.split(",")[2:-1]).strip(" "))
    elif tag in ("FN", "FNDA"):
        n, last = _number(p[0]), _number(p[1]) if tag == "FN" and len(p) > 2 else -1
        name = ",".join(p[1 if last < 0 else 2 :]).strip(" ")
        if len(p) < 2 or not name or n < 0 or (tag == "FN" and (n == 0 or 0 <= last < n)):
            name = None
    elif tag in COUNTERS:
        n = _number(rest)
    elif tag in ("SF", "VER"):
        hit = not rest.strip(" ")
    elif tag not in _TAG:
        tag = "a word" if _WORD.fullmatch(tag) else ""
    return _TAG[tag], n, hit, name


def _last_of(rows: list, keys: int) -> list:
    """Columns sorted, and of rows that are equal in the first so many only the last."""
    order = np.lexsort(rows[::-1])
    rows = [x[order] for x in rows]
    ends = np.ones(len(order), bool)
    ends[:-1] = np.any([x[1:] != x[:-1] for x in rows[:keys]], axis=0)
    return [x[ends] for x in rows]


def _read_records(pieces: pa.Array) -> pa.Array:
    """What the lines of each record say, read as `line_hits`, `branches`, `functions`, `function_projection` and `counters` read entries: `_NUMBERS`, and (line, kind, hit) of what has a line. Equal lines are read once."""
    split = pc.split_pattern(pieces, "\n")
    size = len(pieces)
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    rec = np.repeat(np.arange(size), lengths)
    at = np.arange(len(rec)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    coded = split.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    tags, ns, hits, names = zip(*map(_read_line, coded.dictionary.to_pylist())) if len(code) else ((),) * 4
    ids = {None: -1}
    tag, n, hit = np.array(tags, np.int8)[code], np.array(ns, np.int64)[code], np.array(hits, bool)[code]
    ident = np.array([ids.setdefault(x, len(ids)) for x in names], np.int64)[code]
    of = lambda *t: np.isin(tag, [_TAG[x] for x in t])
    count = lambda at: np.bincount(at, minlength=size)

    def place(mask, last):
        out, rows = np.full(size, -1), np.flatnonzero(mask)[:: 1 if last else -1]
        out[rec[rows]] = at[rows]
        return out

    x = {}
    again = np.zeros(size, np.int64)
    for t in COUNTERS:
        mine = of(t)
        x[t.lower()] = np.full(size, -1)
        np.maximum.at(x[t.lower()], rec[mine], n[mine])
        again += np.maximum(count(rec[mine]) - 1, 0)
    da, br, fns, sf, ver = of("DA"), of("BRDA"), of("FN", "FNDA"), of("SF"), of("VER")
    x |= {"sf_at": place(sf, False), "metric_at": place(~of("SF", "TN", "VER", END), False), "tn_at": place(of("TN"), True), "ver_at": place(ver, True)}
    x |= {"bad_counts": count(rec[of(*COUNTERS) & (n < 0)]), "twice": again, "sf": count(rec[sf]), "ends": count(rec[of(END)]), "odd": count(rec[of(*UNSUPPORTED)]), "unknown": count(rec[of("a word", "")]), "real": count(rec[~of("TN", "")])}
    x |= {"ver": count(rec[ver]), "empty_sf": count(rec[sf & hit]), "empty_ver": count(rec[ver & hit])}
    read = da & (n > 0)
    x |= {"da": count(rec[da]), "da_lines": count(_last_of([rec[read], n[read]], 2)[0]), "da_bad": count(rec[da & ~read]), "da_hit": count(rec[da & hit])}
    x |= {"br": count(rec[br]), "br_bad": count(rec[br & (n < 0)]), "br_hit": count(rec[br & hit]), "br_twice": count(rec[br]) - count(_last_of([rec[br], ident[br]], 2)[0])}
    # Of a name's calls and declarations the greatest; the call of a declared name comes right before it.
    named = fns & (ident >= 0)
    r, name, fn, most = _last_of([rec[named], ident[named], of("FN")[named], n[named]], 3)
    met = np.zeros(len(r), bool)
    met[1:] = fn[1:] & (r[1:] == r[:-1]) & (name[1:] == name[:-1])
    ran = np.zeros(len(r), bool)
    ran[1:] = met[1:] & (most[:-1] > 0)
    declared = [r[fn], most[fn], ran[fn]]
    by_line = _last_of(declared, 2)
    x |= {"fn": count(r[fn]), "fn_lone": count(r) - 2 * count(r[met]), "fn_twice": count(rec[named]) - count(r), "fn_bad": count(rec[fns & ~named]), "fn_hit": count(r[~fn & (most > 0)])}
    agrees = lambda f: (count(f[0]) == x["fnf"]) & (count(f[0][f[2]]) == x["fnh"])
    plain = agrees(declared)
    grouped = agrees(by_line) & ~plain
    told = [np.concatenate([a[plain[declared[0]]], b[grouped[by_line[0]]]]) for a, b in zip(declared, by_line)]
    x |= {"told": count(told[0]), "told_hit": count(told[0][told[2]])}
    lined = br & (n > 0)
    marks = [([rec[read], n[read], hit[read]], _DA), ([rec[lined], n[lined], hit[lined]], _BR), (told, _TOLD), ([*declared[:2], np.zeros(len(declared[0]), bool)], _FN)]
    owner, line, seen = (np.concatenate([m[i] for m, _ in marks]) for i in range(3))
    kind = np.concatenate([np.full(len(m[0]), k, np.int32) for m, k in marks])
    order = np.argsort(owner, kind="stable")
    marked = pa.StructArray.from_arrays([pa.array(line[order]), pa.array(kind[order]), pa.array(seen[order])], ["line", "kind", "hit"])
    offsets = np.concatenate([[0], np.cumsum(count(owner))]).astype(np.int32)
    maybe = {t.lower() for t in COUNTERS} | set(_PLACES)
    numbers = [pa.array(x[k].astype(np.int64), mask=x[k] < 0 if k in maybe else None) for k in _NUMBERS]
    return pa.StructArray.from_arrays([*numbers, pa.ListArray.from_arrays(pa.array(offsets), marked)], [*_NUMBERS, "marks"])


def _read(piece: Column) -> Column:
    """`_read_records` of the lines of record rows, as a struct."""

    def read(pieces: pa.Array) -> pa.Array:
        return _read_records(pieces)

    return F.arrow_udf(read, _READ)(piece)


def branches(found: DataFrame) -> DataFrame:
    """(report, record, file, line, block, branch, taken) of BRDA entries; a branch name may hold commas, taken - is null; malformed ones have a null line."""
    part = lambda i: F.trim(F.regexp_extract("rest", r"^([^,]*),([^,]*),(.*),([^,]*)$", i))
    rows = found.where("tag = 'BRDA'").select("report", "record", "file", _count(part(1)).alias("l"), part(2).alias("block"), part(3).alias("branch"), part(4).alias("t"))
    named = lambda c: (F.col(c) != "") & F.forall(F.split(c, ","), lambda x: ~F.trim(x).isin("", "-"))
    ok = (F.col("l") > 0) & named("block") & named("branch") & ((F.col("t") == "-") | _count(F.col("t")).isNotNull())
    return rows.select("report", "record", "file", F.when(ok, F.col("l")).alias("line"), "block", "branch", _count(F.nullif("t", F.lit("-"))).alias("taken"))


def functions(found: DataFrame) -> DataFrame:
    """(report, record, file, name, line, declared, called, hits, bad): FN and FNDA entries by name.

    FN has a line, perhaps a last line, and a name; FNDA hits and a name.
    declared and called count the entries of the name, bad those that can't be read.
    """
    head, tail = F.regexp_extract("rest", "^([^,]*),", 1), F.regexp_extract("rest", "^[^,]*,(.*)$", 1)
    last = _count(F.regexp_extract(tail, "^([^,]*),", 1))
    is_fn = F.col("tag") == "FN"
    name = F.trim(F.when(is_fn & last.isNotNull(), F.regexp_extract(tail, "^[^,]*,(.*)$", 1)).otherwise(tail))
    n = _count(head)
    ok = F.col("rest").contains(",") & (name != "") & n.isNotNull() & (~is_fn | ((n > 0) & (last.isNull() | ((last > 0) & (last >= n)))))
    rows = found.where(F.col("tag").isin("FN", "FNDA")).select("report", "record", "file", is_fn.alias("fn"), F.when(ok, name).alias("name"), n.alias("n"), F.coalesce(ok, F.lit(False)).alias("ok"))
    return rows.groupBy("report", "record", "file", "name").agg(
        F.max(F.when(F.col("fn"), F.col("n"))).alias("line"), F.count_if(F.col("fn") & F.col("ok")).alias("declared"), F.count_if(~F.col("fn") & F.col("ok")).alias("called"),
        F.max(F.when(~F.col("fn"), F.col("n"))).alias("hits"), F.count_if(~F.col("ok")).alias("bad"),
    )


def counters(found: DataFrame) -> DataFrame:
    """One row per record with LF, LH, FNF, FNH, BRF and BRH, null where the record has none."""
    n = _count(F.col("rest"))
    return found.where(F.col("tag").isin(*COUNTERS)).groupBy("report", "record", "file").agg(*(F.max(F.when(F.col("tag") == t, n)).alias(t.lower()) for t in COUNTERS))


def function_projection(found: DataFrame) -> DataFrame:
    """(report, record, line, hit): a record's functions; those of one line count once where only that agrees with FNF and FNH, and where nothing agrees there are none."""
    each = functions(found).where("declared > 0").select(*RECORD, "line", (F.coalesce("hits", F.lit(0)) > 0).alias("hit"))
    grouped = each.groupBy(*RECORD, "line").agg(F.bool_or("hit").alias("hit"))
    totals = counters(found).select(*RECORD, "fnf", "fnh")
    agreed = lambda rows: rows.groupBy(*RECORD).agg(F.count("*").alias("n"), F.count_if("hit").alias("h")).join(totals, RECORD).where("n = fnf and h = fnh").select(*RECORD)
    plain = agreed(each)
    return each.join(plain, RECORD, "left_semi").union(grouped.join(agreed(grouped).join(plain, RECORD, "left_anti"), RECORD, "left_semi"))


def records(found: DataFrame) -> DataFrame:
    """(report, record, file, lines_found, lines_hit, functions_found, functions_hit, branches_found, branches_hit) of the records, 0 for missing counters."""
    names = ("lines_found", "lines_hit", "functions_found", "functions_hit", "branches_found", "branches_hit")
    n = _count(F.col("rest"))
    rows = found.where("file is not null").groupBy(*RECORD, "file").agg(*(F.max(F.when(F.col("tag") == t, n)).alias(name) for t, name in zip(COUNTERS, names)))
    return rows.select(*RECORD, "file", *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in names))


def production(found: DataFrame, test_lines: DataFrame) -> DataFrame:
    """Records without what stands on test lines (file, line), and `problem` where that can't be told.

    Counters that lines don't explain stay in the denominator, and hits are
    credited to proven production lines and branches only. Records without
    test lines keep their counters.
    """
    tests = test_lines.groupBy("file").agg(F.collect_set("line").alias("tests"))
    read = _whole(found).where("file is not null").select(*RECORD, "file", _read(F.col("piece")).alias("x"))
    c = F.col
    names = ("lines_found", "lines_hit", "functions_found", "functions_hit", "branches_found", "branches_hit")
    totals = {"da_hits": "da_hit", "br": "br", "br_hits": "br_hit", "fn": "told", "fn_hits": "told_hit"}
    rows = read.select(*RECORD, "file", *(F.coalesce(f"x.{t.lower()}", F.lit(0)).alias(n) for t, n in zip(COUNTERS, names)), *(c(f"x.{x}").alias(n) for n, x in totals.items()), "x.marks")
    mark = lambda line, kind, hit: F.struct(line.alias("line"), F.lit(kind).alias("kind"), hit.alias("hit"))
    # A file's test lines come before the marks of the same line, in one walk over both.
    rows = rows.join(tests, "file", "left")
    both = F.array_sort(F.concat(F.transform("tests", lambda t: mark(t, 0, F.lit(False))), "marks"))
    kinds = {"da_test": (_DA, False), "da_test_hit": (_DA, True), "br_test": (_BR, False), "br_test_hit": (_BR, True), "told_test": (_TOLD, False), "told_test_hit": (_TOLD, True), "fn_test": (_FN, False)}
    none = F.struct(F.lit(None).cast("long").alias("at"), *(F.lit(0).cast("long").alias(n) for n in kinds))

    def walk(state, x):
        add = lambda kind, hit: F.when((x["kind"] == kind) & (x["line"] == state["at"]) & (x["hit"] | F.lit(not hit)), 1).otherwise(0)
        return F.struct(F.when(x["kind"] == 0, x["line"]).otherwise(state["at"]).alias("at"), *((state[n] + add(*k)).alias(n) for n, k in kinds.items()))

    walked = F.when(c("tests").isNull(), none).otherwise(F.aggregate(both, none, walk))
    rows = rows.withColumn("in_tests", walked).select(*(n for n in rows.columns if n not in ("marks", "tests")), *(c("in_tests")[n].alias(n) for n in kinds))
    rows = rows.withColumns({"da_hit": c("da_hits") - c("da_test_hit"), "br_own": c("br") - c("br_test"), "br_hit": c("br_hits") - c("br_test_hit"), "fn_own": c("fn") - c("told_test"), "fn_hit": c("fn_hits") - c("told_test_hit")})
    mixed = (F.col("da_test") + F.col("br_test") + F.col("fn_test")) > 0
    pick = lambda new, old: F.when(mixed, new).otherwise(F.col(old)).cast("long").alias(old)
    left = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    unclear = F.when(mixed & (F.col("fn") == 0) & (F.col("functions_found") > 0), "functions are ambiguous").when(mixed & (F.col("br") != F.col("branches_found")), "branches are incomplete")
    return rows.select(
        *RECORD, "file", pick(F.col("lines_found") - F.col("da_test"), "lines_found"), pick(F.least("da_hit", left("lines_hit", "da_test_hit")), "lines_hit"), pick(F.col("fn_own"), "functions_found"), pick(F.col("fn_hit"), "functions_hit"),
        pick(F.col("br_own"), "branches_found"), pick(F.least("br_hit", left("branches_hit", "br_test_hit")), "branches_hit"), unclear.alias("problem"),
    )


def problems(found: DataFrame, require_functions: bool = False, require_branches: bool = False) -> DataFrame:
    """(report, record, problem): what makes a report invalid evidence; a report without records has one too, and so has a file's second record."""
    c = F.col
    read = _whole(found).select(*RECORD, "file", _read(c("piece")).alias("x"))
    rows = read.select(*RECORD, "file", *(f"x.{n}" for n in _NUMBERS))
    lone = lambda a, b: c(a).isNull() != c(b).isNull()
    empty = (c("da") == 0) & c("lf").isNull().eqNullSafe(c("lh").isNull()) & (F.coalesce("lf", F.lit(0)) == 0) & (F.coalesce("lh", F.lit(0)) == 0)
    fnf, fnh = F.coalesce("fnf", F.lit(0)), F.coalesce("fnh", F.lit(0))
    explained = (c("lh") < c("da_hit")) & (c("fn") > fnf) & (c("told") > 0)
    checks = {
        "nested or repeated source file": c("sf") > 1, "no source file": c("sf") == 0, "empty source path": c("empty_sf") > 0, "metric outside a record": c("metric_at") < F.coalesce("sf_at", F.lit(1 << 40)), "test name inside a record": c("tn_at") > c("sf_at"),
        "misplaced version": (c("ver") > 1) | (c("empty_ver") > 0) | (c("ver_at") > c("metric_at")) | (c("ver_at") < c("sf_at")), "unterminated record": c("ends") == 0, "unsupported tag": c("odd") > 0, "unknown tag": c("unknown") > 0,
        "malformed line": c("da_bad") > 0, "duplicate line": c("da") - c("da_bad") > c("da_lines"), "malformed counter": c("bad_counts") > 0, "duplicate counter": c("twice") > 0,
        "unpaired line counters": lone("lf", "lh"), "unpaired function counters": lone("fnf", "fnh"), "unpaired branch counters": lone("brf", "brh"),
        "missing line counters": ~empty & c("lf").isNull() & c("lh").isNull(), "missing function counters": F.lit(require_functions) & c("fnf").isNull(), "missing branch counters": F.lit(require_branches) & c("brf").isNull(),
        "no lines": ~empty & (c("da") == 0), "fewer lines found than listed": c("lf") < c("da_lines"), "more lines hit than found": c("lh") > c("lf"), "more functions hit than found": c("fnh") > c("fnf"), "more branches hit than found": c("brh") > c("brf"),
        "lines hit disagree": (c("lf") == c("da_lines")) & (c("da") > 0) & (c("lh") != c("da_hit")) & ~explained,
        "malformed function": c("fn_bad") > 0, "duplicate function": c("fn_twice") > 0, "functions and their hits disagree": c("fn_lone") > 0,
        "functions without counters": (c("fn") > 0) & c("fnf").isNull() & F.lit(not require_functions), "impossible function hits": (c("fn") > 0) & (c("fn") >= fnf) & (c("fn_hit") >= fnh) & (c("fn_hit") - fnh > c("fn") - fnf),
        "malformed branch": c("br_bad") > 0, "duplicate branch": c("br_twice") > 0, "branches without counters": (c("br") > 0) & c("brf").isNull() & F.lit(not require_branches),
    }
    listed = F.array_compact(F.array(*(F.when(F.coalesce(x, F.lit(False)), F.lit(name)) for name, x in checks.items())))
    # What a record has, the file it is about, and whether it is one at all: told apart by kind in one grouping.
    fact = lambda kind, value, record: F.struct(F.lit(kind).alias("kind"), value.alias("value"), record.cast("long").alias("of"))
    alone = F.lit(None)
    facts = F.concat(F.transform(F.when(c("real") > 0, listed).otherwise(F.slice(listed, 1, 0)), lambda p: fact(0, p, c("record"))), F.array(fact(1, T.record_key(c("file")), alone), fact(2, F.lit(""), alone)))
    each = rows.select(*RECORD, "real", F.explode(facts).alias("fact")).select(*RECORD, "real", "fact.*").where("kind <> 1 or value is not null")
    out = each.groupBy("report", "kind", "value", "of").agg(F.max("record").alias("record"), F.count("*").alias("n"), F.max("real").alias("real"))
    said = F.when(c("kind") == 0, c("value")).when((c("kind") == 1) & (c("n") > 1), "second record of a file").when((c("kind") == 2) & (c("real") == 0), "no records")
    return out.select("report", F.when(c("kind") < 2, c("record")).alias("record"), said.alias("problem")).where("problem is not null")


def union_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of several partial reports as one, and the (file, reports) that more than one of them covers, which is an error."""
    rows = records(found)
    twice = rows.groupBy("file").agg(F.count_distinct("report").alias("reports")).where("reports > 1")
    return rows, twice


def with_native_zeros(found: DataFrame, native: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counters (report, record, file, lf, lh, fnf, fnh, brf, brh) whose missing pairs are zero where the native report proves both zero, and the problems.

    native: (report, file, branch_coverage, num_statements, covered_lines,
    num_branches, covered_branches, functions, covered_functions), as
    `native_counters` makes it.
    """
    heads = found.where("file is not null").select(*RECORD, "file").distinct()
    both = heads.join(counters(found).drop("file"), RECORD, "left").join(native, ["report", "file"], "left")
    pairs = (("lf", "lh", "num_statements", "covered_lines"), ("brf", "brh", "num_branches", "covered_branches"), ("fnf", "fnh", "functions", "covered_functions"))
    zero = lambda a, b: (F.col(a) == 0) & (F.col(b) == 0)
    known = F.col("branch_coverage").isNotNull()
    lacking = [F.col(x).isNull() | F.col(y).isNull() for x, y, _, _ in pairs]
    proven = [F.col(x).isNull() & F.col(y).isNull() & F.coalesce(zero(a, b), F.lit(False)) for x, y, a, b in pairs]
    filled = both.select(*RECORD, "file", *(F.when(p, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) for (x, y, _, _), p in zip(pairs, proven) for c in (x, y)))
    checks = [F.when(~known, F.lit("no native counterpart")), F.when(known & ~F.col("branch_coverage"), F.lit("no branch execution"))]
    checks += [F.when(known & lack & ~p, F.lit(f"omitted {x}/{y} that isn't empty")) for (x, y, _, _), lack, p in zip(pairs, lacking, proven)]
    return filled, both.select(*RECORD, "file", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


_REGION = "struct<summary: struct<num_statements: long, covered_lines: long>>"
_NATIVE = f"struct<meta: struct<branch_coverage: boolean>, files: map<string, struct<summary: struct<num_statements: long, covered_lines: long, num_branches: long, covered_branches: long>, functions: map<string, {_REGION}>>>>"


def native_counters(reports: DataFrame, id_col: str = "report", body_col: str = "body") -> DataFrame:
    """Native coverage reports of Python as counters of each file; functions count if they have statements and a name."""
    rows = reports.select(F.col(id_col).alias("report"), F.from_json(body_col, _NATIVE).alias("r")).select("report", F.coalesce("r.meta.branch_coverage", F.lit(False)).alias("branch_coverage"), F.explode("r.files").alias("file", "f"))
    real = F.filter(F.map_entries("f.functions"), lambda e: (e["key"] != "") & (e["value"]["summary"]["num_statements"] > 0))
    hit = F.filter(real, lambda e: e["value"]["summary"]["covered_lines"] > 0)
    return rows.select("report", "file", "branch_coverage", "f.summary.*", F.size(real).cast("long").alias("functions"), F.size(hit).cast("long").alias("covered_functions"))
