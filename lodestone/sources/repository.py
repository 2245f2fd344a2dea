"""Repositories, changes and saved reports as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import text as T
from ..operators.files import RETIRED_EXTENSIONS, SOURCE_EXTENSIONS, VENDOR_DIRS
from ..plans.lineage import dense_ids


def in_inventory(path: Column) -> Column:
    """A path with an inventoried extension, in no dependency folder."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDOR_DIRS))) & F.lower(T.extension_of(path)).isin(*SOURCE_EXTENSIONS)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last of an ignore file's patterns that matches a path, or a folder above it, excludes it.

    A pattern with a slash before its end is anchored to the root, one that ends
    with a slash names folders only, and ! takes paths back. * and ? stay within
    a part, ** spans parts.
    """
    out = F.lit(False)
    for line in patterns:
        p = line.rstrip("\n")
        p = p if p.endswith("\\ ") else p.rstrip()
        if not p or p.startswith("#"):
            continue
        back, p = p.startswith("!"), p.removeprefix("!").removeprefix("\\")
        folder, p = p.endswith("/"), p.rstrip("/")
        anchored, p = "/" in p, p.lstrip("/")
        regex = ("^" if anchored else "^(?:.*/)?") + T.glob_to_regex(p, within=True)[1:-1] + ("/" if folder else "(?:/|$)")
        out = F.when(path.rlike(regex), not back).otherwise(out)
    return out


#: Precedence of ignore rules, rising: excludes of the user, of the repository, and the two kinds of files in folders.
GLOBAL, EXCLUDE, GITIGNORE, IGNORE = range(4)


def ignore_rules(files: DataFrame) -> DataFrame:
    """(folder, rank, nth, pattern) of the ignore files among files (path, text): one row for each line, the folder "" being the root."""
    name = T.name_of(F.col("path"))
    exclude = F.col("path") == ".git/info/exclude"
    rank = F.when(exclude, EXCLUDE).when(name == ".gitignore", GITIGNORE).when(name == ".ignore", IGNORE)
    folder = F.when(exclude, "").otherwise(F.regexp_replace("path", r"/?[^/]*$", ""))
    rows = files.withColumn("rank", rank).where("rank is not null")
    return rows.select(folder.alias("folder"), "rank", F.posexplode(T.lines(F.col("text"))).alias("nth", "pattern"))


def ignored_by(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored) of files (path) under ignore rules (folder, rank, nth, pattern).

    A file is ignored if it or a folder above it is. Of the rules of all folders
    above an entry that match it, the highest rank decides, then the deepest
    folder, then the last line, and ! takes back. Rules stay a table: a folder's
    are one row, and entries meet the folders above them by equality. Each
    folder is judged once, not again for each of its files. Lines of one folder
    and rank with equal patterns match the same, so only the last of them is tried.
    """
    bare = F.regexp_replace(F.regexp_replace("pattern", r"[\r\n]+$", ""), r"(?<!\\)[ \t]+$", "")
    rows = rules.select("folder", "rank", "nth", bare.alias("p")).where("p <> '' and not startswith(p, '#')")
    back = F.startswith("p", F.lit("!"))
    rows = rows.withColumn("back", back).withColumn("p", F.regexp_replace("p", r"^!", ""))
    body = F.regexp_replace("p", r"/+$", "")
    regex = F.concat(F.when(F.contains(body, F.lit("/")), "^").otherwise("^(?:.*/)?"), T.glob_pattern(F.regexp_replace(body, "^/+", "")), F.lit("$"))
    rows = rows.select("folder", "rank", "nth", regex.alias("regex"), F.endswith("p", F.lit("/")).alias("dirs"), "back").where("regex is not null and regex <> '^(?:.*/)?$'")
    rows = rows.groupBy("folder", "rank", "regex", "dirs").agg(F.max(F.struct("nth", "back")).alias("last"))
    by_folder = rows.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct("rank", "last.nth", "regex", "dirs", "last.back"))).alias("rules"))
    parts = F.split("path", "/")
    prefix = lambda p, i: F.array_join(F.slice(p, F.lit(1), i), "/")
    every = files.select("path").distinct().withColumn("parts", parts)
    above = every.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.struct(prefix(F.col("parts"), i).alias("entry"), (i < F.size("parts")).alias("dir")))).alias("e")).select("path", "e.*")
    entries = above.select("entry", "dir").distinct().withColumn("parts", F.split("entry", "/"))
    seen = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.struct(prefix(F.col("parts"), i).alias("folder"), F.array_join(F.slice("parts", i + 1, F.size("parts")), "/").alias("rest"), i.alias("depth")))
    met = entries.select("entry", "dir", F.explode(seen).alias("s")).select("entry", "dir", "s.*").join(by_folder, "folder")
    hits = F.filter("rules", lambda r: (~r.dirs | F.col("dir")) & F.regexp_like(F.col("rest"), r.regex))
    best = met.select("entry", "dir", "depth", F.explode(F.filter(hits, lambda r, i: (i == F.size(hits) - 1) | (F.get(hits, i + 1).rank != r.rank))).alias("r"))
    judged = best.groupBy("entry", "dir").agg(F.max_by(~F.col("r.back"), F.struct("r.rank", "depth", "r.nth")).alias("out")).where("out")
    gone = above.join(judged.select("entry", "dir"), ["entry", "dir"], "left_semi").select("path").distinct().withColumn("ignored", F.lit(True))
    return files.select("path").join(gone, "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))


def walk(spark: SparkSession, root: str, exclude: list[str] = (), ignore: list[str] = (), hidden: bool = False, extensions: tuple[str, ...] | None = (*SOURCE_EXTENSIONS, *RETIRED_EXTENSIONS), rules: DataFrame | None = None) -> DataFrame:
    """(path, text, read_error, excluded) of the files below a root in order of path; undecodable files are rows with an error.

    Dependency folders, hidden files and folders, other extensions and what the
    `ignore` patterns exclude leave before any content is read (the content is
    a column of the same scan, so only kept rows decode it). `rules` are those of
    ignore files in folders (`ignore_rules`). `exclude` tags.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inner = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in root.rstrip("/")) + "/", "")
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    rows = raw.select(inner.alias("path"), "content").where(~F.arrays_overlap(folders, F.array(*map(F.lit, VENDOR_DIRS))))
    if not hidden:
        rows = rows.where(~F.col("path").rlike(r"(^|/)\."))
    if extensions is not None:
        rows = rows.where(F.lower(T.extension_of(F.col("path"))).isin(*extensions))
    rows = rows.where(~ignored(F.col("path"), list(ignore)))
    if rules is not None:
        rows = rows.join(ignored_by(rows.select("path"), rules).where("ignored"), "path", "left_anti")
    tag = F.lit(False)
    for glob in exclude:
        tag = tag | F.col("path").rlike(T.glob_to_regex(glob))
    valid = F.expr("is_valid_utf8(cast(content as string))")
    return rows.select("path", F.when(valid, F.col("content").cast("string")).alias("text"), F.when(~valid, F.lit("not UTF-8")).alias("read_error"), tag.alias("excluded")).orderBy(F.split("path", "/"))


def snapshot(files: DataFrame) -> DataFrame:
    """(id, path, text, read_error): files (path, content) once each in order of path, with dense ids from 0; of several contents of a path the least counts; content that isn't UTF-8 is an error, not a loss.

    No task sees all paths.
    """
    valid = F.expr("is_valid_utf8(cast(content as string))")
    rows = files.where("path is not null").groupBy("path").agg(F.min("content").alias("content"))
    rows = rows.select("path", F.split("path", "/").alias("k"), F.when(valid, F.col("content").cast("string")).alias("text"), F.when(~valid, F.lit("not UTF-8")).alias("read_error"))
    return dense_ids(rows, "k").drop("k")


def scoped(files: DataFrame, filters: DataFrame) -> DataFrame:
    """Files (path) that equal a filter (filter, is_file) or lie below one that is a folder, with filters' files that weren't found; distinct and ordered.

    The ancestors of a path meet the folders by equality, so no pairs are tried.
    """
    key = F.regexp_replace("filter", r"^\./", "")
    wanted = filters.select(F.regexp_replace(key, "/+$", "").alias("k"), "is_file").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = files.select("path").distinct()
    inside = rows.select("path", F.explode(above).alias("k")).join(wanted.where("not is_file").withColumn("k", F.when(F.col("k") == ".", "").otherwise(F.col("k"))), "k", "left_semi").select("path")
    same = rows.join(wanted.select(F.col("k").alias("path")), "path", "left_semi")
    explicit = wanted.where("is_file").select(F.col("k").alias("path"))
    return inside.union(same).union(explicit).distinct().orderBy(F.split("path", "/"))


def selected(changed: DataFrame, found: DataFrame, filters: DataFrame, excluded: DataFrame, diff: bool) -> tuple[DataFrame, DataFrame]:
    """Files of a run and the excluded ones among them: changed files with all that paths name if `diff`, otherwise found files that paths name."""
    files = changed.select("path").union(scoped(found, filters).select("path")).distinct() if diff else scoped(found, filters)
    return files, excluded.select("path").distinct().join(files, "path", "left_semi")


def _records(text: Column) -> Column:
    return F.filter(F.split(text, "\x00"), lambda x: x != "")


def _bad_path(path: Column) -> Column:
    """Absolute and empty paths and those with a .. part."""
    return path.isNull() | (F.regexp_replace(path, r"(^|/)(\./|\.$)", "$1") == "") | path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def porcelain(status: DataFrame, id_col: str | None = None, text_col: str = "text") -> DataFrame:
    """(report, marker, path, old, problem) of NUL-separated status records; a rename or copy takes the next record of its report as its old path.

    A record of fewer than four characters or without a blank in its third
    place, a rename without its old path, and paths that leave the repository
    are problems.
    """
    who = F.lit(0) if id_col is None else F.col(id_col)
    recs = _records(F.col(text_col))
    renames = lambda r: r.rlike("^([RC].|.[RC]) ")
    state = F.struct(F.lit(False).alias("taken"), F.array().cast("array<boolean>").alias("out"))
    step = lambda s, r: F.struct((~s["taken"] & renames(r)).alias("taken"), F.concat(s["out"], F.array(s["taken"])).alias("out"))
    rows = status.select(who.alias("report"), recs.alias("r")).withColumn("taken", F.aggregate("r", state, step)["out"])
    each = F.transform("r", lambda r, i: F.struct(F.get("taken", i).alias("taken"), r.alias("r"), F.when(renames(r), F.get("r", i + 1)).alias("old")))
    rows = rows.select("report", F.explode(each).alias("x")).where("not x.taken").select("report", "x.r", "x.old")
    fine = F.col("r").rlike(r"(?s)^.. .")
    path = F.when(fine, F.expr("substring(r, 4)"))
    problem = F.when(~fine, "malformed record").when(renames(F.col("r")) & F.col("old").isNull(), "rename without its old path").when(_bad_path(path) | (F.col("old").isNotNull() & _bad_path(F.col("old"))), "path outside the repository")
    return rows.select("report", F.when(fine, F.substring("r", 1, 2)).alias("marker"), path.alias("path"), "old", problem.alias("problem"))


def changed_paths(status: DataFrame) -> DataFrame:
    """Inventory paths of status records that exist after the change: (report, path, untracked)."""
    rows = status.where(F.col("problem").isNull() & ~F.contains("marker", F.lit("D")) & in_inventory(F.col("path")))
    return rows.groupBy("report", "path").agg(F.bool_or(F.col("marker") == "??").alias("untracked"))


def name_status(diffs: DataFrame, id_col: str = "report", text_col: str = "text") -> DataFrame:
    """(report, marker, old, path, lineage, problem) of NUL-separated name-status records; lineage: a rename, not a copy, between inventory paths."""
    recs = _records(F.col(text_col))
    two = lambda r: r.rlike("^[RC]")
    # Records to skip before the next marker, and the place of each marker.
    state = F.struct(F.lit(0).alias("skip"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, r: F.struct(
        F.when(s["skip"] > 0, s["skip"] - 1).when(two(r), F.lit(2)).otherwise(F.lit(1)).alias("skip"), (s["at"] + 1).alias("at"), F.when(s["skip"] > 0, s["out"]).otherwise(F.concat(s["out"], F.array(s["at"]))).alias("out")
    )
    rows = diffs.select(F.col(id_col).alias("report"), recs.alias("r")).withColumn("at", F.aggregate("r", state, step)["out"])
    each = F.transform("at", lambda i: F.struct(F.get("r", i).alias("m"), F.get("r", i + 1).alias("a"), F.get("r", i + 2).alias("b")))
    rows = rows.select("report", F.explode(each).alias("x")).select("report", "x.*")
    fine, moved = F.col("m").rlike("^([ADMTUXB]|[RC][0-9]{3})$"), two(F.col("m"))
    path, old = F.when(moved, F.col("b")).otherwise(F.col("a")), F.when(moved, F.col("a"))
    problem = F.when(~fine, "malformed marker").when(path.isNull(), "record without its path").when(_bad_path(path) | (old.isNotNull() & _bad_path(old)), "path outside the repository")
    lineage = fine & F.col("m").startswith("R") & in_inventory(path) & in_inventory(old)
    return rows.select("report", F.substring("m", 1, 1).alias("marker"), old.alias("old"), path.alias("path"), F.coalesce(lineage, F.lit(False)).alias("lineage"), problem.alias("problem"))


_HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def hunks(diffs: DataFrame, id_col: str = "diff", text_col: str = "text") -> DataFrame:
    """(diff, file, start, count, problem) of the hunks of unified diffs.

    A line "diff --git" begins a file, and the headers --- and +++ count up to
    its first hunk only: within hunks, lines that look like headers are content.
    Quoted paths are decoded. The order of lines is that of the array, so a
    diff is worked on in its row and nothing is shuffled.
    """
    return diffs.select(F.col(id_col).alias("diff"), F.col(text_col).alias("text")).mapInPandas(_hunks, f"diff {diffs.schema[id_col].dataType.simpleString()}, file string, start long, count long, problem string")


def _path_of(rest: str, prefix: str) -> str | None:
    token = rest[:-1] if rest.endswith("\t") else rest
    if rest.startswith('"'):
        token, used = unquoted(rest)
        if rest[used:] not in ("", "\t"):
            raise ValueError("malformed quoted path")
    if token == "/dev/null":
        return None
    if not token.startswith(prefix):
        raise ValueError(f"path without {prefix}")
    parts = [p for p in token[len(prefix) :].split("/") if p not in ("", ".")]
    if not parts or ".." in parts or token[len(prefix) :].startswith("/"):
        raise ValueError("path outside the repository")
    return "/".join(parts)


def _hunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import re

    hunk = re.compile(_HUNK)
    for pdf in batches:
        out = []
        for diff, text in zip(pdf["diff"], pdf["text"]):
            old = new = None
            inside = False
            for line in (text or "").split("\n"):
                try:
                    if line.startswith("diff --git "):
                        old, new, inside = None, None, False
                    elif not inside and line.startswith("--- "):
                        old = _path_of(line[4:], "a/")
                    elif not inside and line.startswith("+++ "):
                        new = _path_of(line[4:], "b/")
                    elif line.startswith("@@"):
                        found, path = hunk.match(line), new or old
                        if not found or path is None:
                            raise ValueError("malformed hunk header" if path else "hunk without a file")
                        start, count = int(found[1]), int(found[2] or 1)
                        if count and not start:
                            raise ValueError("lines from 0 on")
                        inside = True
                        out.append((diff, path, start, count, None))
                except ValueError as e:
                    out.append((diff, new or old, None, None, str(e)))
        frame = pd.DataFrame(out, columns=["diff", "file", "start", "count", "problem"])
        yield frame.astype({"start": "Int64", "count": "Int64"})


def changed_lines(diffs: DataFrame, id_col: str = "diff", text_col: str = "text") -> DataFrame:
    """(diff, file, line) of the lines that unified diffs add or change."""
    found = hunks(diffs, id_col, text_col).where("problem is null and count > 0")
    return found.select("diff", "file", F.explode(F.sequence("start", F.col("start") + F.col("count") - 1)).alias("line"))


def untracked_lines(files: DataFrame) -> DataFrame:
    """(file, line): every line of untracked files (path, text)."""
    n = F.size(T.lines(F.col("text")))
    return files.where(n > 0).select(F.col("path").alias("file"), F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("long"))).alias("line"))


_ESCAPES = {'"': '"', "\\": "\\", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r"}


def unquoted(raw: str) -> tuple[str, int]:
    """A path in double quotes with its C escapes resolved, and how many characters it takes."""
    out, i = bytearray(), 1
    while i < len(raw):
        c = raw[i]
        if c == '"':
            return out.decode(), i + 1
        if c != "\\":
            out += c.encode()
            i += 1
            continue
        e = raw[i + 1 : i + 2]
        if e in _ESCAPES and e:
            out += _ESCAPES[e].encode()
            i += 2
        elif e and e in "01234567":
            j = i + 1
            while j < i + 4 and raw[j : j + 1] in tuple("01234567"):
                j += 1
            if int(raw[i + 1 : j], 8) > 255:
                raise ValueError("octal escape above 255")
            out.append(int(raw[i + 1 : j], 8))
            i = j
        else:
            raise ValueError("unknown escape")
    raise ValueError("unterminated quoted path")


@F.pandas_udf(types.StructType([types.StructField("path", types.StringType()), types.StructField("problem", types.StringType())]))
def unquoted_path(raw: pd.Series) -> pd.DataFrame:
    """Decoded paths; what isn't quoted stays as it is."""

    def one(x):
        if x is None or not x.startswith('"'):
            return x, None
        try:
            path, used = unquoted(x)
            return (path, None) if used == len(x) else (None, "text behind the path")
        except (ValueError, UnicodeDecodeError) as e:
            return None, str(e) if not isinstance(e, UnicodeDecodeError) else "not UTF-8"

    return pd.DataFrame([one(x) for x in raw], columns=["path", "problem"])


def undecodable(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed tracked inventory files (path, untracked) whose content isn't UTF-8."""
    tracked = changed.where(~F.col("untracked") & in_inventory(F.col("path"))).select("path")
    return files.join(tracked, "path", "left_semi").where(~F.expr("is_valid_utf8(cast(content as string))")).select("path")


def input_digests(files: DataFrame, outputs: list[str] = (), folders: tuple[str, ...] = (".git", "target", "node_modules")) -> DataFrame:
    """(path, sha256) of a project's inputs (path, content); version control, builds, dependencies and declared outputs are none."""
    rows = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, folders))))
    for path in outputs:
        rows = rows.where(F.col("path") != path)
    return rows.select("path", F.sha2("content", 256).alias("sha256"))


def save_report(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines; Spark's commit makes the folder appear whole or not at all."""
    findings.write.mode("errorifexists").json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved report; a malformed line fails the read instead of becoming nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def parsed_reports(reports: DataFrame, finding: str, id_col: str = "report", body_col: str = "body") -> DataFrame:
    """(report, passed, findings, problem) of saved report texts; problem: malformed, of another version, or passed with findings."""
    kind = f"struct<schema_version: int, passed: boolean, findings: array<struct<{finding}>>, _bad: string>"
    rows = reports.select(F.col(id_col).alias("report"), F.from_json(body_col, kind, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    n = F.coalesce(F.size("r.findings"), F.lit(0))
    problem = (
        F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "malformed")
        .when(F.coalesce("r.schema_version", F.lit(1)) != 1, "unknown version")
        .when(F.col("r.passed").isNull(), "without a verdict")
        .when(F.col("r.passed") & (n > 0), "passed with findings")
    )
    return rows.select("report", "r.passed", "r.findings", problem.alias("problem"))
