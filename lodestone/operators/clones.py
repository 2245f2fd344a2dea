"""Token-window clones."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, dense_ids

# Capacity limits, beyond which evidence counts as incomplete.
MAX_WINDOWS_PER_HASH = 512
MAX_MATCHES = 200_000


def code_tokens(line: Column) -> Column:
    """Names stay; numbers and quoted strings become one symbol each; other signs stand for themselves; comment lines have none."""
    found = F.regexp_extract_all(line, F.lit(r"""[A-Za-z_][A-Za-z0-9_]*|[0-9][A-Za-z0-9.]*|"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?|\S"""), F.lit(0))
    symbol = lambda x: F.when(x.rlike("^[0-9]"), "_LIT_").when(x.rlike("^[\"'`]"), "_STR_").otherwise(x)
    return F.when(line.rlike(r"^\s*(//|#(?!\[|!\[)|\*|/\*)"), F.array().cast("array<string>")).otherwise(F.transform(found, symbol))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def _once(c: Column) -> Column:
    """An array made once for a row, and not anew for each element that a lambda takes from it."""
    return F.explode(F.array(c))


def window_hashes(streams: DataFrame, k: int, kept: tuple[str, ...] = ()) -> DataFrame:
    """(stream, hs, kept...): the hash of each k consecutive tokens of streams that have as many.

    Tokens are hashed once; hashes of 2, 4, 8 ... tokens are made of two halves,
    and windows of those that k is the sum of, so the work doesn't grow with k.
    """
    rows = streams.select("stream", *kept, _once(F.col("tokens")).alias("_tokens")).where(F.size("_tokens") >= k)
    rows = rows.select("stream", *kept, _once(F.transform("_tokens", lambda t: F.xxhash64(t))).alias("_part")).withColumn("_n", F.size("_part") - (k - 1))
    follow = lambda a, b, by: F.transform(a, lambda h, i: F.xxhash64(h, F.get(b, i + by)))
    size, done = 1, 0
    while True:
        if k & size:
            grown = follow("_hs", F.col("_part"), done) if done else F.col("_part")
            rows = rows.select("stream", *kept, "_part", "_n", _once(grown).alias("_hs"))
            done += size
        if 2 * size > k:
            return rows.select("stream", F.slice("_hs", F.lit(1), F.col("_n")).alias("hs"), *kept)
        rows = rows.select("stream", *kept, "_n", _once(follow("_part", F.col("_part"), size)).alias("_part"), *(["_hs"] if done else []))
        size *= 2


def windows(streams: DataFrame, k: int, digest: bool = False) -> DataFrame:
    """Streams (stream, tokens) to (stream, i, h, before, after): each k consecutive tokens by place and hash, with the hashes of the windows around it.

    With `digest`, h is an MD5 of the tokens themselves, for reports.
    """
    if digest:
        n = F.size("tokens") - (k - 1)
        rows = streams.select("stream", _once(F.col("tokens")).alias("tokens")).where(n > 0)
        hashed = rows.select("stream", F.transform(F.sequence(F.lit(1), n), lambda i: F.md5(F.array_join(F.slice("tokens", i, k), "\x1f"))).alias("hs"))
    else:
        hashed = window_hashes(streams, k)
    # Neighbours are joined to each window first: what is exploded carries no array.
    near = F.transform("hs", lambda h, i: F.struct(i.cast("long").alias("i"), h.alias("h"), F.get("hs", i - 1).alias("before"), F.get("hs", i + 1).alias("after")))
    return hashed.select("stream", _once(F.col("hs")).alias("hs")).select("stream", F.explode(near).alias("w")).select("stream", "w.*")


def _sides(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    side = lambda n: found.select("h", F.col("stream").alias(n), F.col("i").alias(f"{n}i"), F.col("before").alias(f"{n}p"), F.col("after").alias(f"{n}n"))
    return side("a"), side("b")


def matches(found: DataFrame, k: int) -> DataFrame:
    """Ordered pairs of equal windows that don't overlap in one stream: (a, ai, b, bi). There are as many as all copies have in pairs; `spans` doesn't need them."""
    many = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    a, b = _sides(found.join(many, "h", "left_semi"))
    return a.join(b, "h").where(F.expr(f"a < b or (a = b and bi >= ai + {k})")).select("a", "ai", "b", "bi")


def over_capacity(found: DataFrame, limit: int = MAX_WINDOWS_PER_HASH) -> DataFrame:
    """(h, n) of windows that occur more often than the limit."""
    return found.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > limit)


def capacity_failures(found: DataFrame, per_hash: int = MAX_WINDOWS_PER_HASH, pairs: int = MAX_MATCHES) -> DataFrame:
    """(step, message): why the evidence of an index is incomplete; nothing is cut off because of it."""
    n = found.groupBy("h").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    said = F.array_compact(F.array(F.when(F.col("most") > per_hash, F.lit(f"more than {per_hash} windows of one hash")), F.when(F.col("pairs") > pairs, F.lit(f"more than {pairs} matches"))))
    return n.select(F.lit("clone-index").alias("step"), F.explode(said).alias("message"))


def _class_pairs(members: DataFrame, side: str, apart: int) -> DataFrame:
    """(a, b, ai, bi) of equal windows whose neighbours on one side differ or are missing; a window in which a stream begins or ends has a class of its own.

    Windows of one neighbour never meet: pairs of neighbours are made first, and
    then the windows of each, so there are about as many rows as are returned.
    """
    rows = members.where(f"{side}_uneven").select("h", F.coalesce(side, F.xxhash64("stream", F.lit(side))).alias("c"), "stream", "i")
    kinds = rows.select("h", "c").distinct()
    others = kinds.join(kinds.select("h", F.col("c").alias("d")), "h").where("c < d")
    left = rows.withColumnsRenamed({"stream": "x", "i": "xi"}).join(others, ["h", "c"])
    both = left.join(rows.withColumnsRenamed({"c": "d", "stream": "y", "i": "yi"}), ["h", "d"])
    first = (F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("xi") < F.col("yi")))
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    near = (F.col("x") == F.col("y")) & (F.abs(F.col("xi") - F.col("yi")) < apart)
    return both.where(~near).select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("xi", "yi").alias("ai"), pick("yi", "xi").alias("bi"))


def spans(found: DataFrame, k: int, apart: int | None = None) -> DataFrame:
    """Equal windows on one diagonal that follow each other, as one span: (a, b, a_start, b_start, tokens).

    Windows of one stream are paired from `apart` tokens on, by default those that don't overlap.

    Only pairs at which a span begins or ends are made: a neighbour on that side
    differs or is missing. On a diagonal begins and ends take turns, so the n-th
    begin belongs to the n-th end. Windows inside of copies have equal
    neighbours and never meet.
    """
    of = Window.partitionBy("h")
    uneven = lambda c: (F.count(c).over(of) < F.count("*").over(of)) | F.coalesce(F.min(c).over(of) != F.max(c).over(of), F.lit(False))
    seen = found.where("stream is not null").select("h", "stream", "i", "before", "after", (F.count("*").over(of) > 1).alias("many"), uneven("before").alias("before_uneven"), uneven("after").alias("after_uneven"))
    members = cut(seen.where("many and (before_uneven or after_uneven)").drop("many"))
    edges = [_class_pairs(members, side, apart or k).withColumn("edge", F.lit(n)) for n, side in enumerate(("before", "after"))]
    rows = edges[0].unionByName(edges[1]).select("a", "b", "ai", (F.col("bi") - F.col("ai")).alias("diagonal"), "edge").repartition("a", "b", "diagonal")
    nth = F.row_number().over(Window.partitionBy("a", "b", "diagonal", "edge").orderBy("ai"))
    both = rows.withColumn("nth", nth).groupBy("a", "b", "diagonal", "nth").agg(F.max(F.when(F.col("edge") == 0, F.col("ai"))).alias("first"), F.max(F.when(F.col("edge") == 1, F.col("ai"))).alias("last"))
    return both.select("a", "b", F.col("first").alias("a_start"), (F.col("first") + F.col("diagonal")).alias("b_start"), (F.col("last") - F.col("first") + k).alias("tokens"))


def touching(found: DataFrame, changed: DataFrame) -> DataFrame:
    """Spans (a, b, ...) that have a changed file (path) on either side."""
    files = changed.select(F.col("path").alias("_file")).distinct()
    left = found.join(files.withColumnRenamed("_file", "a"), "a", "left_semi").select(*found.columns)
    right = found.join(files.withColumnRenamed("_file", "a"), "a", "left_anti").join(files.withColumnRenamed("_file", "b"), "b", "left_semi").select(*found.columns)
    return left.union(right)


def changed_first(files: DataFrame) -> DataFrame:
    """Files (path, changed) in the order in which an index takes them: changed ones first, then by path."""
    return files.orderBy(F.desc("changed"), F.split("path", "/"))


def input_order(files: DataFrame) -> DataFrame:
    """Files (path, changed) with their `rank` from 0 in that order; no task sees all files."""
    return dense_ids(files.withColumn("_k", F.struct(~F.col("changed"), F.split("path", "/"))), "_k", "rank").drop("_k")


def by_role(streams: DataFrame, dim: DataFrame) -> DataFrame:
    """(role, a, b, a_start, b_start, tokens): clones among the streams (stream, role, tokens) of each role that looks for them, at that role's size.

    Roles are at most nine, each with an index of its own; the sizes come from
    the dimension of the policy.
    """
    out = None
    for role, k in ((r.role, r.clone_min_tokens) for r in dim.where("clones").select("role", "clone_min_tokens").orderBy("role").collect()):
        found = spans(windows(streams.where(F.col("role") == role).select("stream", "tokens"), int(k)), int(k)).withColumn("role", F.lit(role))
        out = found if out is None else out.unionByName(found)
    return None if out is None else out.select("role", "a", "b", "a_start", "b_start", "tokens")


def files_with_clones(found: DataFrame) -> DataFrame:
    return found.select(F.explode(F.array("a", "b")).alias("f")).agg(F.count_distinct("f").alias("files"))


def streams_in_spans(found: DataFrame, k: int, apart: int | None = None) -> DataFrame:
    """(stream) of each side of the spans of windows, once, without a pair: a window links all its streams if it has several, or one if its places are far enough apart."""
    of = Window.partitionBy("h")
    linked = (F.min("stream").over(of) < F.max("stream").over(of)) | (F.max("i").over(of) - F.min("i").over(of) >= (apart or k))
    return found.where("stream is not null").select("stream", linked.alias("linked")).where("linked").select("stream").distinct()


_LEX = re.compile(r"""[A-Za-z_][A-Za-z0-9_]*|[0-9][A-Za-z0-9.]*|"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?|\S""", re.S)
_COMMENT = re.compile(r"""(?:'(?:\\.|[^'\\])*(?:'|$)|"(?:\\.|[^"\\])*(?:"|$)|`(?:\\.|[^`\\])*(?:`|$)|[^'"`/#]|/(?!/)|\#(?=!?\[)|(?<=\S)\#)*""", re.S)
_DYNAMIC = re.compile(r"\s*import(?:\s|/\*.*?\*/|//[^\n]*\n)*[(.]", re.S)
_DECLARES = re.compile(
    r"""use\ |pub\s*(?:\([^)]*\)\s*)?use\ |import[ \t{"']|import$|export\ \*|export\ (?:type\ )?\{|export\ .*\ from\ |(?:export\ \s*|pub\s*(?:\([^)]*\)\s*)?)?type\ \s*(?:\{|[A-Za-z0-9_<>, \[\]]*[A-Za-z0-9_<>,\[\]]\s*=|[^=]*;$|[^=]*\{[^=]*$)""",
    re.S,
)
_QUOTED = re.compile(r"""'(?:\\.|[^'\\])*(?:'|$)|"(?:\\.|[^"\\])*(?:"|$)|`(?:\\.|[^`\\])*(?:`|$)|\\.""", re.S)


class _Declarations:
    """Whether lines belong to an import, a re-export or a type alias, which may span several."""

    def __init__(self):
        self.open, self.depth = False, dict.fromkeys("{([", 0)

    def has(self, line: str) -> bool:
        if not self.open:
            if not _DECLARES.match(line):
                return False
            self.open = True
        for c in _QUOTED.sub("", line):
            if c in "{([":
                self.depth[c] += 1
            elif c in "})]":
                o = "{(["["})]".index(c)]
                self.depth[o] = max(0, self.depth[o] - 1)
        if not any(self.depth.values()) and (line.endswith(";") or not line.endswith(("\\", "=", "|", "&", ","))):
            self.__init__()
        return True


def code_stream(text: str) -> tuple[list[str], list[int]]:
    """Tokens of a source text and the line of each; comments, imports, re-exports and type aliases have none."""
    tokens, lines, at, routine = [], [], 0, _Declarations()
    for n, line in enumerate(text.splitlines(keepends=True) if "\r" not in text else [x + "\n" for x in text.split("\n")], 1):
        rest, at = at, at + len(line)
        bare = line.strip()
        if not bare or bare.startswith(("//", "#", "/*")):
            continue
        code = _COMMENT.match(line)[0]
        bare = code.strip()
        if not bare or (not _DYNAMIC.match(text, rest) and routine.has(bare)):
            continue
        for t in _LEX.findall(code):
            tokens.append("_LIT_" if t[0] in "0123456789" else "_STR_" if t[0] in "\"'`" else t)
            lines.append(n)
    return tokens, lines


def code_streams(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(stream, tokens, lines) of source files; the state that spans lines is kept in the file's own row."""

    def run(batches):
        for pdf in batches:
            both = [code_stream(t or "") for t in pdf["text"]]
            yield pd.DataFrame({"stream": pdf["path"], "tokens": [x[0] for x in both], "lines": [x[1] for x in both]})

    rows = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "stream string, tokens array<string>, lines array<long>")


def long_enough(streams: DataFrame, found: DataFrame, k: int, min_lines: int) -> DataFrame:
    """Spans whose both sides cover `min_lines` lines or more, with those lines."""
    at = streams.select("stream", "lines")
    rows = found.join(at.select(F.col("stream").alias("a"), F.col("lines").alias("la")), "a").join(at.select(F.col("stream").alias("b"), F.col("lines").alias("lb")), "b")
    place = lambda l, s, e=0: F.get(l, (F.col(s) + e).cast("int"))
    rows = rows.select("a", "b", "a_start", "b_start", "tokens", place("la", "a_start").alias("a_first"), F.get("la", (F.col("a_start") + F.col("tokens") - 1).cast("int")).alias("a_last"), place("lb", "b_start").alias("b_first"), F.get("lb", (F.col("b_start") + F.col("tokens") - 1).cast("int")).alias("b_last"))
    return rows.where((F.col("a_last") - F.col("a_first") + 1 >= min_lines) & (F.col("b_last") - F.col("b_first") + 1 >= min_lines))


def fingerprint(tokens: Column, tag: str = "clone-v1") -> Column:
    """FNV-1a of 64 bits over a tag and the length and bytes of each token, as 16 hex digits.

    The state is two halves of 32 bits, because products of 64 bits overflow.
    """
    body = F.concat(F.lit(tag.encode().hex().upper()), F.array_join(F.transform(tokens, lambda t: F.concat(F.lpad(F.hex(F.octet_length(t).cast("long")), 16, "0"), F.hex(F.encode(t, "UTF-8")))), ""))
    octets = F.transform(F.sequence(F.lit(1), F.length(body), F.lit(2)), lambda i: F.conv(F.substring(body, i, F.lit(2)), 16, 10).cast("long"))
    low = F.lit(0xFFFFFFFF)

    def step(s, c):
        x = s["lo"].bitwiseXOR(c)
        carry = F.shiftrightunsigned(x * 435, 32)
        return F.struct((s["hi"] * 435 + carry + F.shiftleft(x, 8)).bitwiseAND(low).alias("hi"), (x * 435).bitwiseAND(low).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    done = F.aggregate(octets, start, step)
    return F.lower(F.concat(F.lpad(F.hex(done["hi"]), 8, "0"), F.lpad(F.hex(done["lo"]), 8, "0")))
