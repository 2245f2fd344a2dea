"""Column expressions on source text and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """The lines of a text as an array: a final line break starts no further line, CR LF counts as one break."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), r"\r?\n", -1))


_BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.trim(x, F.lit(_BLANKS))


_QUOTED = r"""'(?:\\.|[^'\\])*+(?:'|\\?$)|"(?:\\.|[^"\\])*+(?:"|\\?$)|`(?:\\.|[^`\\])*+(?:`|\\?$)"""


def without_comment(line: Column, hashes: bool = True) -> Column:
    """The line up to the first // outside quotes; with `hashes` also up to a # at its start or after white space, which #[ and #![ are not."""
    other = r"[^'\"`/#]|/(?!/)" + (r"|#(?=!?\[)|(?<=[^ \t\n\x0B\f\r])#" if hashes else "|#")
    return F.regexp_extract(line, rf"(?s)^(?:{_QUOTED}|{other})*+", 0)


def visible(text: Column) -> Column:
    """Tabs, carriage returns and other control characters as escapes."""
    out = F.replace(F.replace(text, F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    escaped = lambda c: F.concat(F.lit("\\u{"), F.regexp_replace(F.hex(F.ascii(c)), "^0+(?=.)", ""), F.lit("}"))
    shown = F.array_join(F.transform(F.split(out, ""), lambda c: F.when(c.rlike(r"^[\x00-\x1F\x7F-\x9F]$"), escaped(c)).otherwise(c)), "")
    return F.when(out.rlike(r"[\x00-\x1F\x7F-\x9F]"), shown).otherwise(out)


def short_text(text: Column, limit: int = 240) -> Column:
    """The first line that isn't blank, with control characters shown, cut at `limit` characters with an ellipsis."""
    first = F.try_element_at(F.filter(lines(text), lambda x: strip(x) != ""), F.lit(1))
    shown = visible(strip(first))
    return F.when(F.length(shown) > limit, F.concat(F.left(shown, F.lit(limit)), F.lit("…"))).otherwise(F.coalesce(shown, F.lit("")))


def number(x: Column) -> Column:
    """At most three decimals, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.3f", x.cast("double")), r"\.?0+$", "")


def location(file: Column, line: Column, column: Column, end_line: Column) -> Column:
    """file, file:line, file:line:column or file:first-last."""
    return (
        F.when(line.isNull(), file)
        .when(column.isNotNull(), F.concat_ws(":", file, line.cast("string"), column.cast("string")))
        .when(end_line.isNotNull() & (end_line > line), F.concat(file, F.lit(":"), line.cast("string"), F.lit("-"), end_line.cast("string")))
        .otherwise(F.concat_ws(":", file, line.cast("string")))
    )


def inside_string(prefix: Column) -> Column:
    """Whether an odd number of unescaped single or double quotes stands before a place."""
    bare = F.regexp_replace(prefix, r"\\.", "")
    odd = lambda q: F.length(F.regexp_replace(bare, f"[^{q}]", "")) % 2 == 1
    return odd("'") | odd('"')


def normal_path(path: Column) -> Column:
    """Forward slashes, no leading ./, ASCII lower case."""
    slashed = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")
    return F.translate(slashed, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lexical_path(path: Column) -> Column:
    """Without . and with .. resolved; null where .. leaves the root."""
    step = lambda acc, x: (
        F.when(acc.isNull() | x.isin("", "."), acc)
        .when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)))
        .otherwise(F.concat(acc, F.array(x)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def record_key(path: Column) -> Column:
    """A report's path without empty parts and . and with .. resolved, which never leaves the root; a leading slash stays."""
    slashed = F.regexp_replace(path, r"\\", "/")
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    joined = F.array_join(F.aggregate(F.split(slashed, "/"), F.array().cast("array<string>"), step), "/")
    # Most paths have none of these.
    odd = path.rlike(r"\\|(?:^|/)(?:\.{0,2})(?:/|\z)")
    return F.when(~odd, path).when(slashed.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def relative_key(path: Column) -> Column:
    """A path without . and with .. resolved, where leading .. stay."""
    step = (
        lambda acc, x: F.when(x.isin("", "."), acc)
        .when((x == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(path: Column) -> Column:
    """What follows the last dot of the name, "" without one; a name's leading dot starts none."""
    return F.regexp_extract(name_of(path), r"^.+\.([^.]*)$", 1)


def suffix_of(name: Column) -> Column:
    """What follows the last dot of a name, be it the leading one."""
    return F.regexp_extract(name, r"\.([^.]*)$", 1)


def percent(hit: Column, found: Column) -> Column:
    return F.when(found == 0, F.lit(0.0)).otherwise(hit / found * 100)


def glob_to_regex(glob: str, within: bool = False) -> str:
    """An anchored pattern for a glob: * and ? cross slashes (unless `within` a part), ** spans directories, {a,b} and [ab] as usual."""
    star, one = ("[^/]*", "[^/]") if within else (".*", ".")
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if c == "*":
            out.append(".*" if glob.startswith("**", i) else star)
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
        elif c == "?":
            out.append(one)
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in glob {glob!r}")
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", r"\\") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append("\\" + c if c in r"\.+()|^$}" else c)
        i += 1
    if depth:
        raise ValueError(f"unclosed alternation in glob {glob!r}")
    return "^" + "".join(out) + "$"


def glob_pattern(glob: Column) -> Column:
    """The regular expression, without anchors, of globs in a column, where * and ? stay within a part; null for an unclosed class.

    ** spans parts, [ab] and [!ab] are classes, and a backslash makes the next sign stand for itself.
    """
    # Signs that later steps would read again stand aside as control characters.
    aside = {"*": "\x01", "?": "\x02", "[": "\x03", "]": "\x04", "\\": "\x05"}
    out = glob
    for sign, mark in aside.items():
        out = F.replace(out, F.lit("\\" + sign), F.lit(mark))
    out = F.regexp_replace(out, r"\\(.)", "$1")
    out = F.regexp_replace(out, r"\[[!^]", "[\x06")
    out = F.regexp_replace(out, r"([.+()|^$}{&~\-](?![^\[]*\]))", r"\\$1")
    out = F.regexp_replace(out, r"(^|/)(?:\*\*/)+", "$1\x07")
    out = F.regexp_replace(out, r"\*\*+", "\x08")
    out = F.replace(F.replace(out, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    for mark, regex in (("\x08", ".*"), ("\x07", "(?:.*/)?"), ("\x06", "^"), *((m, "\\" + c) for c, m in aside.items())):
        out = F.replace(out, F.lit(mark), F.lit(regex))
    return F.when(~glob.rlike(r"(?<!\\)\[[^\]]*$"), out)
