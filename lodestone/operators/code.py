"""Source text as code: which lines bear it, which files can run, and small parsers that queries need."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import text as T

_START = re.compile(r"""r(\#*)"|['"`]|//|/\*|\#""")
_BLOCK = re.compile(r"/\*|\*/")
_ONLY_DELIMITERS = re.compile(r"[{}\[\]();,:\s]*\Z")


class LineScanner:
    """Follows strings and nested block comments from line to line."""

    def __init__(self):
        self.depth, self.quote, self.hashes = 0, None, None

    def _hash_comment(self, line: str, at: int) -> bool:
        return line[at + 1 : at + 2] not in ("[", "!") and (at == 0 or line[at - 1].isspace())

    def _string_end(self, line: str, at: int) -> int:
        """Where the open string ends in this line, or the line's length."""
        if self.quote is None:
            close = line.find('"' + "#" * self.hashes, at)
            if close < 0:
                return len(line)
            end, self.hashes = close + 1 + self.hashes, None
            return end
        while at < len(line):
            if line[at] == "\\":
                at += 2
            elif line[at] == self.quote:
                self.quote = None
                return at + 1
            else:
                at += 1
        return len(line)

    def bears_code(self, line: str) -> bool:
        """Whether the next line has code or a part of a string; comments and lone delimiters are none."""
        kept, literal, at = [], self.quote is not None or self.hashes is not None, 0
        while at < len(line):
            if self.depth:
                found = _BLOCK.search(line, at)
                if not found:
                    break
                self.depth += 1 if found[0] == "/*" else -1
                at = found.end()
            elif self.quote is not None or self.hashes is not None:
                literal = True
                at = self._string_end(line, at)
            else:
                found = _START.search(line, at)
                if not found:
                    kept.append(line[at:])
                    break
                kept.append(line[at : found.start()])
                mark = found[0]
                if mark == "//" or (mark == "#" and self._hash_comment(line, found.start())):
                    break
                if mark == "/*":
                    self.depth = 1
                elif mark == "#":
                    kept.append("#")
                elif mark[0] == "r":
                    self.hashes, literal = len(found[1]), True
                else:
                    self.quote, literal = mark, True
                at = found.end()
        if literal:
            return True
        code = "".join(kept).strip()
        if not code or code.startswith(("//", "<!--", "--")) or (code.startswith("#") and not code.startswith(("#[", "#!"))):
            return False
        return not _ONLY_DELIMITERS.match(code)


def _lines(text: str) -> list[str]:
    out = text.split("\n")
    if out and out[-1] == "":
        out.pop()
    return [x.removesuffix("\r") for x in out]


def code_lines(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line) of the lines that bear code; a file's lines are scanned in its own row, as strings and comments span them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths, numbers = [], []
            for path, text in zip(pdf["path"], pdf["text"]):
                scanner = LineScanner()
                found = [n for n, line in enumerate(_lines(text or ""), 1) if scanner.bears_code(line)]
                paths += [path] * len(found)
                numbers += found
            yield pd.DataFrame({"path": paths, "line": pd.array(numbers, dtype="int64")})

    rows = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "path string, line long")


_ERASED = re.compile(r"(?:export\s+)?(?:declare\s+)?(?:interface|type)\s+[\w$]|(?:export\s+)?declare\s|import\s+type[\s{]|export\s+type[\s{*]")
_OPENERS, _CLOSERS = "{([", "})]"


def top_level_statements(text: str) -> list[str] | None:
    """The statements of a script at its top level, comments and strings taken out; null where brackets don't match."""
    bare = re.sub(r"""'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`""", "''", re.sub(r"""('(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`)|//[^\n]*|/\*.*?\*/""", lambda m: m[1] or " ", text, flags=re.S), flags=re.S)
    out, now, open_ = [], [], []
    for c in bare:
        if c in _OPENERS:
            open_.append(c)
        elif c in _CLOSERS:
            if not open_ or _OPENERS.index(open_.pop()) != _CLOSERS.index(c):
                return None
        now.append(c)
        line_end = c == "\n" and not re.search(r"[=|&,:?<(]\s*\Z|\b(?:type|interface|extends|keyof)\s*\Z", "".join(now))
        if not open_ and (c == ";" or line_end or (c == "}" and re.match(r"\s*(?:export\s+)?(?:declare\s+)?(?:interface|namespace|module|global|class|enum|function)\b", "".join(now)))):
            if "".join(now).strip(" \t\r\n;"):
                out.append("".join(now).strip())
            now = []
    if open_:
        return None
    if "".join(now).strip(" \t\r\n;"):
        out.append("".join(now).strip())
    return out


@F.pandas_udf(types.BooleanType())
def _only_types(text: pd.Series) -> pd.Series:
    def one(t):
        statements = top_level_statements(t or "")
        # A line that goes on from the statement before it begins with an operator.
        return statements is not None and all(_ERASED.match(s) or s[0] in "|&" for s in statements)

    return text.map(one)


def not_executable(path: Column, text: Column) -> Column:
    """Stylesheets, and TypeScript files of types and comments only; what can't be read is executable."""
    ext = T.extension_of(path)
    return F.when(F.lower(ext) == "css", True).when(ext.isin("ts", "tsx", "mts", "cts") & text.isNotNull(), F.coalesce(_only_types(text), F.lit(False))).otherwise(False)


# Kinds of nodes that branch, what a report calls them, and the operators that branch.
BRANCHES = (
    "if_expression", "if_statement", "while_expression", "while_statement", "for_expression", "for_statement", "for_in_statement", "loop_expression", "match_expression", "match_arm",
    "switch_statement", "switch_case", "catch_clause", "ternary_expression", "elif_clause", "except_clause", "case_clause", "conditional_expression", "for_in_clause", "if_clause",
)
BRANCH_WORDS = {
    "if_expression": "conditional branch (`if`)", "if_statement": "conditional branch (`if`)", "while_expression": "loop (`while`)", "while_statement": "loop (`while`)",
    "for_expression": "loop (`for`)", "for_statement": "loop (`for`)", "for_in_statement": "loop (`for`)", "loop_expression": "infinite loop (`loop`)", "match_expression": "pattern match (`match`)",
    "match_arm": "pattern match arm (`match`)", "switch_statement": "switch (`switch`)", "switch_case": "switch case", "catch_clause": "exception handler (`catch`)", "ternary_expression": "ternary operator (`? :`)",
}
OPERATORS = ("&&", "||", "and", "or")


def branch_words(kind: Column) -> Column:
    """What a report calls a branch or a boolean operator; null for what doesn't branch."""
    named = F.try_element_at(F.create_map(*(F.lit(x) for p in BRANCH_WORDS.items() for x in p)), kind)
    return F.when(kind.isin(*OPERATORS), F.concat(F.lit("boolean operator `"), kind, F.lit("`"))).when(kind.isin(*BRANCHES), F.coalesce(named, F.lit("branching construct")))


def shell_words(command: Column) -> Column:
    """Words of a command line; quotes join them, a backslash takes the next character as it is, but not in single quotes. What isn't closed ends with the line."""
    single, double, escape = r"'[^']*(?:'|$)", r'"(?:[^"\\]|\\.)*(?:"|\\?$)', r"\\(?:.|$)"
    words = F.regexp_extract_all(F.coalesce(command, F.lit("")), F.lit(rf"(?sU)(?:{single}|{double}|{escape}|[^\s'\"\\])+"), F.lit(0))
    parts = lambda w: F.regexp_extract_all(w, F.lit(rf"(?s){single}|{double}|{escape}|[^'\"\\]+"), F.lit(0))

    def plain(part):
        quoted = F.regexp_replace(F.regexp_extract(part, r'(?s)^"((?:[^"\\]|\\.)*)', 1), r"(?s)\\(.)", "$1")
        return F.when(part.startswith("'"), F.regexp_replace(part, "'", "")).when(part.startswith('"'), quoted).when(part.startswith("\\"), F.regexp_replace(part, r"^\\", "")).otherwise(part)

    return F.transform(words, lambda w: F.array_join(F.transform(parts(w), plain), ""))


_DEPTH = 64


def cfg_value(predicate: Column, test: bool) -> Column:
    """A configuration predicate for a value of `test`, null where it depends on something else or can't be read.

    Names become digits, 0 false, 1 true and 2 unknown, and the innermost
    parentheses are replaced by their value, from the inside out.
    """
    name = r"(?<![\w:])[A-Za-z_][\w:]*"
    s = F.regexp_replace(F.coalesce(predicate, F.lit("")), rf'{name}\s*=\s*"(?:\\.|[^"\\])*"', "2")
    s = F.regexp_replace(F.regexp_replace(s, r"(?<=[\w)])\s+(?=\w)", ","), r"\s+", "")
    s = F.regexp_replace(s, r"(?<![\w:])test(?![\w:(])", "1" if test else "0")
    s = F.regexp_replace(s, name + r"(?![\w:(])", "2")
    # Each pattern has one value, so their order doesn't matter.
    inner = (
        (r"not\(1,?\)", "0"), (r"not\(0,?\)", "1"), (r"not\((?![01],?\))[012,]*\)", "2"), (r"all\((?=[12,]*0)[012,]*\)", "0"), (r"all\([1,]*\)", "1"), (r"all\((?=[1,]*2)[12,]*\)", "2"),
        (r"any\((?=[02,]*1)[012,]*\)", "1"), (r"any\([0,]*\)", "0"), (r"any\((?=[0,]*2)[02,]*\)", "2"), (r"(?!(?:not|all|any)\()[A-Za-z_][\w:]*\([012,]*\)", "2"),
    )

    def once(x):
        for pattern, value in inner:
            x = F.regexp_replace(x, r"(?<![\w:])" + pattern, value)
        return x

    s = F.aggregate(F.sequence(F.lit(1), F.lit(_DEPTH)), s, lambda x, _: F.when(x.contains("("), once(x)).otherwise(x))
    first = F.regexp_extract(s, r"^([012])(?![\w:(])", 1)
    return F.when(first == "1", True).when(first == "0", False)


def requires_test(predicate: Column) -> Column:
    """Whether a predicate surely excludes code outside of tests: false without `test`, and not false with it."""
    return F.coalesce(~cfg_value(predicate, False), F.lit(False)) & F.coalesce(cfg_value(predicate, True), F.lit(True))


def byte_offset(text: Column, line: Column, column: Column) -> Column:
    """The byte at a line and column from 1 on, carriage returns apart; null for a place outside the text."""
    all_lines = F.split(text, "\n", -1)
    before = F.aggregate(F.slice(all_lines, F.lit(1), F.greatest(line - 1, F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 1)
    mine = F.get(all_lines, (line - 1).cast("int"))
    head = F.regexp_substr(mine, F.concat(F.lit("^(?:\r*[^\r]){"), F.greatest(column - 1, F.lit(0)).cast("string"), F.lit("}")))
    inside = text.isNotNull() & (line >= 1) & (column >= 1) & (line <= F.size(all_lines))
    return F.when(inside, before + F.when(column == 1, F.lit(0)).otherwise(F.octet_length(head)))
