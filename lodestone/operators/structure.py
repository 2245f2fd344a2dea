"""Functions of sources with their metrics: Python by its own grammar, Rust, JavaScript and TypeScript by `braces`."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import braces
from .files import PARSED_EXTENSIONS

SCHEMA = "path string, name string, start_line long, start_column long, end_line long, lines long, parameters long, cyclomatic long, nesting long, statements long, error string, error_line long, error_column long"
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)


class _Measure:
    """Branches, deepest nesting and statements of one function; inner functions are measured on their own.

    if, elif, loops, except, case, conditional expressions and the for and if of
    comprehensions branch and nest; boolean operators branch. An elif is as deep
    as its if, but an if inside of else is deeper. A definition counts as a
    statement, and so do the decorators of one as a whole.
    """

    def __init__(self, fn: ast.AST):
        self.branches, self.deepest = 0, 0
        self.statements = int(not isinstance(fn, ast.Lambda))
        todo = [(n, 0) for n in ast.iter_child_nodes(fn) if n not in getattr(fn, "decorator_list", ())]
        while todo:
            node, depth = todo.pop()
            if isinstance(node, _FUNCTIONS):
                self.statements += bool(getattr(node, "decorator_list", ()))
                todo += [(d, depth) for d in getattr(node, "decorator_list", ())]
                continue
            todo += self._visit(node, depth)

    def _branch(self, depth: int) -> int:
        self.branches += 1
        self.deepest = max(self.deepest, depth + 1)
        return depth + 1

    def _visit(self, node: ast.AST, depth: int) -> list[tuple[ast.AST, int]]:
        inner = depth
        if isinstance(node, ast.stmt):
            self.statements += 1 + bool(getattr(node, "decorator_list", ()))
        if isinstance(node, ast.If):
            return self._if(node, depth)
        if isinstance(node, (*_LOOPS, ast.ExceptHandler, ast.IfExp)):
            inner = self._branch(depth)
        elif isinstance(node, ast.match_case):
            inner = self._branch(depth)
            if node.guard is not None:
                return [(node.guard, self._branch(inner)), (node.pattern, inner), *((n, inner) for n in node.body)]
        elif isinstance(node, ast.comprehension):
            out = [(n, self._branch(depth)) for n in node.ifs]
            inner = self._branch(depth)
            return [*out, (node.target, inner), (node.iter, inner)]
        elif isinstance(node, ast.BoolOp):
            self.branches += len(node.values) - 1
        return [(n, inner) for n in ast.iter_child_nodes(node)]

    def _if(self, node: ast.If, depth: int) -> list[tuple[ast.AST, int]]:
        inner = self._branch(depth)
        out = [(node.test, inner), *((n, inner) for n in node.body)]
        rest = node.orelse
        if len(rest) == 1 and isinstance(rest[0], ast.If) and rest[0].col_offset == node.col_offset:
            # elif: another arm, no statement of its own.
            self.statements -= 1
            return [*out, (rest[0], depth)]
        return [*out, *((n, inner) for n in rest)]


def functions_of(path: str, text: str) -> list[tuple]:
    """Rows of a source's functions, or one that tells where it can't be parsed."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, *[None] * 9, str(e), getattr(e, "lineno", None), getattr(e, "offset", None))]
    out = []
    for node in ast.walk(tree):
        if isinstance(node, _FUNCTIONS):
            a = node.args
            params = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + (a.vararg is not None) + (a.kwarg is not None)
            m = _Measure(node)
            out.append((path, getattr(node, "name", "lambda"), node.lineno, node.col_offset + 1, node.end_lineno, node.end_lineno - node.lineno + 1, params, 1 + m.branches, m.deepest, m.statements, None, None, None))
    return sorted(out, key=lambda r: (r[2], r[3], -r[4]))


def functions(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per function of every source with a parser; one that can't be read gives a row with its error, and other files none."""
    rows = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).where(F.lower(T.extension_of(F.col("path"))).isin(*PARSED_EXTENSIONS))
    return _measured(rows, lambda path, text: functions_of(path, text) if path.lower().endswith(".py") else braces.functions_of(path.lower(), text, path))


def _measured(rows: DataFrame, measure: Callable[[str, str], list[tuple]]) -> DataFrame:
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([r for p, t in zip(pdf["path"], pdf["text"]) for r in measure(p, t)], columns=columns)
            yield out.astype({c: "Int64" for c in columns[2:10] + columns[11:]})

    return rows.mapInPandas(run, SCHEMA)


def python_functions(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per function, lambda included; a source that can't be parsed gives a row with its error and where it is."""
    return _measured(files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")), functions_of)
