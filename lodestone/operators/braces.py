"""Functions of Rust, JavaScript and TypeScript sources with their metrics, by a lexer and the structure of brackets.

No grammar is at hand, so this follows statements and the constructs that
branch, not types: conditional types, decorators with code, JSX text with
brackets or quotes, macros by example and generator functions are read roughly.
A source whose brackets or strings don't close is an error with its place.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

_ID = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"[0-9](?:[\w]|\.(?=[0-9]))*")
_OP = re.compile(r"=>|&&=?|\|\|=?|->|::|\?\?=?|\?\.(?![0-9])|\.\.\.|\.\.=?|[=!]==?|[-+*/%^&|<>]=|.", re.S)
_RUST_STRING = re.compile(r'b?r(\#*)".*?"\1|[bc]?"(?:\\.|[^"\\])*"', re.S)
_RUST_CHAR = re.compile(r"b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'")
_JS_STRING = re.compile(r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_OPEN, _CLOSE = "([{", ")]}"
_NO_OPERAND = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "instanceof", "yield", "await", "match", "if", "while"}


class Malformed(ValueError):
    def __init__(self, what: str, at: int):
        super().__init__(what)
        self.at = at


@dataclass
class Source:
    """Tokens (text, kind, place) and, for each bracket, its partner's index."""

    text: str
    rust: bool

    def __post_init__(self):
        self.lines = [0, *(m.end() for m in re.finditer("\n", self.text))]
        self.tokens: list[tuple[str, str, int]] = []
        self._lex()
        self.partner, stack = {}, []
        for i, (t, kind, at) in enumerate(self.tokens):
            if kind == "op" and t in _OPEN:
                stack.append(i)
            elif kind == "op" and t in _CLOSE:
                if not stack or _OPEN.index(self.tokens[stack[-1]][0]) != _CLOSE.index(t):
                    raise Malformed(f"unexpected {t}", at)
                self.partner[i] = stack[-1]
                self.partner[stack.pop()] = i
        if stack:
            raise Malformed("bracket without an end", self.tokens[stack[-1]][2])

    def place(self, at: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.lines, at)
        return line, at - self.lines[line - 1] + 1

    def line(self, i: int) -> int:
        return self.place(self.tokens[i][2])[0]

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][1] != "str" and self.tokens[i][0] in texts

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][1] == "id"

    def operand(self, i: int) -> bool:
        """Whether a value may end at this token."""
        if not 0 <= i < len(self.tokens):
            return False
        t, kind, _ = self.tokens[i]
        return kind in ("num", "str") or (kind == "id" and t not in _NO_OPERAND) or t in (")", "]", "}")

    def _template(self, at: int) -> int:
        begin, at = at, at + 1
        while at < len(self.text):
            c = self.text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                return at + 1
            elif self.text.startswith("${", at):
                depth, at = 1, at + 2
                while at < len(self.text) and depth:
                    if self.text[at] == "`":
                        at = self._template(at)
                        continue
                    depth += {"{": 1, "}": -1}.get(self.text[at], 0)
                    at += 1
            else:
                at += 1
        raise Malformed("text without an end", begin)

    def _lex(self) -> None:
        text, at = self.text, 0
        while at < len(text):
            c = text[at]
            if c.isspace():
                at += 1
            elif text.startswith("//", at):
                at = text.find("\n", at) if "\n" in text[at:] else len(text)
            elif text.startswith("/*", at):
                at = self._comment(at)
            else:
                kind, end = self._token(c, at)
                self.tokens.append((text[at:end], kind, at))
                at = end

    def _comment(self, at: int) -> int:
        depth, begin = 0, at
        for m in re.compile(r"/\*|\*/").finditer(self.text, at):
            depth += 1 if m[0] == "/*" and (self.rust or not depth) else -1 if m[0] == "*/" else 0
            if not depth:
                return m.end()
        raise Malformed("comment without an end", begin)

    def _token(self, c: str, at: int) -> tuple[str, int]:
        if self.rust:
            m = _RUST_STRING.match(self.text, at) or _RUST_CHAR.match(self.text, at)
            if m:
                return "str", m.end()
            if c == '"':
                raise Malformed("text without an end", at)
            if c == "'" and (m := _ID.match(self.text, at + 1)):
                return "life", m.end()
        else:
            if m := _JS_STRING.match(self.text, at):
                return "str", m.end()
            if c == "`":
                return "str", self._template(at)
            if c == "/" and not self.operand(len(self.tokens) - 1) and (m := _REGEX.match(self.text, at)):
                return "str", m.end()
        if m := _ID.match(self.text, at):
            return "id", m.end()
        if m := _NUMBER.match(self.text, at):
            return "num", m.end()
        return "op", _OP.match(self.text, at).end()


@dataclass
class Function:
    name: str
    first: int
    last: int
    params: tuple[int, int]
    body: int
    counts: bool = False


def _segments(s: Source, a: int, b: int, angles: bool) -> int:
    """Comma-separated parts between two tokens that have anything in them."""
    n, depth, some, i = 0, 0, False, a
    while i < b:
        if s.is_(i, *_OPEN):
            i = s.partner[i]
            some = True
        elif angles and s.is_(i, "<"):
            depth += 1
        elif angles and s.is_(i, ">"):
            depth -= 1
        elif s.is_(i, ",") and depth <= 0:
            n, some = n + some, False
        else:
            some = True
        i += 1
    return n + some


def _behind_generics(s: Source, i: int) -> int:
    """What follows generic parameters that begin at i, which may hold function types."""
    depth = 0
    while i < len(s.tokens):
        if s.is_(i, "<"):
            depth += 1
        elif s.is_(i, ">"):
            depth -= 1
        elif not depth:
            return i
        i = s.partner[i] + 1 if s.is_(i, *_OPEN) else i + 1
    return i


def rust_functions(s: Source) -> list[Function]:
    out = []
    for i in range(len(s.tokens)):
        if not s.is_(i, "fn") or not s.named(i + 1):
            continue
        j = _behind_generics(s, i + 2)
        close = s.partner.get(j) if s.is_(j, "(") else None
        k = len(s.tokens) if close is None else close + 1
        while k < len(s.tokens) and not s.is_(k, "{", ";"):
            k = s.partner[k] + 1 if s.is_(k, "(", "[") else k + 1
        if not s.is_(k, "{"):
            continue
        first = i
        while s.is_(first - 1, "async", "unsafe", "const", "extern", "pub", "default") or (first and s.tokens[first - 1][1] == "str" and s.is_(first - 2, "extern")) or (s.is_(first - 1, ")") and s.is_(s.partner[first - 1] - 1, "pub")):
            first = s.partner[first - 1] if s.is_(first - 1, ")") else first - 1
        out.append(Function(s.tokens[i + 1][0], first, s.partner[k], (j + 1, close), k))
    return out


_CONTROL = {"if", "for", "while", "switch", "catch", "with", "function", "return", "await", "typeof", "new", "super"}
_MODIFIERS = ("async", "static", "public", "private", "protected", "readonly", "override", "get", "set", "abstract", "*")


def _annotated(s: Source, i: int) -> int:
    """Behind a type annotation that begins at i with a colon, if one does; the index of the next { or =>."""
    if not s.is_(i, ":"):
        return i
    i += 1
    while i < len(s.tokens) and not s.is_(i, "=>", ";", ",", ")", "="):
        if s.is_(i, "{") and not s.is_(i - 1, ":", "|", "&", "<", ","):
            return i
        i = s.partner[i] + 1 if s.is_(i, *_OPEN) else i + 1
    return i


def _declarator(s: Source, first: int) -> str | None:
    """The name of the variable that a function which begins here is the value of."""
    i = first - 1
    if not s.is_(i, "="):
        return None
    i -= 1
    back = i
    while back >= 0 and not s.is_(back, "const", "let", "var", ";", "{", "}", ","):
        back = s.partner[back] - 1 if s.is_(back, *_CLOSE) else back - 1
    return s.tokens[back + 1][0] if s.is_(back, "const", "let", "var", ",") and s.named(back + 1) and (back + 1 == i or s.is_(back + 2, ":")) else None


def script_functions(s: Source) -> list[Function]:
    out = []
    for i, (t, kind, _) in enumerate(s.tokens):
        if kind == "id" and t == "function" and not s.is_(i + 1, "*"):
            own = s.named(i + 1)
            j = i + 1 + own
            while j < len(s.tokens) and not s.is_(j, "("):
                j += 1
            k = _annotated(s, s.partner.get(j, len(s.tokens)) + 1)
            if s.is_(k, "{"):
                first = i - s.is_(i - 1, "async")
                declared = first == 0 or s.is_(first - 1, ";", "{", "}", "export", "default") or (not s.is_(first - 1, *"=(,:?[&|!+-") and s.line(first - 1) < s.line(first))
                out.append(Function(s.tokens[i + 1][0] if own else _declarator(s, first) or "anonymous", first, s.partner[k], (j + 1, s.partner[j]), k, declared and own))
        elif s.is_(i, "=>"):
            out += _arrow(s, i)
        elif kind in ("id", "str") and t not in _CONTROL and not s.is_(i - 1, ".", "?.", "new", "function", "?", "=", "=>", "(", "*" if s.is_(i - 2, "function") else "."):
            j = i + 1
            if s.is_(j, "<"):
                while j < len(s.tokens) and not s.is_(j, "(", ";", "{"):
                    j += 1
            if not s.is_(j, "("):
                continue
            k = _annotated(s, s.partner[j] + 1)
            if s.is_(k, "{"):
                first = i
                while s.is_(first - 1, *_MODIFIERS):
                    first -= 1
                out.append(Function(t.strip("'\""), first, s.partner[k], (j + 1, s.partner[j]), k, True))
    return sorted(out, key=lambda f: (f.first, -f.last))


def _arrow(s: Source, i: int) -> list[Function]:
    j = i - 1
    if not s.is_(j, ")"):
        back = j
        while back >= 0 and not s.is_(back, ")", ";", "=", ",", "(", "{"):
            back -= 1
        if s.is_(back, ")") and s.is_(back + 1, ":"):
            j = back
    params = (s.partner[j] + 1, j) if s.is_(j, ")") else (j, j + 1)
    first = s.partner[j] if s.is_(j, ")") else j
    first -= s.is_(first - 1, "async")
    # A function type stands behind a colon, or in an alias, and has no body in braces.
    if not s.is_(i + 1, "{"):
        back = first - 1
        while back >= 0 and not s.is_(back, ";", "{", "}", "=>"):
            if s.is_(back, "type", "interface", "declare") and s.named(back + 1):
                return []
            back = s.partner[back] - 1 if s.is_(back, *_CLOSE) else back - 1
        last = _end_of_expression(s, i + 1) - 1
        return [Function(_declarator(s, first) or "anonymous", first, last, params, i + 1)]
    return [Function(_declarator(s, first) or "anonymous", first, s.partner[i + 1], params, i + 1)]


def _continues(s: Source, i: int) -> bool:
    """Whether the token at i goes on with the expression before it, though on a line of its own."""
    return s.tokens[i][1] == "op" and s.tokens[i][0] not in ("{", "}", ";", "++", "--", "@", "#") or s.is_(i, "in", "of", "instanceof", "as", "satisfies")


def _end_of_expression(s: Source, i: int) -> int:
    while i < len(s.tokens) and not s.is_(i, ",", ";", *_CLOSE):
        i = s.partner[i] + 1 if s.is_(i, *_OPEN) else i + 1
        if i < len(s.tokens) and s.operand(i - 1) and s.line(i) > s.line(i - 1) and not _continues(s, i):
            break
    return i


class Measure:
    """Branches, deepest nesting and statements of one function; inner functions are left out."""

    def __init__(self, s: Source, f: Function, inner: dict[int, int]):
        self.s, self.inner = s, {a: b for a, b in inner.items() if a != f.first}
        self.branches, self.deepest, self.statements = 0, 0, int(f.counts)
        self.expression(f.params[0], f.params[1], 0)
        if not s.is_(f.body, "{"):
            self.expression(f.body, f.last + 1, 0)
        elif s.rust:
            self.rust_block(f.body, 0)
        else:
            self.script_block(f.body, 0)

    def branch(self, depth: int) -> int:
        self.branches += 1
        self.deepest = max(self.deepest, depth + 1)
        return depth + 1

    def until(self, i: int, *stops: str) -> int:
        while i < len(self.s.tokens) and not self.s.is_(i, *stops):
            i = self.s.partner[i] + 1 if self.s.is_(i, *_OPEN) else i + 1
        return i

    def expression(self, i: int, end: int, depth: int) -> None:
        """Walks the tokens up to `end`; constructs with bodies take theirs along."""
        s = self.s
        while i < end:
            if i in self.inner:
                i = self.inner[i] + 1
            elif s.rust and s.is_(i, "if", "match", "while", "for", "loop") and s.tokens[i][1] == "id" and not (s.is_(i, "for") and s.is_(i + 1, "<")):
                i = self.rust_construct(i, depth)
            elif s.is_(i, "{"):
                if s.rust:
                    self.rust_block(i, depth)
                else:
                    self.expression(i + 1, s.partner[i], depth)
                i = s.partner[i] + 1
            elif s.is_(i, "(", "["):
                self.expression(i + 1, s.partner[i], depth)
                i = s.partner[i] + 1
            else:
                if s.is_(i, "&&", "||") and s.operand(i - 1):
                    self.branches += 1
                elif not s.rust and s.is_(i, "?") and not s.is_(i + 1, ":", ",", ")", "=", ";"):
                    depth = self.branch(depth)
                i += 1

    # Rust

    def rust_construct(self, i: int, depth: int) -> int:
        """From if, match, while, for or loop to behind its end."""
        s, word = self.s, self.s.tokens[i][0]
        inner = self.branch(depth)
        body = self.until(i + 1, "{")
        self.expression(i + 1, body, inner)
        if body >= len(s.tokens):
            return body
        if word == "match":
            self.arms(body, inner)
        else:
            self.rust_block(body, inner)
        i = s.partner[body] + 1
        if word == "if" and s.is_(i, "else"):
            if s.is_(i + 1, "if"):
                return self.rust_construct(i + 1, depth)
            if s.is_(i + 1, "{"):
                self.rust_block(i + 1, inner)
                return s.partner[i + 1] + 1
        return i

    def arms(self, open_: int, depth: int) -> None:
        s, i, end = self.s, open_ + 1, self.s.partner[open_]
        while i < end:
            arrow = self.until(i, "=>")
            if arrow >= end:
                return
            inner = self.branch(depth)
            for k in range(i, arrow):
                if s.is_(k, "&&", "||") and s.operand(k - 1):
                    self.branches += 1
            i = arrow + 1
            if s.is_(i, "{"):
                self.rust_block(i, inner)
                i = s.partner[i] + 1
            else:
                stop = min(self.until(i, ",", "}"), end)
                self.expression(i, stop, inner)
                i = stop
            i += s.is_(i, ",")

    def rust_block(self, open_: int, depth: int) -> None:
        s, i, end = self.s, open_ + 1, self.s.partner[open_]
        while i < end:
            if i in self.inner:
                i = self.inner[i] + 1
            elif s.is_(i, "#"):
                i = self.until(i, "[") + 1
                i = s.partner[i - 1] + 1
            elif s.is_(i, ";"):
                self.statements += 1
                i += 1
            elif s.is_(i, "struct", "enum", "impl", "mod", "trait", "union") and s.named(i + 1):
                stop = self.until(i, "{", ";")
                i = (s.partner[stop] if s.is_(stop, "{") else stop) + 1
            elif s.is_(i, "if", "match", "while", "for", "loop", "unsafe", "{") or s.tokens[i][1] == "life":
                begin = i + 2 if s.tokens[i][1] == "life" else i
                if s.is_(begin, "{", "unsafe"):
                    body = self.until(begin, "{")
                    self.rust_block(body, depth)
                    i = s.partner[body] + 1
                else:
                    i = self.rust_construct(begin, depth)
                self.statements += 1
                if s.is_(i, ".", "?"):
                    stop = min(self.until(i, ";"), end)
                    self.expression(i, stop, depth)
                    i = stop + 1
                elif s.is_(i, ";"):
                    i += 1
            else:
                stop = min(self.until(i, ";"), end)
                self.expression(i, stop, depth)
                self.statements += s.is_(stop, ";") and stop < end
                i = stop + 1

    # JavaScript and TypeScript

    def script_block(self, open_: int, depth: int) -> None:
        i, end = open_ + 1, self.s.partner[open_]
        while i < end:
            i = max(self.statement(i, end, depth), i + 1)

    def _headed(self, i: int, depth: int) -> int:
        """Walks the brackets at i and gives what follows them."""
        if not self.s.is_(i, "("):
            return i
        self.expression(i + 1, self.s.partner[i], depth)
        return self.s.partner[i] + 1

    def statement(self, i: int, end: int, depth: int) -> int:
        s = self.s
        if i in self.inner and s.is_(i + s.is_(i, "async"), "function"):
            return self.inner[i] + 1
        if s.is_(i, "{"):
            self.script_block(i, depth)
            return s.partner[i] + 1
        self.statements += 1
        word = s.tokens[i][0] if s.tokens[i][1] == "id" else ""
        if word == "if":
            inner = self.branch(depth)
            i = self.statement(self._headed(i + 1, inner), end, inner)
            if s.is_(i, "else"):
                return self.statement(i + 1, end, depth if s.is_(i + 1, "if") else inner)
            return i
        if word in ("for", "while"):
            inner = self.branch(depth)
            i += 1 + s.is_(i + 1, "await")
            plain = s.is_(i, "(") and s.is_(i + 1, "let", "const", "var") and any(s.is_(k, ";") for k in range(i, s.partner[i]))
            self.statements += plain
            return self.statement(self._headed(i, inner), end, inner)
        if word == "do":
            i = self.statement(i + 1, end, depth)
            i = self._headed(i + 1, depth)
            return i + s.is_(i, ";")
        if word == "switch":
            return self.switch(i, depth)
        if word == "try":
            self.script_block(i + 1, depth)
            i = s.partner[i + 1] + 1
            if s.is_(i, "catch"):
                inner = self.branch(depth)
                i += 1
                i = s.partner[i] + 1 if s.is_(i, "(") else i
                self.script_block(i, inner)
                i = s.partner[i] + 1
            if s.is_(i, "finally"):
                self.script_block(i + 1, depth)
                i = s.partner[i + 1] + 1
            return i
        if word in ("interface", "enum", "namespace", "declare", "type", "abstract", "class") and s.named(i + 1):
            stop = self.until(i, "{", ";")
            if word == "type":
                stop = _end_of_expression(s, i)
                return stop + s.is_(stop, ";")
            if word == "class" and s.is_(stop, "{"):
                self.members(stop, depth)
            return (s.partner[stop] if s.is_(stop, "{") else stop) + 1
        if word in ("export",):
            return self.statement(i + 1 + s.is_(i + 1, "default"), end, depth)
        if word and s.is_(i + 1, ":") and word not in ("case", "default"):
            return self.statement(i + 2, end, depth)
        stop = i
        while stop < end and not s.is_(stop, ";"):
            nxt = self.inner[stop] + 1 if stop in self.inner else s.partner[stop] + 1 if s.is_(stop, *_OPEN) else stop + 1
            if nxt < end and (s.operand(nxt - 1) or s.is_(nxt - 1, "return", "break", "continue")) and s.line(nxt) > s.line(nxt - 1) and not _continues(s, nxt):
                stop = nxt
                break
            stop = nxt
        stop = min(stop, end)
        self.expression(i, stop, depth)
        return stop + (s.is_(stop, ";") and stop < end)

    def members(self, open_: int, depth: int) -> None:
        """Fields of a class count as definitions; its methods are functions of their own."""
        s, i, end = self.s, open_ + 1, self.s.partner[open_]
        while i < end:
            if i in self.inner:
                i = self.inner[i] + 1
            elif s.is_(i, ";"):
                i += 1
            else:
                stop = min(_end_of_expression(s, i), end)
                self.statements += 1
                self.expression(i, stop, depth)
                i = max(stop, i + 1)

    def switch(self, i: int, depth: int) -> int:
        s = self.s
        inner = self.branch(depth)
        body = self._headed(i + 1, inner)
        if not s.is_(body, "{"):
            return body
        k, end, at = body + 1, s.partner[body], inner
        while k < end:
            if s.is_(k, "case"):
                at = self.branch(inner)
                stop = self.until(k + 1, ":")
                self.expression(k + 1, stop, at)
                k = stop + 1
            elif s.is_(k, "default") and s.is_(k + 1, ":"):
                at, k = inner, k + 2
            else:
                k = max(self.statement(k, end, at), k + 1)
        return end + 1


def functions_of(path: str, text: str, shown: str | None = None) -> list[tuple]:
    """Rows as `structure.SCHEMA` has them, in order of place, or one that tells where the source can't be read."""
    rust, path, text = path.endswith(".rs"), shown or path, text or ""
    try:
        s = Source(text, rust)
    except Malformed as e:
        lines = [0, *(m.end() for m in re.finditer("\n", text))]
        line = bisect.bisect_right(lines, e.at)
        return [(path, *[None] * 9, str(e), line, e.at - lines[line - 1] + 1)]
    found = rust_functions(s) if rust else script_functions(s)
    inner = {f.first: f.last for f in found}
    out = []
    for f in found:
        m = Measure(s, f, {a: b for a, b in inner.items() if f.first < a and b <= f.last})
        (line, column), last = s.place(s.tokens[f.first][2]), s.line(f.last)
        out.append((path, f.name, line, column, last, last - line + 1, _segments(s, *f.params, True), 1 + m.branches, m.deepest, m.statements, None, None, None))
    return sorted(out, key=lambda r: (r[2], r[3], -r[4]))
