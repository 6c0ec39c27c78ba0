"""Two-pass code extraction, first pass: what a file alone says, as rows (see operators.resolution).

Python is read by its own parser; languages with braces by the tokens of sources.lexer and a stack of open scopes.
"""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexer import Token, tokens

SCHEMA = "fact string, scope string, outer string, klass string, name string, kind string, receiver string, target string, candidates array<string>, arity int, line int"
_TYPES = [*[pa.string()] * 8, pa.list_(pa.string()), pa.int32(), pa.int32()]
Row = tuple


def row(fact: str, line: int, scope: str = "", outer: str = "file", klass: str = "", name: str = "", kind: str = "", receiver: str = "", target: str = "", candidates: list | None = None, arity: int | None = None) -> Row:
    return fact, scope, outer, klass, name, kind, receiver, target, candidates or [], arity, line


# ---- Python ---------------------------------------------------------------------------------------------------


def _module_files(path: str, module: str, level: int) -> list[str]:
    base = posixpath.dirname(path)
    for _ in range(level - 1):
        base = posixpath.dirname(base)
    inner = module.replace(".", "/")
    roots = [base] if level else ["", *([posixpath.dirname(path)] if posixpath.dirname(path) else [])]
    out = []
    for r in roots:
        at = posixpath.join(r, inner) if inner else r
        out += [f"{at}.py", f"{at}/__init__.py"] if inner else [posixpath.join(at, "__init__.py")]
    return out


def python(path: str, text: str) -> Iterator[Row]:
    """Facts of a Python file; one that does not parse has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    stack: list[tuple[ast.AST, tuple, str, str]] = [(tree, (), "file", "")]
    while stack:
        at, scope, outer, klass = stack.pop()
        here = {"scope": "::".join(scope), "outer": outer, "klass": klass}
        for x in ast.iter_child_nodes(at):
            line, inner = getattr(x, "lineno", 1), (x, scope, outer, klass)
            if isinstance(x, ast.Import):
                for a in x.names:
                    files = _module_files(path, a.name, 0)
                    yield row("imports", line, name=a.asname or a.name, kind="path", receiver=a.name, candidates=files)
            elif isinstance(x, ast.ImportFrom):
                for a in x.names:
                    said = "." * x.level + (x.module or "")
                    yield row("imports", line, name=a.asname or a.name, kind="path", receiver=said, target=a.name, candidates=_module_files(path, x.module or "", x.level))
                    if a.name != "*":  # the name may be a module of the package
                        yield row("imports", line, name=a.asname or a.name, kind="path", receiver=said, candidates=_module_files(path, ".".join(filter(None, [x.module, a.name])), x.level))
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield row("declares", line, name=x.name, kind="function", arity=len(x.args.args) + len(x.args.posonlyargs), **here)
                inner = (x, (*scope, x.name), "function", klass)
            elif isinstance(x, ast.ClassDef):
                yield row("declares", line, name=x.name, kind="class", **here)
                own = "::".join((*scope, x.name))
                for b in x.bases:
                    parts = ast.unparse(b).rpartition(".") if isinstance(b, (ast.Name, ast.Attribute)) else ("", "", "")
                    if parts[2]:
                        yield row("inherits", line, scope=own, receiver=parts[0], name=parts[2])
                inner = (x, (*scope, x.name), "class", own)
            elif isinstance(x, ast.Call) and isinstance(x.func, (ast.Name, ast.Attribute)):
                f = x.func
                if isinstance(f, ast.Name):
                    yield row("calls", line, name=f.id, **here)
                else:
                    v = f.value
                    of = "super" if isinstance(v, ast.Call) and isinstance(v.func, ast.Name) and v.func.id == "super" else ast.unparse(v) if isinstance(v, (ast.Name, ast.Attribute)) else "?"
                    yield row("calls", line, name=f.attr, receiver=of, **here)
            stack.append(inner)


# ---- languages with braces ------------------------------------------------------------------------------------

# Words that open a type, a space of names, a further part of a type, and a function; words that no call starts with.
TYPES = {
    "ts": ("class", "interface", "enum"), "cpp": ("class", "struct", "union"), "java": ("class", "interface", "enum", "record"), "csharp": ("class", "interface", "struct", "record", "enum"),
    "kotlin": ("class", "interface", "object"), "swift": ("class", "struct", "enum", "protocol", "actor"), "go": (), "rust": ("struct", "enum", "trait"), "php": ("class", "interface", "trait", "enum"),
}
SPACES = ("namespace", "module", "mod")
PARTS = {"swift": ("extension",), "rust": ("impl",)}
FUNCTIONS = {"ts": ("function",), "kotlin": ("fun",), "swift": ("func",), "go": ("func",), "rust": ("fn",), "php": ("function",)}
NO_CALLS = frozenset("if for while switch catch return sizeof else do new delete throw match guard foreach elseif using lock fixed typeof decltype alignof static_assert function fun func fn array list isset unset empty include require include_once require_once import when select super this await".split())
#: Words before a name that leave it a call; any other makes it the name of a variable with its type.
_CALL_AFTER = frozenset("return else do case throw await yield new in of and or not co_return co_await goto".split())
HEIRS = ("extends", "implements", ":")

# Functions of a PHP content system whose first string (or the one of the given place) names something: relation and kind.
NAMED = {
    "add_action": ("listens_to", "hook", 0), "add_filter": ("listens_to", "hook", 0),
    "do_action": ("fires", "hook", 0), "do_action_ref_array": ("fires", "hook", 0), "apply_filters": ("fires", "hook", 0), "apply_filters_ref_array": ("fires", "hook", 0),
    "get_option": ("reads_option", "option", 0), "get_site_option": ("reads_option", "option", 0),
    "update_option": ("writes_option", "option", 0), "add_option": ("writes_option", "option", 0), "delete_option": ("writes_option", "option", 0), "update_site_option": ("writes_option", "option", 0),
    "current_user_can": ("secured_by", "capability", 0), "user_can": ("secured_by", "capability", 1), "author_can": ("secured_by", "capability", 1),
    "add_shortcode": ("listens_to", "shortcode", 0),
    "wp_schedule_event": ("scheduled_by", "scheduled_job", 2), "wp_schedule_single_event": ("scheduled_by", "scheduled_job", 1),
}
ROUTES = ("get", "post", "put", "delete", "patch", "all")
EMITS, LISTENS = ("emit", "publish", "dispatch"), ("on", "subscribe", "listen")


def _after(t: list[Token], i: int) -> int:
    """The place after the bracket that closes the one at i."""
    depth, pairs = 0, {"(": ")", "[": "]", "{": "}"}
    opening, closing = t[i].value, pairs[t[i].value]
    for k in range(i, len(t)):
        if t[k].kind == "op":
            depth += (t[k].value == opening) - (t[k].value == closing)
            if depth == 0:
                return k + 1
    return len(t)


def _arguments(t: list[Token], i: int, end: int) -> list[list[Token]]:
    """The tokens of each argument between the brackets at i and end - 1."""
    out, depth = [[]], 0
    for x in t[i + 1 : end - 1]:
        if x.kind == "op":
            depth += (x.value in "([{<") - (x.value in ")]}>")
            if x.value == "," and depth <= 0:
                out.append([])
                continue
        out[-1].append(x)
    return out if out[-1] or len(out) > 1 else []


def _script_files(path: str, module: str) -> list[str]:
    if not module.startswith("."):
        return []
    at = posixpath.normpath(posixpath.join(posixpath.dirname(path), module))
    stem = re.sub(r"\.(js|mjs|cjs|jsx)$", "", at)
    return [at, *(f"{s}{e}" for s in dict.fromkeys((at, stem)) for e in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"))]


class Braces:
    """One walk over a file's tokens with the stack of open scopes."""

    def __init__(self, path: str, text: str, language: str):
        self.path, self.lang = path, "ts" if language == "tsx" else language
        self.t = tokens(text, language)
        self.stack: list[tuple[str, str, int, int | None]] = []  # name, kind, depth of its brace, parameters
        self.arity: int | None = None  # of what is coming
        self.depth = self.paren = 0
        self.coming: tuple[str, str, int] | None = None  # name, kind, open brackets at its head
        self.out: list[Row] = []
        self.skip: set[int] = set()  # names that are declared, not called

    def here(self) -> dict:
        named = [s for s in self.stack if s[0]]
        types = [k for k, s in enumerate(named) if s[1] == "class"]
        return {"scope": "::".join(s[0] for s in named), "outer": named[-1][1] if named else "file", "klass": "::".join(s[0] for s in named[: types[-1] + 1]) if types else ""}

    def value(self, k: int) -> str:
        return self.t[k].value if 0 <= k < len(self.t) and self.t[k].kind in ("op", "id") else ""

    def declare(self, k: int, name: str, kind: str, arity: int | None = None, body: bool = True) -> None:
        parts = name.split("::")
        h = self.here()
        scope = "::".join(filter(None, [h["scope"], *parts[:-1]]))
        self.out.append(row("declares", self.t[k].line, scope=scope, outer="class" if len(parts) > 1 else h["outer"], klass=h["klass"], name=parts[-1], kind=kind, arity=arity))
        if body:
            self.coming, self.arity = (name, kind, self.paren), arity

    def walk(self) -> list[Row]:
        t, k = self.t, 0
        while k < len(t):
            x = t[k]
            if x.kind == "op":
                self.punctuation(x.value)
            elif x.kind == "id":
                k = self.word(k)
            k += 1
        return self.out

    def punctuation(self, v: str) -> None:
        if v == "{":
            self.depth += 1
            if self.coming and self.coming[2] == self.paren:
                self.stack.append((*self.coming[:2], self.depth, self.arity))
                self.coming = None
        elif v == "}":
            if self.stack and self.stack[-1][2] == self.depth:
                self.stack.pop()
            self.depth = max(0, self.depth - 1)
        elif v in "([":
            self.paren += 1
        elif v in ")]":
            self.paren = max(0, self.paren - 1)
        elif v == ";" and self.coming and self.coming[2] == self.paren:
            self.coming = None

    def word(self, k: int) -> int:
        """Handles the word at k; the last place that it has used up."""
        t, v, lang, before = self.t, self.t[k].value, self.lang, self.value(k - 1)
        member = before in (".", "->", "?.", "?->")
        if not member:
            if v in ("import", "use", "using", "from", "require", "require_once", "include", "include_once", "export"):
                self.imported(k)
            if v in TYPES[lang] and not (v == "class" and before == "enum"):
                return self.type(k)
            if v in SPACES and lang in ("cpp", "ts", "csharp", "rust", "php") and k + 1 < len(t) and t[k + 1].kind == "id":
                self.coming = (t[k + 1].value, "space", self.paren)
                return k + 1
            if v in PARTS.get(lang, ()):
                return self.part(k)
            if v in FUNCTIONS.get(lang, ()):
                return self.function(k)
            if lang == "go" and v == "type" and k + 2 < len(t) and t[k + 2].value in ("struct", "interface"):
                self.declare(k, t[k + 1].value, "class")
                return k + 2
            if lang == "ts" and v in ("const", "let", "var") and k + 2 < len(t) and t[k + 1].kind == "id":
                self.arrow(k + 1)
        if lang == "php" and v == "$wpdb":
            self.table(k)
        if self.value(k + 1) == "(" and (member or v not in NO_CALLS) and k not in self.skip:
            typed = lang in ("cpp", "java", "csharp")
            end = self.method(k) if (typed or lang == "ts") and not member else None
            if end is not None:
                return end - 1
            if not (typed and k and self.t[k - 1].kind == "id" and self.t[k - 1].value not in _CALL_AFTER):
                self.call(k)
        return k

    def type(self, k: int) -> int:
        t, j = self.t, k + 1
        if j < len(t) and t[j].value in ("class", "struct"):
            j += 1
        name, end = None, j
        while end < len(t) and t[end].kind == "id" and t[end].value not in ("extends", "implements", "final", "permits", "where"):
            name, end = t[end].value, end + 1
        stop = end
        while stop < len(t) and t[stop].value not in ("{", ";", "}") and not (t[stop].value in ")=" and t[stop].kind == "op" and self.lang == "cpp"):
            if t[stop].value == "(":
                stop = _after(t, stop)
                continue
            if self.lang in ("kotlin", "rust") and t[stop].line > t[end - 1].line and t[stop].kind == "id":
                break
            stop += 1
        opens = stop < len(t) and t[stop].value == "{"
        if name is None or not opens and self.lang in ("cpp", "ts", "java", "csharp", "swift", "php") or end < len(t) and t[end].value in (">", ",", "."):
            return k
        own = "::".join(filter(None, [self.here()["scope"], name]))
        self.declare(k, name, "class", body=opens)
        heirs, depth = False, 0
        for x, y in zip(t[end:stop], [*t[end + 1 : stop], Token("op", "", 0)], strict=False):
            depth += (x.value in ("<", "(")) - (x.value in (">", ")"))
            heirs = heirs or x.value in HEIRS and depth == 0
            if heirs and depth == 0 and x.kind == "id" and x.value not in (*HEIRS, "public", "private", "protected", "virtual", "final", "with", "by", "where") and y.value not in ("::", ".", "\\"):
                self.out.append(row("inherits", x.line, scope=own, name=x.value))
        return stop - 1

    def part(self, k: int) -> int:
        """A further part of a type: its functions belong to the type named last before the brace."""
        t, j, name, depth = self.t, k + 1, None, 0
        while j < len(t) and t[j].value not in ("{", ";"):
            depth += (t[j].value == "<") - (t[j].value == ">")
            if t[j].kind == "id" and depth == 0:
                if t[j].value == "where" or self.lang == "swift" and name:
                    break
                name = t[j].value if t[j].value != "for" else None
            j += 1
        if name:
            self.coming = (name, "class", self.paren)
        return k

    def function(self, k: int) -> int:
        t, j, owner = self.t, k + 1, ""
        if self.lang == "go" and self.value(j) == "(":  # the receiver's type
            end = _after(t, j)
            owner, j = next((x.value for x in reversed(t[j:end]) if x.kind == "id"), ""), end
        while j < len(t) and t[j].value in ("*", "&"):
            j += 1
        if self.lang == "kotlin":
            if self.value(j) == "<":
                while j < len(t) and t[j].value != ">":
                    j += 1
                j += 1
            while j + 2 < len(t) and t[j + 1].value == "." and t[j + 2].kind == "id":  # an extension of a type
                owner, j = t[j].value, j + 2
        if j >= len(t) or t[j].kind != "id":
            self.coming = ("", "function", self.paren) if self.lang in ("ts", "php") else None
            return k
        name, at = t[j].value, j + 1
        while at < len(t) and t[at].value not in ("(", "{", ";"):
            at += 1
        arity = len(_arguments(t, at, _after(t, at))) if self.value(at) == "(" else None
        self.declare(j, f"{owner}::{name}" if owner else name, "function", arity)
        self.skip.add(j)
        return j

    def arrow(self, k: int) -> None:
        t, j = self.t, k + 1
        while j < len(t) and t[j].value not in ("=", ";", ",", ")") and t[j].line == t[k].line:
            j = _after(t, j) if t[j].value in ("(", "{", "[") else j + 1
        if self.value(j) != "=":
            return
        j += 2 if self.value(j + 1) == "async" else 1
        at = _after(t, j) if self.value(j) == "(" else j + 1
        arity = len(_arguments(t, j, at)) if self.value(j) == "(" else 1
        while at < len(t) and at < j + 400 and t[at].value not in ("=>", ";", "{") and (self.value(j) == "(" and self.value(_after(t, j)) == ":"):
            at += 1
        if self.value(at) == "=>" or self.value(j) == "function":
            self.declare(k, t[k].value, "function", arity, body=self.value(j) != "function" and self.value(at + 1) == "{")

    def method(self, k: int) -> int | None:
        """Where the head ends whose name, with a bracket after it, stands at k, if it is declared here: C++, Java, C# and members of script classes."""
        t, h = self.t, self.here()
        if h["outer"] == "function" or any(s[1] == "function" for s in self.stack) or self.paren:
            return None
        if self.lang != "cpp" and h["outer"] != "class":
            return None
        name, first = t[k].value, k
        while first >= 2 and t[first - 1].value == "::" and t[first - 2].kind == "id":
            first -= 2
            name = f"{t[first].value}::{name}"
        end = _after(t, k + 1)
        typed = first > 0 and (t[first - 1].kind == "id" and t[first - 1].value not in ("return", "else", "new", "throw") or t[first - 1].value in ("*", "&", ">", "]"))
        inside = h["outer"] == "class"
        j = end
        while j < len(t) and t[j].value not in ("{", ";", "}") and not (t[j].value == "=" and self.lang != "cpp"):
            if t[j].value in ("(", "["):
                j = _after(t, j)
            elif t[j].value == ":" and self.lang == "cpp":  # initial values of members
                while j < len(t) and t[j].value not in ("(", "{"):
                    j += 1
                j = _after(t, j) if j < len(t) else j
                while self.value(j) == ",":
                    while j < len(t) and t[j].value not in ("(", "{"):
                        j += 1
                    j = _after(t, j) if j < len(t) else j
            else:
                j += 1
        body = self.value(j) == "{"
        if not (body and (typed or inside or "::" in name) or self.value(j) == ";" and (typed and (inside or self.lang == "cpp") or inside and self.lang == "cpp")):
            return None
        inner = _arguments(t, k + 1, end)
        if self.lang == "cpp" and not body and inner and any(len(a) == 1 and a[0].kind in ("num", "str") for a in inner):
            return None  # a variable with an initial value
        arity = 0 if len(inner) == 1 and len(inner[0]) == 1 and inner[0][0].value == "void" else len(inner)
        self.declare(k, name, "function", arity, body=body)
        return j

    def call(self, k: int) -> None:
        t, name, before = self.t, self.t[k].value, self.value(k - 1)
        if before == "new" or before == "@" or before == "#":
            return
        receiver = ""
        if before in (".", "->", "?.", "?->", "::"):
            receiver = t[k - 2].value if k >= 2 and t[k - 2].kind == "id" else "?"
        arity = next((s[3] for s in reversed(self.stack) if s[1] == "function"), None)
        self.out.append(row("calls", t[k].line, name=name, receiver=receiver, arity=arity, **self.here()))
        said = [a[0].value if len(a) == 1 and a[0].kind == "str" else None for a in _arguments(t, k + 1, _after(t, k + 1))]
        first = said[0] if said else None
        if self.lang == "php" and name in NAMED and len(said) > NAMED[name][2] and said[NAMED[name][2]]:
            relation, kind, at = NAMED[name]
            self.register(t[k].line, relation, kind, said[at])
        elif self.lang == "php" and name == "register_rest_route" and len(said) > 1 and said[0] and said[1]:
            self.register(t[k].line, "serves_route", "endpoint", f"/{said[0].strip('/')}/{said[1].strip('/')}")
        elif self.lang == "ts" and first and receiver:
            if name in ROUTES and first.startswith("/"):
                self.register(t[k].line, "serves_route", "endpoint", f"{'ANY' if name == 'all' else name.upper()} {first}")
            elif name in EMITS or name in LISTENS:
                self.register(t[k].line, "emits" if name in EMITS else "listens_on", "event_channel", first)
        elif self.lang == "ts" and first and name == "fetch":
            self.register(t[k].line, "http_calls", "http_call", first)

    def register(self, line: int, relation: str, kind: str, name: str) -> None:
        self.out.append(row("registers", line, name=name, kind=kind, target=relation, **self.here()))

    def table(self, k: int) -> None:
        """$wpdb->prefix . 'name' and $wpdb->name: a logical table."""
        t = self.t
        if self.value(k + 1) != "->" or k + 2 >= len(t):
            return
        name = t[k + 2].value
        if name == "prefix":
            following = next((x.value for x in t[k + 3 : k + 5] if x.kind == "str"), "")
            name = m[0] if (m := re.match(r"\w+", following)) else ""
        elif self.value(k + 3) == "(" or name in ("last_error", "insert_id", "num_rows", "base_prefix", "charset"):
            return
        if name:
            self.register(t[k].line, "references_table", "wp_table", name)

    def imported(self, k: int) -> None:
        t, v, lang = self.t, self.t[k].value, self.lang
        line = t[k].line
        if lang == "cpp":
            return
        if lang == "ts":
            if v == "require" and k + 2 < len(t) and t[k + 2].kind == "str":
                name = t[k - 2].value if self.value(k - 1) == "=" else ""
                self.out.append(row("imports", line, name=name, kind="path", receiver=t[k + 2].value, candidates=_script_files(self.path, t[k + 2].value)))
                return
            if v not in ("import", "export"):
                return
            end = k + 1
            while end < min(len(t), k + 400) and t[end].kind != "str" and t[end].value not in (";", "(", "=") and not (v == "export" and t[end].value in ("function", "class", "const", "let", "default", "async", "interface", "type", "enum", "abstract")):
                end += 1
            if end >= len(t) or t[end].kind != "str":
                return
            module = t[end].value
            files, said = _script_files(self.path, module), t[k + 1 : end]
            word = lambda i: said[i].value if 0 <= i < len(said) else ""
            for i, x in enumerate(said):
                if x.kind != "id" or x.value in ("from", "as", "type") or word(i - 1) == "as":
                    if x.value == "default" or x.kind == "id":
                        continue
                    if x.value == "*":
                        whole = word(i + 1) == "as"
                        self.out.append(row("imports", line, name=word(i + 2) if whole else "*", kind="path", receiver=module, target="" if whole else "*", candidates=files))
                    continue
                alias = word(i + 2) if word(i + 1) == "as" else x.value
                self.out.append(row("imports", line, name=alias, kind="path", receiver=module, target=x.value, candidates=files))
            return
        if lang == "php" and v != "use":
            at = next((x for x in t[k + 1 : k + 8] if x.kind == "str"), None)
            if at:
                self.out.append(row("imports", line, name=at.value, kind="suffix", receiver=at.value, candidates=[at.value.lstrip("./")]))
            return
        if v in ("import", "use", "using") and not any(s[1] == "function" for s in self.stack):
            said = []
            for x in t[k + 1 : k + 40]:
                if x.value in (";", "{", "(", "as") or x.line > line or x.kind not in ("id", "op"):
                    break
                said.append(x.value)
            name = "".join(said).removeprefix("static")
            if name:
                self.out.append(row("imports", line, name=re.split(r"[.:\\]", name)[-1], kind="external", receiver=name))


_INCLUDE = re.compile(r'^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]', re.M)
_DIRECTIVE = re.compile(r"^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", re.M | re.S)


def braces(language: str):
    """A reader of files in one language with braces."""

    def run(path: str, text: str) -> Iterator[Row]:
        if language == "cpp":
            for m in _INCLUDE.finditer(text):
                if not m[1].endswith(".generated.h"):
                    yield row("imports", text.count("\n", 0, m.start()) + 1, name=m[1], kind="suffix", receiver=m[1], candidates=[m[1]])
            text = _DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        elif language == "go":
            for block in re.finditer(r"^import\s*(?:\(([^)]*)\)|([^\n]*))", text, re.M):
                for m in re.finditer(r'(?:(\w+)\s+)?"([^"\n]+)"', block[1] or block[2] or ""):
                    yield row("imports", text.count("\n", 0, block.start()) + 1, name=m[1] or m[2].rpartition("/")[2], kind="external", receiver=m[2])
        kind = "tsx" if language == "ts" and re.search(r"\.[jt]sx$|\.js$", path) else language
        yield from Braces(path, text, kind).walk()

    return run


#: Which reader reads which file names.
READERS = {
    "python": (r"\.py$", python),
    "ts": (r"\.(ts|tsx|js|jsx|mjs|cjs)$", braces("ts")),
    "cpp": (r"\.(c|cc|cpp|cxx|h|hpp)$", braces("cpp")),
    "kotlin": (r"\.kts?$", braces("kotlin")),
    "swift": (r"\.swift$", braces("swift")),
    "php": (r"\.php$", braces("php")),
    "go": (r"\.go$", braces("go")),
    "rust": (r"\.rs$", braces("rust")),
    "java": (r"\.java$", braces("java")),
    "csharp": (r"(?<!\.Build)\.cs$", braces("csharp")),
}


def facts(files: DataFrame, language: str) -> DataFrame:
    """Facts of files(repo, path, text) in one language; null texts and other files have none."""
    pattern, read = READERS[language]

    def run(batches):
        for b in batches:
            found = [(repo, path, *x) for repo, path, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in read(path, text)]
            columns = list(zip(*found, strict=True)) or [[]] * (2 + len(_TYPES))
            names = ["repo", "path", *(x.split()[0] for x in SCHEMA.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), *_TYPES], strict=True)], names)

    own = files.where(F.col("path").rlike(pattern) & F.col("text").isNotNull()).select("repo", "path", "text")
    return own.mapInArrow(run, f"repo string, path string, {SCHEMA}")
