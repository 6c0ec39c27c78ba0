"""Tokens of languages with braces: what is a string, a comment, markup or a pattern is told from what is code.

One scanner serves all of them; a language says which of its parts it has.  Strings with code inside (templates,
interpolation) and markup with code inside are scanned by the same rules, one within another.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from typing import NamedTuple


class Token(NamedTuple):
    """kind: id, op, str (its contents), num, or tag (a markup element's name)."""

    kind: str
    value: str
    line: int


@dataclass(frozen=True)
class Language:
    """What a language has besides identifiers, numbers, // and /* */."""

    quotes: str = "\"'"
    triple: bool = False
    #: What opens code inside a string, what closes it, and the quotes in which it does.
    inner: tuple[str, str, str] = ("", "", "")
    template: bool = False
    markup: bool = False
    patterns: bool = False
    raw: str = ""
    hash_comments: bool = False
    nested_comments: bool = False
    within: tuple[str, str] = ("", "")
    names: str = r"[A-Za-z_$][\w$]*"


_JS = {"template": True, "patterns": True, "inner": ("${", "}", "`")}
LANGUAGES = {
    "ts": Language(**_JS),
    "tsx": Language(**_JS, markup=True),
    "cpp": Language(raw=r'(?:u8|[uUL])?R"([^\s()\\]{0,16})\(', names=r"~?[A-Za-z_]\w*"),
    "java": Language(triple=True),
    "csharp": Language(triple=True, raw=r'\$?@\$?"', names=r"@?[A-Za-z_]\w*"),
    "kotlin": Language(triple=True, inner=("${", "}", '"'), nested_comments=True),
    "swift": Language(quotes='"', triple=True, inner=("\\(", ")", '"'), nested_comments=True),
    "go": Language(quotes="\"'`"),
    "rust": Language(raw=r'b?r(#*)"', nested_comments=True),
    "php": Language(raw=r"<<<[ \t]*([\"']?)([A-Za-z_]\w*)\1\r?\n", inner=("{$", "}", '"'), hash_comments=True, within=("<?", "?>"), names=r"\$?[A-Za-z_]\w*"),
}
_OPS = re.compile(r"::|->|\?->|=>|\?\.|[^\s\w]")
_NUMBER = re.compile(r"\d[\w.]*")
_PATTERN = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Words after which an expression begins.
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new do else yield await instanceof default".split())
_CLOSING = frozenset(")]}")


@dataclass
class Scanner:
    text: str
    language: Language
    out: list[Token] = field(default_factory=list)

    def __post_init__(self):
        self.ends = [m.start() for m in re.finditer("\n", self.text)]
        self.names = re.compile(self.language.names)
        self.raw = re.compile(self.language.raw) if self.language.raw else None

    def add(self, kind: str, value: str, at: int) -> None:
        self.out.append(Token(kind, value, bisect_right(self.ends, at - 1) + 1))

    def value_next(self) -> bool:
        """Whether an expression may begin here, so that / opens a pattern and < an element."""
        if not self.out:
            return True
        kind, value, _ = self.out[-1]
        return kind == "op" and value not in _CLOSING or kind == "id" and value in _BEFORE_VALUE

    def scan(self) -> list[Token]:
        opening, closing = self.language.within
        if not opening:
            self.code(0, "")
            return self.out
        at = self.text.find(opening)
        while at >= 0:
            at += len(re.match(r"<\?(?:php|=)?", self.text[at : at + 5])[0])
            at = self.text.find(opening, self.code(at, closing))
        return self.out

    def code(self, i: int, until: str) -> int:
        """Tokens from i on; the place after `until` where it closes what was open, or the end."""
        t, lang, n, depth = self.text, self.language, len(self.text), 0
        pairs = {"}": "{", ")": "("}
        while i < n:
            c = t[i]
            if c.isspace():
                i += 1
                continue
            if until == "?>" and t.startswith("?>", i):
                return i + 2
            if t.startswith("//", i) or lang.hash_comments and c == "#" and not t.startswith("#[", i):
                end = t.find("\n", i)
                end = n if end < 0 else end
                stop = t.find("?>", i, end) if until == "?>" else -1
                i = end if stop < 0 else stop
                continue
            if t.startswith("/*", i):
                i = self.comment(i)
                continue
            if self.raw and (m := self.raw.match(t, i)):
                i = self.rest_of_raw(m)
                continue
            if lang.template and c == "`":
                i = self.string(i + 1, "`", i)
                continue
            if lang.triple and t.startswith('"""', i):
                i = self.string(i + 3, '"""', i)
                continue
            if c in lang.quotes:
                if c == "'" and lang in (LANGUAGES["rust"], LANGUAGES["cpp"]) and not re.match(r"'(\\[^']*|[^'\\])'", t[i : i + 12]):
                    i += 1  # a lifetime, or a separator of digits
                    continue
                i = self.string(i + 1, c, i)
                continue
            if lang.patterns and c == "/" and self.value_next() and (m := _PATTERN.match(t, i)):
                self.add("str", m[0], i)
                i = m.end()
                continue
            if lang.markup and c == "<" and self.value_next() and re.match(r"<[A-Za-z>]", t[i : i + 2]):
                i = self.element(i)
                continue
            if m := self.names.match(t, i):
                self.add("id", m[0], i)
                i = m.end()
                continue
            if m := _NUMBER.match(t, i):
                self.add("num", m[0], i)
                i = m.end()
                continue
            if until and c == until:
                if depth == 0:
                    return i + 1
                depth -= 1
            elif until and pairs.get(until) == c:
                depth += 1
            m = _OPS.match(t, i)
            if m:
                self.add("op", m[0], i)
            i = m.end() if m else i + 1
        return n

    def comment(self, i: int) -> int:
        t, depth = self.text, 0
        for m in re.compile(r"/\*|\*/").finditer(t, i):
            depth += 1 if m[0] == "/*" and (self.language.nested_comments or depth == 0) else -1 if m[0] == "*/" else 0
            if depth == 0:
                return m.end()
        return len(t)

    def rest_of_raw(self, m: re.Match) -> int:
        t = self.text
        if m[0].startswith("<<<"):
            end = re.compile(rf"^[ \t]*{m[2]}\b", re.M).search(t, m.end())
            self.add("str", t[m.end() : end.start() if end else len(t)], m.start())
            return end.end() if end else len(t)
        if m[0].endswith('@"') or m[0].endswith('$"'):  # a doubled quote stands for one
            end = re.compile(r'"(?!")').search(re.sub(r'""', "\0\0", t), m.end())
            self.add("str", t[m.end() : end.start() if end else len(t)], m.start())
            return end.end() if end else len(t)
        closing = f"){m[1]}\"" if m[0].endswith("(") else f'"{m[1]}'
        end = t.find(closing, m.end())
        end = len(t) if end < 0 else end
        self.add("str", t[m.end() : end], m.start())
        return min(len(t), end + len(closing))

    def string(self, i: int, quote: str, start: int) -> int:
        """The rest of a string from i on; code inside it is scanned in its turn, after the string's own token."""
        t, (opening, closing, where) = self.text, self.language.inner
        inside = opening if quote[0] in where else ""
        single = quote in "\"'" and self.language not in (LANGUAGES["php"],)
        stops = re.compile("|".join([re.escape(inside), r"\\."] if inside == "\\(" else [r"\\.", re.escape(inside)] if inside else [r"\\."]) + "|" + re.escape(quote) + ("|\n" if single else ""), re.S)
        at, said, codes = i, [], []
        while True:
            m = stops.search(t, at)
            if not m:
                said.append(t[at:])
                at = len(t)
                break
            said.append(t[at : m.start()])
            at = m.end()
            if m[0] in (quote, "\n"):
                break
            if inside and m[0] == inside:
                own, self.out = self.out, []
                at = self.code(m.end() - (1 if inside == "{$" else 0), closing)
                codes, self.out = codes + self.out, own
                said.append(inside + closing)
            else:
                said.append(m[0])
        self.add("str", "".join(said), start)
        self.out += codes
        return at

    def element(self, i: int) -> int:
        """A markup element from its < on: attributes, children, and the code in braces."""
        t, n = self.text, len(self.text)
        m = re.compile(r"<([\w.:-]*)").match(t, i)
        if m[1]:
            self.add("tag", m[1], i)
        i = m.end()
        while i < n and t[i] != ">":  # attributes
            if t.startswith("/>", i):
                return i + 2
            if t[i] in "\"'":
                end = t.find(t[i], i + 1)
                i = n if end < 0 else end + 1
            elif t[i] == "{":
                i = self.braced(i)
            else:
                i += 1
        i += 1
        while i < n:  # children
            m = re.compile(r"[<{]").search(t, i)
            if not m:
                return n
            i = m.start()
            if t.startswith("</", i):
                end = t.find(">", i)
                return n if end < 0 else end + 1
            if t[i] == "{":
                i = self.braced(i)
            elif re.match(r"<[A-Za-z>]", t[i : i + 2]):
                i = self.element(i)
            else:
                i += 1
        return n

    def braced(self, i: int) -> int:
        self.add("op", "(", i)  # an expression begins
        i = self.code(i + 1, "}")
        self.add("op", ")", i)
        return i


def tokens(text: str, language: str) -> list[Token]:
    """The tokens of a text; what is nested beyond Python's depth is cut there."""
    s = Scanner(text, LANGUAGES[language])
    try:
        return s.scan()
    except RecursionError:
        return s.out
