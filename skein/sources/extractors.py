"""Code extractors: files in, graph nodes and edges out.

An extractor is a Python function of one file; extract() spreads it over files in Arrow batches.  Python files are read with the
standard library's parser, shell, package and crontab files by patterns.  Languages whose reading needs a grammar
library that is not installed are not covered (see the README).
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Found = list[tuple[str, str, str, str, str, int]]
#: Methods that register a route, send and receive an event.
ROUTES = ("get", "post", "put", "delete", "patch", "route")
EMITS, LISTENS = ("emit", "publish", "dispatch"), ("on", "subscribe", "listen")


def node(kind: str, name: str, line: int) -> tuple:
    return "node", kind, name, "", "", line


def edge(name: str, relation: str, kind: str, target: str, line: int) -> tuple:
    return "edge", kind, name, relation, target, line


def python(path: str, text: str) -> Found:
    """file, function, class, endpoint, event_channel; imports, defines, calls, inherits, serves_route, emits, listens_on."""
    out = [node("file", path, 1)]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out
    stack: list[tuple[ast.AST, str]] = [(tree, path)]
    while stack:
        at, owner = stack.pop()
        for x in ast.iter_child_nodes(at):
            inner = owner
            line = getattr(x, "lineno", 1)
            if isinstance(x, ast.Import):
                out += [edge(path, "imports", "module", a.name, line) for a in x.names]
            elif isinstance(x, ast.ImportFrom):
                out.append(edge(path, "imports", "module", "." * x.level + (x.module or ""), line))
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(x, ast.ClassDef) else "function"
                inner = f"{owner}::{x.name}"
                out += [node(kind, inner, line), edge(owner, "defines", kind, inner, line)]
                if kind == "class":
                    out += [edge(inner, "inherits", "class", ast.unparse(b), line) for b in x.bases]
                for d in x.decorator_list:
                    if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ROUTES and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                        name = f"{'ANY' if d.func.attr == 'route' else d.func.attr.upper()} {d.args[0].value}"
                        out += [node("endpoint", name, line), edge(path, "serves_route", "endpoint", name, line)]
            elif isinstance(x, ast.Call):
                name = ast.unparse(x.func) if isinstance(x.func, (ast.Name, ast.Attribute)) else ""
                if name:
                    out.append(edge(owner, "calls", "function", name, line))
                last = name.rpartition(".")[2]
                if "." in name and last in EMITS + LISTENS and x.args and isinstance(x.args[0], ast.Constant) and isinstance(x.args[0].value, str):
                    out += [node("event_channel", x.args[0].value, line), edge(owner, "emits" if last in EMITS else "listens_on", "event_channel", x.args[0].value, line)]
            stack.append((x, inner))
    return out


def shell(path: str, text: str) -> Found:
    """script, command, env_var; invokes, reads_env."""
    out = [node("script", path, 1)]
    seen = set()
    for k, line in enumerate(text.split("\n"), 1):
        code = re.sub(r"(^|\s)#.*", "", line)
        for m in re.finditer(r"(?:^|[;&|]\s*|\$\()\s*(?:exec\s+|sudo\s+)?(\./[\w./-]+|[a-z][\w-]*)(?=\s|$|\))", code):
            if m[1] not in ("if", "then", "else", "elif", "fi", "for", "do", "done", "while", "case", "esac", "in", "function", "local", "export", "return", "echo", "set", "cd", "exit", "shift", "read", "test", "true", "false") and ("c", m[1]) not in seen:
                seen.add(("c", m[1]))
                out += [node("command", m[1], k), edge(path, "invokes", "command", m[1], k)]
        for m in re.finditer(r"\$\{?([A-Z][A-Z0-9_]+)", code):
            if ("e", m[1]) not in seen:
                seen.add(("e", m[1]))
                out += [node("env_var", m[1], k), edge(path, "reads_env", "env_var", m[1], k)]
    return out


def package(path: str, text: str) -> Found:
    """package_script and what it invokes."""
    try:
        scripts = json.loads(text).get("scripts") or {}
    except (ValueError, AttributeError):
        return []
    out = []
    for name, command in scripts.items() if isinstance(scripts, dict) else ():
        out.append(node("package_script", f"{path}#{name}", 1))
        first = str(command).split()[:1]
        out += [edge(f"{path}#{name}", "invokes", "command", first[0], 1)] if first else []
        out += [edge(f"{path}#{name}", "invokes", "package_script", f"{path}#{m}", 1) for m in re.findall(r"(?:npm|yarn|pnpm) run ([\w:-]+)", str(command))]
    return out


def crontab(path: str, text: str) -> Found:
    """scheduled_job and the command scheduled by it."""
    out = []
    for k, line in enumerate(text.split("\n"), 1):
        m = re.match(r"^\s*((?:\S+\s+){5})(\S.*)$", line)
        if m and not line.lstrip().startswith("#") and re.fullmatch(r"[\d*/,\-\s]+", m[1]):
            name = f"{path}:{k}"
            out += [node("scheduled_job", name, k), edge(m[2].split()[0], "scheduled_by", "scheduled_job", name, k)]
    return out


#: Which extractor reads which file names.
EXTRACTORS: dict[str, tuple[str, Callable[[str, str], Found]]] = {"python": (r"\.py$", python), "shell": (r"\.(sh|bash)$", shell), "glue": (r"(^|/)package\.json$", package), "cron": (r"(^|/)crontab$|\.cron$", crontab)}


def extract(files: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (kind, qualified_name, file_path, line, extracted_by) and edges (from_name, relation, to_kind, to_name, line) of files(path, text)."""
    pattern, f = EXTRACTORS[name]

    def run(batches):
        for b in batches:
            rows = [(p, *x) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in f(p, t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string()] * 6 + [pa.int32()])], ["path", "what", "kind", "name", "relation", "target", "line"])

    found = files.where(F.col("path").rlike(pattern)).select("path", "text").mapInArrow(run, "path string, what string, kind string, name string, relation string, target string, line int")
    nodes = found.where("what = 'node'").select("kind", F.col("name").alias("qualified_name"), F.col("path").alias("file_path"), "line", F.lit(name).alias("extracted_by"))
    edges = found.where("what = 'edge'").select(F.col("name").alias("from_name"), "relation", F.col("kind").alias("to_kind"), F.col("target").alias("to_name"), "line")
    return nodes, edges


#: What opens a definition or an import in each language, one pattern for each kind; the name is the first group.
PATTERNS: dict[str, tuple[str, dict[str, str]]] = {
    "script": (r"\.(ts|tsx|js|jsx|mjs|cjs)$", {"function": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)|^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", "class": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "imports": r"^\s*import\s.*?from\s+['\"]([^'\"]+)|require\(\s*['\"]([^'\"]+)", "inherits": r"class\s+\w+\s+extends\s+([\w.]+)", "exports": r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|interface|type|enum)\s+(\w+)", "serves_route": r"\b\w+\.(?:get|post|put|delete|patch)\(\s*['\"](/[^'\"]*)", "emits": r"\.emit\(\s*['\"]([^'\"]+)", "listens_on": r"\.on\(\s*['\"]([^'\"]+)"}),
    "cpp": (r"\.(c|cc|cpp|cxx|h|hpp)$", {"function": r"^[\w:<>,&*~\s]+?[\s&*]([\w:~]+)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{", "class": r"^\s*(?:class|struct)\s+(?:[A-Z_]+\s+)?(\w+)[^;(]*\{", "imports": r"^\s*#\s*include\s*[<\"]([^>\"]+)", "inherits": r"^\s*(?:class|struct)\s+.*?:\s*(?:public|protected|private)\s+([\w:]+)"}),
    "kotlin": (r"\.kts?$", {"function": r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(\w+)\s*\(", "class": r"^\s*(?:\w+\s+)*(?:class|interface|object)\s+(\w+)", "imports": r"^\s*import\s+([\w.*]+)", "inherits": r"\bclass\s+\w+[^:{]*:\s*(\w+)", "depends_on": r"implementation\(project\(\"([^\"]+)"}),
    "swift": (r"\.swift$", {"function": r"^\s*(?:\w+\s+)*func\s+(\w+)", "class": r"^\s*(?:\w+\s+)*(?:class|struct|enum|protocol|actor)\s+(\w+)", "imports": r"^\s*import\s+(\w+)", "inherits": r"\b(?:class|struct)\s+\w+\s*:\s*(\w+)"}),
    "php": (r"\.php$", {"function": r"^\s*(?:\w+\s+)*function\s+&?(\w+)\s*\(", "class": r"^\s*(?:abstract\s+|final\s+)*(?:class|interface|trait)\s+(\w+)", "imports": r"^\s*(?:use\s+([\w\\]+)|(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+))", "inherits": r"\bclass\s+\w+\s+extends\s+([\w\\]+)", "emits": r"\bdo_action\(\s*['\"]([^'\"]+)", "listens_on": r"\badd_(?:action|filter)\(\s*['\"]([^'\"]+)"}),
    "go": (r"\.go$", {"function": r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "class": r"^type\s+(\w+)\s+(?:struct|interface)", "imports": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$"}),
    "rust": (r"\.rs$", {"function": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)", "class": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)", "imports": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "inherits": r"^\s*impl(?:<[^>]*>)?\s+(\w+)\s+for\b"}),
    "java": (r"\.java$", {"function": r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized)\s+)+(?:<[^>]*>\s*)?[\w<>\[\],.? ]+\s+(\w+)\s*\(", "class": r"^\s*(?:\w+\s+)*(?:class|interface|enum|record)\s+(\w+)", "imports": r"^\s*import\s+(?:static\s+)?([\w.*]+)", "inherits": r"\bclass\s+\w+\s+extends\s+([\w.]+)"}),
    "csharp": (r"\.cs$", {"function": r"^\s*(?:(?:public|protected|private|internal|static|async|override|virtual|sealed)\s+)+[\w<>\[\],.? ]+\s+(\w+)\s*\(", "class": r"^\s*(?:\w+\s+)*(?:class|interface|struct|record|enum)\s+(\w+)", "imports": r"^\s*using\s+([\w.]+)\s*;", "inherits": r"\bclass\s+\w+\s*:\s*([\w.]+)"}),
    "unreal": (r"\.Build\.cs$", {"depends_on": r"\"(\w+)\"", "module": r"\bclass\s+(\w+)\s*:\s*ModuleRules"}),
}
_KINDS = {"imports": "module", "inherits": "class", "depends_on": "module", "serves_route": "endpoint", "emits": "event_channel", "listens_on": "event_channel", "exports": "function"}
_NO_FUNCTIONS = frozenset("if for while switch catch return sizeof else do new delete throw".split())


def by_patterns(language: str) -> Callable[[str, str], Found]:
    """An extractor that reads a language line by line (X1, X3 to X8): declarations, imports, bases, routes and events, but no scopes or calls."""
    rules = {k: re.compile(p, re.M) for k, p in PATTERNS[language][1].items()}

    def run(path: str, text: str) -> Found:
        out = [node("file", path, 1)]
        for kind, rule in rules.items():
            for m in rule.finditer(text):
                name = next((g for g in m.groups() if g), "")
                line = text.count("\n", 0, m.start()) + 1
                if kind in ("function", "class", "module"):
                    if name and name not in _NO_FUNCTIONS:
                        out += [node(kind, f"{path}::{name}", line), edge(path, "defines", kind, f"{path}::{name}", line)]
                elif name:
                    target = _KINDS[kind]
                    if target in ("endpoint", "event_channel"):
                        out.append(node(target, name, line))
                    out.append(edge(path, kind, target, f"{path}::{name}" if kind == "exports" else name, line))
        return out

    return run


EXTRACTORS |= {name: (pattern, by_patterns(name)) for name, (pattern, _) in PATTERNS.items()}
