import pytest

from skein.operators import resolution
from skein.sources import facts, lexer

PYTHON = {
    "app/__init__.py": "from .core import run, Job as Task\n",
    "app/core.py": """
import app.util as u
from app.util import helper as h, Base
from . import extra
class Job(Base):
    def go(self):
        def inner():
            h()
        inner()
        self.step()
        self.deep()
        self.missing()
        super().step()
        u.other()
        extra.more()
        return run
def run():
    Job()
    Job.go(None)
    Job.step(None)
    print(1)
""",
    "app/util.py": """
class Root:
    def deep(self): pass
class Base(Root):
    def step(self): self.deep()
def helper(): pass
def other():
    helper()
    helper()
""",
    "app/extra.py": "from app.util import *\ndef more():\n    other()\n    _hidden()\n",
    "main.py": "from app import run, Task\nimport app\nrun()\nTask.go(1)\napp.run()\nunknown()\n",
    "two.py": "from left import f\nfrom right import f\nf()\n",
    "left.py": "from right import g\ndef f(): g()\n",
    "right.py": "from left import f as lf\ndef f(): lf()\ndef g(): pass\n",
    "broken.py": "def (",
}
CPP = {
    "a/base.h": '#pragma once\nclass Base { public: void init(); virtual int size() const; };\n',
    "a/base.cpp": '#include "base.h"\nvoid Base::init() { size(); log("it\'s (not) a call()"); }\nint Base::size() const { return 1; }\n',
    "b/use.cpp": '#include "a/base.h"\n#include <vector>\n#include "util.h"\nnamespace n {\nclass Use : public Base { Use(int x) : v(x) { init(); } int v; };\nint pick(int a) { return a; }\nint pick(int a, int b) { return pick(a); }\n}\nint main() { n::pick(1); Base b; b.size(); /* pick(3) */ return 0; }\n',
    "x/util.h": "#define CALL(x) pick(x)\ninline int only() { return R\"(pick(1))\"[0]; }\n",
    "y/util.h": "int other();\n",
}
SCRIPT = {
    "src/a.tsx": """import { x as y, z } from "./b";
import * as lib from './lib';
const t = `a ${y(`in ${z(1)}`)} don't call(1)`;
export const Comp = ({ a }) => { const v = lib.deep(a); return <div className="it's" onClick={() => Comp(a)}>don't call(2) {y(1)} <b>won't</b></div>; };
class A extends lib.Box { run() { this.go(); this.open(); /call(3)/.test(v); } go() { return 1 / z(2) / 3; } }
app.get('/users', handler); bus.emit("made");
""",
    "src/b.ts": "export function x(n: number) { return n; }\nexport { deep as z } from './lib';\n",
    "src/lib/index.ts": "export function deep(n) { return n; }\nexport class Box { open() { deep(1); } }\n",
}


def tree(spark, files):
    return spark.createDataFrame([("r", p, t) for p, t in files.items()] + [("r", "none.py", None)], "repo string, path string, text string")


def edges(resolved, relation):
    return {(r["from_id"], r["to_id"], r["n"]) for r in resolved.edges.collect() if r["relation"] == relation}


def tally(resolved, relation):
    out = {}
    for r in resolved.tally.collect():
        if r["relation"] == relation:
            out[r["path"], r["status"]] = r["n"]
    return out


def test_python_tree(spark):
    files = tree(spark, PYTHON)
    found = resolution.by_scope(facts.facts(files, "python"), files)
    assert edges(found, "calls") == {
        ("app/core.py::Job::go::inner", "app/util.py::helper", 1),
        ("app/core.py::Job::go", "app/core.py::Job::go::inner", 1),
        ("app/core.py::Job::go", "app/util.py::Base::step", 2),
        ("app/core.py::Job::go", "app/util.py::Root::deep", 1),
        ("app/core.py::Job::go", "app/util.py::other", 1),
        ("app/core.py::Job::go", "app/extra.py::more", 1),
        ("app/core.py::run", "app/core.py::Job", 1),
        ("app/core.py::run", "app/core.py::Job::go", 1),
        ("app/core.py::run", "app/util.py::Base::step", 1),
        ("app/util.py::Base::step", "app/util.py::Root::deep", 1),
        ("app/util.py::other", "app/util.py::helper", 2),
        ("app/extra.py::more", "app/util.py::other", 1),
        ("main.py", "app/core.py::run", 2),
        ("main.py", "app/core.py::Job::go", 1),
        ("left.py::f", "right.py::g", 1),
        ("right.py::f", "left.py::f", 1),
    }
    assert edges(found, "inherits") == {("app/core.py::Job", "app/util.py::Base", 1), ("app/util.py::Base", "app/util.py::Root", 1)}
    calls = tally(found, "calls")
    assert calls["two.py", "ambiguous"] == 1 and ("two.py", "resolved") not in calls
    assert calls["main.py", "external"] == 1 and calls["app/core.py", "external"] == 3 and calls["app/extra.py", "external"] == 1


def test_cpp_tree(spark):
    files = tree(spark, CPP)
    rows = facts.facts(files, "cpp")
    found = resolution.by_name(rows, files)
    assert edges(found, "calls") == {
        ("r#Base::init", "r#Base::size", 1),
        ("r#n::Use::Use", "r#Base::init", 1),
        ("r#main", "r#Base::size", 1),
    }
    assert edges(found, "inherits") == {("r#n::Use", "r#Base", 1)}
    assert edges(found, "imports") == {("a/base.cpp", "a/base.h", 1), ("b/use.cpp", "a/base.h", 1)}
    assert tally(found, "calls") == {("a/base.cpp", "resolved"): 1, ("a/base.cpp", "external"): 1, ("b/use.cpp", "resolved"): 2, ("b/use.cpp", "ambiguous"): 2}
    assert tally(found, "imports") == {("a/base.cpp", "resolved"): 1, ("b/use.cpp", "resolved"): 1, ("b/use.cpp", "external"): 2}
    fan = resolution.by_name(rows, files, "fan")
    more = {(r["from_id"], r["to_id"], r["confidence"]) for r in fan.edges.collect() if r["confidence"] == "INFERRED"}
    assert more == {("r#main", "r#n::pick", "INFERRED"), ("r#main", "r#n::pick/1", "INFERRED"), ("r#n::pick/1", "r#n::pick", "INFERRED")}
    with pytest.raises(ValueError):
        resolution.by_name(rows, files, "guess")


def test_script_tree_and_graph(spark):
    files = tree(spark, SCRIPT)
    nodes, links, counts = resolution.code_graph(facts.facts(files, "ts"), files, "ts")
    got = {(r["from_id"], r["relation"], r["to_id"]) for r in links.collect() if r["relation"] != "defines"}
    deep = "src/lib/index.ts::deep"
    assert got == {
        ("src/a.tsx", "imports", "src/b.ts"), ("src/a.tsx", "imports", "src/lib/index.ts"), ("src/b.ts", "imports", "src/lib/index.ts"),
        ("src/a.tsx", "calls", "src/b.ts::x"), ("src/a.tsx", "calls", deep),
        ("src/a.tsx::Comp", "calls", deep), ("src/a.tsx::Comp", "calls", "src/b.ts::x"),
        ("src/a.tsx::A::run", "calls", "src/a.tsx::A::go"), ("src/a.tsx::A::go", "calls", deep), ("src/lib/index.ts::Box::open", "calls", deep),
        ("src/a.tsx", "serves_route", "endpoint:GET /users"), ("src/a.tsx", "emits", "event_channel:made"),
    }
    kinds = {(r["kind"], r["id"]) for r in nodes.collect()}
    assert {("endpoint", "endpoint:GET /users"), ("class", "src/a.tsx::A"), ("function", "src/a.tsx::A::go"), ("file", "src/b.ts")} <= kinds
    assert ("src/a.tsx::A", "src/a.tsx::A::run") in {(r["from_id"], r["to_id"]) for r in links.where("relation = 'defines'").collect()}
    assert counts.where("status = 'ambiguous'").isEmpty()


def test_php_names_and_hidden_code(spark):
    text = """<b>don't do_action('html')</b><?php
class Shop { function boot() { add_action('init', 'start'); $this->say("it's {$o->name('x')}"); return <<<EOT
do_action('heredoc') don't
EOT;
} function say($x) {} }
# do_action('comment')
function start() { do_action("saved"); get_option('opt'); update_option('opt', 1); user_can($u, 'edit'); add_shortcode('box', 'f'); $t = $wpdb->prefix . 'tips'; register_rest_route('v1', 'items'); }
?> isn't <?php wp_schedule_event(time(), 'daily', 'sweep');"""
    files = spark.createDataFrame([("r", "p.php", text)], "repo string, path string, text string")
    _, links, _ = resolution.code_graph(facts.facts(files, "php"), files, "php")
    got = {(r["from_id"], r["relation"], r["to_id"]) for r in links.where("relation <> 'defines'").collect()}
    assert got == {
        ("r#Shop::boot", "listens_to", "hook:init"), ("r#Shop::boot", "calls", "r#Shop::say"), ("r#start", "fires", "hook:saved"), ("r#start", "reads_option", "option:opt"),
        ("r#start", "writes_option", "option:opt"), ("r#start", "secured_by", "capability:edit"), ("r#start", "listens_to", "shortcode:box"), ("r#start", "references_table", "wp_table:tips"),
        ("r#start", "serves_route", "endpoint:/v1/items"), ("p.php", "scheduled_by", "scheduled_job:sweep"),
    }


CASES = {
    ("kotlin", "class A(val x: Int) : B(x), I { fun go(a: Int): Int { return \"don't ${f(\"x\")}\".let { g(a) } } }\nfun String.ext(a: Int) = h(a)\n"): ({"A", "go", "ext"}, {"f", "g", "h"}, {"B", "I"}),
    ("swift", 'struct S: P { func go(_ a: Int) { say("x \\(f("y"))"); self.h() } }\nextension S { func more() { go(1) } }\n'): ({"S", "go", "more"}, {"say", "f", "h", "go"}, {"P"}),
    ("go", 'package main\nimport ("fmt"; m "a/b")\ntype T struct { x int }\nfunc (t *T) Run(a int) { t.other(); fmt.Println(`don\'t f()`) }\nfunc main() { m.Go(1) }\n'): ({"T", "Run", "main"}, {"other", "Println", "Go"}, set()),
    ("rust", "struct S<'a> { v: &'a str }\nimpl<'a> D for S<'a> { fn go(&self) { self.h(); let c = 'x'; f(r#\"a\"b(1)\"#) } }\nfn f(a: &str) {}\n"): ({"S", "go", "f"}, {"h", "f"}, set()),
    ("java", 'public class A extends B implements I { int x = f(1); public A(int y) { super(y); go(); } int go() throws E { String s = "g()"; return c.run("""\n it\'s h() """); } }\n'): ({"A", "go"}, {"f", "go", "run"}, {"B", "I"}),
    ("csharp", 'namespace N { class A : B, I { public int Go(int a) { return H($@"x ""q()"" ", a); } int P => K(1); } }\n'): ({"A", "Go"}, {"H", "K"}, {"B", "I"}),
}


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_other_languages(case):
    language, text = case
    rows = list(facts.READERS[language][1]("f", text))
    of = lambda fact: {r[4] for r in rows if r[0] == fact}
    assert (of("declares"), of("calls"), of("inherits")) == CASES[case]


def test_tokens_of_unfinished_texts():
    for language in lexer.LANGUAGES:
        for text in ("", "'", '"', "`${", "/*", "<?php", "<?php <<<A\n", '"""', "<div {", "a(", 'R"x(', "{" * 50 + "\0", "\\", "$", "@\"", "${" * 2000, "`${" * 3000):
            lexer.tokens(text, language)
            list(facts.READERS.get(language, facts.READERS["ts"])[1]("a", text))


def test_chains_of_imports_and_bases_settle(spark):
    n = 9
    code = {f"m{k}.py": f"from m{k + 1} import f, C as C{k}\nclass C(C{k}): pass\n" for k in range(n)}
    code[f"m{n}.py"] = "def f(): pass\nclass C:\n    def go(self): pass\n"
    code["use.py"] = "from m0 import f, C\nf()\nC.go(1)\n"
    files = tree(spark, code)
    found = resolution.by_scope(facts.facts(files, "python"), files)
    assert edges(found, "calls") == {("use.py", f"m{n}.py::f", 1), ("use.py", f"m{n}.py::C::go", 1)}


def test_long_chains_circles_and_several_sources(spark):
    # a chain of 150 files; a circle of three; a name from two files, one of them at the chain's end; a star import within a chain
    rows = [("c0", "f")] + [("two", "g"), ("x", "f"), ("s0", "h"), ("s0", "_p"), ("r1", "z")]
    decls = spark.createDataFrame([("r", p, "", n, f"{p}::{n}", "function") for p, n in rows], "repo string, path string, scope string, name string, id string, kind string")
    asks = [(f"c{k}", "f", "f", f"c{k - 1}") for k in range(1, 150)] + [(f"r{k}", "z", "z", f"r{(k + 1) % 3}") for k in range(3)]
    asks += [("y", "f", "f", "c149"), ("y", "f", "f", "x"), ("w", "v", "f", "y"), ("s1", "*", "*", "s0"), ("s2", "q", "h", "s1"), ("s3", "q", "q", "s2"), ("s4", "q", "q", "s3")]
    imports = spark.createDataFrame([("r", p, n, t, f) for p, n, t, f in asks], "repo string, path string, name string, target string, file string")
    got = {(r["path"], r["name"]): (r["n"], r["id"], r["kind"]) for r in resolution.visible(decls, imports).collect()}
    want = {(p, n): (1, f"{p}::{n}", "function") for p, n in rows} | {(f"c{k}", "f"): (1, "c0::f", "function") for k in range(150)} | {(f"r{k}", "z"): (1, "r1::z", "function") for k in range(3)}
    want |= {("y", "f"): (2, "c0::f", "function"), ("w", "v"): (2, "c0::f", "function"), ("s1", "h"): (1, "s0::h", "function")} | {(f"s{k}", "q"): (1, "s0::h", "function") for k in (2, 3, 4)}
    assert got == want
