import pytest
from pyspark.sql import functions as F

from skein.operators import graph, writes

NODES = [("a", "file", "A", "a.ts"), ("b", "component", "B", "a.ts"), ("c", "endpoint", "C", "b.ts"), ("d", "table", "D", None), ("z", "function", "Z", "z.ts")]
EDGES = [("1", "b", "a", "defined_in"), ("2", "b", "c", "calls_endpoint"), ("3", "c", "d", "references_table"), ("4", "a", "c", "imports"), ("5", "c", "b", "calls_endpoint")]


@pytest.fixture(scope="module")
def g(spark):
    n = spark.createDataFrame(NODES, "id string, kind string, name string, file_path string")
    e = spark.createDataFrame([(*x, "EXTRACTED", 0.0) for x in EDGES], "id string, from_node string, to_node string, relation string, confidence string, weight double")
    return n, e


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id string")


def test_reach(spark, g):
    rows = lambda **k: {r["id"]: r["hop"] for r in graph.reach(g[1], ids(spark, "b"), 3, **k).collect()}
    assert rows() == {"b": 0, "a": 1, "c": 1, "d": 2}
    assert rows(direction="in") == {"b": 0, "c": 1, "a": 2}
    assert rows(direction="out", relation="calls_endpoint") == {"b": 0, "c": 1}
    assert rows(limit=1) == {"b": 0, "c": 1, "a": 2}  # calls_endpoint comes before defined_in; then only one of a and d


def test_shortest_path(spark, g):
    path = [(r["step"], r["node"]) for r in graph.shortest_path(g[1], "a", "d").orderBy("step").collect()]
    assert path == [(0, "a"), (1, "c"), (2, "d")]
    assert graph.shortest_path(g[1], "a", "z").count() == 0
    assert [r["node"] for r in graph.shortest_path(g[1], "a", "a").collect()] == ["a"]


def test_traverse_charges_before_duplicates(spark, g):
    step = graph.Step("both", ("calls_endpoint",))
    nodes, edges = graph.traverse(*g, ids(spark, "b"), [step], 1)
    assert {r["id"] for r in nodes.collect()} == {"b", "c"} and [r["id"] for r in edges.collect()] == ["2"]
    nodes, edges = graph.traverse(*g, ids(spark, "b"), [step, graph.Step("out", ("references_table",), ("table",))], None)
    assert {(r["id"], r["step"]) for r in nodes.collect()} == {("b", 0), ("c", 1), ("d", 2)} and {r["id"] for r in edges.collect()} == {"2", "3", "5"}
    with pytest.raises(ValueError):
        graph.Step("sideways", ("x",))
    with pytest.raises(ValueError):
        graph.traverse(*g, ids(spark, "b"), [], None)


def test_unused(spark, g):
    out = graph.unused(*g, ["component", "function", "file", "table"], ["calls_endpoint"], ["imports"])
    assert {r["id"] for r in out.collect()} == {"z"}  # a exports, b is called, d has no path
    assert graph.unused(*g, ["function"], ["calls_endpoint"], reasoned=ids(spark, "z")).count() == 0


def test_strength_and_degree(spark, g):
    e = g[1].unionByName(spark.createDataFrame([("6", "a", "z", "co_changed_with", "INFERRED", 7.0)], g[1].select("id", "from_node", "to_node", "relation", "confidence", "weight").schema))
    out = {r["id"]: r["strength"] for r in graph.strength(e, spark.createDataFrame([("b", 4)], "id string, n int")).collect()}
    assert out["6"] == 7.0 and out["1"] == 7.0 and out["3"] == 3.0
    assert {r["id"]: r["degree"] for r in graph.degree(g[1]).collect()} == {"a": 2, "b": 3, "c": 4, "d": 1}


def test_mermaid():
    text = graph.mermaid([("a", 'x"[y]'), ("b", "B")], [("a", "b", "uses"), ("a", "q", "uses")])
    assert text.splitlines() == ["graph LR", '  n0["x  y "]', '  n1["B"]', "  n0 -->|uses| n1"]


def test_writes(spark):
    cols = "kind string, qualified_name string, file_path string, content_hash string, extracted_by string, id string"
    old = spark.createDataFrame([("file", "a", "a", "h", "ts", "1"), ("function", "f", "a", None, "ts", "2"), ("endpoint", "e", None, None, "ts", "3"), ("file", "p", "p", "k", "py", "4")], cols)
    new = spark.createDataFrame([("file", "a", "a", "h2", "ts", "1"), ("function", "g", "a", None, "ts", "5")], cols)
    names = lambda df: sorted(r["qualified_name"] for r in df.collect())
    assert names(writes.splice(old, new, "ts", ["kind", "qualified_name"], ["endpoint"])) == ["a", "e", "g", "p"]
    again = writes.splice(writes.splice(old, new, "ts", ["kind", "qualified_name"]), new, "ts", ["kind", "qualified_name"])
    assert names(again) == ["a", "g", "p"]
    out = writes.splice_files(old, new, spark.createDataFrame([("a",)], "file_path string"), spark.createDataFrame([("p",)], "file_path string"), ["kind", "qualified_name"])
    assert names(out) == ["a", "e", "g"]
    assert {r["content_hash"] for r in writes.filled_hashes(old).where("file_path = 'a'").collect()} == {"h"}
    with pytest.raises(ValueError):
        writes.filled_hashes(old.unionByName(spark.createDataFrame([("file", "a2", "a", "other", "ts", "9")], cols)))
    e = spark.createDataFrame([("file", "a", "function", "f", "defines"), ("file", "a", "file", "a", "imports"), ("file", "a", "file", "none", "imports")], "from_kind string, from_name string, to_kind string, to_name string, relation string")
    rows, dropped = writes.resolved(e, old)
    assert [(r["from_node"], r["to_node"]) for r in rows.collect()] == [("1", "2")] and dropped == 2
    assert names(writes.orphans(old, rows.withColumn("relation", F.lit("defines")), ["endpoint"])) == ["e"]
    assert writes.unknown_words(old, "kind", ["file"]).count() == 2
    assert names(writes.insert_new(old, new, ["kind", "qualified_name"])) == ["g"]


def test_no_allowance_gives_no_edges(spark, g):
    nodes, edges = graph.traverse(*g, ids(spark, "b"), [graph.Step("both", ("calls_endpoint",))], 0)
    assert [(r["id"], r["step"]) for r in nodes.collect()] == [("b", 0)] and edges.count() == 0 and edges.columns == g[1].columns


def test_seeds_keep_every_hit(spark):
    rows = [("1", "function", "xy", "m.xy", "a/1"), ("2", "class", "x", "m.x", "a/2"), ("3", "function", "axb", None, "b/3"), ("4", "file", "q", "X", "b/4"), ("5", "file", "none", "none", "a/5"), ("x%", "file", "per%cent", None, None)]
    nodes = spark.createDataFrame(rows, "id string, kind string, name string, qualified_name string, file_path string")
    found = lambda *a, **k: ([r["id"] for r in graph.named_seeds(nodes, *a, **k)[0].orderBy("place").collect()], graph.named_seeds(nodes, *a, **k)[1])
    assert found("x") == (["2", "4", "1", "3"], False)
    assert found("x", most=2) == (["2", "4"], True)
    assert found("X", kinds=("function",)) == (["1", "3"], False) and found("x", path_prefix="b/") == (["4", "3"], False)
    assert found("3") == (["3"], False) and found("%c") == (["x%"], False) and found("nothing") == ([], False)


def test_impact_reasons_and_caps(spark):
    nodes = spark.createDataFrame([(f"n{k}", "table" if k == 9 else "function", "a/x" if k % 2 else "b/y") for k in range(10)], "id string, kind string, file_path string")
    edges = spark.createDataFrame([(f"e{k}", f"n{k}", "n0", "calls", "EXTRACTED") for k in range(1, 9)] + [("e9", "n9", "n1", "imports", "INFERRED"), ("e10", "n0", "n0", "calls", "EXTRACTED")], "id string, from_node string, to_node string, relation string, confidence string")
    decisions = spark.createDataFrame([("n1", "p", f"d{k}", "s", k, k != 3) for k in range(25)] + [("n1", "q", "other", "s", 99, True)], "node string, project string, description string, source string, at int, valid boolean")
    lessons = spark.createDataFrame([("n0", None, "global", True), ("n0", "q", "theirs", True), ("n0", "p", "old", False), ("n2", "p", "own", True)], "node string, project string, rule string, valid boolean")
    roots = spark.createDataFrame([("a",), ("b",)], "root string")
    row = lambda **k: graph.impact(nodes, edges, ids(spark, "n0"), decisions, lessons, roots, "p", **k).collect()[0]
    r = row()
    assert (r["dependents"], r["edges"], r["capped"], r["repos"], r["risk"], r["confidence"]) == (9, 10, False, 2, "HIGH", "SUFFICIENT")
    assert [d["description"] for d in r["decisions"]] == [f"d{k}" for k in range(24, 4, -1)] and r["lessons"] == ["global", "own"]
    assert r["reasons"] == "public boundary affected: table; spans 2 configured repositories; 9 dependents (>= 5); 2 distinct dependency relations (>= 2); 22 linked decisions/lessons; non-extracted edge confidence: INFERRED"
    r = row(cap=3, schema_stale=True, stale=ids(spark, "n1"))  # e10, e1 and e2 come first
    assert (r["dependents"], r["edges"], r["capped"], r["confidence"]) == (2, 3, True, "LIMITED")
    assert r["reasons"].startswith("traversal capped at 3 edges; spans 2") and r["reasons"].endswith("a returned code node is stale or unattributed")
    quiet = graph.impact(nodes, edges, ids(spark, "n9"), decisions.limit(0), lessons.limit(0), roots.limit(0)).collect()[0]
    assert (quiet["dependents"], quiet["risk"], quiet["decisions"]) == (0, "HIGH", [])


def test_audited_changes(spark):
    records = spark.createDataFrame([(1, "p", 0.5), (2, None, 0.9), (3, "q", 0.1), (4, "p", 0.2)], "id int, project string, score double")
    changes = spark.createDataFrame([(1, 2, 0.75, "up"), (1, 1, -0.25, "down"), (1, 3, -0.5, "again"), (2, 1, 0.5, "more"), (3, 1, 0.5, "theirs"), (9, 1, 0.5, "none"), (2, 2, None, "nothing")], "id int, at int, delta double, reason string")
    out, audit = writes.audited(records, changes, ["at"], "p")
    assert {r["id"]: r["score"] for r in out.collect()} == {1: 0.5, 2: 1.0, 3: 0.1, 4: 0.2} and out.columns == records.columns
    assert sorted((r["id"], r["at"], r["from"], r["to"], r["reason"]) for r in audit.collect()) == [(1, 1, 0.5, 0.25, "down"), (1, 2, 0.25, 1.0, "up"), (1, 3, 1.0, 0.5, "again"), (2, 1, 0.9, 1.0, "more"), (2, 2, 1.0, 1.0, "nothing")]
    assert writes.audited(records, changes.limit(0), ["at"])[1].count() == 0
