import re

import pytest
from pyspark.sql import functions as F

from skein.catalog import Tables
from skein.functions.text import similarity
from skein.operators.navigation import navigate
from skein.plans.catalog import QUERIES, _edges, _nodes


def grams(text):
    return {p[i : i + 3] for w in re.split(r"[\W_]+", text.lower()) if w for p in [f"  {w} "] for i in range(len(p) - 2)}


def walk(texts, near, asked, seeds, evaluations, evidence, beside):
    """One question at a time, item by item."""
    out, g = {}, {k: grams(v) for k, v in texts.items()}
    for q, text in asked.items():
        w = grams(text)
        score = lambda k, w=w: round(len(g[k] & w) / len(g[k] | w), 9) if g[k] | w else 0.0
        held = {k: (True, score(k), 0) for k in seeds.get(q, ()) if k in texts}
        done = []
        while len(done) < evaluations and (left := [k for k in held if k not in done]):
            at = min(left, key=lambda k: (-held[k][1], k))
            done.append(at)
            for k in sorted((k for k in near.get(at, ()) if k in texts), key=lambda k: (-score(k), k))[:beside]:
                held.setdefault(k, (False, score(k), len(done)))
            order = sorted(held, key=lambda k: (not held[k][0], -held[k][1], k))
            held = {k: held[k] for n, k in enumerate(order) if n < evidence or held[k][0]}
        stop = "no_evidence" if not held else "work_cap" if any(k not in done for k in held) else "stop"
        order = sorted(held, key=lambda k: (not held[k][0], -held[k][1], k))
        out[q] = ([(n, k, round(held[k][1], 6), held[k][0], held[k][2]) for n, k in enumerate(order, 1)], stop, done)
    return out


def graph_of(nodes, edges):
    texts = {r["id"]: r["text"] for r in nodes.collect()}
    near = {}
    for r in edges.select("from_node", "to_node").collect():
        near.setdefault(r[0], set()).add(r[1])
        near.setdefault(r[1], set()).add(r[0])
    return texts, near


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_a_walk(spark, sf):
    folder = f"/root/testdata/{sf}"
    t = Tables(spark, folder)
    nodes = _nodes(t).select("id", F.concat_ws(" ", "kind", "name").alias("text"))
    texts, near = graph_of(nodes, _edges(t))
    asked = {k: f"which customer or supplier of {v}" for k, v in texts.items() if k[:2] in ("r:", "n:")}
    want = walk(texts, near, asked, {k: [k] for k in asked}, 8, 24, 32)
    got = {}
    for r in QUERIES["navigation"](spark, folder).orderBy("question", "place").collect():
        got.setdefault(r["question"], ([], r["stop"]))[0].append((r["place"], r["id"], round(r["score"], 6), r["protected"], r["round"]))
    assert got == {q: (rows, stop) for q, (rows, stop, _) in want.items()}


def test_bounds_seeds_and_stops(spark):
    texts = {"a": "red fox", "b": "red dog", "c": "blue fox", "d": "red fox run", "e": "none", "f": "fox"}
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "f"), ("f", "gone"), ("e", "e")]
    nodes = spark.createDataFrame(list(texts.items()), "id string, text string")
    edges = spark.createDataFrame([(str(k), a, b, "x") for k, (a, b) in enumerate(pairs)], "id string, from_node string, to_node string, relation string")
    asked = {"q": "red fox", "p": "blue", "z": "x"}
    seeds = {"q": ["a", "e", "e"], "p": ["e", "c", "b", "f"], "z": ["gone"]}
    q = spark.createDataFrame(list(asked.items()), "question string, text string")
    s = spark.createDataFrame([(k, x) for k, xs in seeds.items() for x in xs], "question string, id string")
    _, near = graph_of(nodes, edges)
    for bounds in ((8, 24, 32), (2, 3, 1), (1, 1, 1), (0, 5, 5), (20, 3, 2)):
        r = navigate(nodes, edges, q, s, similarity, *bounds)
        want = walk(texts, near, asked, seeds, *bounds)
        got = {k: [] for k in asked}
        for x in r.evidence.orderBy("question", "place").collect():
            got[x["question"]].append((x["place"], x["id"], round(x["score"], 6), x["protected"], x["round"]))
        assert got == {k: v[0] for k, v in want.items()}, bounds
        assert {x["question"]: x["stop"] for x in r.stops.collect()} == {k: v[1] for k, v in want.items()}
        assert sorted((x["question"], x["round"], x["id"]) for x in r.trace.collect()) == sorted((k, n, i) for k, v in want.items() for n, i in enumerate(v[2], 1))


def test_what_is_near_stays_in_many_parts(spark, monkeypatch):
    # edges are stored without being grouped, and ids meet their texts in as many parts as asked for
    from skein.operators import navigation

    plans, store = [], navigation.settled
    monkeypatch.setattr(navigation, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df))
    nodes = spark.createDataFrame([("a", "red fox"), ("b", "red dog"), ("c", "fox")], "id string, text string")
    edges = spark.createDataFrame([(str(k), *e, "x") for k, e in enumerate([("a", "b"), ("a", "b"), ("b", "a"), ("a", "c")])], "id string, from_node string, to_node string, relation string")
    q = spark.createDataFrame([("q", "red fox")], "question string, text string")
    r = navigation.navigate(nodes, edges, q, q.selectExpr("question", "'a' as id"), similarity)
    assert [(x["id"], x["round"]) for x in r.evidence.orderBy("place").collect()] == [("a", 0), ("c", 1), ("b", 1)]
    assert "Aggregate" not in plans[0] and "Exchange" not in plans[0] and plans[1].count("REPARTITION_BY_NUM") == 2
