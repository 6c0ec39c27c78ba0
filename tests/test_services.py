import math
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators import retrieval, services

GOOD = {"seed": {"text": "save"}, "steps": [{"direction": "out", "relations": ["defines"], "target_kinds": ["function"]}], "limit": 5}


def test_graph_query():
    q = services.graph_query(GOOD)
    assert (q.seed, q.by_id, q.limit, q.steps[0].kinds) == ("save", False, 5, ("function",))


@pytest.mark.parametrize(
    "bad",
    [
        None,
        {},
        GOOD | {"extra": 1},
        GOOD | {"seed": {"text": " "}},
        GOOD | {"seed": {"text": "a", "node_id": "b"}},
        GOOD | {"steps": []},
        GOOD | {"steps": GOOD["steps"] * 4},
        GOOD | {"steps": [{"direction": "up", "relations": ["x"]}]},
        GOOD | {"steps": [{"direction": "in", "relations": []}]},
        GOOD | {"steps": [{"direction": "in", "relations": "x"}]},
        GOOD | {"limit": True},
        GOOD | {"limit": 0},
        GOOD | {"limit": "5"},
    ],
)
def test_bad_graph_queries_are_refused(bad):
    with pytest.raises(ValueError):
        services.graph_query(bad)


@pytest.fixture(scope="module")
def memory(spark):
    rows = [("a", "the quick fox", [1.0, 0.0], "m"), ("b", "the quick dog", [0.9, 0.1], "m"), ("c", "quick thinking", [1.0, 0.0], "old"), ("d", "nothing here", [0.0, 1.0], "m"), ("e", "quick quick", None, None)]
    return spark.createDataFrame(rows, "id string, text string, embedding array<double>, embedding_model string")


def lanes(rows):
    return [(r["lane"], r["id"]) for r in rows.orderBy("rank").collect()]


def test_hybrid_states(memory):
    assert lanes(retrieval.hybrid(memory, "quick", [1.0, 0.0], "m", 2)) == [("semantic", "a"), ("stale", "e")]
    assert lanes(retrieval.hybrid(memory, "quick", [1.0, 0.0], "m", 1)) == [("semantic", "a")]
    assert {x for x, _ in lanes(retrieval.hybrid(memory, "quick", None, "m", 5))} == {"lexical"}
    assert {i for _, i in lanes(retrieval.hybrid(memory, "quick", [-1.0, -1.0], "m", 5))} == {"a", "b", "c", "e"}
    assert lanes(retrieval.hybrid(memory, "quick", [1.0], "m", 5))[0][0] == "lexical"  # another length scores 0


def test_fusion(spark):
    r = lambda *ids: spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "id string, rank int")
    fused = [x["id"] for x in retrieval.fuse(r("a", "b", "c"), r("c", "b", "a")).orderBy("rank").collect()]
    assert fused == ["a", "c", "b"]
    tail = [x["id"] for x in retrieval.rerank(r(*"abcdefghij"), spark.createDataFrame([(c, float(ord(c))) for c in "abcdefgh"], "id string, logit double")).orderBy("rank").collect()]
    assert tail[8:] == ["i", "j"] and set(tail[:8]) == set("abcdefgh")


def test_topics(spark):
    t = spark.createDataFrame([("one", ["c++", "graph"], False), ("two", ["graph"], False), ("base", [], True), ("none", ["graphs"], False)], "title string, keywords array<string>, always boolean")
    assert [r["title"] for r in retrieval.topics(t, "A graph in c++").collect()] == ["base", "one", "two"]


def test_similar_texts_lose_no_pair(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 600").select("doc_id", F.left("text", F.lit(120)).alias("text"))
    from skein.functions.text import similarity

    a, b = (docs.select(F.col("doc_id").alias(f"id_{s}"), F.col("text").alias(f"t_{s}")) for s in "ab")
    want = {(r[0], r[1]) for r in a.join(b, F.col("id_a") < F.col("id_b")).where(similarity(F.col("t_a"), F.col("t_b")) >= 0.3).select("id_a", "id_b").collect()}
    members, links = retrieval.similar_texts(docs, 0.3, key="doc_id")
    of = {r["doc_id"]: r["class_id"] for r in members.collect()}
    linked = {(r["class_a"], r["class_b"]) for r in links.collect()}
    ids = sorted(of)
    got = {(x, y) for k, x in enumerate(ids) for y in ids[k + 1 :] if of[x] == of[y] or (min(of[x], of[y]), max(of[x], of[y])) in linked}
    assert got == want
    links_of = {r["doc_id"]: r["n_links"] for r in retrieval.alike(docs, 0.3, key="doc_id").collect()}
    assert links_of == {r["doc_id"]: sum(r["doc_id"] in p for p in want) for r in docs.collect()}


def test_embedder_is_deterministic(spark):
    e = services.hash_embedder(16)
    df = spark.createDataFrame([("a b",), ("a b",), ("",), (None,)], "t string").select(e("t").alias("v")).collect()
    assert df[0]["v"] == df[1]["v"] and sum(x * x for x in df[0]["v"]) == pytest.approx(1.0) and not any(df[2]["v"]) and not any(df[3]["v"])


def test_sets_travel_once_a_group(spark, monkeypatch):
    # 60 tiles of near sizes: by pairs of tiles each would travel 61 times
    monkeypatch.setattr(retrieval, "TILE", 1)
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(60)]
    kinds = spark.createDataFrame(rows, "_kind long, text string").select("_kind", F.array_sort(tx.trigrams(F.col("text"))).alias("_g"))
    tiles = retrieval._tiles(kinds)
    assert tiles.count() == 60 and retrieval._dealt(tiles, 0.5).count() <= 60 * (retrieval.GROUPS + 1)


def test_rare_trigrams_count_exactly(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 4)
    # more trigrams than have bits of their own
    rows = [(k, " ".join(chr(0x4E00 + (97 * (k // 2) + j * j) % 20000) + chr(0x4E00 + j + k // 2) for j in range(150 + k % 2 * 20))) for k in range(120)]
    docs = spark.createDataFrame(rows, "id long, text string")
    sets = {r["id"]: frozenset(r["g"]) for r in docs.select("id", tx.trigrams(F.col("text")).alias("g")).collect()}
    assert len(frozenset().union(*sets.values())) > retrieval.BITS
    _, links = retrieval.similar_texts(docs, 0.6)
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) >= 0.6}
    assert want and {(r["class_a"], r["class_b"]): r["score"] for r in links.collect()} == pytest.approx(want)


def test_links_are_summed_where_they_are_found(spark, monkeypatch):
    """F3 of round 4: no table of links, of which there may be as many as pairs; copies count, in one group and across groups."""
    monkeypatch.setattr(retrieval, "TILE", 2)
    monkeypatch.setattr(retrieval, "AT_ONCE", 3)
    monkeypatch.setattr(retrieval, "_linked", None)
    rows = [(f"d{k:02}", " ".join(f"w{j}" for j in range(10 + k % 17)) + " " + chr(0x4E00 + k % 5) * 3) for k in range(60)] + [("x", ""), ("y", None)]
    docs = spark.createDataFrame(rows, "id string, text string")
    sets = {r["id"]: frozenset(r["g"] or []) for r in docs.select("id", tx.trigrams(F.col("text")).alias("g")).collect()}
    want = {a: (min([b for b in sets if x and sets[b] == x] or [a]), sum(a != b and bool(x & y) and len(x & y) / len(x | y) >= 0.8 for b, y in sets.items())) for a, x in sets.items()}
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in retrieval.alike(docs, 0.8).collect()}
    assert got == want and max(n for _, n in got.values()) > 10 and len({c for c, _ in got.values()}) > 20


def test_vectors_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    monkeypatch.setattr(retrieval, "STRIP", 3)
    rng = random.Random(5)
    rows = [(f"k{k:02}", [rng.gauss(0, 1) for _ in range(3 + (k % 11 == 0))], k % 2) for k in range(50)] + [("z", [0.0] * 3, 0), ("n", None, 0), ("m", [1.0, None, 2.0], 0), ("l", [1.0, 2.0, 3.0], None), ("k02", [1.0, 2.0, 2.0], 0), ("nan", [float("nan"), 1.0, 1.0], 1)]
    got = sorted((r["id_a"], r["id_b"], r["score"]) for r in retrieval.similar_vectors(spark.createDataFrame(rows, "id string, embedding array<double>, label int"), 0.4).collect())
    want, size = [], lambda v: math.sqrt(sum(x * x for x in v))
    for a, v, k in rows:
        for b, w, m in rows:
            if a < b and k == m and k is not None and v and w and len(v) == len(w) and None not in v + w and any(v) and any(w):
                s = sum(x * y for x, y in zip(v, w, strict=True)) / (size(v) * size(w))
                want += [(a, b, s)] if not s < 0.4 else []
    assert [x[:2] for x in got] == sorted(x[:2] for x in want) and len(want) > 100 and any("nan" in x for x in got)
    assert [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want)], nan_ok=True)
