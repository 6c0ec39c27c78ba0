import itertools
import random

from skein.llm import decontamination as op


def brute(docs, items):
    """Every alignment of every item to every document."""
    out = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for k, x in items:
            v = (x or "").lower().split()
            n = len(v)
            if n < 5:
                if n and w == v:
                    out[d, k] = (n, n)
                continue
            size = min(n, max(13, -(-n // 2)))
            for start in range(-n + 1, len(w)):
                m = [0 <= start + i < len(w) and w[start + i] == v[i] for i in range(n)]
                verbatim = "1" * min(n, 13) in "".join("01"[x] for x in m)
                if verbatim or any(sum(m[i : i + size]) * 5 >= size * 4 for i in range(n - size + 1)):
                    out[d, k] = max(out.get((d, k), (n, 0)), (n, sum(m)))
    return out


def run(spark, documents, docs, items):
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, seed int")
    rows = op.contaminated(documents(docs), bench).collect()
    assert len(rows) == len({(r["doc_id"], r["item_id"]) for r in rows})
    return {(r["doc_id"], r["item_id"]): (r["item_words"], r["equal_words"]) for r in rows}


def test_against_every_alignment(spark, documents, words):
    rng = random.Random(4)
    items = [(k, " ".join(words(n, 50 + k))) for k, n in enumerate((5, 6, 9, 13, 14, 20, 38, 60, 4))]
    docs = []
    for k in range(60):
        w, v = words(rng.randrange(120)), items[k % 9][1].split()
        for j in range(len(v)):
            if rng.random() < (0, 0.1, 0.2, 0.3)[k % 4]:
                v[j] = "zz"
        cut = v[: len(v) * 3 // 5] if k % 5 == 4 else v
        at = rng.randrange(len(w) + 1)
        docs.append((k, " \n".join(w[:at] + [x.upper() for x in cut] + w[at:])))
    docs += [(100, None), (101, ""), (102, "one two"), (103, " ".join(words(5000)) + " " + items[6][1])]
    got = run(spark, documents, docs, items)
    assert got == brute(docs, items)
    assert len(got) > 25 and (103, 6) in got


def test_verbatim_excerpts_of_long_items(spark, documents, words):
    items = [(k, " ".join(words(n, 70 + k))) for k, n in enumerate((38, 59, 1000))]
    docs = []
    for k, text in items:
        v = text.split()
        for n in (12, 13, 20, len(v) // 2 - 1):
            for at in (0, 5, len(v) - n):
                docs.append((len(docs), " ".join(words(30) + v[at : at + n] + words(30))))
    want = {(d, d // 12) for d in range(len(docs)) if d % 12 >= 3}
    found = run(spark, documents, docs, items)
    assert set(found) == want and found[3, 0][1] >= 13


def test_masks_lose_nothing():
    for n in range(5, 19):
        for gone in itertools.combinations(range(n), n // 5):
            seeds = sum(all(a + o not in gone for o in m) for m in op.MASKS for a in range(n - m[-1]))
            assert seeds >= op.LEAST_SEEDS.get(n, op.LONG_SEEDS)


def test_long_texts_in_runs(spark, documents, words, monkeypatch):
    items = [(k, " ".join(words(20, k))) for k in range(5)]
    docs = [(1, " ".join(" ".join(words(k)) + " " + items[k % 5][1] for k in range(40)))]
    want = brute(docs, items)
    monkeypatch.setattr(op, "RUN", 7)
    assert run(spark, documents, docs, items) == want and len(want) == 5


def test_blocks_of_seeds(spark, documents, words, monkeypatch):
    items = [(k, " ".join(words(20, k))) for k in range(12)]
    docs = [(k, " ".join(words(10)) + " " + items[k % 12][1]) for k in range(30)]
    want = brute(docs, items)
    monkeypatch.setattr(op, "SEEDS_AT_ONCE", 300)
    assert run(spark, documents, docs, items) == want and len(want) == 30


def test_empty_null_and_repeated(spark, documents, words):
    item = " ".join(words(15, 1))
    assert run(spark, documents, [], [(1, item)]) == {}
    assert run(spark, documents, [(1, item)], []) == {}
    assert run(spark, documents, [(1, item), (1, item), (None, item)], [(1, item), (1, item), (None, None)]) == {(1, 1): (15, 15), (None, 1): (15, 15)}


def test_short_items_count_where_they_are_the_whole_document(spark, documents):
    items = spark.createDataFrame([(1, "Two words"), (2, "one"), (3, " "), (4, None), (5, "a b c d")], "item_id long, text string")
    docs = documents([(1, "two  WORDS\n"), (2, "just two words"), (3, "one"), (4, ""), (5, None), (6, "a b c d"), (6, "a b c d")])
    got = sorted(tuple(r) for r in op.contaminated(docs, items).collect())
    assert got == [(1, 1, 2, 2), (3, 2, 1, 1), (6, 5, 4, 4)]


def test_short_items_among_others_against_brute(spark, documents, words):
    items = [(k, " ".join(words(n, 30 + k))) for k, n in enumerate((1, 2, 3, 4, 5, 8))]
    docs = [(k, (items[k % 6][1].upper() if k // 6 % 2 else items[k % 6][1] + " more") if k < 24 else " ".join(words(k % 7))) for k in range(60)]
    got = run(spark, documents, docs, items)
    assert got == brute(docs, items) and {k for _, k in got} == set(range(6))
