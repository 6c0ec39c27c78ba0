import numpy as np

from skein.llm import embedding_dedup


def brute(rows, cosine=0.98):
    """Links and components by comparing all pairs."""
    links, root = {k: 0 for k, _, _ in rows}, {k: k for k, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    good = [(k, np.array(v, np.float64), g) for k, v, g in rows if v is not None and g is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, (a, u, g) in enumerate(good):
        for b, v, h in good[i + 1 :]:
            if g == h and len(u) == len(v) and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (links[k], find(k), find(k) == k) for k in root}


def table(spark, rows):
    return spark.createDataFrame([(k, v, g, 1) for k, v, g in rows], "vec_id long, embedding array<float>, label int, rep int")


def got(spark, rows):
    out = embedding_dedup.near_duplicates(table(spark, rows)).collect()
    assert len(out) == len(rows)
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = []
    for k in range(900):
        c = centres[k % 12] + rng.normal(size=16) * (0.08 if k % 3 else 0.6)
        rows.append((k, [float(x) for x in np.float32(c)], int(k % 2)))
    rows += [(2000 + k, rows[5][1], 1) for k in range(40)]
    rows += [(3000 + k, [float(x) for x in np.float32(np.array(rows[7][1]) + rng.normal(size=16) * 0.01)], 1) for k in range(300)]
    want = brute(rows)
    assert got(spark, rows) == want
    assert sum(n for n, _, _ in want.values()) > 1000


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1),
        (2, v, None),
        (3, None, 1),
        (4, [0.0, 0.0, 0.0], 1),
        (5, [1.0, float("nan"), 3.0], 1),
        (6, [1.0, None, 3.0], 1),
        (7, [], 1),
        (8, [2.0, 4.0, 6.0], 1),
        (9, [1.0, 2.0], 1),
        (10, v, 1),
        (11, [float("inf"), 2.0, 3.0], 1),
        (12, [1e-30, 2e-30, 3e-30], 1),
    ]
    out = got(spark, rows)
    for k in (1, 8, 10, 12):
        assert out[k] == (3, 1, k == 1)
    for k in (2, 3, 4, 5, 6, 7, 9, 11):
        assert out[k] == (0, k, True)


def test_empty(spark):
    assert embedding_dedup.near_duplicates(table(spark, [(1, [1.0], 1)]).limit(0)).count() == 0


def test_leaves_cover_all_pairs():
    rng = np.random.default_rng(1)
    u = embedding_dedup._units(rng.normal(size=(333, 4)))
    pairs = [(int(x), int(y)) for i, j in embedding_dedup.ego_join(u, u[:, :2], u, u[:, :2], True, 0.9, float(np.sqrt(0.2)) + 1e-9) for x, y in zip(i, j, strict=True)]
    want = {(i, j) for i in range(333) for j in range(i + 1, 333) if u[i] @ u[j] >= 0.9}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_several_groups_of_several_blocks(spark):
    rng = np.random.default_rng(8)
    x = np.float32(rng.normal(size=(200, 5))[rng.integers(0, 200, 6000)] + rng.normal(size=(6000, 5)) * rng.choice([0.02, 0.3], (6000, 1)))
    out = got(spark, [(k, v, 7) for k, v in enumerate(x.astype(float).tolist())])
    u = embedding_dedup._units(x.astype(np.float64))
    near = u @ u.T >= 0.98
    root = np.arange(len(x))
    while True:
        low = np.array([root[n].min() for n in near])
        if (low == root).all():
            break
        root = low
    assert out == {k: (int(near[k].sum()) - 1, int(root[k]), bool(root[k] == k)) for k in range(len(x))}
